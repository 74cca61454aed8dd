"""Geometry as ``rings ARRAY<ARRAY<STRUCT<x, y>>>``: measures and canonical forms as Columns.

A polygon's rings are closed; holes and further parts are simply further rings, because every
inside test here is an even-odd test: a ring inside an odd number of the others bounds a hole,
any other ring bounds a part. Lines use the same type with one open ring per part, points a
one-point ring.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 and the sphere used for lon/lat lengths.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
WGS84_E2 = WGS84_F * (2 - WGS84_F)
SPHERE_R = 6371008.8


def ring_from_xy(*points: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def _points(rings: Column) -> Column:
    return F.flatten(rings)


def envelope(rings: Column) -> Column:
    """struct(xmin, ymin, xmax, ymax); NULL fields for an empty geometry."""
    xs = F.transform(_points(rings), lambda p: p["x"])
    ys = F.transform(_points(rings), lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax")
    )


def envelope_centre(box: Column) -> Column:
    return F.struct(((box["xmin"] + box["xmax"]) / 2).alias("x"), ((box["ymin"] + box["ymax"]) / 2).alias("y"))


def _steps(ring: Column) -> Column:
    """Consecutive point pairs of a ring."""
    count = F.size(ring) - 1
    return F.when(count < 1, F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>")).otherwise(
        F.zip_with(F.slice(ring, 1, F.greatest(count, F.lit(0))), F.slice(ring, 2, F.greatest(count, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    )


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def ring_area(ring: Column) -> Column:
    """Signed shoelace area of a closed ring, in squared map units."""
    return _total(F.transform(_steps(ring), lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])) / 2


def _once(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, not per element of inner functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _holds(ring: Column, p: Column) -> Column:
    """Even-odd test of a point against one ring."""
    over = lambda s: (s["a"]["y"] > p["y"]) != (s["b"]["y"] > p["y"])
    right = lambda s: p["x"] < s["a"]["x"] + (p["y"] - s["a"]["y"]) * (s["b"]["x"] - s["a"]["x"]) / (s["b"]["y"] - s["a"]["y"])
    return F.size(F.filter(_steps(ring), lambda s: F.when(over(s), right(s)).otherwise(False))) % 2 == 1


def _probe(ring: Column) -> Column:
    """The middle of a ring's first edge: rings of one geometry touch in single points at most."""
    a, b = F.get(ring, F.lit(0)), F.get(ring, F.lit(1))
    return F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))


def ring_depths(rings: Column) -> Column:
    """For each ring, how many other rings hold it: even for parts, odd for holes."""
    return _once(rings, lambda all_: F.transform(all_, lambda ring, i: F.size(F.filter(all_, lambda other, j: (i != j) & _holds(other, _probe(ring))))))


def planar_area(rings: Column) -> Column:
    """Area of all parts without their holes."""
    sign = lambda depth: F.when(depth % 2 == 0, 1.0).otherwise(-1.0)
    own = _once(rings, lambda all_: _total(F.zip_with(all_, ring_depths(all_), lambda r, d: F.abs(ring_area(r)) * sign(d))))
    return F.when(F.size(rings) > 0, own).otherwise(0.0)


def polygon_parts(rings: Column) -> Column:
    """Rings by part: each outer ring followed by its own holes."""
    def of(all_):
        ringed = F.zip_with(all_, ring_depths(all_), lambda r, d: F.struct(r.alias("r"), d.alias("d")))
        own = lambda outer, z: F.filter(z, lambda h: (h["d"] == outer["d"] + 1) & _holds(outer["r"], _probe(h["r"])))
        return _once(ringed, lambda z: F.transform(F.filter(z, lambda o: o["d"] % 2 == 0), lambda o: F.concat(F.array(o["r"]), F.transform(own(o, z), lambda h: h["r"]))))

    return _once(rings, of)


def planar_length(rings: Column) -> Column:
    side = lambda s: F.sqrt(F.pow(s["b"]["x"] - s["a"]["x"], 2) + F.pow(s["b"]["y"] - s["a"]["y"], 2))
    return _total(F.transform(rings, lambda r: _total(F.transform(_steps(r), side))))


def _authalic_q(sin_lat: Column) -> Column:
    e = WGS84_E2**0.5
    return (1 - WGS84_E2) * (sin_lat / (1 - WGS84_E2 * sin_lat * sin_lat) - F.log((1 - e * sin_lat) / (1 + e * sin_lat)) / (2 * e))


def geodesic_area_km2(rings: Column) -> Column:
    """Area of a lon/lat polygon on the ellipsoid, by the shoelace sum on the equal-area plane.

    Straight edges in that plane stand in for geodesics; for area polygons of a few
    kilometres the difference is far below a thousandth.
    """
    def equal_area(p: Column) -> Column:
        lat = F.radians(p["y"])
        return F.struct((F.radians(p["x"]) * WGS84_A).alias("x"), (_authalic_q(F.sin(lat)) * WGS84_A / 2).alias("y"))

    return planar_area(F.transform(rings, lambda r: F.transform(r, equal_area))) / 1e6


def haversine_m(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dlat, dlon = F.radians(y2 - y1), F.radians(x2 - x1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * SPHERE_R * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def geodesic_length_m(rings: Column) -> Column:
    side = lambda s: haversine_m(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])
    return _total(F.transform(rings, lambda r: _total(F.transform(_steps(r), side))))


def pixel_hectares(latitude: Column, width_deg: float, height_deg: float) -> Column:
    """Size of a lon/lat pixel at its own latitude."""
    return F.greatest(F.lit(0.01), F.abs(F.cos(F.radians(latitude)))) * (111_320 * width_deg * 110_574 * height_deg / 10_000)


def display_copy(rings: Column, places: int = 5) -> Column:
    rounded = lambda p: F.struct(F.bround(p["x"], places).alias("x"), F.bround(p["y"], places).alias("y"))
    return F.transform(rings, lambda r: F.transform(r, rounded))


def fingerprint(rings: Column) -> Column:
    return F.md5(F.to_json(rings))


def ring_vertices(ring: Column) -> Column:
    """Vertices without the repeated closing point."""
    closed = (F.size(ring) > 1) & (F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1))
    return F.size(ring) - F.when(closed, 1).otherwise(0)


def vertex_count(rings: Column) -> Column:
    """Sum over rings; NULL when a ring has fewer than three vertices (degenerate)."""
    counts = F.transform(rings, ring_vertices)
    return F.when((F.size(rings) > 0) & (F.array_min(counts) >= 3), F.aggregate(counts, F.lit(0), lambda a, n: a + n))


def _coordinates(rings: Column) -> Column:
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))


def geojson_polygon(parts: Column) -> Column:
    """GeoJSON geometry struct of the only part of a polygon."""
    return F.struct(F.lit("Polygon").alias("type"), _coordinates(F.get(parts, F.lit(0))).alias("coordinates"))


def geojson_multipolygon(parts: Column) -> Column:
    """GeoJSON geometry struct of a polygon with several parts."""
    return F.struct(F.lit("MultiPolygon").alias("type"), F.transform(parts, _coordinates).alias("coordinates"))
