"""Closed-form projections: UTM (series to n^4), equal-area cylindrical, geocentric datum shift."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellsight.functions.geometry import WGS84_A, WGS84_E2, WGS84_F


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    f: float
    shift: tuple[float, float, float] = (0.0, 0.0, 0.0)  # metres to WGS84


# Ellipsoids, the Adindan shift for Ethiopia, UTM scale and false origin.
WGS84 = Ellipsoid(WGS84_A, WGS84_F)
ADINDAN = Ellipsoid(6378249.145, 1 / 293.465, (-165.0, -11.0, 206.0))
SCALE, FALSE_EAST = 0.9996, 500_000.0
CENTRAL_37N = 39.0
EQUAL_AREA_LATITUDE = 30.0


def _series(ell: Ellipsoid):
    n = ell.f / (2 - ell.f)
    radius = ell.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    beta = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    )
    delta = (
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    )
    return n, radius, alpha, beta, delta


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _with(values: dict[str, Column], then) -> Column:
    """Bind intermediate values once: without it the nested series repeat them thousands of times."""
    bound = F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), then)
    return F.get(bound, F.lit(0))


def utm_forward(lon: Column, lat: Column, central: float = CENTRAL_37N, ell: Ellipsoid = WGS84) -> Column:
    """Northern-hemisphere UTM easting/northing in metres."""
    n, radius, alpha, _, _ = _series(ell)
    k = 2 * math.sqrt(n) / (1 + n)

    def sums(c: Column) -> Column:
        xi, eta = c["xi"], c["eta"]
        east, north = eta, xi
        for j, a in enumerate(alpha, start=1):
            east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return _point(FALSE_EAST + SCALE * radius * east, SCALE * radius * north)

    def sphere(c: Column) -> Column:
        xi = F.atan2(c["t"], F.cos(c["d"]))
        return _with({"xi": xi, "eta": F.atanh(F.sin(c["d"]) / F.sqrt(1 + c["t"] * c["t"]))}, sums)

    def conformal(c: Column) -> Column:
        return _with({"t": F.sinh(F.atanh(c["s"]) - k * F.atanh(k * c["s"])), "d": c["d"]}, sphere)

    return _with({"s": F.sin(F.radians(lat)), "d": F.radians(lon - central)}, conformal)


def utm_inverse(x: Column, y: Column, central: float = CENTRAL_37N, ell: Ellipsoid = WGS84) -> Column:
    _, radius, _, beta, delta = _series(ell)

    def latitude(c: Column) -> Column:
        lat = c["chi"]
        for j, d in enumerate(delta, start=1):
            lat = lat + d * F.sin(2 * j * c["chi"])
        return _point(central + F.degrees(c["lam"]), F.degrees(lat))

    def angles(c: Column) -> Column:
        chi = F.asin(F.sin(c["xi"]) / F.cosh(c["eta"]))
        return _with({"chi": chi, "lam": F.atan2(F.sinh(c["eta"]), F.cos(c["xi"]))}, latitude)

    def series(c: Column) -> Column:
        xi, eta = c["xi"], c["eta"]
        for j, b in enumerate(beta, start=1):
            xi = xi - b * F.sin(2 * j * c["xi"]) * F.cosh(2 * j * c["eta"])
            eta = eta - b * F.cos(2 * j * c["xi"]) * F.sinh(2 * j * c["eta"])
        return _with({"xi": xi, "eta": eta}, angles)

    return _with({"xi": y / (SCALE * radius), "eta": (x - FALSE_EAST) / (SCALE * radius)}, series)


def unfolded(lat: Column, known: Column) -> Column:
    """A latitude that an inverse gave, back on the turn of the latitude it came from.

    Projections see the sine of a latitude: beyond a pole (known outside -90 to 90) the inverse gives its mirror image.
    """
    turns = F.round(known / 180)
    return 180 * turns + F.when(turns % 2 == 0, lat).otherwise(-lat)


_E = math.sqrt(WGS84_E2)
_K0 = math.cos(math.radians(EQUAL_AREA_LATITUDE)) / math.sqrt(1 - WGS84_E2 * math.sin(math.radians(EQUAL_AREA_LATITUDE)) ** 2)
_QP = (1 - WGS84_E2) * (1 / (1 - WGS84_E2) - math.log((1 - _E) / (1 + _E)) / (2 * _E))


def equal_area_forward(lon: Column, lat: Column) -> Column:
    """Cylindrical equal-area with true scale at 30 degrees."""
    s = F.sin(F.radians(lat))
    q = (1 - WGS84_E2) * (s / (1 - WGS84_E2 * s * s) - F.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))
    return _point(F.radians(lon) * (WGS84_A * _K0), q * (WGS84_A / (2 * _K0)))


def equal_area_inverse(x: Column, y: Column) -> Column:
    b = F.asin(y * (2 * _K0 / (WGS84_A * _QP)))
    e2, e4, e6 = WGS84_E2, WGS84_E2**2, WGS84_E2**3
    lat = (
        b
        + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * b)
        + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * b)
        + (761 * e6 / 45360) * F.sin(6 * b)
    )
    return _point(F.degrees(x / (WGS84_A * _K0)), F.degrees(lat))


def datum_to_wgs84(lon: Column, lat: Column, ell: Ellipsoid = ADINDAN) -> Column:
    """Three-parameter geocentric shift; metre-level like the published parameters."""
    e2 = ell.f * (2 - ell.f)
    b = WGS84_A * (1 - WGS84_F)
    ep2 = WGS84_E2 / (1 - WGS84_E2)

    def back(c: Column) -> Column:
        theta = F.atan2(c["z"] * WGS84_A, c["p"] * b)
        out = F.atan2(c["z"] + ep2 * b * F.pow(F.sin(theta), 3), c["p"] - WGS84_E2 * WGS84_A * F.pow(F.cos(theta), 3))
        return _point(F.degrees(F.atan2(c["y"], c["x"])), F.degrees(out))

    def planar(c: Column) -> Column:
        return _with({"x": c["x"], "y": c["y"], "z": c["z"], "p": F.sqrt(c["x"] * c["x"] + c["y"] * c["y"])}, back)

    def geocentric(c: Column) -> Column:
        nu = ell.a / F.sqrt(1 - e2 * F.pow(F.sin(c["phi"]), 2))
        x = nu * F.cos(c["phi"]) * F.cos(c["lam"]) + ell.shift[0]
        y = nu * F.cos(c["phi"]) * F.sin(c["lam"]) + ell.shift[1]
        return _with({"x": x, "y": y, "z": nu * (1 - e2) * F.sin(c["phi"]) + ell.shift[2]}, planar)

    return _with({"phi": F.radians(lat), "lam": F.radians(lon)}, geocentric)


def to_lonlat(x: Column, y: Column, crs: int) -> Column:
    """Point in 4326, 32637, 6933 or 20137 to lon/lat on WGS84."""
    if crs == 4326:
        return _point(x, y)
    if crs == 32637:
        return utm_inverse(x, y)
    if crs == 6933:
        return equal_area_inverse(x, y)
    if crs == 20137:
        return _with({"g": utm_inverse(x, y, ell=ADINDAN)}, lambda c: datum_to_wgs84(c["g"]["x"], c["g"]["y"]))
    raise ValueError(f"no transformation from EPSG:{crs}")


def rings_to(rings: Column, transform) -> Column:
    """Apply ``transform(x, y) -> struct(x, y)`` to every point."""
    return F.transform(rings, lambda r: F.transform(r, lambda p: transform(p["x"], p["y"])))
