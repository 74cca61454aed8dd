"""Vector operators: extents, interior points, crossings, validity, shares, display geometry."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellsight.functions import geometry as G
from cellsight.operators.ranking import exact_quantiles
from cellsight.operators.zonal import edges, line_segments
from cellsight.session import cut

MARGIN = 1e-9
LEAF_PAIRS, DEPTH = 65_536, 20


def extent(features: DataFrame, pad: float = 0.0, keys: Sequence[str] = (), rings: str = "rings") -> DataFrame:
    """Padded extent over all features, or per group; partial aggregation, four numbers travel."""
    boxed = features.select(*keys, G.envelope(F.col(rings)).alias("b"))
    sides = [
        (F.min("b.xmin") - pad).alias("xmin"),
        (F.min("b.ymin") - pad).alias("ymin"),
        (F.max("b.xmax") + pad).alias("xmax"),
        (F.max("b.ymax") + pad).alias("ymax"),
    ]
    return boxed.groupBy(*keys).agg(*sides) if keys else boxed.agg(*sides)


def interior_point(features: DataFrame, ident: str = "area_id", rings: str = "rings") -> DataFrame:
    """A point that lies inside: middle of the widest inside stretch of the middle line.

    The line is moved off vertices to the middle between the box centre and the nearest vertex
    height above it, so crossings are proper.
    """
    box = features.select(ident, rings, G.envelope(F.col(rings)).alias("b"))
    centre = (F.col("b.ymin") + F.col("b.ymax")) / 2
    above = F.array_min(F.filter(F.transform(F.flatten(rings), lambda p: p["y"]), lambda y: y > centre))
    lined = box.select(ident, ((centre + F.coalesce(above, F.col("b.ymax"))) / 2).alias("y0"))
    edge = edges(features, ident, rings).join(lined, ident)
    hit = edge.where((F.least("y1", "y2") <= F.col("y0")) & (F.col("y0") < F.greatest("y1", "y2")))
    x = F.col("x1") + (F.col("y0") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    scan = W.partitionBy(ident).orderBy("x")
    paired = hit.select(ident, "y0", x.alias("x")).select(ident, "y0", "x", F.lead("x").over(scan).alias("x2"), F.row_number().over(scan).alias("k"))
    inside = paired.where((F.col("k") % 2 == 1) & F.col("x2").isNotNull())
    widest = F.max_by(F.struct(((F.col("x") + F.col("x2")) / 2).alias("x"), F.col("y0").alias("y")), F.struct(F.col("x2") - F.col("x"), -F.col("x")))
    return inside.groupBy(ident).agg(widest.alias("p")).select(ident, F.col("p.x").alias("px"), F.col("p.y").alias("py"))


def bucket_segments(segments: DataFrame, size: float) -> DataFrame:
    """Segments with every square bucket (bx, by) they pass through.

    Row by row along the segment, so a long diagonal meets the buckets on its way and not the
    whole of its box. Every range is widened by a rounding margin, so that two segments that
    touch on a border share a bucket whichever way their places were computed; a pair can
    therefore meet in two buckets.
    """
    u1, v1, u2, v2 = (F.col(c) / size for c in ("x1", "y1", "x2", "y2"))
    span = lambda a, b: F.explode(F.sequence(F.floor(a - (F.abs(a) + 1) * MARGIN), F.floor(b + (F.abs(b) + 1) * MARGIN)))
    low, high = F.least(v1, v2), F.greatest(v1, v2)
    rows = segments.select("*", span(low, high).alias("by"))
    left, right = F.least(u1, u2), F.greatest(u1, u2)
    at = lambda v: F.greatest(left, F.least(right, u1 + (v - v1) * (u2 - u1) / (v2 - v1)))
    ua = F.when(v1 == v2, u1).otherwise(at(F.greatest(low, F.col("by").cast("double"))))
    ub = F.when(v1 == v2, u2).otherwise(at(F.least(high, F.col("by") + F.lit(1.0))))
    return rows.withColumn("bx", span(F.least(ua, ub), F.greatest(ua, ub)))


def paired_buckets(left: DataFrame, right: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """Both segment sets in common buckets (bx, by).

    Two segments that meet share the bucket of their meeting point. The bucket size is the caller's and the same
    everywhere; a crowded bucket is a skewed join key, which adaptive execution splits by rows of either side.
    """
    return bucket_segments(left, size), bucket_segments(right, size)


def _same_bucket(a: str, b: str) -> Column:
    return (F.col(f"{a}.bx") == F.col(f"{b}.bx")) & (F.col(f"{a}.by") == F.col(f"{b}.by"))


def _side(ax, ay, bx, by, px, py) -> Column:
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def segments_meet(a: str, b: str, proper: bool = False) -> Column:
    """Do segments ``a.*`` and ``b.*`` (x1, y1, x2, y2) meet? ``proper`` leaves out mere touching."""
    p = [F.col(f"{a}.{c}") for c in ("x1", "y1", "x2", "y2")]
    q = [F.col(f"{b}.{c}") for c in ("x1", "y1", "x2", "y2")]
    d1, d2 = _side(*p, q[0], q[1]), _side(*p, q[2], q[3])
    d3, d4 = _side(*q, p[0], p[1]), _side(*q, p[2], p[3])
    crossing = (d1 * d2 < 0) & (d3 * d4 < 0)
    if proper:
        return crossing
    box = (
        (F.least(p[0], p[2]) <= F.greatest(q[0], q[2]))
        & (F.least(q[0], q[2]) <= F.greatest(p[0], p[2]))
        & (F.least(p[1], p[3]) <= F.greatest(q[1], q[3]))
        & (F.least(q[1], q[3]) <= F.greatest(p[1], p[3]))
    )
    return (d1 * d2 <= 0) & (d3 * d4 <= 0) & box


def points_in_areas(points: DataFrame, areas: DataFrame, size: float, point: str, area: str, rings: str = "rings", x: str = "px", y: str = "py") -> DataFrame:
    """(point, area) pairs by the even-odd rule for free points.

    Every area is cut into horizontal bands of ``size``: a band holds the edges that reach into
    it, already clipped to the area. A point meets only the edges of its own band of the areas
    whose column range covers it, and counts the crossings to its right.
    """
    edge = edges(areas, area, rings).where("y1 <> y2")
    banded = edge.select("*", F.explode(F.sequence(F.floor(F.least("y1", "y2") / size), F.floor(F.greatest("y1", "y2") / size))).alias("band"))
    reach = banded.groupBy(area, "band").agg(F.min(F.least("x1", "x2")).alias("lo"), F.max(F.greatest("x1", "x2")).alias("hi"))
    columns = reach.withColumn("stripe", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))))
    placed = points.select(point, F.col(x).alias("_x"), F.col(y).alias("_y")).withColumn("band", F.floor(F.col("_y") / size)).withColumn("stripe", F.floor(F.col("_x") / size))
    candidate = placed.join(columns, ["band", "stripe"]).where("_x >= lo AND _x < hi").drop("lo", "hi", "stripe")
    crossed = candidate.join(banded, [area, "band"]).where((F.least("y1", "y2") <= F.col("_y")) & (F.col("_y") < F.greatest("y1", "y2")))
    cross_x = F.col("x1") + (F.col("_y") - F.col("y1")) * ((F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    odd = crossed.groupBy(point, area).agg(F.count_if(cross_x > F.col("_x")).alias("n")).where("n % 2 = 1")
    return odd.select(point, area)


def parts_inside(features: DataFrame, areas: DataFrame, size: float, ident: str, area: str, rings: str = "rings") -> DataFrame:
    """Distinct (id, area) pairs where the first vertex of some ring of the feature lies inside the area."""
    ring = features.select(F.col(ident).alias("_id"), F.posexplode(rings).alias("_part", "_ring"))
    first = ring.select(F.struct("_id", "_part").alias("_vertex"), F.get("_ring", F.lit(0)).alias("p")).select("_vertex", F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    return points_in_areas(first, areas, size, "_vertex", area, rings).select(F.col("_vertex._id").alias(ident), area).distinct()


def _reference_point(a: str, b: str) -> tuple[Column, Column]:
    """One point that two meeting segments share: where they cross, or the least end of one that lies on the other."""
    p = [F.col(f"{a}.{c}") for c in ("x1", "y1", "x2", "y2")]
    q = [F.col(f"{b}.{c}") for c in ("x1", "y1", "x2", "y2")]
    dx, dy, ex, ey = p[2] - p[0], p[3] - p[1], q[2] - q[0], q[3] - q[1]
    det = dx * ey - dy * ex
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((q[0] - p[0]) * ey - (q[1] - p[1]) * ex) / det))
    low = lambda s: F.least(F.struct(s[0].alias("x"), s[1].alias("y")), F.struct(s[2].alias("x"), s[3].alias("y")))
    shared = F.greatest(low(p), low(q))
    return F.when(det != 0, p[0] + t * dx).otherwise(shared["x"]), F.when(det != 0, p[1] + t * dy).otherwise(shared["y"])


def _quarters(rows: DataFrame, size: float) -> DataFrame:
    """Rows of a cell (bx, by) with each of its four quarters, of side ``size``, that their segment reaches (widened by the rounding margin)."""
    x, y = F.col("q") % 2, F.floor(F.col("q") / 2)
    spread = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumns({"bx": 2 * F.col("bx") + x, "by": 2 * F.col("by") + y}).drop("q")
    u1, v1, u2, v2 = (F.col(c) / size for c in ("x1", "y1", "x2", "y2"))
    cx, cy = F.col("bx") + 0.5, F.col("by") + 0.5
    half = 0.5 + 4 * MARGIN * (F.greatest(F.abs(F.col("bx")), F.abs(F.col("by"))) + 2)
    over = lambda a, b, c: (F.least(a, b) <= c + half) & (F.greatest(a, b) >= c - half)
    aside = F.abs((u2 - u1) * (cy - v1) - (v2 - v1) * (cx - u1))
    return spread.where(over(u1, u2, cx) & over(v1, v2, cy) & (aside <= half * (F.abs(u2 - u1) + F.abs(v2 - v1))))


def quadtree_leaves(left: DataFrame, right: DataFrame, size: float, limit: int = LEAF_PAIRS, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Both segment tables in the leaves (level, bx, by) of one quadtree that follows their density.

    It starts from squares of ``size``. A square that one side doesn't reach is dropped; one whose counts allow more than ``limit`` pairs is quartered,
    until none does or ``depth`` is reached (segments that all pass through one point can't be parted). One count decides every
    level, and only rows of quartered squares are placed again.
    """
    cells = lambda df: df.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n"))
    sides = [bucket_segments(df, size) for df in (left, right)]
    leaves = []
    for level in range(depth + 1):
        n = cells(sides[0]).withColumnRenamed("n", "n_left").join(cells(sides[1]).withColumnRenamed("n", "n_right"), ["bx", "by"])
        n = cut(n.select("bx", "by", (F.col("n_left") * F.col("n_right") > (limit if level < depth else 1 << 62)).alias("full")))
        placed = [df.join(n, ["bx", "by"]).withColumn("level", F.lit(level)) for df in sides]
        leaves.append([df.where("NOT full").drop("full") for df in placed])
        if n.where("full").isEmpty():
            break
        sides = [cut(_quarters(df.where("full").drop("full", "level"), size / 2 ** (level + 1))) for df in placed]
    return tuple(reduce(DataFrame.unionByName, side) for side in zip(*leaves))


def meeting_segments(left: DataFrame, right: DataFrame, size: float, limit: int = LEAF_PAIRS) -> DataFrame:
    """Pairs ``a.*``, ``b.*`` of segments that meet, each once: in the leaf that holds the pair's reference point."""
    a, b = quadtree_leaves(left, right, size, limit)
    here = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("level", "bx", "by")]
    side = F.lit(size) / F.pow(F.lit(2.0), F.col("a.level"))
    x, y = _reference_point("a", "b")
    own = (F.floor(x / side) == F.col("a.bx")) & (F.floor(y / side) == F.col("a.by"))
    return a.alias("a").join(b.alias("b"), here[0] & here[1] & here[2]).where(segments_meet("a", "b") & own)


def intersecting(areas: DataFrame, lines: DataFrame, size: float, area: str = "area_id", line: str = "line_id", rings: str = "rings") -> DataFrame:
    """Distinct (area, line) pairs that intersect: a segment meets an edge, or a vertex of any part of the line lies inside.

    Pairs of segments come out once; what is left to make distinct is a pair that meets in several segments.
    """
    meets = meeting_segments(edges(areas, area, rings), line_segments(lines, line, rings), size)
    inside = parts_inside(lines, areas, size, line, area, rings)
    return meets.select(f"a.{area}", f"b.{line}").unionByName(inside.select(area, line)).distinct()


def polygons_overlap(left: DataFrame, right: DataFrame, size: float, left_id: str, right_id: str) -> DataFrame:
    """Distinct pairs of polygons that intersect: borders meet, or one holds a vertex of any ring of the other."""
    found = meeting_segments(edges(left, left_id), edges(right, right_id), size).select(f"a.{left_id}", f"b.{right_id}")
    found = found.unionByName(parts_inside(left, right, size, left_id, right_id))
    return found.unionByName(parts_inside(right, left, size, right_id, left_id).select(left_id, right_id)).distinct()


def _solid_edges(features: DataFrame, ident: str, rings: str) -> DataFrame:
    """Edges with a length and finite ends, numbered anew within their ring: ``_k`` of ``_of``."""
    ends = ["x1", "y1", "x2", "y2"]
    finite = F.forall(F.array(*ends), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    solid = edges(features, ident, rings).where(finite).where("x1 <> x2 OR y1 <> y2")
    ring = W.partitionBy(ident, "ring")
    return solid.withColumns({"_k": F.row_number().over(ring.orderBy("seq")), "_of": F.count(F.lit(1)).over(ring)})


def ring_problems(features: DataFrame, size: float, ident: str = "area_id", rings: str = "rings") -> DataFrame:
    """Per feature: empty, coordinates that are no finite numbers, degenerate ring, open ring, places of faults, and validity.

    The borders of a feature form an arrangement, looked at only inside common buckets, never over all edge pairs. ``crossing`` is the
    least place where edges cross or share a stretch: crossed rings, spikes, a border that runs back along itself, doubled rings.
    ``touching`` is the least place where edges of one ring meet that are no neighbours in it. Rings of a feature may touch each other;
    rings that pass through each other only at vertices of both are not told from such. Repeated points in a row are no fault.
    """
    r = F.col(rings)
    n = F.coalesce(F.size(F.flatten(r)), F.lit(-1))
    off = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    shape = features.select(
        ident,
        (r.isNull() | (n <= 0)).alias("is_empty"),
        F.exists(r, lambda ring: F.exists(ring, lambda p: off(p["x"]) | off(p["y"]))).alias("not_finite"),
        F.exists(r, lambda ring: G.ring_vertices(ring) < 3).alias("degenerate"),
        F.exists(r, lambda ring: F.get(ring, F.lit(0)) != F.get(ring, F.size(ring) - 1)).alias("open_ring"),
    )
    seg = bucket_segments(_solid_edges(features, ident, rings), size)
    a, b = seg.alias("a"), seg.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (ident, "bx", "by")]
    order = F.struct("a.ring", "a._k") < F.struct("b.ring", "b._k")
    met = a.join(b, same[0] & same[1] & same[2] & order).where(segments_meet("a", "b"))
    p, q = ([F.col(f"{s}.{c}") for c in ("x1", "y1", "x2", "y2")] for s in "ab")
    ends = lambda s: [F.struct(s[i].alias("x"), s[i + 1].alias("y")) for i in (0, 2)]
    level = (_side(*p, q[0], q[1]) == 0) & (_side(*p, q[2], q[3]) == 0)
    stretch = level & (F.greatest(F.least(*ends(p)), F.least(*ends(q))) < F.least(F.greatest(*ends(p)), F.greatest(*ends(q))))
    neighbours = (F.col("b._k") - F.col("a._k") == 1) | ((F.col("a._k") == 1) & (F.col("b._k") == F.col("a._of")))
    touch = (F.col("a.ring") == F.col("b.ring")) & ~neighbours
    x, y = _reference_point("a", "b")
    place = F.struct(x.alias("x"), y.alias("y"))
    faults = met.select(F.col(f"a.{ident}").alias(ident), F.when(segments_meet("a", "b", proper=True) | stretch, place).alias("c"), F.when(touch, place).alias("t"))
    first = faults.groupBy(ident).agg(F.min("c").alias("crossing"), F.min("t").alias("touching"))
    out = shape.join(first, ident, "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    sound = ~flag("is_empty") & ~flag("not_finite") & ~flag("degenerate") & ~flag("open_ring")
    return out.withColumn("is_valid", sound & F.col("crossing").isNull() & F.col("touching").isNull())


def invalid_reason() -> Column:
    at = lambda what, c: F.concat(F.lit(f"{what}["), F.col(f"{c}.x").cast("string"), F.lit(" "), F.col(f"{c}.y").cast("string"), F.lit("]"))
    return (
        F.when(F.col("is_empty"), "Empty geometry")
        .when(F.col("not_finite"), "Invalid Coordinate")
        .when(F.col("degenerate"), "Too few points in geometry component")
        .when(F.col("open_ring"), "Ring is not closed")
        .when(F.col("crossing").isNotNull(), at("Self-intersection", "crossing"))
        .when(F.col("touching").isNotNull(), at("Ring Self-intersection", "touching"))
    )


def split_at_crossings(segments: DataFrame, cutters: DataFrame, size: float, ident: str) -> DataFrame:
    """Segments cut where a cutter edge crosses them: (id, ring, seq, x1, y1, x2, y2) pieces."""
    a, b = paired_buckets(segments, cutters.select("x1", "y1", "x2", "y2"), size)
    hit = a.alias("a").join(b.alias("b"), _same_bucket("a", "b")).where(segments_meet("a", "b"))
    dx, dy = F.col("a.x2") - F.col("a.x1"), F.col("a.y2") - F.col("a.y1")
    ex, ey = F.col("b.x2") - F.col("b.x1"), F.col("b.y2") - F.col("b.y1")
    det = dx * ey - dy * ex
    at = ((F.col("b.x1") - F.col("a.x1")) * ey - (F.col("b.y1") - F.col("a.y1")) * ex) / det
    along = lambda x, y: ((x - F.col("a.x1")) * dx + (y - F.col("a.y1")) * dy) / (dx * dx + dy * dy)
    both = F.array(along(F.col("b.x1"), F.col("b.y1")), along(F.col("b.x2"), F.col("b.y2")))
    ts = F.when(det != 0, F.array(at)).otherwise(both)
    key = [ident, "ring", "seq"]
    cuts = hit.select(*[F.col(f"a.{k}").alias(k) for k in key], F.explode(ts).alias("t")).where("t > 0 AND t < 1").distinct()
    ends = segments.select(*key, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"))
    scan = W.partitionBy(*key).orderBy("t")
    pieces = cuts.unionByName(ends).select(*key, "t", F.lead("t").over(scan).alias("t2")).where("t2 IS NOT NULL")
    joined = pieces.join(segments, key)
    place = lambda t, p, q: F.col(p) + F.col(t) * (F.col(q) - F.col(p))
    return joined.select(
        *key,
        "t",
        place("t", "x1", "x2").alias("x1"),
        place("t", "y1", "y2").alias("y1"),
        place("t2", "x1", "x2").alias("x2"),
        place("t2", "y1", "y2").alias("y2"),
    )


def _middles(pieces: DataFrame, ident: str) -> DataFrame:
    tag = F.concat_ws("|", *[F.col(c).cast("string") for c in (ident, "ring", "seq", "t")])
    return pieces.withColumn("piece", tag).withColumn("px", (F.col("x1") + F.col("x2")) / 2).withColumn("py", (F.col("y1") + F.col("y2")) / 2)


def clip_lines(lines: DataFrame, region: DataFrame, size: float, ident: str = "line_id", region_id: str = "region_id") -> DataFrame:
    """Pieces of lines that lie inside the region; no other part is altered or dropped."""
    pieces = split_at_crossings(line_segments(lines, ident), edges(region, region_id), size, ident)
    placed = _middles(pieces, ident)
    keep = points_in_areas(placed, region, size, "piece", region_id)
    return placed.join(keep.select("piece").distinct(), "piece", "left_semi").select(ident, "ring", "seq", "t", "x1", "y1", "x2", "y2")


def clip_points(points: DataFrame, region: DataFrame, size: float, ident: str = "point_id", region_id: str = "region_id") -> DataFrame:
    keep = points_in_areas(points, region, size, ident, region_id)
    return points.join(keep.select(ident).distinct(), ident, "left_semi")


def length_inside(lines: DataFrame, region: DataFrame, size: float, ident: str = "line_id", region_id: str = "region_id") -> DataFrame:
    """Length of each line inside the region."""
    kept = clip_lines(lines, region, size, ident, region_id)
    side = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    return kept.groupBy(ident).agg(F.sum(side).alias("inside"))


def _oriented(features: DataFrame, rings: str = "rings") -> DataFrame:
    """Outer rings counter-clockwise, holes clockwise."""
    turned = F.zip_with(rings, G.ring_depths(F.col(rings)), lambda ring, d: F.when((G.ring_area(ring) > 0) == (d % 2 == 0), ring).otherwise(F.reverse(ring)))
    return features.withColumn(rings, turned)


def _keyed(pieces: DataFrame, *names: str, back: bool = False) -> DataFrame:
    """Ends of the pieces, rounded, as ``k0..k3`` (from the far end with ``back``), with the named columns."""
    ends = ("x2", "y2", "x1", "y1") if back else ("x1", "y1", "x2", "y2")
    return pieces.select(*names, *[(F.round(F.col(c), 9) + F.lit(0.0)).alias(f"k{i}") for i, c in enumerate(ends)])


def _held_by(pieces: DataFrame, border: DataFrame, polygons: DataFrame, size: float, ident: str) -> DataFrame:
    """(piece, polygon id) where the middle of the piece lies inside the polygon and the piece is no part of its ``border`` pieces, either way round."""
    keys = ["k0", "k1", "k2", "k3"]
    either = _keyed(border, F.col(ident).alias("_on")).unionByName(_keyed(border, F.col(ident).alias("_on"), back=True)).distinct()
    on = _keyed(pieces, "piece").join(either, keys).select("piece", F.col("_on").alias(ident)).distinct()
    return points_in_areas(pieces, polygons, size, "piece", ident).join(on, ["piece", ident], "left_anti")


def area_inside(features: DataFrame, region: DataFrame, size: float, ident: str = "area_id", region_id: str = "region_id") -> DataFrame:
    """Area of each polygon inside the region, by Green's theorem over cut borders; polygons of the region may overlap and count once.

    All borders are cut where they meet. What a cut piece bounds follows from the depth of the region on either side: polygons that hold
    the piece, and polygons whose own border runs along it (their inside lies on its left). A region piece bounds the union if nothing of the region lies
    on its right. The border of the intersection consists of such pieces inside the feature, and of feature pieces with some
    of the region on their left. No overlay polygon is built.
    """
    features, region = _oriented(features), _oriented(region)
    fe, re = edges(features, ident), edges(region, region_id)
    term = (F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2
    keys = ["k0", "k1", "k2", "k3"]
    # the features are cut at the pieces of the region, so shared border pieces have equal ends
    # both piece tables feed several branches: checkpointed, they are computed once
    cutters = fe.select("x1", "y1", "x2", "y2").unionByName(re.select("x1", "y1", "x2", "y2"))
    rp = cut(_middles(split_at_crossings(re, cutters, size, region_id), region_id))
    own = cut(_middles(split_at_crossings(fe, rp, size, ident), ident))

    right = _keyed(rp, F.col(region_id).alias("_right"), back=True)  # polygons whose inside lies on the right of a piece
    faced = _keyed(rp, "piece").join(right, keys).select("piece")
    covered = faced.unionByName(_held_by(rp, rp, region, size, region_id).select("piece")).distinct()
    union = rp.join(covered, "piece", "left_anti")
    union = _keyed(union, "piece", "x1", "y1", "x2", "y2", "px", "py").dropDuplicates(keys)  # polygons that share a piece of border

    left = _keyed(own, "piece").join(_keyed(rp).distinct(), keys).select("piece")
    held = _held_by(own, rp, region, size, region_id).select("piece")
    kept = own.join(left.unionByName(held).distinct(), "piece", "left_semi").select(ident, term.alias("part"))

    shared = _keyed(own, ident).unionByName(_keyed(own, ident, back=True)).distinct()
    holders = points_in_areas(union, features, size, "piece", ident)
    foreign = union.join(holders, "piece").join(shared, [ident, *keys], "left_anti").select(ident, term.alias("part"))
    return kept.unionByName(foreign).groupBy(ident).agg(F.sum("part").alias("inside"))


def classify_layers(shares: DataFrame, overrides: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Forced class first, then the share inside the region; an unknown share is national."""
    joined = shares.join(overrides, "layer", "left")
    by_share = F.when(F.col("inside") / F.nullif(F.col("total"), F.lit(0.0)) >= threshold, "regional").otherwise("national")
    return joined.withColumn("inside_ratio", F.col("inside") / F.nullif(F.col("total"), F.lit(0.0))).withColumn("class", F.coalesce("forced_class", by_share)).drop("forced_class")


def vertex_statistics(features: DataFrame, ident: str = "area_id", rings: str = "rings", floor: int = 4) -> DataFrame:
    """Minimum, median and maximum vertices, and how many features sit at the floor."""
    counted = features.select(G.vertex_count(F.col(rings)).alias("n"))
    stats = counted.agg(
        F.count(F.lit(1)).alias("feature_count"),
        F.count_if(F.col("n").isNull()).alias("degenerate_count"),
        F.min("n").alias("minimum_vertices"),
        F.max("n").alias("maximum_vertices"),
        F.count_if(F.col("n") <= floor).alias("floor_feature_count"),
    )
    median = exact_quantiles(counted, [], "n", [0.5], ["median_vertices"])
    return stats.withColumn("median_vertices", median.scalar()).withColumn("floor_vertices", F.lit(floor))


def low_vertex_findings(before: DataFrame, after: DataFrame, allowed: DataFrame, ident: str = "area_id", floor: int = 4) -> DataFrame:
    """Identities lost or added by simplification, and new floor features outside the allow-list."""
    lost = before.select(ident).exceptAll(after.select(ident)).select(ident, F.lit("identity_missing").alias("finding"))
    added = after.select(ident).exceptAll(before.select(ident)).select(ident, F.lit("identity_unexpected").alias("finding"))
    low = after.where(G.vertex_count(F.col("rings")) <= floor).select(ident).join(allowed, ident, "left_anti")
    return lost.unionByName(added).unionByName(low.select(ident, F.lit("new_floor_feature").alias("finding")))
