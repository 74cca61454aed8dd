"""Spatial operators against plain brute force on small inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellsight.operators import nearest as N
from cellsight.operators import vector as V
from cellsight.operators import zonal as Z

RINGS = "array<array<struct<x:double,y:double>>>"


def closed(points):
    return [(float(x), float(y)) for x, y in [*points, points[0]]]


def star(rng, cx, cy, radius, n):
    return closed([(cx + radius * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), cy + radius * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)])


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if y1 != y2 and min(y1, y2) <= y < max(y1, y2) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) > x:
                odd = not odd
    return odd


def areas(spark, shapes, name="area_id"):
    return spark.createDataFrame([(k, rings) for k, rings in shapes.items()], f"{name} string, rings {RINGS}")


@pytest.mark.parametrize("dx, dy", [(1.0, 1.0), (1.0, -1.0), (-1.0, -1.0), (0.37, -0.53)])
def test_spans_equal_the_point_test(spark, dx, dy):
    rng = random.Random(1)
    shapes = {f"a{i}": [star(rng, rng.uniform(-8, 8), rng.uniform(-8, 8), 6, 9)] for i in range(6)}
    shapes["hole"] = [closed([(-5, -5), (5, -5), (5, 5), (-5, 5)]), closed([(-2, -2), (2, -2), (2, 2), (-2, 2)])]
    size = int(40 / min(abs(dx), abs(dy)))
    grid = Z.Grid(-20.0 if dx > 0 else 20.0, -20.0 if dy > 0 else 20.0, dx, dy, size, size)
    got = {(r.area_id, r.row, r.col) for r in Z.enumerate_cells(Z.area_spans(areas(spark, shapes), grid)).collect()}
    centre = lambda r, c: (grid.x0 + (c + 0.5) * dx, grid.y0 + (r + 0.5) * dy)
    want = {(k, r, c) for k, s in shapes.items() for r in range(size) for c in range(size) if inside(s, *centre(r, c))}
    assert got == want


def test_shared_borders_give_each_cell_to_one_area(spark):
    rng = random.Random(2)
    xs, ys = [0, 7, 13, 20], [0, 6, 15, 20]
    nodes = {(i, j): (x + (rng.uniform(-2, 2) if 0 < i < 3 else 0), y + (rng.uniform(-2, 2) if 0 < j < 3 else 0)) for i, x in enumerate(xs) for j, y in enumerate(ys)}
    shapes = {f"{i}{j}": [closed([nodes[i, j], nodes[i + 1, j], nodes[i + 1, j + 1], nodes[i, j + 1]])] for i in range(3) for j in range(3)}
    grid = Z.Grid(0.0, 20.0, 0.25, -0.25, 80, 80)
    cells = Z.enumerate_cells(Z.area_spans(areas(spark, shapes), grid))
    per_cell = cells.groupBy("row", "col").count()
    assert per_cell.count() == 6400 and per_cell.where("count > 1").count() == 0


def test_all_touched_contains_centres_and_has_no_doubles(spark):
    rng = random.Random(3)
    shapes = {f"a{i}": [star(rng, rng.uniform(10, 30), rng.uniform(10, 30), 7, 11)] for i in range(4)}
    grid = Z.Grid(0.0, 0.0, 1.0, 1.0, 40, 40)
    table = areas(spark, shapes)
    centre = {(r.area_id, r.row, r.col) for r in Z.enumerate_cells(Z.area_spans(table, grid)).collect()}
    rows = [(r.area_id, r.row, r.col) for r in Z.enumerate_cells(Z.area_spans(table, grid, True)).collect()]
    assert len(rows) == len(set(rows)) and centre <= set(rows)
    for key, rings in shapes.items():  # every sampled border point lies in a touched cell
        for (x1, y1), (x2, y2) in zip(rings[0], rings[0][1:]):
            for t in np.linspace(0, 1, 50, endpoint=False):
                x, y = x1 + t * (x2 - x1), y1 + t * (y2 - y1)
                assert (key, math.floor(y), math.floor(x)) in set(rows)


def test_wide_area_crosses_many_tiles(spark):
    shapes = {"wide": [closed([(3, 1), (997, 1), (997, 4), (3, 4)])]}
    grid = Z.Grid(0.0, 0.0, 1.0, 1.0, 1000, 10)
    cells = spark.range(10_000).select((F.col("id") / 1000).cast("int").alias("row"), (F.col("id") % 1000).cast("int").alias("col"))
    joined = Z.cells_in_areas(cells, Z.area_spans(areas(spark, shapes), grid))
    assert joined.count() == 3 * 994 and joined.distinct().count() == 3 * 994


def test_empty_area_keeps_a_zero_row(spark):
    from cellsight.operators import composite as K

    tiny = areas(spark, {"tiny": [closed([(39.0, 13.0), (39.00001, 13.0), (39.0, 13.00001)])], "big": [closed([(39.0, 13.0), (39.01, 13.0), (39.0, 13.01)])]})
    got = {r.area_id: r.total_eligible_pixel_count for r in K.eligible_pixels(tiny, K.analysis_spans(tiny)).collect()}
    assert got["tiny"] <= 1 and 500 < got["big"] < 800


def test_nearest_segment_equals_brute_force(spark):
    rng = random.Random(4)
    segs = [(f"s{i}", x := rng.gauss(0, 50), y := rng.gauss(0, 50), x + rng.gauss(0, 8), y + rng.gauss(0, 8)) for i in range(150)]
    segs += [(f"hot{i}", 1.0 + i * 1e-4, 1.0, 1.0 + i * 1e-4, 1.5) for i in range(60)] + [("long", -400.0, -300.0, 500.0, 350.0)]
    points = [(f"p{i}", rng.gauss(0, 60), rng.gauss(0, 60)) for i in range(120)] + [("far", 9000.0, -7000.0), ("on", 1.0, 1.2), ("negative", -0.01, -0.01)]
    got = {r.area_id: r.distance for r in N.nearest_segment(spark.createDataFrame(points, "area_id string, px double, py double"), spark.createDataFrame(segs, "line_id string, x1 double, y1 double, x2 double, y2 double"), 2.0).collect()}

    def distance(px, py, x1, y1, x2, y2):
        d = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = max(0, min(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / d)) if d else 0
        return math.hypot(px - x1 - t * (x2 - x1), py - y1 - t * (y2 - y1))

    assert len(got) == len(points)
    for name, px, py in points:
        assert got[name] == pytest.approx(min(distance(px, py, *s[1:]) for s in segs), abs=1e-9)


def slab_area(a, b):
    """Area of the intersection by exact horizontal slabs between all vertex and crossing heights."""
    segments = [[(p, q) for r in rings for p, q in zip(r, r[1:])] for rings in (a, b)]
    ys = {p[1] for side in segments for s in side for p in s}
    for (x1, y1), (x2, y2) in segments[0]:
        for (x3, y3), (x4, y4) in segments[1]:
            d = (x2 - x1) * (y4 - y3) - (y2 - y1) * (x4 - x3)
            if d:
                t = ((x3 - x1) * (y4 - y3) - (y3 - y1) * (x4 - x3)) / d
                u = ((x3 - x1) * (y2 - y1) - (y3 - y1) * (x2 - x1)) / d
                if 0 <= t <= 1 and 0 <= u <= 1:
                    ys.add(y1 + t * (y2 - y1))
    total, ys = 0.0, sorted(ys)
    for low, high in zip(ys, ys[1:]):
        y = (low + high) / 2
        spans = []
        for side in segments:
            xs = sorted(x1 + (y - y1) * (x2 - x1) / (y2 - y1) for (x1, y1), (x2, y2) in side if min(y1, y2) <= y < max(y1, y2))
            spans.append(list(zip(xs[::2], xs[1::2])))
        total += (high - low) * sum(max(0, min(p[1], q[1]) - max(p[0], q[0])) for p in spans[0] for q in spans[1])
    return total


def test_area_inside_equals_slab_integration(spark):
    rng = random.Random(5)
    shapes = {f"a{i}": [star(rng, rng.uniform(0, 20), rng.uniform(0, 20), 6, 8)] for i in range(8)}
    shapes["same"] = [closed([(2, 2), (18, 2), (18, 18), (2, 18)])]  # equals the region's outer ring
    shapes["half"] = [closed([(2, 2), (10, 2), (10, 18), (2, 18)])]  # shares three sides
    shapes["outside"] = [closed([(18, 2), (25, 2), (25, 18), (18, 18)])]  # touches along one side only
    shapes["around"] = [closed([(-5, -5), (30, -5), (30, 30), (-5, 30)])]
    shapes["within"] = [closed([(3, 3), (5, 3), (5, 5), (3, 5)])]
    region = {"r": [closed([(2, 2), (18, 2), (18, 18), (2, 18)]), closed([(8, 8), (8, 12), (12, 12), (12, 8)])]}
    got = {r.area_id: r.inside for r in V.area_inside(areas(spark, shapes), areas(spark, region, "region_id"), 3.0).collect()}
    for key, rings in shapes.items():
        assert got.get(key, 0.0) == pytest.approx(slab_area(rings, region["r"]), abs=1e-7), key


def test_length_inside_and_clip(spark):
    region = areas(spark, {"r": [closed([(0, 0), (10, 0), (10, 10), (0, 10)])]}, "region_id")
    lines = areas(spark, {"through": [[(-5.0, 5.0), (15.0, 5.0)]], "diagonal": [[(-1.0, -1.0), (11.0, 11.0)]], "out": [[(20.0, 0.0), (21.0, 0.0)]], "bent": [[(5.0, 5.0), (5.0, 15.0), (8.0, 15.0), (8.0, 9.0)]]}, "line_id")
    got = {r.line_id: r.inside for r in V.length_inside(lines, region, 2.0).collect()}
    assert got == pytest.approx({"through": 10.0, "diagonal": 10 * 2**0.5, "bent": 6.0})


def test_ring_problems(spark):
    shapes = {
        "good": [closed([(0, 0), (9, 0), (9, 9), (0, 9)])], "bowtie": [closed([(0, 0), (4, 4), (4, 0), (0, 4)])], "thin": [closed([(0, 0), (1, 1)])], "empty": [],
        "open": [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)]], "hole_crosses": [closed([(0, 0), (9, 0), (9, 9), (0, 9)]), closed([(5, 5), (12, 5), (12, 6), (5, 6)])],
    }
    got = {r.area_id: (r.is_valid, r.reason) for r in V.ring_problems(areas(spark, shapes), 2.0).withColumn("reason", V.invalid_reason()).collect()}
    assert got["good"] == (True, None) and got["bowtie"] == (False, "Self-intersection[2.0 2.0]")
    assert not any(got[k][0] for k in ("thin", "empty", "open", "hole_crosses"))


def test_ring_problems_of_the_arrangement(spark):
    box = closed([(0, 0), (4, 0), (4, 4), (0, 4)])
    shapes = {
        "spike": [closed([(0, 0), (4, 0), (4, 4), (2, 4), (2, 6), (2, 4), (0, 4)])],
        "touches_itself": [closed([(0, 0), (4, 0), (2, 2), (4, 4), (0, 4), (2, 2)])],
        "vertex_on_edge": [closed([(0, 0), (6, 0), (6, 4), (3, 0), (0, 4)])],
        "runs_back": [closed([(0, 0), (6, 0), (6, 4), (4, 4), (4, 0), (2, 0), (2, 4), (0, 4)])],
        "twice": [box, box], "not_a_number": [closed([(0, 0), (4, 0), (float("nan"), 4)])], "infinite": [closed([(0, 0), (4, 0), (float("inf"), 4)])],
        "hole_touches": [closed([(0, 0), (9, 0), (9, 9), (0, 9)]), closed([(0, 4), (4, 2), (4, 6)])],
        "repeated_points": [closed([(0, 0), (0, 0), (4, 0), (4, 4), (4, 4), (4, 4), (0, 4)])], "two_parts": [box, closed([(4, 4), (8, 4), (8, 8)])],
    }
    got = {r.area_id: (r.is_valid, r.reason) for r in V.ring_problems(areas(spark, shapes), 2.0).withColumn("reason", V.invalid_reason()).collect()}
    assert got == {
        "spike": (False, "Self-intersection[2.0 4.0]"), "touches_itself": (False, "Ring Self-intersection[2.0 2.0]"), "vertex_on_edge": (False, "Ring Self-intersection[3.0 0.0]"),
        "runs_back": (False, "Self-intersection[2.0 0.0]"), "twice": (False, "Self-intersection[0.0 0.0]"), "not_a_number": (False, "Invalid Coordinate"), "infinite": (False, "Invalid Coordinate"),
        "hole_touches": (True, None), "repeated_points": (True, None), "two_parts": (True, None),
    }


def test_interior_points_are_inside(spark):
    rng = random.Random(6)
    shapes = {f"a{i}": [star(rng, 0, 0, 10, 12)] for i in range(20)}
    shapes["u"] = [closed([(0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (2, 2), (2, 10), (0, 10)])]
    got = V.interior_point(areas(spark, shapes)).collect()
    assert len(got) == len(shapes) and all(inside(shapes[r.area_id], r.px, r.py) for r in got)


def test_slope_of_a_plane(spark):
    cells = spark.range(100).select((F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col")).withColumn("value", F.col("col") * 3.0 + F.col("row") * 4.0)
    got = Z.slope(cells, 1.0, 1.0).collect()
    assert len(got) == 64 and all(r.slope_pct == pytest.approx(500.0) for r in got)


def test_window_rejects_a_box_outside(spark):
    grid = Z.Grid(30.0, 20.0, 0.05, -0.05, 100, 100)
    assert grid.window(31.0, 18.0, 32.0, 19.0) == (20, 20, 20, 20)
    with pytest.raises(ValueError):
        grid.window(50.0, 18.0, 51.0, 19.0)


def test_bucketed_pairs_equal_the_plain_predicate(spark):
    """Also where sloped segments touch on bucket borders: many end on whole-number points, on one another's inside."""
    rng = random.Random(9)
    free = lambda n, p: [(f"{p}{i}", x := rng.uniform(0, 4), y := rng.uniform(0, 4), x + rng.gauss(0, 0.3), y + rng.gauss(0, 0.3)) for i in range(n)]
    left, right = free(60, "a"), free(60, "b")
    for i in range(300):
        x, y, t, dx, dy = rng.randint(0, 40), rng.randint(0, 40), rng.uniform(0.1, 0.9), rng.uniform(-2, 2), rng.uniform(-2, 2)
        left.append((f"p{i}", x - t * dx, y - t * dy, x * 1.0, y * 1.0))
        right.append((f"q{i}", x * 1.0, y * 1.0, x + dy, y - dx))
    columns = "id string, x1 double, y1 double, x2 double, y2 double"
    a, b = spark.createDataFrame(left, columns), spark.createDataFrame(right, columns)
    names = lambda joined: {(r[0], r[1]) for r in joined.where(V.segments_meet("a", "b")).select("a.id", "b.id").collect()}
    plain = names(a.alias("a").crossJoin(b.alias("b")))
    for size in (1.0, 0.5, 0.3):
        x, y = V.paired_buckets(a, b, size)
        assert names(x.alias("a").join(y.alias("b"), V._same_bucket("a", "b"))) == plain
    assert len(plain) > 300


def test_ranks_of_text_nulls_and_odd_numbers(spark):
    from cellsight.operators.ranking import global_rank, exact_quantiles

    rng = random.Random(12)
    odd = [None, None, float("nan"), float("inf"), float("-inf"), 0.0, -0.5, 1e-300, 4e9 + 1]
    rows = [(i, rng.choice(odd) if i % 3 == 0 else 1e9 + rng.randrange(300) / 7, rng.choice(["", "a", "ab", "abcdefgh", "abcdefgi", "é", None, "zz"]), 2**53 + rng.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, v double, s string, n long")
    for name in ("v", "s", "n"):
        got = {r.id: (r.rank_position, r.rank_min) for r in global_rank(df, name, "id").collect()}
        plain = df.selectExpr("id", f"row_number() OVER (ORDER BY {name} NULLS LAST, md5(string(id)), id) AS p", f"rank() OVER (ORDER BY {name} NULLS LAST) AS m")
        assert got == {r.id: (r.p, r.m) for r in plain.collect()}
    known = sorted(r[1] for r in rows if r[1] is not None and not math.isnan(r[1]) and abs(r[1]) != math.inf)
    (r,) = exact_quantiles(df.where("v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity')"), [], "v", [0.1, 0.5, 0.9], ["a", "b", "c"]).collect()
    assert [r.a, r.b, r.c] == pytest.approx(np.quantile(known, [0.1, 0.5, 0.9]).tolist(), rel=1e-15)
    (r,) = exact_quantiles(df, [], "v", [0.0, 1.0], ["low", "high"]).collect()
    assert r.low == -math.inf and (math.isnan(r.high) or any(math.isnan(x[1]) for x in rows if x[1] is not None))


def test_nearest_segment_of_far_points(spark):
    from cellsight.operators.nearest import nearest_segment

    points = spark.createDataFrame([("near", 1.0, 1.0), ("far", 4e8, -3e8), ("left", -1e7, 5.0)], "area_id string, px double, py double")
    lines = spark.createDataFrame([("l1", 0.0, 0.0, 2.0, 0.0), ("l2", -50.0, 4.0, -40.0, 4.0)], "line_id string, x1 double, y1 double, x2 double, y2 double")
    got = {r.area_id: (r.line_id, r.distance) for r in nearest_segment(points, lines, 0.5).collect()}
    assert got == {"near": ("l1", 1.0), "far": ("l1", pytest.approx(((4e8 - 2) ** 2 + 9e16) ** 0.5)), "left": ("l2", pytest.approx(((1e7 - 50) ** 2 + 1) ** 0.5))}
    assert nearest_segment(points, lines.where("false"), 0.5).count() == 0


def test_nearest_in_time_equals_trying_all(spark):
    from cellsight.operators.nearest import nearest_in_time

    rng = random.Random(4)
    second = lambda: rng.randrange(0, 40 * 86400, 900)
    items = [(f"i{k:03d}", second()) for k in range(60)] + [("i999", 5), ("i998", 5)]
    asks = [(f"r{k}", second() + 450 * (k % 3)) for k in range(200)] + [("none", 300 * 86400), ("tie", 5)]
    frame = lambda rows, a, b: spark.createDataFrame(rows, f"{a} string, s long").select(a, F.timestamp_seconds("s").alias(b))
    want = {}
    for name, t in asks:
        best = min(((abs(s - t), s, i) for i, s in items if abs(s - t) <= 2 * 86400), default=None)
        if best:
            want[name] = best[2], float(best[0])
    got = {r.request_id: (r.item_id, r.gap_seconds) for r in nearest_in_time(frame(asks, "request_id", "wanted"), frame(items, "item_id", "stamp"), "request_id", "wanted", "item_id", "stamp").collect()}
    assert got == want


def test_ordinals_and_previous_values_equal_plain_windows(spark):
    from pyspark.sql import Window as W

    from cellsight.operators.ranking import ordinals
    from cellsight.operators.runs import previous_value

    rng = random.Random(10)
    rows = [(i, rng.choice(["hot", "hot", "b", None]), rng.randrange(1000) * 1000 + i, rng.choice([None, 1.0, 2.0])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k string, t int, v double")
    by = W.partitionBy("k").orderBy("t")
    got = {r.id: r.ordinal for r in ordinals(df, ["k"], "t", "id").collect()}
    assert got == {r.id: r.o for r in df.select("id", F.row_number().over(by).alias("o")).collect()}
    known = df.where("k IS NOT NULL")
    got = {r.id: r.p for r in previous_value(known, ["k"], ["t"], "v", F.floor(F.col("t") / 100_000), "p").collect()}
    assert got == {r.id: r.o for r in known.select("id", F.lag("v").over(by).alias("o")).collect()}


def _brute_meets(a, b):
    side = lambda ax, ay, bx, by, px, py: (bx - ax) * (py - ay) - (by - ay) * (px - ax)
    sign = lambda v: (v > 0) - (v < 0)
    d1, d2, d3, d4 = (sign(side(*a, *b[:2])), sign(side(*a, *b[2:])), sign(side(*b, *a[:2])), sign(side(*b, *a[2:])))
    over = lambda i: min(a[i], a[i + 2]) <= max(b[i], b[i + 2]) and min(b[i], b[i + 2]) <= max(a[i], a[i + 2])
    return d1 * d2 <= 0 and d3 * d4 <= 0 and over(0) and over(1)


@pytest.mark.parametrize("limit", [100, 10**9])
def test_quadtree_pairs_come_once_and_all(spark, limit):
    """Half of all segments crowd one bucket; some touch, some overlap along a line, some lie on cell borders."""
    rng = random.Random(limit)
    place = lambda dense: rng.uniform(8.0, 8.4) if dense else rng.uniform(-20, 20)
    make = lambda k: [(i, *[place(i % 2) for _ in range(4)]) for i in range(k)]
    grid = [(1000 + i, float(i % 5) * 4, 0.0, float(i % 5) * 4, 4.0 * (i % 3)) for i in range(12)] + [(2000 + i, i * 0.5, 4.0, i * 0.5 + 1.0, 4.0) for i in range(9)]
    left, right = make(120) + grid, make(120) + [(i + 5000, *r) for i, *r in grid]
    frame = lambda rows, n: spark.createDataFrame(rows, f"{n} long, x1 double, y1 double, x2 double, y2 double")
    got = [(r.l, r.r) for r in V.meeting_segments(frame(left, "l"), frame(right, "r"), 4.0, limit).select("a.l", "b.r").collect()]
    want = {(a[0], b[0]) for a in left for b in right if _brute_meets(a[1:], b[1:])}
    assert len(got) == len(set(got)) and set(got) == want


def test_quadtree_leaves_stay_small_where_it_is_crowded(spark):
    n = 3000  # half of all segments lie in one bucket of the first level
    spread = spark.range(n).selectExpr("id AS l", *[f"IF(id % 2 = 0, 1.0 + (id * {k} % 997) / 400.0, (id * {k} % 211) * 4.0) AS {c}" for k, c in ((37, "x1"), (53, "y1"))])
    short = spread.selectExpr("l", "x1", "y1", "x1 + 0.01 AS x2", "y1 + 0.013 AS y2")
    a, b = V.quadtree_leaves(short, short.withColumnRenamed("l", "r"), 4.0, 400)
    counted = a.groupBy("level", "bx", "by").count().join(b.groupBy("level", "bx", "by").count().withColumnRenamed("count", "other"), ["level", "bx", "by"])
    most = counted.selectExpr("max(count * other) AS m", "max(level) AS deep").first()
    assert most.m <= 400 and most.deep >= 2


def test_far_points_measure_few_segments(spark):
    """Branch and bound: 1,000 points far outside meet a bounded share of 2,500 segments each."""
    points = spark.range(1000).selectExpr("concat('p', id) AS area_id", "cos(id * 0.7) * 1e7 AS px", "sin(id * 0.7) * 1e7 AS py")
    segments = spark.range(2500).selectExpr("concat('l', id) AS line_id", "(id % 50) * 1.0 AS x1", "floor(id / 50) * 1.0 AS y1", "(id % 50) + 0.4 AS x2", "floor(id / 50) + 0.3 AS y2")
    counts = N.nearest_candidates(points, segments, 0.5).groupBy("area_id").count().agg(F.count("*"), F.avg("count"), F.max("count")).first()
    assert counts[0] == 1000 and counts[1] < 25 and counts[2] < 250


def test_points_a_hundred_billion_away_measure_few_segments(spark):
    """a slack relative to the distance opened every bucket within 100 units of the nearest for such points."""
    points = spark.range(200).selectExpr("concat('p', id) AS area_id", "(id - 100) * 3e6 AS px", "id * -1e9 - 1e8 AS py")
    segments = spark.range(5000).selectExpr("concat('l', id) AS line_id", "(id % 50) * 1.0 AS x1", "floor(id / 50) * 1.0 AS y1", "(id % 50) + 0.4 AS x2", "floor(id / 50) + 0.3 AS y2")
    counts = N.nearest_candidates(points, segments, 0.5).groupBy("area_id").count().agg(F.count("*"), F.max("count")).first()
    assert counts[0] == 200 and counts[1] <= 200
    got = {r.area_id: r.distance for r in N.nearest_segment(points, segments, 0.5).collect()}
    pairs = points.crossJoin(segments).withColumn("d", N.point_segment_distance(*[F.col(c) for c in ("px", "py", "x1", "y1", "x2", "y2")]))
    assert got == {r.area_id: r.d for r in pairs.groupBy("area_id").agg(F.min("d").alias("d")).collect()}


def test_area_inside_overlapping_regions_count_once(spark):
    box = lambda a, b, c, d: [closed([(a, b), (c, b), (c, d), (a, d)])]
    shapes = {"across": box(0, 0, 3, 2), "within": box(0.5, 0.5, 2.5, 1.5), "overlap": box(1, 0, 2, 2), "outside": box(10, 0, 11, 1)}
    region = {"p": box(0, 0, 2, 2), "q": box(1, 0, 3, 2), "copy": box(1, 0, 3, 2), "inner": box(0.25, 0.25, 0.5, 0.5)}
    got = {r.area_id: r.inside for r in V.area_inside(areas(spark, shapes), areas(spark, region, "region_id"), 2.0).collect()}
    assert got == pytest.approx({"across": 6.0, "within": 2.0, "overlap": 2.0})
