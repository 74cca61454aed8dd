"""Hand-computed cases for the places where similar definitions differ."""

import datetime as dt
import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellsight.functions import classes as C
from cellsight.functions import dates as D
from cellsight.functions import geometry as G
from cellsight.functions import numeric as M
from cellsight.functions import projection as P
from cellsight.functions import text as T
from cellsight.operators import baseline as B
from cellsight.operators import composite as K
from cellsight.operators import layers as L
from cellsight.operators import quality as Q
from cellsight.operators import ranking as R
from cellsight.operators import runs as U
from cellsight.plans import priority, release, scenario, skill

date = dt.date


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(*values):
    return F.array(*[F.lit(v) for v in values])


# ---- rounding, medians, percentiles


def test_round_half_even_on_the_binary_value(spark):
    random.seed(3)
    xs = [62.25, 62.35, 62.45, 2.675, -2.5, 0.5, 1.5, 2.5, -0.05, 89.95, 1e-9, 0.0] + [random.uniform(-1e3, 1e3) for _ in range(300)] + [100 * k / 2000 for k in range(2001)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits in (0, 1, 2, 4):
        for row in df.select("x", M.py_round(F.col("x"), digits).alias("y")).collect():
            assert row.y == round(row.x, digits)
    assert one(spark, M.py_round(F.lit(None).cast("double"), 1)) is None


def test_baseline_percentile_rounds_ties_as_its_sql(spark):
    """a median that ends in 5 was rounded to the even digit, in SQL away from zero."""
    years = spark.createDataFrame([("a", 56.125), ("b", 49.625), ("c", -0.125), ("d", 1.004999)], "area_id string, depth double")
    now = years.withColumn("depth", F.lit(1.0))
    medians = lambda **how: {r.area_id: r.baseline_median for r in B.observed_against_years(now, years, **how).collect()}
    assert medians(rounded=M.sql_round) == {"a": 56.13, "b": 49.63, "c": -0.13, "d": 1.0}
    assert medians() == {"a": 56.12, "b": 49.62, "c": -0.12, "d": 1.0}


def test_three_medians_and_two_percentiles(spark):
    four = lit(1.0, 2.0, 3.0, 4.0)
    assert one(spark, M.upper_median(four)) == 3.0
    assert one(spark, M.array_quantile(four, 0.5)) == 2.5
    # value 2 over (1, 2, 2, 3)
    assert one(spark, M.mid_rank_pct(F.lit(1), F.lit(2), F.lit(4))) == 50.0
    assert one(spark, M.inclusive_pct(F.lit(3), F.lit(4))) == 75.0


def test_array_quantile_is_linear_interpolation(spark):
    values = sorted([3.1, 0.2, 8.8, 5.5, 1.7, 9.9, 2.0])
    for p in (0.0, 1 / 3, 0.5, 2 / 3, 0.8, 1.0):
        assert one(spark, M.array_quantile(lit(*values), p)) == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_value_bin_is_monotone(spark):
    random.seed(5)
    xs = sorted([0.0, -0.0, 1e-300, -1e-300, 7.999999999999999, 8.0, 8.000000000000002, 1e300] + [random.choice([-1, 1]) * math.exp(random.uniform(-30, 30)) for _ in range(2000)])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    bins = [r.b for r in df.select("i", M.value_bin(F.col("x")).alias("b")).orderBy("i").collect()]
    assert bins == sorted(bins)


def test_exact_quantiles_with_copies_negatives_and_one_value(spark):
    random.seed(7)
    rows = [("hot", float(random.choice([0, 0, 0, 5, -3, 2.5, 100]))) for _ in range(3000)] + [("wide", random.gauss(0, 1e6)) for _ in range(501)] + [("single", 4.25)]
    df = spark.createDataFrame(rows + [("hot", None)], "k string, v double")
    probs = [0.0, 0.2, 0.5, 0.77, 1.0]
    got = {r.k: r for r in R.exact_quantiles(df, ["k"], "v", probs, list("abcde")).collect()}
    for k in ("hot", "wide", "single"):
        values = [v for kk, v in rows if kk == k]
        for name, p in zip("abcde", probs):
            assert got[k][name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("n", [1, 3, 9, 10, 23, 400])
def test_scaled_ntile_equals_plain_ntile(spark, n):
    from pyspark.sql import Window as W

    random.seed(n)
    df = spark.createDataFrame([(i, float(random.choice([1, 1, 1, random.random()]))) for i in range(n)], "id int, v double")
    plain = F.ntile(10).over(W.orderBy("v", F.md5(F.col("id").cast("string")), "id"))
    a = {r.id: r.d for r in R.ntile(df, 10, "v", "id", "d").collect()}
    assert a == {r.id: r.d for r in df.select("id", plain.alias("d")).collect()}


def test_quantile_class_clamps_to_six_classes(spark):
    values = [1.0, 2.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    expected = {i: max(0, min(5, sorted(values).index(v) * 6 // len(values))) for i, v in enumerate(values)}
    assert {r.id: r.quantile_class for r in R.quantile_class(df, "v", "id").collect()} == expected


# ---- classes


def test_class_edges(spark):
    rows = spark.createDataFrame([(10.0,), (20.0,), (80.0,), (90.0,), (79.9,), (None,)], "p double")
    got = [r.c for r in rows.select(C.rainfall_condition(F.col("p")).alias("c")).collect()]
    assert got == ["exceptionally_dry", "drier_than_typical", "wetter_than_typical", "exceptionally_wet", "typical_range", "unavailable"]


def test_band_gate_and_missing_road(spark):
    assert one(spark, C.rainfall_band(F.lit(5.0), F.lit("ok"), F.lit(89.9))) == "unavailable"
    assert one(spark, C.rainfall_band(F.lit(5.0), F.lit("ok"), F.lit(90.0))) == "very_low"
    none_text, none_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    assert one(spark, C.road_context(none_text, none_number)) == "far"
    assert one(spark, C.road_context(F.lit("bad"), F.lit(10.0))) == "unavailable"
    assert one(spark, C.road_context(F.lit("ok"), F.lit(899.9))) == "near"


def test_tiers_and_their_quality(spark):
    tier = lambda px, sc, cov: one(spark, C.evidence_tier(F.lit(px), F.lit(sc), F.lit(cov)))
    assert (tier(29, 9, 95.0), tier(40, 2, 69.9), tier(30, 2, 70.0), tier(40, 1, 99.0)) == ("insufficient", "limited", "adequate", "insufficient")
    assert one(spark, C.tier_quality(F.lit("limited"))) == "limited_observation_coverage"
    assert one(spark, C.tier_quality(F.lit("limited"), full_run=False)) == "insufficient_observation_coverage"


def test_outlook_tie_and_nulls(spark):
    d = lambda v: F.lit(v).cast("decimal(5,4)")
    assert one(spark, C.outlook_category(d(0.4), d(0.4), d(0.2)))["category"] == "Below normal"
    assert one(spark, C.outlook_category(d(None), d(0.3), d(0.2)))["category"] == "Near normal"
    assert one(spark, C.outlook_category(d(None), d(None), d(None)))["category"] == "Unavailable"


def test_provider_period_labels(spark):
    rows = [
        ('{"phase":"3","scenario":"ML2","valid_from":"2026-06-01","valid_to":"2026-09-30"}',),
        ('{"ipc_phase":"9","start_date":"2026-11-01","end_date":"2027-01-31"}',),
        ('{"ml1":" ","valid_from":"2026-06-01","valid_to":"2026-06-30"}',),
    ]
    got = C.provider_context(spark.createDataFrame(rows, "properties string")).collect()
    assert [(r.label, r.scenario, r.period) for r in got] == [
        ("Crisis", "Projected assessment", "Jun–Sep 2026"),
        ("Provider classification", "Assessment type not supplied", "Nov 2026–Jan 2027"),
        ("Classification not supplied", "Assessment type not supplied", "Jun 2026"),
    ]


def test_quality_bits(spark):
    accepted = lambda qa, p: one(spark, K.mask_profiles(F.lit(qa).cast("short"))[p])
    assert not accepted(0b00000100, "strict") and accepted(0b00000100, "adjacency_allowed")
    assert not accepted(0b00000010, "adjacency_allowed")
    assert not accepted(0b11000000, "strict") and accepted(0b01000000, "strict")
    assert not accepted(255, "adjacency_allowed")


# ---- dates


def test_pentad_ends_differ_between_probe_and_summary(spark):
    args = lambda y, m: (F.lit(y), F.lit(m), F.lit(6))
    assert one(spark, D.pentad_end_summary(*args(2026, 7))) == date(2026, 7, 30)
    assert one(spark, D.pentad_end_summary(*args(2028, 2))) == date(2028, 2, 28)
    assert one(spark, D.pentad_end(*args(2026, 7))) == date(2026, 7, 31)
    assert one(spark, D.pentad_end(*args(2028, 2))) == date(2028, 2, 29)


def test_dekads_completed_month_validity(spark):
    period = one(spark, D.dekad_period(F.lit("X-3.L2-T-D.2026-02-D3")))
    assert (period["start"], period["end"]) == (date(2026, 2, 21), date(2026, 2, 28))
    assert one(spark, D.dekad_period(F.lit("no code"))) is None
    day = lambda s: F.lit(s).cast("date")
    assert one(spark, D.completed_month(day("2026-11-03"))) == date(2026, 9, 1)
    assert one(spark, D.completed_month(day("2026-11-06"))) == date(2026, 10, 1)
    preview = one(spark, D.preview_validity(day("2026-05-01")))
    start = (date(2026, 5, 1) + dt.timedelta(days=32)).replace(day=1)
    assert (preview["valid_from"], preview["valid_to"]) == (start, (start + dt.timedelta(days=123)).replace(day=1) - dt.timedelta(days=1))


def test_trailing_window_wraps_and_needs_all_six(spark):
    rows = [("a", 2025, 12, p, 1.0) for p in (4, 5, 6)] + [("a", 2026, 1, p, 1.0) for p in (1, 2, 3, 5)]
    df = spark.createDataFrame(rows, "area_id string, y int, m int, p int, v double").withColumn("o", D.pentad_ordinal(F.col("y"), F.col("m"), F.col("p")))
    got = {(r.y, r.m, r.p): r.trailing_total for r in U.trailing_periods(df, ["area_id"], "o", "v").collect()}
    assert got[(2026, 1, 3)] == 6.0 and got[(2026, 1, 2)] is None and got[(2026, 1, 5)] is None


def test_evenly_spaced_uses_half_even_places(spark):
    df = spark.createDataFrame([("k", i) for i in range(10)] + [("s", i) for i in range(3)], "k string, t int")
    got = sorted(r.t for r in U.evenly_spaced(df, ["k"], "t", 4).where("k = 'k'").collect())
    assert got == sorted({round(i * 9 / 3) for i in range(4)})
    assert U.evenly_spaced(df, ["k"], "t", 4).where("k = 's'").count() == 3


# ---- references


@pytest.mark.parametrize("reference_years, used", [(7, 6), (6, None)])
def test_leave_one_out_needs_six_rows(spark, reference_years, used):
    years = list(range(2018, 2018 + reference_years))
    rows = spark.createDataFrame([("a", 8, y, float(y - 2017)) for y in years], "area_id string, calendar_month int, year int, value double")
    got = B.leave_own_year_out(rows.where("year = 2018"), rows, (2018, 2025)).first()
    assert got.reference_count == used
    assert (got.reference_median is None) == (used is None)
    if used:
        assert got.reference_median == 4.5 and got.reference_percentile == 0.0


def test_target_outside_the_reference_years_uses_all_rows(spark):
    rows = spark.createDataFrame([("a", 8, y, float(y - 2017)) for y in range(2018, 2024)], "area_id string, calendar_month int, year int, value double")
    target = spark.createDataFrame([("a", 8, 2026, 3.0)], rows.schema)
    got = B.leave_own_year_out(target, rows, (2018, 2025)).first()
    assert (got.reference_count, got.reference_median, got.reference_percentile) == (6, 3.5, 50.0)


def test_leave_own_year_out_equals_filtering_the_reference(spark):
    """Ties inside and across years, years of nothing else, targets without a value or outside the years, repeated targets."""
    rng = random.Random(8)
    rows = [("a", m, y, float(rng.randint(0, 6))) for m in (1, 2) for y in range(2018, 2023) for _ in range(rng.randint(0, 4))]
    rows += [("b", 1, 2019, 3.0)] * 9 + [("c", 1, y, None) for y in range(2018, 2022)] + [(None, 1, 2018, 1.0)]
    targets = [(a, m, y, v) for a in ("a", "b", "c", "none", None) for m in (1, 2) for y in (2017, 2018, 2019, 2021, 2024) for v in (None, 2.5, 3.0)] + [("a", 1, 2019, 3.0)]
    schema = "area_id string, calendar_month int, year int, value double"
    got = B.leave_own_year_out(spark.createDataFrame(targets, schema), spark.createDataFrame(rows, schema), (2018, 2022), minimum=3)
    want = []
    for a, m, y, v in targets:
        ref = sorted(r[3] for r in rows if a is not None and r[:2] == (a, m) and r[3] is not None and not (2018 <= y <= 2022 and r[2] == y))
        n, k = len(ref), (len(ref) - 1) // 2
        median = None if n < 3 else (ref[k] + ref[n // 2]) / 2
        below = None if n < 3 or v is None else sum(x <= v for x in ref) / n * 100
        want.append((a, m, y, v, n if n >= 3 else None, median, below))
    columns = ["area_id", "calendar_month", "year", "value", "reference_count", "reference_median", "reference_percentile"]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    close = lambda r: tuple(None if x is None else round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(close, got.select(*columns).collect()), key=key) == sorted(map(close, want), key=key)


def test_reference_counts_rows_not_years(spark):
    rows = spark.createDataFrame([("a", 8, 2020, float(i)) for i in range(6)], "area_id string, calendar_month int, year int, value double")
    assert B.seasonal_reference(rows).first().valid_year_count == 6


def test_provisional_comparison_skips_incomplete_years(spark):
    current = spark.createDataFrame([("a", 2.0), ("b", 2.0)], "area_id string, depth double")
    history = spark.createDataFrame([("a", float(i % 4)) for i in range(25)] + [("a", None)] + [("b", 1.0)] * 24, "area_id string, depth double")
    got = {r.area_id: r for r in B.provisional_comparison(current, history).collect()}
    values = [float(i % 4) for i in range(25)]
    assert got["a"].baseline_median == np.median(values)
    assert got["a"].provisional_percentile == round(100 * (sum(v < 2 for v in values) + 0.5 * sum(v == 2 for v in values)) / 25, 1)
    assert got["b"].comparison_status == "insufficient_historical_grid_coverage" and got["b"].baseline_median is None


# ---- skill, scenario, priority, release


def test_skill_against_plain_python(spark):
    random.seed(11)
    records = [{"year": 2000 + i, "o": random.uniform(0, 100), "members": [random.uniform(0, 100) for _ in range(7)]} for i in range(9)]
    for r in records:
        r["mean"] = float(np.mean(r["members"]))
    rows = spark.createDataFrame([(1, r["year"], r["o"], r["mean"], sorted(r["members"])) for r in records], "lead int, year int, observed_mm double, ensemble_mean_mm double, members_mm array<double>")
    got = {r.category: r for r in skill.tercile_skill(rows, ["lead"]).collect()}
    cat = lambda v, q: "below" if v < q[0] else "above" if v > q[1] else "near"
    for name in ("below", "near", "above"):
        brier, clim = [], []
        for r in records:
            others = [x for x in records if x is not r]
            oq, mq = np.quantile([x["o"] for x in others], [1 / 3, 2 / 3]), np.quantile([x["mean"] for x in others], [1 / 3, 2 / 3])
            event = cat(r["o"], oq) == name
            brier.append((np.mean([cat(m, mq) == name for m in r["members"]]) - event) ** 2)
            clim.append((np.mean([cat(x["o"], oq) == name for x in others]) - event) ** 2)
        assert got[name].brier_score == pytest.approx(np.mean(brier))
        assert got[name].brier_skill_score == pytest.approx(1 - np.mean(brier) / np.mean(clim))


def test_scenario_order_and_nulls(spark):
    columns = "area_id string, rainfall_percentile double, ndvi_deviation_pct double, wapor_deviation_pct double, ndvi_valid_year_count int, wapor_valid_year_count int, rainfall_limit double, ndvi_limit double, wapor_limit double, logic string, category string, reviewer string, note string"
    base = dict(area_id="x", rainfall_percentile=15.0, ndvi_deviation_pct=-30.0, wapor_deviation_pct=-1.0, ndvi_valid_year_count=7, wapor_valid_year_count=8, rainfall_limit=20.0, ndvi_limit=-20.0, wapor_limit=-25.0, logic="either", category="cleared", reviewer="Ab", note="eight ch")
    def f(null_as_zero=False, **change):
        return scenario.finding(spark.createDataFrame([tuple({**base, **change}.values())], columns), null_as_zero=null_as_zero).first().finding
    assert f() == "Rainfall + land-surface signals agree (not independent)"
    assert f(ndvi_valid_year_count=5) == "Insufficient reference evidence"
    assert f(category="") == "Withheld pending confounder review"
    assert f(category="withheld") == "Withheld pending confounder resolution"
    assert f(note="short") == "Blocked pending reviewer record"
    assert f(logic="rainfall") == "Rainfall-only discussion signal"
    assert f(logic="both") == "Rainfall signal without land-surface agreement"
    assert f(rainfall_percentile=50.0) == "Land-surface divergence to review"
    assert f(rainfall_percentile=None, ndvi_deviation_pct=0.0) == "No selected discussion trigger"
    assert f(True, rainfall_percentile=None, ndvi_deviation_pct=0.0) == "Rainfall signal without land-surface agreement"


def test_priority_classes(spark):
    columns = "run_id string, area_id string, percentile double, quality_status string, coverage_pct double, population_decile int, cropland_decile int, nearest_road_m double, road_quality string"
    rows = [("r", "a", 10.0, "ok", 95.0, 7, None, 6000.0, "ok"), ("r", "b", 20.0, "ok", 95.0, 1, 7, 10.0, "ok"), ("r", "c", 10.0, "ok", 95.0, 6, 6, None, None), ("r", "d", 34.0, "ok", 90.0, 9, 9, 1.0, "bad"), ("r", "e", 1.0, "ok", 89.0, 9, 9, 1.0, "ok")]
    got = {r.area_id: r for r in priority.assess(spark.createDataFrame(rows, columns)).collect()}
    assert [got[k].priority_class for k in "abcde"] == ["critical", "high", "moderate", "watch", "insufficient_evidence"]
    assert [got[k].priority_rank for k in "abcde"] == [4, 3, 2, 1, 0]
    assert got["a"].triggered_rules[1] == priority.ROAD_RULES["far"] and got["c"].triggered_rules[1] == priority.ROAD_RULES["none"]
    public = priority.public_replay(spark.createDataFrame(rows, columns).transform(priority.assess))
    assert not set(release.FORBIDDEN_FIELDS) & set(public.columns)


def test_freshness_arithmetic_and_alarm(spark):
    contract = release.contract(spark)
    ended = spark.createDataFrame([(row[0], date(2026, 10, 1)) for row in release.FRESHNESS], "source_key string, source_observation_end date")
    facts = release.freshness(ended, contract)
    observed = facts.where("source_key = 'observed'").first()
    assert (observed.expected_next, observed.stale_after) == (date(2026, 11, 1), date(2026, 11, 20))
    state = lambda f, day: release.alarm(f, contract, F.lit(day).cast("date")).first().state
    assert state(facts, "2026-10-21") == "current" and state(facts, "2026-10-22") == "stale"
    assert state(facts.where("source_key <> 'rapid'"), "2026-10-02") == "invalid"


# ---- geometry, layers, text


def test_geodesic_area_of_a_degree_cell(spark):
    ring = G.ring_from_xy(*[(F.lit(float(x)), F.lit(float(y))) for x, y in ((39, 13), (40, 13), (40, 14), (39, 14), (39, 13))])
    assert one(spark, G.geodesic_area_km2(F.array(ring))) == pytest.approx(11990.0, rel=2e-3)


def test_projections_round_trip(spark):
    points = spark.createDataFrame([(36.5, 12.3), (39.0, 0.0), (40.2, 14.9), (41.9, 3.0)], "lon double, lat double")
    for forward, inverse in ((P.utm_forward, P.utm_inverse), (P.equal_area_forward, P.equal_area_inverse)):
        there = points.withColumn("p", forward(F.col("lon"), F.col("lat")))
        for r in there.withColumn("b", inverse(F.col("p.x"), F.col("p.y"))).collect():
            assert r.b.x == pytest.approx(r.lon, abs=1e-7) and r.b.y == pytest.approx(r.lat, abs=1e-7)
    origin = one(spark, P.utm_forward(F.lit(39.0), F.lit(0.0)))
    assert (origin.x, origin.y) == (500000.0, 0.0)
    edge = one(spark, P.equal_area_forward(F.lit(180.0), F.lit(0.0)))
    assert edge.x == pytest.approx(17367530.45, abs=0.01)
    shifted = one(spark, P.to_lonlat(F.lit(500000.0), F.lit(1400000.0), 20137))
    plain = one(spark, P.to_lonlat(F.lit(500000.0), F.lit(1400000.0), 32637))
    assert 50 < math.hypot((shifted.x - plain.x) * 108000, (shifted.y - plain.y) * 110600) < 300


def test_latitudes_beyond_a_pole_come_back_on_their_turn(spark):
    """at 60 times the data roads reach latitudes beyond 90; the inverse alone gave their mirror image."""
    points = spark.createDataFrame([(36.7, lat) for lat in (-200.0, -100.25, -89.5, 12.3, 89.9975, 90.0025, 180.5, 251.9, 300.0)], "lon double, lat double")
    u = points.withColumn("u", P.utm_forward(F.col("lon"), F.col("lat")))
    for r in u.withColumn("back", P.unfolded(P.utm_inverse(F.col("u.x"), F.col("u.y"))["y"], F.col("lat"))).collect():
        assert r.back == pytest.approx(r.lat, abs=5e-7)


def test_bounds_flag_order(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (4326, 200.0, 0.0, 190.0, 1.0, "INVERTED_BOUNDS"), (4326, 0.0, 0.0, 190.0, 1.0, "OUT_OF_RANGE_FOR_4326"), (None, 1.0, 1.0, 2.0, 2.0, "CRS_MISSING_BUT_BOUNDS_LOOK_GEOGRAPHIC"),
        (32637, 0.0, 0.0, 2e8, 1.0, "ABSURD_MAGNITUDE_BOUNDS"), (4326, nan, 0.0, 1.0, 1.0, "NONFINITE_BOUNDS"), (4326, -inf, 0.0, 1.0, 1.0, "NONFINITE_BOUNDS"),
        (4326, 1.0, 1.0, 1.0, 1.0, "ZERO_EXTENT"), (4326, None, None, None, None, "NO_BOUNDS"), (32637, 1.0, 1.0, 5e5, 1e6, None), (None, 0.0, 0.0, 5e5, 1e6, None),
    ]
    df = spark.createDataFrame([r[:5] for r in rows], "crs int, xmin double, ymin double, xmax double, ymax double")
    assert [r.f for r in df.select(L.bounds_flag(F.col("crs")).alias("f")).collect()] == [r[5] for r in rows]


def test_epsg_text(spark):
    df = spark.createDataFrame([("32637",), (" epsg:4326 ",), ("EPSG: 20137",), ("x",), (None,)], "t string")
    assert [r.e for r in df.select(T.epsg_code(F.col("t")).alias("e")).collect()] == [32637, 4326, 20137, None, None]


def test_index_name_equals_python(spark, tables):
    texts = ["  Ｆｕｌｌ　Width ", "Ångström  Ⅳ", "plain  Name", "ﬁne", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = lambda t: None if t is None else " ".join(unicodedata.normalize("NFKD", t).lower().strip().split())
    assert [r.n for r in df.select(T.index_name(F.col("t")).alias("n")).collect()] == [plain(t) for t in texts]


def test_manifest_and_configuration_rules(spark):
    missing = one(spark, Q.missing_members(F.lit('{"run_id":1}'), ["run_id", "status", "method"]))
    assert missing == ["method", "status"]
    bad = spark.createDataFrame([(1, '{"monthly_profiles":[1],"factors":[],"priority_rules":[1]}'), (2, "not json")], "id int, configuration string")
    found = {(r.id, r.rule) for r in Q.check_rows(bad, Q.configuration_rules(), ["id"]).collect()}
    assert (1, "monthly_profiles") in found and (1, "factors_or_rules_empty") in found and (2, "monthly_profiles") in found


def test_rainfall_artifact_rules_fail_closed(spark):
    rows = [("area-1", 1.0, 5.0, "typical_range", 3, 100.0, "ok"), ("bad", None, None, "odd", -1, 101.0, "ok")]
    df = spark.createDataFrame(rows, "area_id string, rainfall_mm double, percentile double, condition_class string, grid_cell_count int, coverage_pct double, quality_status string")
    found = Q.check_rows(df, Q.rainfall_rules("area-"), ["area_id"])
    assert {r.rule for r in found.collect()} == {"area_id_prefix", "coverage_range", "cell_count", "condition_class", "ok_but_incomplete"}
    with pytest.raises(ValueError):
        Q.require_empty(found, "artifact")
    Q.require_empty(found.where("area_id = 'area-1'"), "artifact")
