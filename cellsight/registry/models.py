"""Priority, scenario, skill, readiness and outlook queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellsight.functions import classes as C
from cellsight.operators import quality as Q
from cellsight.operators.runs import quality_summary, run_inventory
from cellsight.plans import priority as P
from cellsight.plans import readiness as RD
from cellsight.plans import scenario as S
from cellsight.plans import skill as K
from cellsight.registry import query
from cellsight.registry.inputs import AREAS_SQL, EVIDENCE_SQL, RUNS_SQL, with_

# ---- priority: rainfall evidence per (month run, area), exposure from customer and orders

RAIN_SQL = """rain AS (SELECT 'rain-' || strftime(l_shipdate, '%Y-%m') AS run_id, 'area-' || l_suppkey AS area_id, avg(l_quantity) * 2 AS percentile, count(*) AS lines,
    80.0::DOUBLE + 2 * min(l_linenumber) AS coverage_pct, CASE WHEN min(l_returnflag) = 'R' THEN 'insufficient_grid_coverage' ELSE 'ok' END AS quality_status
  FROM lineitem GROUP BY 1, 2)"""
EXPOSURE_SQL = """exposure AS (SELECT 'area-' || (c_custkey % (SELECT count(*) FROM supplier)) AS area_id, sum(c_acctbal) AS population_total, 100.0::DOUBLE * count(*) FILTER (WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')) / count(*) AS cropland_pct,
    CASE WHEN min(c_custkey) % 12 = 0 THEN 'insufficient_coverage' ELSE 'ok' END AS quality_status FROM customer GROUP BY 1),
population AS (SELECT area_id, ntile(10) OVER (ORDER BY round(population_total, 2), md5(area_id), area_id) AS population_decile FROM exposure WHERE quality_status = 'ok'),
cropland AS (SELECT area_id, ntile(10) OVER (ORDER BY cropland_pct, md5(area_id), area_id) AS cropland_decile FROM exposure WHERE quality_status = 'ok'),
road AS (SELECT 'area-' || s_suppkey AS area_id, (s_suppkey * 97) % 9000 * 1.0 AS nearest_road_m, CASE WHEN s_suppkey % 8 = 0 THEN 'unavailable' ELSE 'ok' END AS road_quality FROM supplier WHERE s_suppkey % 5 <> 0)"""
ASSESS_SQL = """ev AS (SELECT r.*, population_decile, cropland_decile, nearest_road_m, road_quality FROM rain r LEFT JOIN population USING (area_id) LEFT JOIN cropland USING (area_id) LEFT JOIN road USING (area_id)),
gate AS (SELECT *, quality_status <> 'ok' OR coverage_pct < 84 OR percentile IS NULL AS closed, coalesce(population_decile, 0) >= 7 OR coalesce(cropland_decile, 0) >= 7 AS exposed FROM ev),
assessed AS (SELECT *,
    CASE WHEN closed THEN 'unavailable' WHEN percentile <= 10 THEN 'very_low' WHEN percentile <= 20 THEN 'low' WHEN percentile <= 33 THEN 'watch' ELSE 'no_signal' END AS rainfall_band,
    CASE WHEN road_quality <> 'ok' THEN 'unavailable' WHEN nearest_road_m < 900 THEN 'near' WHEN nearest_road_m < 5500 THEN 'intermediate' ELSE 'far' END AS road_context,
    CASE WHEN quality_status = 'ok' AND coverage_pct >= 84 THEN 'eligible_for_review' WHEN quality_status = 'ok' THEN 'insufficient_coverage' ELSE 'unavailable' END AS evidence_state,
    CASE WHEN closed THEN 'insufficient_evidence' WHEN percentile <= 10 AND exposed THEN 'critical' WHEN percentile <= 20 AND exposed THEN 'high' WHEN percentile <= 33 THEN 'moderate' ELSE 'watch' END AS priority_class
  FROM gate)"""
PRIORITY = (RAIN_SQL, EXPOSURE_SQL, ASSESS_SQL)
GATE = 84.0


def rainfall_rows(t):
    li = t.raw("lineitem")
    quality = F.when(F.min("l_returnflag") == "R", "insufficient_grid_coverage").otherwise("ok")
    return li.groupBy(F.concat(F.lit("rain-"), F.date_format("l_shipdate", "yyyy-MM")).alias("run_id"), F.concat(F.lit("area-"), "l_suppkey").alias("area_id")).agg(
        (F.avg("l_quantity") * 2).alias("percentile"), F.count(F.lit(1)).alias("lines"), (80.0 + 2 * F.min("l_linenumber")).alias("coverage_pct"), quality.alias("quality_status")
    )


def exposure_rows(t):
    c = t.raw("customer")
    suppliers = t.raw("supplier").agg(F.count(F.lit(1)).alias("n")).scalar()
    crop = F.count_if(F.col("c_mktsegment").isin("BUILDING", "FURNITURE"))
    return c.groupBy(F.concat(F.lit("area-"), F.col("c_custkey") % suppliers).alias("area_id")).agg(
        F.round(F.sum("c_acctbal"), 2).alias("population_total"), (F.lit(100.0) * crop / F.count(F.lit(1))).alias("cropland_pct"),
        F.when(F.min("c_custkey") % 12 == 0, "insufficient_coverage").otherwise("ok").alias("quality_status"),
    )


def road_rows(t):
    s = t.raw("supplier").where("s_suppkey % 5 <> 0")
    key = F.col("s_suppkey")
    return s.select(F.concat(F.lit("area-"), key).alias("area_id"), ((key * 97) % 9000 * 1.0).alias("nearest_road_m"), F.when(key % 8 == 0, "unavailable").otherwise("ok").alias("quality_status"))


def assessments(t):
    exposure = exposure_rows(t)
    population = P.exposure_deciles(exposure, "population_total", "population_decile")
    cropland = P.exposure_deciles(exposure, "cropland_pct", "cropland_decile")
    return P.assess(P.with_exposure(rainfall_rows(t), population, cropland, road_rows(t)), GATE)


def _rank_case(values: dict[str, object]) -> str:
    quote = lambda v: str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return "CASE priority_class " + " ".join(f"WHEN '{k}' THEN {quote(v)}" for k, v in values.items()) + " END"


@query(
    "priority_assessment",
    with_(
        *PRIORITY,
        then=f"""SELECT run_id, area_id, rainfall_band, population_decile, cropland_decile, road_context, evidence_state, priority_class, {_rank_case({k: v[0] for k, v in P.LEVELS.items()})} AS priority_rank,
        {_rank_case({k: v[1] for k, v in P.LEVELS.items()})} AS planning_action,
        {_rank_case({k: v[2] for k, v in P.LEVELS.items()})} || ' | ' || CASE WHEN road_quality = 'ok' AND nearest_road_m >= 5500 THEN '{P.ROAD_RULES['far']}' WHEN road_quality = 'ok' THEN '{P.ROAD_RULES['near']}' ELSE '{P.ROAD_RULES['none']}' END AS triggered_rules,
        road_quality = 'ok' AS accessibility_available FROM assessed""",
    ),
)
def priority_assessment(t):
    return assessments(t).select(
        "run_id", "area_id", "rainfall_band", "population_decile", "cropland_decile", "road_context", "evidence_state", "priority_class", "priority_rank", "planning_action",
        F.array_join("triggered_rules", " | ").alias("triggered_rules"), F.col("input_quality.accessibility_available").alias("accessibility_available"),
    )


ROLLUP_SQL = ", ".join(f"count(*) FILTER (WHERE priority_class = '{c}') AS {c}" for c in P.CLASSES)


@query("priority_rollup", with_(*PRIORITY, then=f"SELECT run_id, count(*) AS areas, {ROLLUP_SQL} FROM assessed GROUP BY 1"))
def priority_rollup(t):
    return P.class_rollup(assessments(t), ["run_id"])


@query(
    "calibration_preview",
    with_(
        *PRIORITY,
        then="""SELECT 'preview-' || run_id AS snapshot_id, strftime(CAST(substr(run_id, 6) || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m-%d') AS valid_from, count(*) AS areas,
        count(*) FILTER (WHERE evidence_state = 'eligible_for_review') AS eligible_for_review, count(*) FILTER (WHERE rainfall_band = 'very_low') AS very_low, count(*) FILTER (WHERE rainfall_band = 'low') AS low, count(*) FILTER (WHERE rainfall_band = 'watch') AS watch
        FROM assessed GROUP BY run_id""",
    ),
)
def calibration_preview(t):
    rolled = P.preview_rollup(assessments(t), ["run_id"])
    months = rolled.select("run_id", F.to_date(F.concat(F.substring("run_id", 6, 7), F.lit("-01"))).alias("source_latest_month"))
    joined = rolled.join(P.preview_snapshots(months), "run_id")
    return joined.select("snapshot_id", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), "areas", "eligible_for_review", "very_low", "low", "watch")


@query(
    "public_replay",
    with_(
        *PRIORITY,
        then=f"""SELECT run_id, retrospective_draft_code, count(*) AS features, min(interpretation_note) AS note FROM (SELECT run_id, CASE priority_class WHEN 'critical' THEN 'C1' WHEN 'high' THEN 'C2' WHEN 'moderate' THEN 'C3' WHEN 'watch' THEN 'C4' ELSE 'insufficient-evidence' END AS retrospective_draft_code, '{P.PUBLIC_NOTE}' AS interpretation_note FROM assessed) r GROUP BY 1, 2""",
    ),
)
def public_replay(t):
    named = assessments(t)
    public = P.public_replay(named.withColumn("name_en", F.col("run_id")))
    return public.groupBy(F.col("name_en").alias("run_id"), "retrospective_draft_code").agg(F.count(F.lit(1)).alias("features"), F.min("interpretation_note").alias("note"))


@query("public_replay_index", with_(*PRIORITY, then="SELECT run_id, count(*) AS areas, count(*) FILTER (WHERE priority_class = 'critical') AS \"C1\", count(*) FILTER (WHERE priority_class = 'high') AS \"C2\", count(*) FILTER (WHERE priority_class = 'moderate') AS \"C3\", count(*) FILTER (WHERE priority_class = 'watch') AS \"C4\", count(*) FILTER (WHERE priority_class = 'insufficient_evidence') AS insufficient_evidence FROM assessed GROUP BY 1"))
def public_replay_index(t):
    return P.public_replay_index(P.class_rollup(assessments(t), ["run_id"]), ["run_id"])


# ---- scenario

SCENARIO_SQL = """yearly AS (SELECT 'area-' || l_suppkey AS area_id, year(l_shipdate) AS yr, avg(l_quantity) AS q, avg(l_linenumber) AS w, min(l_returnflag) AS rf FROM lineitem WHERE month(l_shipdate) = 8 GROUP BY 1, 2),
refs AS (SELECT area_id, quantile_cont(q, 0.5) AS qm, quantile_cont(w, 0.5) AS wm, count(*) AS n FROM yearly WHERE yr < 2001 GROUP BY 1),
packet AS (SELECT a.area_id, a.area_key, y.q * 2 AS rainfall_percentile, y.q AS ndvi_value, r.qm AS ndvi_median_value, CASE WHEN r.qm > 0 THEN 100 * (y.q - r.qm) / r.qm END AS ndvi_deviation_pct, r.n AS ndvi_valid_year_count,
    y.w AS wapor_value, r.wm AS wapor_median_value, CASE WHEN r.wm > 0 THEN 100 * (y.w - r.wm) / r.wm END AS wapor_deviation_pct
  FROM areas a LEFT JOIN yearly y ON y.area_id = a.area_id AND y.yr = 2001 LEFT JOIN refs r ON r.area_id = a.area_id)"""


def scenario_packet(t):
    li = t.raw("lineitem").where("month(l_shipdate) = 8")
    yearly = li.groupBy(F.concat(F.lit("area-"), "l_suppkey").alias("area_id"), F.year("l_shipdate").alias("yr")).agg(F.avg("l_quantity").alias("q"), F.avg("l_linenumber").alias("w"))
    now = yearly.where("yr = 2001").withColumn("quality_status", F.lit("ok"))
    # one value per year, so the built-in percentile holds a handful of values per area
    reference = lambda c: yearly.where("yr < 2001").groupBy("area_id").agg(F.percentile(c, F.lit(0.5)).alias("median_value"), F.count(F.lit(1)).alias("valid_year_count"))
    rain = now.select("area_id", F.col("q").alias("rainfall_mm"), (F.col("q") * 2).alias("percentile"), "quality_status")
    side = lambda c: now.select("area_id", F.col(c).alias("value"), "quality_status")
    return S.packet(t.areas().select("area_id", "area_key"), rain, side("q"), side("w"), reference("q"), reference("w"))


@query(
    "scenario_packet",
    with_(AREAS_SQL, SCENARIO_SQL, then="SELECT area_id, round(rainfall_percentile, 8) AS rainfall_percentile, round(ndvi_deviation_pct, 6) AS ndvi_deviation_pct, ndvi_valid_year_count, round(wapor_deviation_pct, 6) AS wapor_deviation_pct FROM packet"),
)
def scenario_packet_query(t):
    r = lambda c, n: F.round(c, n).alias(c)
    return scenario_packet(t).select("area_id", r("rainfall_percentile", 8), r("ndvi_deviation_pct", 6), "ndvi_valid_year_count", r("wapor_deviation_pct", 6))


FINDING_SQL = """st AS (SELECT *, CASE area_key % 3 WHEN 0 THEN 'rainfall' WHEN 1 THEN 'either' ELSE 'both' END AS logic, CASE WHEN area_key % 11 = 0 THEN '' WHEN area_key % 11 = 1 THEN 'withheld' ELSE 'cleared' END AS category,
    CASE WHEN area_key % 7 = 0 THEN 'X' ELSE 'Reviewer' END AS reviewer, coalesce(rainfall_percentile <= 48, false) AS rain, coalesce(ndvi_deviation_pct <= -5, false) AS nd, coalesce(wapor_deviation_pct <= -5, false) AS wa FROM packet)"""


@query(
    "scenario_findings",
    with_(
        AREAS_SQL, SCENARIO_SQL, FINDING_SQL,
        then="""SELECT area_id, CASE WHEN coalesce(ndvi_valid_year_count, 0) < 6 THEN 'Insufficient reference evidence' WHEN category = '' THEN 'Withheld pending confounder review' WHEN category <> 'cleared' THEN 'Withheld pending confounder resolution'
          WHEN length(reviewer) < 2 THEN 'Blocked pending reviewer record' WHEN rain AND logic = 'rainfall' THEN 'Rainfall-only discussion signal'
          WHEN rain AND ((logic = 'both' AND nd AND wa) OR (logic = 'either' AND (nd OR wa))) THEN 'Rainfall + land-surface signals agree (not independent)' WHEN rain THEN 'Rainfall signal without land-surface agreement'
          WHEN nd OR wa THEN 'Land-surface divergence to review' ELSE 'No selected discussion trigger' END AS finding FROM st""",
    ),
)
def scenario_findings(t):
    key = F.col("area_key")
    cases = (
        scenario_packet(t)
        .withColumn("rainfall_limit", F.lit(48.0)).withColumn("ndvi_limit", F.lit(-5.0)).withColumn("wapor_limit", F.lit(-5.0))
        .withColumn("logic", F.when(key % 3 == 0, "rainfall").when(key % 3 == 1, "either").otherwise("both"))
        .withColumn("category", F.when(key % 11 == 0, "").when(key % 11 == 1, "withheld").otherwise("cleared"))
        .withColumn("reviewer", F.when(key % 7 == 0, "X").otherwise("Reviewer")).withColumn("note", F.lit("documented locally"))
    )
    return S.finding(cases).select("area_id", "finding")


# ---- skill

SKILL_SQL = """mem AS (SELECT l_suppkey % 5 AS region, CASE l_linestatus WHEN 'O' THEN 1 ELSE 2 END AS lead, year(l_shipdate) AS yr, l_linenumber AS member, avg(l_quantity) AS depth FROM lineitem GROUP BY 1, 2, 3, 4),
obs AS (SELECT l_suppkey % 5 AS region, year(l_shipdate) AS yr, avg(l_quantity + l_linenumber) AS observed FROM lineitem GROUP BY 1, 2),
rec AS (SELECT region, lead, yr, observed, avg(depth) AS mean_mm, stddev_pop(depth) AS spread_mm FROM mem JOIN obs USING (region, yr) GROUP BY 1, 2, 3, 4),
cuts AS (SELECT a.region, a.lead, a.yr, a.observed, quantile_cont(b.observed, 1.0/3) AS ol, quantile_cont(b.observed, 2.0/3) AS oh, quantile_cont(b.mean_mm, 1.0/3) AS ml, quantile_cont(b.mean_mm, 2.0/3) AS mh
  FROM rec a JOIN rec b ON a.region = b.region AND a.lead = b.lead AND a.yr <> b.yr GROUP BY 1, 2, 3, 4),
clim AS (SELECT c.region, c.lead, c.yr, avg(CASE WHEN b.observed < ol THEN 1.0 ELSE 0 END) AS cb, avg(CASE WHEN b.observed > oh THEN 1.0 ELSE 0 END) AS ca FROM cuts c JOIN rec b ON c.region = b.region AND c.lead = b.lead AND c.yr <> b.yr GROUP BY 1, 2, 3),
prob AS (SELECT c.region, c.lead, c.yr, avg(CASE WHEN depth < ml THEN 1.0 ELSE 0 END) AS pb, avg(CASE WHEN depth > mh THEN 1.0 ELSE 0 END) AS pa FROM cuts c JOIN mem m ON c.region = m.region AND c.lead = m.lead AND c.yr = m.yr GROUP BY 1, 2, 3),
cs AS (SELECT region, lead, category, CASE category WHEN 'below' THEN pb WHEN 'above' THEN pa ELSE 1 - pb - pa END AS p, CASE category WHEN 'below' THEN cb WHEN 'above' THEN ca ELSE 1 - cb - ca END AS r,
  CASE WHEN (CASE WHEN observed < ol THEN 'below' WHEN observed > oh THEN 'above' ELSE 'near' END) = category THEN 1.0 ELSE 0.0 END AS e
  FROM cuts JOIN clim USING (region, lead, yr) JOIN prob USING (region, lead, yr) CROSS JOIN (VALUES ('below'), ('near'), ('above')) v(category)),
sk AS (SELECT region, lead, category, count(*) AS years, avg((p - e) * (p - e)) AS bs, avg((r - e) * (r - e)) AS cbs FROM cs GROUP BY 1, 2, 3)"""


def skill(t):
    return K.tercile_skill(skill_records(t), ["region", "lead"])


def skill_records(t):
    li = t.raw("lineitem")
    region, year = (F.col("l_suppkey") % 5).alias("region"), F.year("l_shipdate").alias("year")
    lead = F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("lead")
    members = li.groupBy(region, lead, year, F.col("l_linenumber").alias("member")).agg(F.avg("l_quantity").alias("depth"))
    observed = li.groupBy(region, year).agg(F.avg(F.col("l_quantity") + F.col("l_linenumber")).alias("observed_mm"))
    return K.skill_records(members, observed, ["region", "lead"])


@query("skill_records", with_(SKILL_SQL, then="SELECT region, lead, yr AS year, round(observed, 6) AS observed_mm, round(mean_mm, 6) AS ensemble_mean_mm, round(spread_mm, 6) AS ensemble_spread_mm FROM rec"))
def skill_records_query(t):
    r = lambda c: F.round(c, 6).alias(c)
    return skill_records(t).select("region", "lead", "year", r("observed_mm"), r("ensemble_mean_mm"), r("ensemble_spread_mm"))


@query(
    "forecast_skill",
    with_(SKILL_SQL, then="SELECT region, lead, category, years, round(bs, 6) AS brier_score, round(cbs, 6) AS climatology_brier_score, round(CASE WHEN cbs > 0 THEN 1 - bs / cbs END, 6) AS brier_skill_score FROM sk"),
)
def forecast_skill(t):
    r = lambda c: F.round(c, 6).alias(c)
    return skill(t).select("region", "lead", "category", "years", r("brier_score"), r("climatology_brier_score"), r("brier_skill_score"))


@query(
    "lead_comparison",
    with_(SKILL_SQL, then="SELECT region, category, round(max(CASE WHEN lead = 1 THEN 1 - bs / cbs END), 6) AS lead_1, round(max(CASE WHEN lead = 2 THEN 1 - bs / cbs END), 6) AS lead_2 FROM sk GROUP BY 1, 2"),
)
def lead_comparison(t):
    out = K.lead_comparison(skill(t), ["region"], "lead", [1, 2])
    return out.select("region", "category", F.round("lead_1", 6).alias("lead_1"), F.round("lead_2", 6).alias("lead_2"))


# ---- readiness: every order is the latest run of one source

READY_SQL = """counts AS (SELECT run_id, count(*) AS areas, count(*) FILTER (WHERE quality_status = 'ok') AS usable_areas, coalesce(round(avg(coverage_pct), 2), 0) AS mean_coverage_pct FROM evidence GROUP BY 1),
src AS (SELECT r.run_id, r.indicator AS source_id, CASE WHEN r.status = 'validated' AND season_size = 3 THEN 'failed' ELSE r.status END AS run_status, date_diff('day', CAST(obs_end AS DATE), DATE '2001-08-15') AS age_days,
    CASE indicator WHEN 'rainfall' THEN 900 WHEN 'ndvi' THEN 400 END AS freshness_days, areas, usable_areas, mean_coverage_pct, boundary_set_version, CASE WHEN indicator IN ('ndvi', 'wapor') THEN season_size <> 1 END AS baseline_ready,
    indicator IN ('rainfall', 'ndvi') AS required, CAST(substr(r.run_id, 5) AS BIGINT) % 40 AS grp FROM runs r LEFT JOIN counts c ON c.run_id = r.run_id),
rs AS (SELECT *, CASE WHEN run_status IN ('failed', 'degraded') THEN 'Latest run is ' || run_status || '.' END AS r1, CASE WHEN age_days > freshness_days THEN 'Observation is older than the ' || freshness_days || '-day freshness policy.' END AS r2,
    CASE WHEN areas = 0 OR usable_areas = 0 THEN 'No area summaries meet the source quality rule.' END AS r3, CASE WHEN areas < 3 THEN 'Only ' || areas || ' of 3 canonical areas have a source summary.' END AS r4,
    CASE WHEN areas > 0 AND mean_coverage_pct < 90 THEN 'Mean area coverage is below the readiness policy.' END AS r5, CASE WHEN boundary_set_version <> 'areas-v1' THEN 'Boundary-set version does not match the current model contract.' END AS r6,
    CASE WHEN NOT baseline_ready THEN 'A validated seasonal baseline is not available.' END AS r7 FROM src),
states AS (SELECT *, concat_ws(' ', r1, r2, r3, r4, r5, r6, r7) AS reasons, CASE WHEN coalesce(r1, r2, r3, r4, r5, r6, r7) IS NULL THEN 'usable' WHEN run_status = 'degraded' THEN 'degraded' WHEN coalesce(age_days > freshness_days, false) THEN 'stale' ELSE 'incomplete' END AS state FROM rs)"""


def source_states(t):
    counts = quality_summary(t.evidence(), ["run_id"])
    runs = t.runs()
    status = F.when((F.col("status") == "validated") & (F.size("season_months") == 3), "failed").otherwise(F.col("status"))
    sources = runs.join(counts, "run_id", "left").select(
        "run_id", F.col("indicator").alias("source_id"), status.alias("run_status"), F.to_date("obs_end").alias("observation_date"),
        F.when(F.col("indicator") == "rainfall", 900).when(F.col("indicator") == "ndvi", 400).alias("freshness_days"),
        "areas", "usable_areas", "mean_coverage_pct", "boundary_set_version", F.when(F.col("indicator").isin("ndvi", "wapor"), F.size("season_months") != 1).alias("baseline_ready"),
        F.lit(3).alias("expected_areas"), F.col("indicator").isin("rainfall", "ndvi").alias("required_for_draft"), (F.substring("run_id", 5, 20).cast("long") % 40).alias("grp"),
    )
    return RD.source_states(sources, F.lit("2001-08-15").cast("date"), "areas-v1")


@query("source_readiness", with_(EVIDENCE_SQL, RUNS_SQL, READY_SQL, then="SELECT run_id, source_id, age_days, reasons, state FROM states"))
def source_readiness(t):
    return source_states(t).select("run_id", "source_id", F.col("age_days").cast("long").alias("age_days"), F.array_join("reasons", " ").alias("reasons"), "state")


@query(
    "readiness_decision",
    with_(
        EVIDENCE_SQL, RUNS_SQL, READY_SQL,
        "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp, source_id ORDER BY age_days, run_id DESC) AS rn FROM states) s WHERE rn = 1)",
        then="""SELECT grp, CASE WHEN bool_or(required AND state <> 'usable') THEN 'not_ready' ELSE 'draft_evidence_only' END AS status, NOT bool_or(required AND state <> 'usable') AS draft_matrix_allowed,
        CASE WHEN bool_or(source_id IN ('ndvi', 'wapor') AND state <> 'usable') THEN 'Watch' ELSE 'Not evaluated' END AS maximum_class, count(*) FILTER (WHERE required AND state <> 'usable') AS required_failures,
        coalesce(string_agg(concat_ws(' ', source_id || ': ' || r1, source_id || ': ' || r2, source_id || ': ' || r3, source_id || ': ' || r4, source_id || ': ' || r5, source_id || ': ' || r6, source_id || ': ' || r7), ' ' ORDER BY source_id) FILTER (WHERE required AND state <> 'usable'), '') AS reasons FROM latest GROUP BY 1""",
    ),
)
def readiness_decision(t):
    from cellsight.operators.runs import latest_by

    latest = latest_by(source_states(t), ["grp", "source_id"], [-F.col("age_days"), F.col("run_id")])
    return RD.decision(latest, ["ndvi", "wapor"], ["grp"]).withColumn("reasons", F.array_join("reasons", " "))


@query(
    "probe_states",
    with_(
        EVIDENCE_SQL, RUNS_SQL,
        then="""SELECT run_id, CASE WHEN o % 15 = 0 THEN 'unavailable' WHEN age > 700 THEN 'degraded' WHEN run_id IN (SELECT run_id FROM evidence WHERE value > 30) THEN 'current' ELSE 'ready' END AS probe_state, CASE WHEN age <= 700 THEN 'development' ELSE 'degraded' END AS run_status
        FROM (SELECT run_id, CAST(substr(run_id, 5) AS BIGINT) AS o, date_diff('day', CAST(obs_end AS DATE), DATE '2001-08-15') AS age FROM runs) r""",
    ),
)
def probe_states(t):
    age = F.datediff(F.lit("2001-08-15").cast("date"), F.to_date("obs_end"))
    stamp = F.when(F.substring("run_id", 5, 20).cast("long") % 15 != 0, F.col("obs_end"))
    latest = t.runs().select("run_id", stamp.alias("stamp"), age.alias("age_days"), F.lit(700).alias("max_age_days"))
    out = RD.probe_states(latest, t.evidence().where("value > 30"))
    return out.select("run_id", "probe_state", RD.run_status(F.col("age_days"), F.col("max_age_days")).alias("run_status"))


# ---- outlook and provider context


@query(
    "outlook_categories",
    """WITH p AS (SELECT l_orderkey, l_linenumber, CAST(l_discount * 10 AS DECIMAL(5,4)) AS b, CASE WHEN l_linenumber <> 3 THEN CAST(l_tax * 10 AS DECIMAL(5,4)) END AS n, CAST(round(l_quantity / 50, 4) AS DECIMAL(5,4)) AS a FROM lineitem),
    g AS (SELECT *, greatest(b, n, a) AS top FROM p)
    SELECT CASE WHEN b = top THEN 'Below normal' WHEN n = top THEN 'Near normal' ELSE 'Above normal' END AS category,
      CAST(CASE WHEN top < 0.40 THEN 0.32 WHEN top < 0.50 THEN 0.48 WHEN top < 0.60 THEN 0.65 WHEN top < 0.70 THEN 0.80 ELSE 0.92 END AS DOUBLE) AS opacity, count(*) AS features FROM g GROUP BY 1, 2""",
)
def outlook_categories(t):
    li = t.raw("lineitem")
    d = lambda c: c.cast("decimal(5,4)")
    out = C.outlook_category(d(F.col("l_discount") * 10), F.when(F.col("l_linenumber") != 3, d(F.col("l_tax") * 10)), d(F.round(F.col("l_quantity") / 50, 4)))
    chosen = li.select(out.alias("o")).select("o.category", C.opacity(F.col("o.probability")).alias("opacity"))
    return chosen.groupBy("category", "opacity").agg(F.count(F.lit(1)).alias("features"))


@query(
    "provider_context",
    """WITH e AS (SELECT event_id, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INTEGER) AS k, ts FROM events)
    SELECT CASE WHEN k % 7 = 6 THEN '' ELSE CAST(k % 7 AS VARCHAR) END AS value,
      CASE k % 7 WHEN 1 THEN 'Minimal' WHEN 2 THEN 'Stressed' WHEN 3 THEN 'Crisis' WHEN 4 THEN 'Emergency' WHEN 5 THEN 'Catastrophe' WHEN 6 THEN 'Classification not supplied' ELSE 'Provider classification' END AS label,
      CASE k % 3 WHEN 0 THEN 'Current assessment' WHEN 1 THEN 'Projected assessment' ELSE 'Assessment type not supplied' END AS scenario, count(*) AS features FROM e GROUP BY 1, 2, 3""",
)
def provider_context(t):
    k = F.get_json_object("props", "$.k").cast("int")
    phase = F.when(k % 7 != 6, (k % 7).cast("string"))
    scenario = F.when(k % 3 == 0, "ML1").when(k % 3 == 1, "ML2")
    properties = F.to_json(F.struct(F.when(k % 2 == 0, phase).alias("ipc_phase"), F.when(k % 2 != 0, phase).alias("classification"), scenario.alias("scenario")))
    context = C.provider_context(t.raw("events").select(properties.alias("properties")))
    return context.groupBy("value", "label", "scenario").agg(F.count(F.lit(1)).alias("features"))


@query(
    "outlook_violations",
    """SELECT rule, count(*) AS rows FROM (SELECT CASE WHEN l_quantity / 48 > 1 THEN 'above_normal_probability_range' END AS rule FROM lineitem UNION ALL SELECT CASE WHEN l_linenumber > 5 THEN 'validity_order' END FROM lineitem) v WHERE rule IS NOT NULL GROUP BY 1""",
)
def outlook_violations(t):
    li = t.raw("lineitem")
    rows = li.select(
        "l_orderkey", (F.col("l_discount")).alias("below_normal_probability"), F.col("l_tax").alias("near_normal_probability"), (F.col("l_quantity") / 48).alias("above_normal_probability"),
        F.lit(90.0).alias("coverage_pct"), F.col("l_shipdate").alias("valid_from"), F.when(F.col("l_linenumber") > 5, F.date_sub("l_shipdate", 1)).otherwise(F.to_date("l_shipdate")).alias("valid_to"),
    )
    return Q.check_rows(rows, Q.outlook_rules(), ["l_orderkey"]).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "configuration_violations",
    """SELECT o_orderkey, rule FROM (SELECT o_orderkey, CASE WHEN 11 + o_orderkey % 3 <> 12 THEN 'monthly_profiles' END AS rule FROM orders UNION ALL SELECT o_orderkey, CASE WHEN o_custkey % 20 = 0 THEN 'factors_or_rules_empty' END FROM orders
       UNION ALL SELECT o_orderkey, CASE WHEN o_custkey % 20 > 16 THEN 'matrix_too_large' END FROM orders) v WHERE rule IS NOT NULL""",
)
def configuration_violations(t):
    times = lambda n: F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit("1"), n.cast("int")), ","), F.lit("]"))
    o = t.raw("orders")
    document = F.concat(
        F.lit('{"monthly_profiles":'), times(F.col("o_orderkey") % 3 + 11), F.lit(',"factors":'), times(F.col("o_custkey") % 20), F.lit(',"priority_rules":[1,2]}')
    )
    return Q.check_rows(o.select("o_orderkey", document.alias("configuration")), Q.configuration_rules(), ["o_orderkey"])
