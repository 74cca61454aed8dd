"""Run, evidence, baseline, window and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellsight.functions import dates as D
from cellsight.functions.numeric import sql_round
from cellsight.operators import baseline as B
from cellsight.operators import nearest as N
from cellsight.operators import quality as Q
from cellsight.operators import ranking as R
from cellsight.operators import runs as U
from cellsight.registry import query
from cellsight.registry.inputs import AREAS_SQL, EVIDENCE_SQL, RUNS_SQL, with_

EV = (EVIDENCE_SQL, RUNS_SQL)
YEARS = (1995, 2001)
DAY = "yyyy-MM-dd"

# ---- filters


@query(
    "history_allowed_runs",
    with_(
        RUNS_SQL,
        then="SELECT indicator, status, count(*) AS runs FROM runs WHERE (indicator = 'rainfall' AND status IN ('development', 'validated', 'published')) OR (indicator <> 'rainfall' AND status IN ('development', 'degraded')) GROUP BY 1, 2",
    ),
)
def history_allowed_runs(t):
    kept = t.runs().where(U.history_allowed(F.col("indicator"), F.col("status")))
    return kept.groupBy("indicator", "status").agg(F.count(F.lit(1)).alias("runs"))


@query(
    "usable_evidence",
    with_(
        EVIDENCE_SQL,
        then="SELECT area_id, count(*) FILTER (WHERE quality_status = 'ok' AND coverage_pct >= 90 AND value IS NOT NULL) AS usable, count(*) FILTER (WHERE lower(quality_status) IN ('ok', 'validated') AND (coverage_pct IS NULL OR coverage_pct >= 90)) AS releasable FROM evidence GROUP BY 1",
    ),
)
def usable_evidence(t):
    q, c = F.col("quality_status"), F.col("coverage_pct")
    return t.evidence().groupBy("area_id").agg(F.count_if(U.usable(F.col("value"), q, c)).alias("usable"), F.count_if(U.release_usable(q, c)).alias("releasable"))


@query(
    "reference_candidates",
    with_(RUNS_SQL, then="SELECT indicator, count(*) AS candidates FROM runs WHERE candidate_only OR notes LIKE 'Baseline pilot only%' GROUP BY 1"),
)
def reference_candidates(t):
    kept = t.runs().where(U.reference_candidate(F.col("candidate_only"), F.col("notes")))
    return kept.groupBy("indicator").agg(F.count(F.lit(1)).alias("candidates"))


@query(
    "json_predicates",
    "SELECT event_type, count(*) FILTER (WHERE CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS INTEGER) = 7) AS sevens, count(*) AS events FROM events GROUP BY 1",
)
def json_predicates(t):
    return t.raw("events").groupBy("event_type").agg(F.count_if(U.json_contains(F.col("props"), {"k": "7"})).alias("sevens"), F.count(F.lit(1)).alias("events"))


@query("table_text_filter", with_(AREAS_SQL, then="SELECT area_id, name_en, district_en FROM areas WHERE contains(lower(name_en || ' ' || district_en), '7 nation_1')"))
def table_text_filter(t):
    a = t.areas()
    return a.where(U.names_contain(" 7 Nation_1 ", F.col("name_en"), F.col("district_en"))).select("area_id", "name_en", "district_en")


@query(
    "top_values_report",
    with_(EVIDENCE_SQL, then="SELECT run_id, area_id, value, coverage_pct FROM (SELECT DISTINCT run_id, area_id, value, coverage_pct FROM evidence WHERE quality_status = 'ok') e ORDER BY value DESC, coverage_pct DESC, run_id, area_id LIMIT 50"),
)
def top_values_report(t):
    """User-chosen multi-key order and a bounded result size."""
    rows = t.evidence().where("quality_status = 'ok'").select("run_id", "area_id", "value", "coverage_pct").distinct()
    order = [F.desc_nulls_last("value"), F.desc("coverage_pct"), F.asc("run_id"), F.asc("area_id")]
    return U.bounded_limit(rows, order, 50, most=100)


# ---- latest-of selections


@query(
    "latest_run_per_indicator",
    with_(RUNS_SQL, then="SELECT indicator, run_id, strftime(obs_end, '%Y-%m-%d') AS obs_end FROM (SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY obs_end DESC, created_at DESC, run_id DESC) AS rn FROM runs) r WHERE rn = 1"),
)
def latest_run_per_indicator(t):
    return U.latest_run(t.runs(), ["indicator"]).select("indicator", "run_id", F.date_format("obs_end", DAY).alias("obs_end"))


@query(
    "latest_rainfall_run",
    with_(
        RUNS_SQL,
        then="SELECT status, run_id, CAST(season_size AS INTEGER) AS season_size FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY source_latest_month DESC, season_size DESC, created_at DESC, run_id DESC) AS rn FROM runs) r WHERE rn = 1",
    ),
)
def latest_rainfall_run(t):
    return U.latest_rainfall_run(t.runs(), ["status"]).select("status", "run_id", F.size("season_months").alias("season_size"))


@query(
    "static_runs",
    with_(
        RUNS_SQL,
        then="SELECT indicator, run_id FROM (SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY created_at DESC, run_id DESC) AS rn FROM runs WHERE status IN ('development', 'validated') AND boundary_set_version = 'areas-v1' AND run_id LIKE 'run-1%') r WHERE rn = 1",
    ),
)
def static_runs(t):
    return U.static_run(t.runs(), "areas-v1", "run-1", ["indicator"]).select("indicator", "run_id")


CONFIG_SQL = """config AS (SELECT 'conf-' || o_orderkey AS configuration_id, o_custkey % 50 AS grp, CASE o_orderstatus WHEN 'F' THEN 'draft' WHEN 'O' THEN 'published' ELSE 'retired' END AS status,
  o_orderkey % 20 = 0 AS active_for_review, o_orderkey % 9 AS version, o_orderdate AS created_at FROM orders)"""


def configurations(t):
    o = t.raw("orders")
    status = F.when(F.col("o_orderstatus") == "F", "draft").when(F.col("o_orderstatus") == "O", "published").otherwise("retired")
    return o.select(
        F.concat(F.lit("conf-"), "o_orderkey").alias("configuration_id"), (F.col("o_custkey") % 50).alias("grp"), status.alias("status"),
        (F.col("o_orderkey") % 20 == 0).alias("active_for_review"), (F.col("o_orderkey") % 9).alias("version"), F.col("o_orderdate").alias("created_at"),
    )


@query(
    "active_configuration",
    with_(
        CONFIG_SQL,
        then="""SELECT grp, active_for_review, status, version, strftime(created_at, '%Y-%m-%d') AS created_at FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY active_for_review DESC, CASE status WHEN 'published' THEN 0 ELSE 1 END, version DESC, created_at DESC) AS rn
          FROM config WHERE status IN ('draft', 'published')) c WHERE rn = 1""",
    ),
)
def active_configuration(t):
    out = U.active_configuration(configurations(t), ["grp"])
    return out.select("grp", "active_for_review", "status", "version", F.date_format("created_at", DAY).alias("created_at"))


OUTLOOK_SQL = """outlooks AS (SELECT 'out-' || o_orderkey AS run_id, o_custkey % 20 AS region, CAST(o_orderdate AS DATE) AS valid_from, CAST(o_orderdate AS DATE) + CAST(90 AS INTEGER) AS valid_to,
  CAST(o_orderdate AS TIMESTAMP) - INTERVAL 20 DAY AS issued_at FROM orders),
staged AS (SELECT *, CASE WHEN valid_from > DATE '2000-06-15' THEN 'upcoming' WHEN valid_to < DATE '2000-06-15' THEN 'archived' ELSE 'active' END AS state FROM outlooks)"""
AS_OF = F.to_date


def outlooks(t):
    o = t.raw("orders")
    start = F.to_date("o_orderdate")
    return o.select(
        F.concat(F.lit("out-"), "o_orderkey").alias("run_id"), (F.col("o_custkey") % 20).alias("region"), start.alias("valid_from"), F.date_add(start, 90).alias("valid_to"),
        F.date_sub(start, 20).cast("timestamp").alias("issued_at"),
    )


@query(
    "current_outlook",
    with_(
        OUTLOOK_SQL,
        then="SELECT region, run_id, state FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY CASE state WHEN 'active' THEN 0 ELSE 1 END, valid_from, issued_at DESC, run_id) AS rn FROM staged WHERE state <> 'archived') s WHERE rn = 1",
    ),
)
def current_outlook(t):
    return U.current_outlook(outlooks(t), F.lit("2000-06-15").cast("date"), ["region"]).select("region", "run_id", "state")


@query("ordered_outlooks", with_(OUTLOOK_SQL, then="SELECT run_id, state, strftime(valid_from, '%Y-%m-%d') AS valid_from FROM staged"))
def ordered_outlooks(t):
    out = U.order_outlooks(outlooks(t), F.lit("2000-06-15").cast("date"))
    return out.select("run_id", "state", F.date_format("valid_from", DAY).alias("valid_from"))


@query("hash_sample", with_(AREAS_SQL, then="SELECT area_id FROM areas ORDER BY md5(area_id), area_id LIMIT 20"))
def hash_sample(t):
    return U.hash_sample(t.areas().select("area_id"), "area_id", 20)


@query(
    "evenly_spaced_stamps",
    with_(
        RUNS_SQL,
        """st AS (SELECT DISTINCT indicator, obs_end FROM runs)""",
        """nm AS (SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY obs_end) - 1 AS i, count(*) OVER (PARTITION BY indicator) AS n FROM st)""",
        then="SELECT DISTINCT indicator, strftime(obs_end, '%Y-%m-%d') AS obs_end FROM nm CROSS JOIN range(7) k(k) WHERE n <= 7 OR i = CAST(round_even(k * (n - 1) / 6.0::DOUBLE, 0) AS BIGINT)",
    ),
)
def evenly_spaced_stamps(t):
    out = U.evenly_spaced(t.runs(), ["indicator"], "obs_end", 7)
    return out.select("indicator", F.date_format("obs_end", DAY).alias("obs_end"))


ITEMS_SQL = """items AS (SELECT 'item-' || o_orderkey AS item_id, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS stamp FROM orders)"""


def items(t):
    o = t.raw("orders")
    stamp = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 24) * 3_600_000_000)
    return o.select(F.concat(F.lit("item-"), "o_orderkey").alias("item_id"), stamp.alias("stamp"))


@query(
    "latest_in_month_slot",
    with_(
        ITEMS_SQL,
        then="""SELECT y AS "year", m AS "month", max(stamp) IS NULL AS missing, strftime(max(stamp), '%Y-%m-%d %H') AS stamp, max_by(item_id, (stamp, item_id)) AS item_id
        FROM range(1995, 2003) yy(y) CROSS JOIN (VALUES (3), (8)) mm(m) LEFT JOIN items ON year(stamp) = y AND month(stamp) = m GROUP BY 1, 2""",
    ),
)
def latest_in_month_slot(t):
    out = N.latest_in_slot(U.slots(t.spark, (1995, 2002), [3, 8]), items(t), ["year", "month"], "item_id", "stamp")
    return out.select("year", "month", "missing", F.date_format("stamp", "yyyy-MM-dd HH").alias("stamp"), "item_id")


REQUEST_SQL = "requests AS (SELECT 'req-' || p_partkey AS request_id, TIMESTAMP '1995-01-10 06:30:00' + to_hours(CAST((p_partkey * 37) % 55000 AS INTEGER)) AS wanted FROM part)"


def requests(t):
    micros = F.unix_micros(F.lit("1995-01-10 06:30:00").cast("timestamp")) + ((F.col("p_partkey") * 37) % 55000) * 3_600_000_000
    return t.raw("part").select(F.concat(F.lit("req-"), "p_partkey").alias("request_id"), F.timestamp_micros(micros).alias("wanted"))


@query(
    "nearest_in_time",
    with_(
        REQUEST_SQL, ITEMS_SQL,
        then="""SELECT request_id, item_id, strftime(stamp, '%Y-%m-%d %H:%M') AS stamp, gap / 1e6 AS gap_seconds FROM (
          SELECT request_id, item_id, stamp, abs(epoch_us(stamp) - epoch_us(wanted)) AS gap, row_number() OVER (PARTITION BY request_id ORDER BY abs(epoch_us(stamp) - epoch_us(wanted)), stamp, item_id) AS rn
          FROM requests JOIN items ON stamp BETWEEN wanted - INTERVAL 2 DAY AND wanted + INTERVAL 2 DAY) n WHERE rn = 1""",
    ),
)
def nearest_in_time(t):
    out = N.nearest_in_time(requests(t), items(t), "request_id", "wanted", "item_id", "stamp")
    return out.select("request_id", "item_id", F.date_format("stamp", "yyyy-MM-dd HH:mm").alias("stamp"), "gap_seconds")


@query(
    "nearest_in_month",
    with_(
        ITEMS_SQL,
        "months AS (SELECT CAST(m AS DATE) AS month FROM generate_series(TIMESTAMP '1990-01-01', TIMESTAMP '2001-12-01', INTERVAL 1 MONTH) g(m))",
        """cand AS (SELECT month, item_id, stamp, abs(epoch_us(stamp) - epoch_us(month + INTERVAL 20 DAY + INTERVAL 12 HOUR)) AS gap FROM months JOIN items ON date_trunc('month', stamp) = month)""",
        """rk AS (SELECT *, gap > 172800000000 AS far, row_number() OVER (PARTITION BY month ORDER BY gap > 172800000000, gap, stamp, item_id) AS rn FROM cand)""",
        then="""SELECT strftime(m.month, '%Y-%m') AS month, item_id, CASE WHEN far IS NULL THEN 'unavailable' WHEN far THEN 'whole_month' ELSE 'near_21st' END AS selection FROM months m LEFT JOIN rk ON rk.month = m.month AND rn = 1""",
    ),
)
def nearest_in_month(t):
    months = U.slots(t.spark, (1990, 2001), range(1, 13)).select(F.make_date("year", "month", F.lit(1)).alias("month"))
    out = N.nearest_in_month(months, items(t), "month", "item_id", "stamp")
    return out.select(F.date_format("month", "yyyy-MM").alias("month"), "item_id", "selection")


@query(
    "first_available_month",
    with_(RUNS_SQL, then="SELECT indicator, status, strftime(max(source_latest_month), '%Y-%m') AS first_available FROM runs WHERE source_latest_month <= DATE '2001-03-01' AND source_latest_month > DATE '2000-03-01' GROUP BY 1, 2"),
)
def first_available_month(t):
    out = U.first_available_month(t.runs(), ["indicator", "status"], "source_latest_month", "2001-03-20", 12)
    return out.select("indicator", "status", F.date_format("first_available", "yyyy-MM").alias("first_available"))


# ---- joins


@query(
    "evidence_of_runs",
    with_(
        *EV, AREAS_SQL,
        then="SELECT indicator, district_en, count(*) AS rows, sum(value) AS value_sum FROM evidence JOIN runs USING (run_id) JOIN areas USING (area_id) GROUP BY 1, 2",
    ),
)
def evidence_of_runs(t):
    joined = U.evidence_of_runs(t.evidence(), t.runs().select("run_id", "indicator"), t.areas().select("area_id", "district_en"))
    return joined.groupBy("indicator", "district_en").agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("value_sum"))


@query(
    "run_inventory",
    with_(
        *EV,
        then="SELECT r.run_id, indicator, status, count(e.run_id) AS area_count, count(*) FILTER (WHERE e.quality_status = 'ok') AS usable_count FROM runs r LEFT JOIN evidence e ON e.run_id = r.run_id GROUP BY 1, 2, 3",
    ),
)
def run_inventory(t):
    return U.run_inventory(t.runs().select("run_id", "indicator", "status"), t.evidence())


@query(
    "pinned_optional_joins",
    with_(
        AREAS_SQL,
        "m AS (SELECT 'month-' || year(l_shipdate) || '-' || month(l_shipdate) AS run_id, 'area-' || l_suppkey AS area_id, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2)",
        then="SELECT a.area_id, x.value AS rainfall_value, y.value AS ndvi_value FROM areas a LEFT JOIN m x ON x.area_id = a.area_id AND x.run_id = 'month-1996-6' LEFT JOIN m y ON y.area_id = a.area_id AND y.run_id = 'month-1996-7'",
    ),
)
def pinned_optional_joins(t):
    run = F.concat_ws("-", F.lit("month"), F.year("l_shipdate"), F.month("l_shipdate"))
    monthly = t.raw("lineitem").groupBy(run.alias("run_id"), F.concat(F.lit("area-"), "l_suppkey").alias("area_id")).agg(F.avg("l_quantity").alias("value"))
    return U.with_optional(t.areas().select("area_id"), {"rainfall": (monthly, "month-1996-6"), "ndvi": (monthly, "month-1996-7")})


@query(
    "ordered_case_list",
    with_(EVIDENCE_SQL, AREAS_SQL, then="SELECT c.ord, a.area_id, name_en, count(e.area_id) AS rows FROM (VALUES (1, 'area-7'), (2, 'area-3'), (3, 'area-5')) c(ord, area_id) JOIN areas a USING (area_id) LEFT JOIN evidence e ON e.area_id = a.area_id GROUP BY 1, 2, 3"),
)
def ordered_case_list(t):
    cases = U.ordered_cases(t.areas().select("area_id", "name_en"), ["area-7", "area-3", "area-5"])
    counts = t.evidence().groupBy("area_id").agg(F.count(F.lit(1)).alias("rows"))
    return cases.join(counts, "area_id", "left").withColumn("rows", F.coalesce("rows", F.lit(0))).orderBy("ord")


@query(
    "areas_with_and_without",
    with_(
        *EV, AREAS_SQL,
        "hit AS (SELECT DISTINCT area_id FROM evidence JOIN runs USING (run_id) WHERE indicator = 'ndvi' AND value > 45 AND quality_status = 'ok' AND coverage_pct >= 98)",
        then="SELECT area_id, area_id IN (SELECT area_id FROM hit) AS has_high_ndvi FROM areas",
    ),
)
def areas_with_and_without(t):
    """EXISTS as a semi-join, NOT EXISTS as an anti-join."""
    high = t.evidence().where("value > 45 AND quality_status = 'ok' AND coverage_pct >= 98").join(t.runs().where("indicator = 'ndvi'"), "run_id", "left_semi")
    areas = t.areas().select("area_id")
    keys = high.select("area_id")
    return areas.join(keys, "area_id", "left_semi").withColumn("has_high_ndvi", F.lit(True)).unionByName(
        areas.join(keys, "area_id", "left_anti").withColumn("has_high_ndvi", F.lit(False))
    )


PRODUCTS_SQL = """products AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'P3.T' ELSE 'P3.AETI' END || '.' || strftime(o_orderdate, '%Y-%m') || '-D' || least(3, (day(o_orderdate) - 1) // 10 + 1) AS code,
  CASE WHEN o_orderkey % 13 <> 0 THEN 'u/' || o_orderkey END AS url, o_orderkey FROM orders),
uniq AS (SELECT code, min(url) AS url FROM products GROUP BY 1)"""


def products(t):
    o = t.raw("orders")
    dekad = F.least(F.lit(3), F.floor((F.dayofmonth("o_orderdate") - 1) / 10) + 1)
    code = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "P3.T").otherwise("P3.AETI"), F.lit("."), F.date_format("o_orderdate", "yyyy-MM"), F.lit("-D"), dekad)
    url = F.when(F.col("o_orderkey") % 13 != 0, F.concat(F.lit("u/"), "o_orderkey"))
    return o.select(code.alias("code"), url.alias("url")).groupBy("code").agg(F.min("url").alias("url"))


@query(
    "product_pairs",
    with_(
        PRODUCTS_SQL,
        """pr AS (SELECT substr(a.code, 6) AS suffix, a.url AS first_url, b.url AS second_url FROM uniq a JOIN uniq b ON b.code = 'P3.AETI.' || substr(a.code, 6) WHERE a.code LIKE 'P3.T.%' AND a.url IS NOT NULL AND b.url IS NOT NULL)""",
        """pp AS (SELECT *, CAST(substr(suffix, 1, 7) || '-01' AS DATE) AS m, CAST(substr(suffix, 10, 1) AS INTEGER) AS d FROM pr)""",
        then="""SELECT suffix, first_url, second_url, strftime(m + CAST((d - 1) * 10 AS INTEGER), '%Y-%m-%d') AS period_start, strftime(CASE WHEN d = 3 THEN last_day(m) ELSE m + CAST(d * 10 - 1 AS INTEGER) END, '%Y-%m-%d') AS period_end FROM pp""",
    ),
)
def product_pairs(t):
    pairs = U.pair_products(products(t), "P3.T", "P3.AETI")
    period = D.dekad_period(F.concat(F.lit("x."), "suffix"))
    return pairs.select("suffix", "first_url", "second_url", F.date_format(period["start"], DAY).alias("period_start"), F.date_format(period["end"], DAY).alias("period_end"))


@query(
    "snapshot_difference",
    with_(
        *EV,
        "y AS (SELECT indicator, area_id, max(CASE WHEN year(obs_end) = 2000 THEN value END) AS first_value, max(CASE WHEN year(obs_end) = 1999 THEN value END) AS second_value FROM evidence JOIN runs USING (run_id) WHERE year(obs_end) IN (1999, 2000) GROUP BY 1, 2)",
        then="SELECT *, first_value - second_value AS difference FROM y",
    ),
)
def snapshot_difference(t):
    joined = t.evidence().join(t.runs().select("run_id", "indicator", F.year("obs_end").alias("year")), "run_id")
    return U.run_difference(joined, F.col("year") == 2000, F.col("year") == 1999, keys=["indicator"])


STORED_SQL = """stored AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS value FROM lineitem WHERE l_suppkey % 29 <> 0 GROUP BY 1, 2),
source AS (SELECT l_orderkey, l_suppkey, sum(CASE WHEN l_suppkey % 31 = 0 THEN l_quantity + 0.5 ELSE l_quantity + 1e-9 END) AS value FROM lineitem WHERE l_suppkey % 23 <> 0 GROUP BY 1, 2)"""


def stored_and_source(t):
    li = t.raw("lineitem")
    key = ["l_orderkey", "l_suppkey"]
    stored = li.where("l_suppkey % 29 <> 0").groupBy(*key).agg(F.sum("l_quantity").alias("value"))
    shifted = F.when(F.col("l_suppkey") % 31 == 0, F.col("l_quantity") + 0.5).otherwise(F.col("l_quantity") + 1e-9)
    return stored, li.where("l_suppkey % 23 <> 0").groupBy(*key).agg(F.sum(shifted).alias("value"))


FINDINGS_SQL = """findings AS (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey,
  CASE WHEN a.l_orderkey IS NULL THEN 'missing_in_store' WHEN b.l_orderkey IS NULL THEN 'missing_in_source' WHEN abs(a.value - b.value) > 1e-6 THEN 'different' END AS finding
  FROM stored a FULL JOIN source b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey)"""


@query("stored_versus_source", with_(STORED_SQL, FINDINGS_SQL, then="SELECT * FROM findings WHERE finding IS NOT NULL"))
def stored_versus_source(t):
    stored, source = stored_and_source(t)
    return U.compare_values(stored, source, ["l_orderkey", "l_suppkey"], "value").select("l_orderkey", "l_suppkey", "finding")


@query(
    "comparison_summary",
    with_(
        STORED_SQL, FINDINGS_SQL,
        then="SELECT finding, count(*) AS rows, list_sort(list(DISTINCT id) FILTER (WHERE rn <= 5)) AS ids FROM (SELECT finding, 'run-' || l_orderkey || '/' || l_suppkey AS id, row_number() OVER (PARTITION BY finding ORDER BY 'run-' || l_orderkey || '/' || l_suppkey) AS rn FROM findings WHERE finding IS NOT NULL) f GROUP BY 1",
    ).replace("list_sort(list(DISTINCT id) FILTER (WHERE rn <= 5)) AS ids", "string_agg(CASE WHEN rn <= 5 THEN id END, ',' ORDER BY id) AS ids"),
)
def comparison_summary(t):
    stored, source = stored_and_source(t)
    findings = U.compare_values(stored, source, ["l_orderkey", "l_suppkey"], "value").withColumn("id", F.concat(F.lit("run-"), "l_orderkey", F.lit("/"), "l_suppkey"))
    return U.comparison_summary(findings, "id").select("finding", "rows", F.array_join("sample_ids", ",").alias("ids"))


# ---- aggregations


@query(
    "class_counts_map",
    with_(
        *EV,
        "c AS (SELECT indicator, quality_status || ':' || count(*) AS kv FROM evidence JOIN runs USING (run_id) GROUP BY indicator, quality_status)",
        then="SELECT indicator, string_agg(kv, ',' ORDER BY kv) AS quality_counts FROM c GROUP BY 1",
    ),
)
def class_counts_map(t):
    joined = t.evidence().select("run_id", "quality_status").join(t.runs().select("run_id", "indicator"), "run_id")
    mapped = U.counts_map(joined, ["indicator"], "quality_status", "m")
    text = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    return mapped.select("indicator", text.alias("quality_counts"))


@query(
    "quality_summary",
    with_(
        *EV,
        then="SELECT indicator, count(*) AS areas, count(*) FILTER (WHERE quality_status = 'ok') AS usable_areas, coalesce(round(avg(coverage_pct), 2), 0) AS mean_coverage_pct FROM evidence JOIN runs USING (run_id) GROUP BY 1",
    ),
)
def quality_summary(t):
    return U.quality_summary(t.evidence().join(t.runs().select("run_id", "indicator"), "run_id"), ["indicator"])


@query(
    "retained_months",
    with_(
        *EV,
        then="""SELECT indicator, count(DISTINCT run_id) AS retained_runs, count(DISTINCT strftime(obs_end, '%Y-%m')) AS retained_months, strftime(min(obs_end), '%Y-%m-%d') AS first_observation, strftime(max(obs_end), '%Y-%m-%d') AS latest_observation,
        string_agg(DISTINCT strftime(obs_end, '%Y-%m'), ',' ORDER BY strftime(obs_end, '%Y-%m')) AS calendar_months FROM runs WHERE status IN ('development', 'degraded', 'validated', 'published') AND run_id IN (SELECT run_id FROM evidence) GROUP BY 1""",
    ),
)
def retained_months(t):
    out = U.retained_months(t.runs(), t.evidence(), ["indicator"])
    text = lambda c: F.date_format(c, DAY).alias(c)
    return out.select("indicator", "retained_runs", "retained_months", text("first_observation"), text("latest_observation"), F.array_join("calendar_months", ",").alias("calendar_months"))


@query(
    "availability_matrix",
    with_(
        RUNS_SQL,
        "have AS (SELECT DISTINCT indicator, month(obs_end) AS month, year(obs_end) AS year FROM runs WHERE year(obs_end) BETWEEN 1995 AND 2001)",
        "grid AS (SELECT indicator, m AS month, y AS year FROM (SELECT DISTINCT indicator FROM runs) i CROSS JOIN range(1, 13) a(m) CROSS JOIN range(1995, 2002) b(y))",
        "mm AS (SELECT g.indicator, g.month, string_agg(CASE WHEN h.year IS NOT NULL THEN CAST(g.year AS VARCHAR) END, ',' ORDER BY g.year) AS av, string_agg(CASE WHEN h.year IS NULL THEN CAST(g.year AS VARCHAR) END, ',' ORDER BY g.year) AS mi, count(h.year) = 7 AS complete FROM grid g LEFT JOIN have h USING (indicator, month, year) GROUP BY 1, 2)",
        then="SELECT indicator, CAST(month AS INTEGER) AS month, coalesce(av, '') AS years_available, coalesce(mi, '') AS years_missing, complete, CASE WHEN min(complete) OVER (PARTITION BY indicator) THEN 'candidate_coverage_complete' ELSE 'candidate_coverage_incomplete' END AS status FROM mm",
    ),
)
def availability_matrix(t):
    records = t.runs().select("indicator", F.year("obs_end").alias("year"), F.month("obs_end").alias("month"))
    out = U.availability_matrix(records, ["indicator"], YEARS)
    text = lambda c: F.array_join(c, ",").alias(c)
    return out.select("indicator", "month", text("years_available"), text("years_missing"), "complete", "status")


@query(
    "value_range",
    with_(
        *EV,
        "j AS (SELECT *, quality_status = 'ok' AND value IS NOT NULL AS ok FROM evidence JOIN runs USING (run_id))",
        then="SELECT indicator, status, min(CASE WHEN ok THEN value END) AS lowest, max(CASE WHEN ok THEN value END) AS highest, count(*) FILTER (WHERE ok) AS usable, count(*) AS total FROM j GROUP BY 1, 2",
    ),
)
def value_range(t):
    return U.value_range(t.evidence().join(t.runs().select("run_id", "indicator", "status"), "run_id"), ["indicator", "status"])


# ---- references


def dated_evidence(t):
    return t.evidence().join(t.runs().select("run_id", "indicator", "obs_end", "status", "candidate_only", "notes"), "run_id")


REF_SQL = """dated AS (SELECT *, year(obs_end) AS yr, month(obs_end) AS mon FROM evidence JOIN runs USING (run_id)),
ref AS (SELECT area_id, mon AS calendar_month, yr, value FROM dated WHERE yr BETWEEN 1996 AND 2000 AND status IN ('development', 'degraded', 'validated')
  AND (candidate_only OR notes LIKE 'Baseline pilot only%') AND quality_status = 'ok' AND coverage_pct >= 90 AND value IS NOT NULL)"""


@query(
    "seasonal_reference",
    with_(
        *EV, REF_SQL,
        then="SELECT area_id, calendar_month, count(*) AS valid_year_count, round(quantile_cont(value, 0.5), 8) AS median_value, round(quantile_cont(value, 0.2), 8) AS p20_value, round(quantile_cont(value, 0.8), 8) AS p80_value FROM ref GROUP BY 1, 2 HAVING count(*) >= 6",
    ),
)
def seasonal_reference(t):
    out = B.seasonal_reference(B.reference_rows(dated_evidence(t), (1996, 2000)))
    r = lambda c: F.round(c, 8).alias(c)
    return out.select("area_id", "calendar_month", "valid_year_count", r("median_value"), r("p20_value"), r("p80_value"))


AREA_MONTH_SQL = """am AS (SELECT 'area-' || l_suppkey AS area_id, year(l_shipdate) AS yr, month(l_shipdate) AS mon, avg(CASE WHEN l_returnflag <> 'R' THEN l_quantity END) AS value,
  100.0::DOUBLE * count(*) FILTER (WHERE l_returnflag <> 'R') / count(*) AS cov FROM lineitem GROUP BY 1, 2, 3)"""


def area_months(t):
    li = t.raw("lineitem")
    ok = F.col("l_returnflag") != "R"
    return li.groupBy(F.concat(F.lit("area-"), "l_suppkey").alias("area_id"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("calendar_month")).agg(
        F.avg(F.when(ok, F.col("l_quantity"))).alias("value"), (F.lit(100.0) * F.count_if(ok) / F.count(F.lit(1))).alias("coverage_pct")
    )


@query(
    "leave_own_year_out",
    with_(
        AREA_MONTH_SQL,
        "rf AS (SELECT * FROM am WHERE value IS NOT NULL AND cov >= 40)",
        """lo AS (SELECT t.area_id, t.mon, t.yr, t.value, count(r.value) AS n, quantile_cont(r.value, 0.5) AS med, 100.0 * count(*) FILTER (WHERE r.value <= t.value) / nullif(count(r.value), 0) AS pct
          FROM am t LEFT JOIN rf r ON r.area_id = t.area_id AND r.mon = t.mon AND r.yr BETWEEN 1995 AND 2000 AND (t.yr NOT BETWEEN 1995 AND 2000 OR r.yr <> t.yr) GROUP BY 1, 2, 3, 4)""",
        then="""SELECT area_id, mon AS calendar_month, yr AS year, value, CAST(CASE WHEN n >= 5 THEN n END AS INTEGER) AS reference_count, round(CASE WHEN n >= 5 THEN med END, 8) AS reference_median,
          round(CASE WHEN n >= 5 AND value IS NOT NULL THEN pct END, 8) AS reference_percentile, round(CASE WHEN n >= 5 AND med > 0 THEN 100 * (value - med) / med END, 8) AS reference_deviation_pct,
          CASE WHEN n >= 5 THEN 'candidate_review_required' ELSE 'unavailable' END AS baseline_status FROM lo""",
    ),
)
def leave_own_year_out(t):
    targets = area_months(t)
    rows = targets.where("value IS NOT NULL AND coverage_pct >= 40 AND year BETWEEN 1995 AND 2000").select("area_id", "calendar_month", "year", "value")
    out = B.leave_own_year_out(targets, rows, (1995, 2000), minimum=5)
    r = lambda c: F.round(c, 8).alias(c)
    return out.select("area_id", "calendar_month", "year", "value", "reference_count", r("reference_median"), r("reference_percentile"), r("reference_deviation_pct"), "baseline_status")


@query(
    "baseline_percentile",
    with_(
        AREA_MONTH_SQL,
        "ys AS (SELECT area_id, yr, sum(value) AS depth FROM am WHERE mon IN (6, 7) GROUP BY 1, 2)",
        """c AS (SELECT a.area_id, a.depth, list_sort(list(b.depth))[count(*) // 2 + 1] AS med, round(100 * (count(*) FILTER (WHERE b.depth < a.depth) + 0.5 * count(*) FILTER (WHERE b.depth = a.depth)) / count(*), 1) AS pct
          FROM ys a JOIN ys b ON b.area_id = a.area_id AND b.yr BETWEEN 1995 AND 2000 WHERE a.yr = 2001 GROUP BY 1, 2)""",
        then="SELECT area_id, round(depth, 6) AS depth, round(med, 2) AS baseline_median, pct AS percentile FROM c",
    ),
)
def baseline_percentile(t):
    season = area_months(t).where("calendar_month IN (6, 7)").groupBy("area_id", "year").agg(F.sum("value").alias("depth"))
    current = season.where("year = 2001").select("area_id", "depth")
    history = season.where("year BETWEEN 1995 AND 2000").select("area_id", "depth")
    out = B.observed_against_years(current, history, rounded=sql_round).where("percentile IS NOT NULL")
    return out.select("area_id", F.round("depth", 6).alias("depth"), "baseline_median", "percentile")


PENTAD_SQL = """pt AS (SELECT 'area-' || l_suppkey AS area_id, year(l_shipdate) AS y, month(l_shipdate) AS m, least((day(l_shipdate) - 1) // 5 + 1, 6) AS p, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3, 4),
po AS (SELECT *, (y * 12 + m - 1) * 6 + p AS o FROM pt),
tr AS (SELECT *, count(*) OVER w AS n, sum(v) OVER w AS total FROM po WINDOW w AS (PARTITION BY area_id ORDER BY o RANGE BETWEEN 5 PRECEDING AND CURRENT ROW))"""


def pentads(t):
    li = t.raw("lineitem")
    day = F.col("l_shipdate")
    return li.groupBy(
        F.concat(F.lit("area-"), "l_suppkey").alias("area_id"), F.year(day).alias("year"), F.month(day).alias("month"), D.pentad_of(day).alias("pentad")
    ).agg(F.sum("l_quantity").alias("period_mean"))


@query(
    "trailing_pentads",
    with_(PENTAD_SQL, then="SELECT area_id, o AS ordinal, n AS periods_present, CASE WHEN n = 6 THEN total END AS trailing_total FROM tr"),
)
def trailing_pentads(t):
    from cellsight.plans.rainfall import pentad_totals

    return pentad_totals(pentads(t)).select("area_id", "ordinal", "periods_present", "trailing_total")


@query(
    "provisional_comparison",
    with_(
        PENTAD_SQL,
        "ft AS (SELECT area_id, y, CASE WHEN n = 6 THEN total END AS depth FROM tr WHERE m = 8 AND p = 4)",
        """cp AS (SELECT c.area_id, c.depth, count(h.depth) AS n, quantile_cont(h.depth, 0.5) AS med, 100 * (count(*) FILTER (WHERE h.depth < c.depth) + 0.5 * count(*) FILTER (WHERE h.depth = c.depth)) / nullif(count(h.depth), 0) AS pct
           FROM ft c LEFT JOIN ft h ON h.area_id = c.area_id AND h.y BETWEEN 1995 AND 2000 WHERE c.y = 2001 GROUP BY 1, 2)""",
        then="""SELECT area_id, depth, CASE WHEN n >= 4 THEN round(med, 2) END AS baseline_median, CASE WHEN n >= 4 AND depth IS NOT NULL THEN round(pct, 1) END AS provisional_percentile,
          CASE WHEN n >= 4 THEN 'provisional_preliminary_vs_final' ELSE 'insufficient_historical_grid_coverage' END AS comparison_status FROM cp""",
    ),
)
def provisional_comparison(t):
    from cellsight.plans.rainfall import pentad_totals, preliminary_comparison

    return preliminary_comparison(pentad_totals(pentads(t)), 2001, 8, 4, (1995, 2000), 4)


@query(
    "distribution_breaks",
    "SELECT count(*) AS rows, round(sum(o_totalprice), 2) AS total, round(quantile_cont(o_totalprice, 0.2), 6) AS p20, round(quantile_cont(o_totalprice, 0.4), 6) AS p40, round(quantile_cont(o_totalprice, 0.6), 6) AS p60, round(quantile_cont(o_totalprice, 0.8), 6) AS p80 FROM orders",
)
def distribution_breaks(t):
    out = B.distribution_breaks(t.raw("orders"), [], "o_totalprice", [0.2, 0.4, 0.6, 0.8])
    return out.select("rows", F.round("total", 2).alias("total"), *[F.round(c, 6).alias(c) for c in ("p20", "p40", "p60", "p80")])


@query(
    "distribution_breaks_by_status",
    "SELECT o_orderstatus, count(*) AS rows, " + ", ".join(f"round(quantile_cont(o_totalprice, {p}), 6) AS p{round(p * 100):02d}" for p in (0.1, 0.2, 0.4, 0.6, 0.8, 0.9)) + " FROM orders GROUP BY 1",
)
def distribution_breaks_by_status(t):
    probs = [0.1, 0.2, 0.4, 0.6, 0.8, 0.9]
    out = B.distribution_breaks(t.raw("orders"), ["o_orderstatus"], "o_totalprice", probs)
    return out.select("o_orderstatus", "rows", *[F.round(f"p{round(p * 100):02d}", 6).alias(f"p{round(p * 100):02d}") for p in probs])


# ---- windows


@query("exposure_deciles", "SELECT c_custkey, ntile(10) OVER (ORDER BY c_acctbal, md5(CAST(c_custkey AS VARCHAR)), c_custkey) AS decile FROM customer")
def exposure_deciles(t):
    return R.ntile(t.raw("customer").select("c_custkey", "c_acctbal"), 10, "c_acctbal", "c_custkey", "decile").select("c_custkey", F.col("decile").cast("long").alias("decile"))


@query(
    "quantile_classes",
    "SELECT l_quantity, quantile_class, count(*) AS rows FROM (SELECT l_quantity, CAST(greatest(0, least(5, floor((rank() OVER (ORDER BY l_quantity) - 1) * 6.0 / count(*) OVER ()))) AS INTEGER) AS quantile_class FROM lineitem) q GROUP BY 1, 2",
)
def quantile_classes(t):
    """Class per order line; a quantity is shared by very many lines."""
    li = t.raw("lineitem").select("l_quantity", F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("id"))
    return R.quantile_class(li, "l_quantity", "id").groupBy("l_quantity", "quantile_class").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "stratified_sample",
    """SELECT stratum, sample_rank, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey) AS sample_rank
       FROM (SELECT c_custkey, ntile(4) OVER (ORDER BY c_acctbal, md5(CAST(c_custkey AS VARCHAR)), c_custkey) AS stratum FROM customer) s) r WHERE sample_rank <= 5""",
)
def stratified_sample(t):
    return R.stratified_sample(t.raw("customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey").select("stratum", "sample_rank", "c_custkey")


@query("feature_ordinals", with_(AREAS_SQL, then="SELECT area_id, row_number() OVER (PARTITION BY district_key ORDER BY area_key) AS ordinal FROM areas"))
def feature_ordinals(t):
    return R.ordinals(t.areas().select("area_id", "district_key", "area_key"), ["district_key"], "area_key", "area_id").select("area_id", "ordinal")


@query(
    "evidence_history",
    with_(
        *EV,
        "h AS (SELECT indicator, area_id, run_id, obs_end, max(value) AS value FROM evidence JOIN runs USING (run_id) WHERE status IN ('development', 'degraded') GROUP BY 1, 2, 3, 4)",
        then="SELECT indicator, area_id, run_id, value, 100 * (value - 25.0) / 25.0 AS deviation_pct, value - lag(value) OVER (PARTITION BY indicator, area_id ORDER BY obs_end, run_id) AS change FROM h",
    ),
)
def evidence_history(t):
    parts = t.parts("lineitem")
    runs = t.runs().where("status IN ('development', 'degraded')").select("run_id", "indicator", F.col("obs_end").alias("observation_at"))
    joined = t.evidence().select("run_id", "area_id", "value").repartition(parts, "run_id").join(runs.repartition(parts, "run_id"), "run_id")
    one = joined.groupBy("indicator", "area_id", "run_id", "observation_at").agg(F.max("value").alias("value")).withColumn("expected_median", F.lit(25.0))
    return U.history(one, bucket=F.year("observation_at"), parts=parts).select("indicator", "area_id", "run_id", "value", "deviation_pct", "change")


# ---- set operations


@query(
    "set_differences",
    "SELECT *, 'left_only' AS side FROM (SELECT l_suppkey, l_partkey FROM lineitem WHERE year(l_shipdate) = 2000 EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE year(l_shipdate) = 2001) a UNION ALL SELECT *, 'right_only' FROM (SELECT l_suppkey, l_partkey FROM lineitem WHERE year(l_shipdate) = 2001 EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE year(l_shipdate) = 2000) b",
)
def set_differences(t):
    li = t.raw("lineitem").select("l_suppkey", "l_partkey", F.year("l_shipdate").alias("y"))
    return U.set_differences(li.where("y = 2000").drop("y"), li.where("y = 2001").drop("y"), t.parts("lineitem"))


@query("missing_members", "SELECT event_type, CASE WHEN CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS INTEGER) >= 0 THEN 'run_id,status' END AS missing, count(*) AS documents FROM events GROUP BY 1, 2")
def missing_members(t):
    missing = F.array_join(Q.missing_members(F.col("props"), ["k", "status", "run_id"]), ",")
    return t.raw("events").groupBy("event_type", missing.alias("missing")).agg(F.count(F.lit(1)).alias("documents"))


@query(
    "first_occurrences",
    "SELECT l_orderkey, l_suppkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2",
)
def first_occurrences(t):
    return U.first_occurrence(t.raw("lineitem"), ["l_orderkey"], "l_suppkey", "l_linenumber")


# ---- dates


@query(
    "calendar_periods",
    """SELECT o_orderkey, least((day(o_orderdate) - 1) // 5 + 1, 6) AS pentad, strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end,
      strftime(CASE WHEN day(o_orderdate) <= 5 THEN date_trunc('month', o_orderdate) - INTERVAL 2 MONTH ELSE date_trunc('month', o_orderdate) - INTERVAL 1 MONTH END, '%Y-%m-%d') AS completed_month,
      strftime(o_orderdate - INTERVAL 35 DAY, '%Y-%m-%d') AS window_start, strftime(o_orderdate - INTERVAL 5 DAY, '%Y-%m-%d') AS window_end,
      strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m-%d') AS preview_from,
      strftime(date_trunc('month', date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + INTERVAL 123 DAY) - INTERVAL 1 DAY, '%Y-%m-%d') AS preview_to,
      date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') AS age_days FROM orders""",
)
def calendar_periods(t):
    day = F.to_date("o_orderdate")
    text = lambda c: F.date_format(c, DAY)
    window = D.rolling_window(day, 30)
    preview = D.preview_validity(day)
    return t.raw("orders").select(
        "o_orderkey", D.pentad_of(day).cast("long").alias("pentad"), text(D.replay_validity(day)["valid_to"]).alias("month_end"), text(D.completed_month(day)).alias("completed_month"),
        text(window["start"]).alias("window_start"), text(window["end"]).alias("window_end"), text(preview["valid_from"]).alias("preview_from"), text(preview["valid_to"]).alias("preview_to"),
        D.age_days(day, F.lit("2001-12-31").cast("date")).cast("long").alias("age_days"),
    )


# ---- quality gates


@query(
    "evidence_violations",
    with_(
        EVIDENCE_SQL,
        then="""SELECT rule, count(*) AS rows FROM (SELECT CASE WHEN NOT area_id LIKE 'area-1%' THEN 'area_id_prefix' END AS rule FROM evidence UNION ALL SELECT CASE WHEN coverage_pct - 85 < 0 THEN 'coverage_range' END FROM evidence
          UNION ALL SELECT CASE WHEN coverage_pct > 95 THEN 'pixel_counts' END FROM evidence UNION ALL SELECT CASE WHEN quality_status = 'ok' AND value IS NULL THEN 'ok_without_value' END FROM evidence) v WHERE rule IS NOT NULL GROUP BY 1""",
    ),
)
def evidence_violations(t):
    e = t.evidence().withColumn("valid_pixel_count", F.col("coverage_pct").cast("int")).withColumn("grid_cell_count", F.lit(95)).withColumn("coverage_pct", F.col("coverage_pct") - 85)
    return Q.check_rows(e, Q.pixel_rules("area-1"), ["run_id", "area_id"]).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "key_violations",
    with_(
        *EV, AREAS_SQL,
        then="""SELECT rule, count(*) AS keys FROM (SELECT 'duplicate_key' AS rule FROM evidence GROUP BY run_id, area_id HAVING count(*) > 1
          UNION ALL SELECT 'unknown_run' FROM (SELECT DISTINCT run_id FROM evidence WHERE run_id NOT IN (SELECT run_id FROM runs WHERE status <> 'degraded')) a
          UNION ALL SELECT 'unknown_area' FROM (SELECT DISTINCT area_id FROM evidence WHERE area_id NOT IN (SELECT area_id FROM areas WHERE area_key % 9 <> 0)) b) v GROUP BY 1""",
    ),
)
def key_violations(t):
    e = t.evidence()
    twice = Q.duplicates(e, ["run_id", "area_id"]).select("rule")
    runs = Q.orphans(e, t.runs().where("status <> 'degraded'"), ["run_id"], "unknown_run").select("rule")
    areas = Q.orphans(e, t.areas().where("area_key % 9 <> 0"), ["area_id"], "unknown_area").select("rule")
    return twice.unionByName(runs).unionByName(areas).groupBy("rule").agg(F.count(F.lit(1)).alias("keys"))


@query("active_configuration_violations", with_(CONFIG_SQL, then="SELECT grp, 'one_active' AS rule FROM config WHERE active_for_review GROUP BY 1 HAVING count(*) > 1"))
def active_configuration_violations(t):
    return Q.one_active(configurations(t), ["grp"])
