"""Queries that write and read back: artifacts, insert-if-absent, revisions, and the rules of an artifact."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cellsight.operators import quality as Q
from cellsight.registry import query
from cellsight.registry.inputs import with_
from cellsight.session import shared_dir
from cellsight.sources import scans, sinks
from cellsight.streaming import ingest

ARTIFACT_SQL = """art AS (SELECT CASE WHEN s_suppkey % 13 = 0 THEN 'bad-' ELSE 'area-' END || s_suppkey AS area_id, s_name AS name_en, CASE WHEN s_suppkey % 7 <> 0 THEN 'NATION_' || s_nationkey END AS district_en,
  CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS rainfall_mm, s_acctbal / 2 AS baseline_median_mm, CASE WHEN s_suppkey % 6 <> 0 THEN (s_suppkey % 100)::DOUBLE END AS percentile,
  CASE WHEN s_suppkey % 9 = 0 THEN 'odd' WHEN s_suppkey % 5 = 0 THEN 'unavailable' ELSE 'typical_range' END AS condition_class, CAST(s_suppkey % 17 - 1 AS INTEGER) AS grid_cell_count,
  (s_suppkey % 105)::DOUBLE AS coverage_pct, CASE WHEN s_suppkey % 4 = 0 THEN 'insufficient_grid_coverage' ELSE 'ok' END AS quality_status, 'run-' || s_nationkey AS run FROM supplier)"""


def artifact_rows(t):
    s, k = t.raw("supplier"), F.col("s_suppkey")
    return s.select(
        F.concat(F.when(k % 13 == 0, "bad-").otherwise("area-"), k).alias("area_id"), F.col("s_name").alias("name_en"), F.when(k % 7 != 0, F.concat(F.lit("NATION_"), "s_nationkey")).alias("district_en"),
        F.when(k % 5 != 0, F.col("s_acctbal")).cast("double").alias("rainfall_mm"), (F.col("s_acctbal") / 2).cast("double").alias("baseline_median_mm"), F.when(k % 6 != 0, (k % 100).cast("double")).alias("percentile"),
        F.when(k % 9 == 0, "odd").when(k % 5 == 0, "unavailable").otherwise("typical_range").alias("condition_class"), (k % 17 - 1).cast("int").alias("grid_cell_count"),
        (k % 105).cast("double").alias("coverage_pct"), F.when(k % 4 == 0, "insufficient_grid_coverage").otherwise("ok").alias("quality_status"), F.concat(F.lit("run-"), "s_nationkey").alias("run"),
    )


def _folder(t, name: str) -> str:
    return f"{shared_dir(t.spark)}/stores/{name}-{uuid.uuid4().hex}"


@query("artifact_round_trip", with_(ARTIFACT_SQL, then="SELECT art.* EXCLUDE (run), CASE WHEN run IN ('run-1', 'run-7') THEN run END AS run_id, CASE run WHEN 'run-1' THEN 'development' WHEN 'run-7' THEN 'validated' END AS run_status FROM art WHERE run IN ('run-1', 'run-7', 'run-12')"))
def artifact_round_trip(t):
    """Two runs as CSV with a manifest each, and one whose manifest has no entry, written and read by pattern."""
    base, rows = _folder(t, "artifacts"), artifact_rows(t)
    for run, status in (("run-1", "development"), ("run-7", "validated"), ("run-12", None)):
        manifest = t.raw("nation").where(F.col("n_nationkey") == int(run[4:])).select(F.lit(run).alias("run_id"), F.lit(status).cast("string").alias("status"))
        sinks.write_artifact(rows.where(F.col("run") == run).drop("run"), manifest if status else manifest.where("false"), f"{base}/{run}")
    return scans.artifact(t.spark, f"{base}/*/rows", f"{base}/*/manifest")


@query(
    "rainfall_violations",
    with_(
        ARTIFACT_SQL,
        """rules AS (SELECT area_id, unnest([CASE WHEN NOT starts_with(area_id, 'area-') THEN 'area_id_prefix' END, CASE WHEN coverage_pct NOT BETWEEN 0 AND 100 THEN 'coverage_range' END, CASE WHEN grid_cell_count < 0 THEN 'cell_count' END,
          CASE WHEN condition_class = 'odd' THEN 'condition_class' END, CASE WHEN quality_status = 'ok' AND (rainfall_mm IS NULL OR percentile IS NULL) THEN 'ok_but_incomplete' END]) AS rule FROM art)""",
        then="SELECT area_id, rule FROM rules WHERE rule IS NOT NULL",
    ),
)
def rainfall_violations(t):
    """Every violated rule of a rainfall artifact."""
    return Q.check_rows(artifact_rows(t), Q.rainfall_rules("area-"), ["area_id"])


@query(
    "insert_absent",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'late ' || least(c_mktsegment, 'M') END AS segment, CAST(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal ELSE c_acctbal + 1 END AS DOUBLE) AS balance FROM customer""",
)
def insert_absent(t):
    """A third of all keys is stored first; a second load with every key, some twice, adds the others and changes nothing."""
    c = t.raw("customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("double").alias("balance"))
    path = _folder(t, "absent")
    sinks.insert_absent(c.where("c_custkey % 3 = 0"), path, ["c_custkey"])
    late = c.select("c_custkey", F.concat(F.lit("late "), "segment").alias("segment"), (F.col("balance") + 1).alias("balance"))
    for _ in range(2):
        sinks.insert_absent(late.unionByName(late.withColumn("segment", F.lit("late M"))), path, ["c_custkey"])
    return t.spark.read.schema(c.schema).parquet(path)


@query(
    "merge_revisions",
    """SELECT strftime(ts, '%Y-%m') AS run_id, 'area-' || (user_id % 50) AS area_id, max_by(value, (CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END, ts, event_id)) AS value,
    NOT bool_or(event_type = 'purchase') AS is_preliminary FROM events GROUP BY 1, 2""",
)
def merge_revisions(t):
    """Events dealt over several files, late ones among them, merged file by file: final rows replace preliminary ones and stay."""
    base, e = _folder(t, "revisions"), t.raw("events")
    maturity = F.when(F.col("event_type") == "purchase", "final").otherwise("preliminary")
    order = F.struct("ts", "event_id")
    rows = e.select(F.date_format("ts", "yyyy-MM").alias("run_id"), F.concat(F.lit("area-"), F.col("user_id") % 50).alias("area_id"), "value", maturity.alias("maturity"), order.alias("loaded_at"))
    rows.repartition(3, F.xxhash64("loaded_at")).write.parquet(f"{base}/in")  # every file holds early and late rows
    schema = "run_id string, area_id string, value double, maturity string, loaded_at struct<ts: timestamp, event_id: bigint>"
    stream = ingest.evidence_stream(t.spark, f"{base}/in", schema, files_per_batch=1)
    ingest.merge_revisions(stream, f"{base}/rows", f"{base}/state").awaitTermination()
    kept = t.spark.read.schema(rows.schema).parquet(f"{base}/rows")
    return kept.select("run_id", "area_id", "value", (F.col("maturity") == "preliminary").alias("is_preliminary"))
