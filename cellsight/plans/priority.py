"""Exposure deciles, rainfall bands and priority classes per month and area."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsight.functions import classes as C
from cellsight.functions.dates import preview_validity, replay_validity
from cellsight.operators.ranking import ntile
from cellsight.operators.runs import class_counts

# Classes with rank, planning action and rule text.
LEVELS = {
    "insufficient_evidence": (0, "Do not rank; resolve evidence gap", "Insufficient evidence: rainfall is unavailable or below coverage gate"),
    "critical": (4, "Immediate verification and coordinated response planning", "Critical: very low same-month rainfall and elevated exposure"),
    "high": (3, "Targeted verification and Woreda planning review", "High: low same-month rainfall and elevated exposure"),
    "moderate": (2, "Monitor closely and prepare contingency options", "Moderate: rainfall is below the watch threshold"),
    "watch": (1, "Continue monitoring and verify evidence", "Watch: valid rainfall evidence without an adverse rainfall threshold"),
}
ROAD_RULES = {
    "far": "Accessibility context: constrained (distance to mapped roads)",
    "near": "Accessibility context: mapped-road proximity available",
    "none": "Accessibility context: unavailable",
}
CLASSES = ("critical", "high", "moderate", "watch", "insufficient_evidence")
NEUTRAL_CODES = {"critical": "C1", "high": "C2", "moderate": "C3", "watch": "C4"}
NEUTRAL_DEFAULT = "insufficient-evidence"
PUBLIC_FIELDS = (
    "area_id", "name_en", "district_en", "rainfall_mm", "baseline_median_mm", "rainfall_percentile", "population_decile",
    "cropland_decile", "accessibility_context", "evidence_state", "input_quality",
)
PUBLIC_NOTE = "Retrospective retained evidence only; no operational recommendation."


def exposure_deciles(exposure: DataFrame, value: str, name: str) -> DataFrame:
    """Deciles over the areas with good quality; ties by md5 of the id instead of at random."""
    fit = exposure.where((F.col("quality_status") == "ok") & F.col(value).isNotNull())
    return ntile(fit, 10, value, "area_id", name).select("area_id", name)


def with_exposure(rainfall: DataFrame, population: DataFrame, cropland: DataFrame, roads: DataFrame) -> DataFrame:
    """Rainfall of all months in one plan, left-joined once with the static context."""
    road = roads.select("area_id", "nearest_road_m", F.col("quality_status").alias("road_quality"))
    return rainfall.join(population, "area_id", "left").join(cropland, "area_id", "left").join(road, "area_id", "left")


def _priority_class(minimum: float) -> Column:
    p = F.col("percentile")
    exposed = (F.coalesce("population_decile", F.lit(0)) >= 7) | (F.coalesce("cropland_decile", F.lit(0)) >= 7)
    closed = C.gate_closed(p, F.col("quality_status"), F.col("coverage_pct"), minimum)
    return (
        F.when(closed, "insufficient_evidence")
        .when((p <= 10) & exposed, "critical")
        .when((p <= 20) & exposed, "high")
        .when(p <= 33, "moderate")
        .otherwise("watch")
    )


def _level(position: int) -> Column:
    ladder = F.when(F.lit(False), F.lit(LEVELS["watch"][position]))
    for name, values in LEVELS.items():
        ladder = ladder.when(F.col("priority_class") == name, F.lit(values[position]))
    return ladder


def context_columns(evidence: DataFrame, minimum: float = 90.0) -> DataFrame:
    """Band, road context and evidence state: the calibration preview of each (run, area)."""
    q, c = F.col("quality_status"), F.col("coverage_pct")
    return (
        evidence.withColumn("rainfall_band", C.rainfall_band(F.col("percentile"), q, c, minimum))
        .withColumn("road_context", C.road_context(F.col("road_quality"), F.col("nearest_road_m")))
        .withColumn("evidence_state", C.evidence_state(q, c, minimum))
    )


def assess(evidence: DataFrame, minimum: float = 90.0) -> DataFrame:
    """Class, rank, action, rules and input quality of each (run, area)."""
    good_road = F.col("road_quality") == "ok"
    road_rule = (
        F.when(good_road & (F.col("nearest_road_m") >= 5500), ROAD_RULES["far"]).when(good_road, ROAD_RULES["near"]).otherwise(ROAD_RULES["none"])
    )
    quality = F.struct(
        F.col("coverage_pct").alias("rainfall_coverage_pct"),
        F.col("quality_status").alias("rainfall_quality"),
        F.col("population_decile").isNotNull().alias("population_available"),
        F.col("cropland_decile").isNotNull().alias("cropland_available"),
        good_road.alias("accessibility_available"),
    )
    return (
        context_columns(evidence, minimum)
        .withColumn("priority_class", _priority_class(minimum))
        .withColumn("priority_rank", _level(0).cast("int"))
        .withColumn("planning_action", _level(1))
        .withColumn("triggered_rules", F.array(_level(2), road_rule))
        .withColumn("input_quality", quality)
    )


def replay_snapshots(runs: DataFrame, version: int) -> DataFrame:
    valid = replay_validity(F.col("source_latest_month"))
    return runs.select("run_id", F.concat(F.lit(f"replay-v{version}-"), F.col("run_id")).alias("snapshot_id"), valid.alias("v")).select("run_id", "snapshot_id", "v.*")


def preview_snapshots(runs: DataFrame) -> DataFrame:
    valid = preview_validity(F.col("source_latest_month"))
    return runs.select("run_id", F.concat(F.lit("preview-"), F.col("run_id")).alias("snapshot_id"), valid.alias("v")).select("run_id", "snapshot_id", "v.*")


def class_rollup(assessments: DataFrame, keys: Sequence[str]) -> DataFrame:
    return class_counts(assessments, keys, "priority_class", CLASSES)


def preview_rollup(assessments: DataFrame, keys: Sequence[str]) -> DataFrame:
    return assessments.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("areas"),
        F.count_if(F.col("evidence_state") == "eligible_for_review").alias("eligible_for_review"),
        *[F.count_if(F.col("rainfall_band") == b).alias(b) for b in ("very_low", "low", "watch")],
    )


def public_replay(assessments: DataFrame) -> DataFrame:
    """Only allow-listed fields and a neutral code; class, rank, action and rules never leave."""
    code = F.coalesce(*[F.when(F.col("priority_class") == k, v) for k, v in NEUTRAL_CODES.items()], F.lit(NEUTRAL_DEFAULT))
    kept = [c for c in PUBLIC_FIELDS if c in assessments.columns]
    return assessments.select(*kept, code.alias("retrospective_draft_code"), F.lit(PUBLIC_NOTE).alias("interpretation_note"))


def public_replay_index(rollup: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = [F.col(c).alias(NEUTRAL_CODES.get(c, c)) for c in CLASSES]
    return rollup.select(*keys, "areas", *renamed)
