"""Freshness facts and alarms, workspace assembly, release gates and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsight.functions.text import RELEASE_ID
from cellsight.operators.quality import Rule, check_rows
from cellsight.operators.runs import latest_run, release_usable

# Cadence contract per source (expected after, stale after, in days) and automation state.
FRESHNESS = (
    ("observed", "Final rainfall (CHIRPS)", 31, 50, "automatic"),
    ("rapid", "Rapid rainfall (CHIRPS preliminary)", 10, 20, "automatic"),
    ("vegetation", "Vegetation (Copernicus NDVI)", 10, 25, "manual-until-acquisition"),
    ("vegetation_moisture", "Vegetation moisture (HLS NDMI)", 35, 65, "manual-experimental"),
    ("soil_water", "Soil water (Copernicus SWI)", 10, 25, "manual-until-acquisition"),
    ("thermal", "Thermal context (CLMS LST)", 10, 25, "replacement-required"),
    ("water_use", "Crop water use (FAO WaPOR)", 10, 25, "manual-until-acquisition"),
)
FORBIDDEN_FIELDS = ("priority_class", "priority_rank", "planning_action", "triggered_rules")
EXPOSURE_FIELDS = {
    "population": ("area_id", "name_en", "district_en", "population_total", "people_per_sq_km", "coverage_pct", "quality_status"),
    "cropland": ("area_id", "name_en", "district_en", "cropland_pct", "cropland_area_ha", "coverage_pct", "quality_status"),
    "road": ("area_id", "name_en", "district_en", "nearest_road_m", "road_intersects", "quality_status"),
}
HISTORY_FIELDS = ("area_id", "value", "coverage_pct", "quality_status")


def contract(spark: SparkSession) -> DataFrame:
    """The cadence contract as a table of seven parameter rows."""
    return spark.createDataFrame(list(FRESHNESS), "source_key string, label string, expected_after_days int, stale_after_days int, automation_state string")


def freshness(observed: DataFrame, cadence: DataFrame) -> DataFrame:
    """expected_next and stale_after from the end of the latest observation per source."""
    return observed.join(cadence, "source_key").select(
        *observed.columns,
        "label",
        F.date_add("source_observation_end", F.col("expected_after_days")).alias("expected_next"),
        F.date_add("source_observation_end", F.col("stale_after_days")).alias("stale_after"),
        "automation_state",
    )


def freshness_text(as_of: Column) -> Column:
    """Text for the workspace; stale after the end of the stale_after day."""
    stale = F.to_timestamp(as_of) >= F.to_timestamp(F.date_add("stale_after", 1))
    mode = (
        F.when(F.col("automation_state") == "automatic", "automatic source refresh")
        .when(F.col("automation_state") == "replacement-required", "source replacement required")
        .otherwise("manual acquisition pending")
    )
    shown = lambda c: F.coalesce(F.substring(F.col(c).cast("string"), 1, 10), F.lit("not recorded"))
    state = F.when(F.coalesce(stale, F.lit(False)), "STALE").otherwise("within declared window")
    return F.concat(
        F.lit("Data as of "), shown("source_observation_end"), F.lit(" · "), state, F.lit(" · "), mode, F.lit(". Expected next: "), shown("expected_next"), F.lit(".")
    )


def alarm(facts: DataFrame, cadence: DataFrame, as_of: Column, keys: Sequence[str] = ()) -> DataFrame:
    """current, stale (with the list of sources) or invalid (sources do not match the contract).

    A release has one fact per contract source, so the gathered list holds at most seven texts.
    """
    expected = cadence.agg(F.array_sort(F.collect_set("source_key")).alias("k")).scalar()
    text = F.concat(
        F.col("source_key"), F.lit(" (as of "), F.coalesce(F.col("source_observation_end").cast("string"), F.lit("unknown")),
        F.lit("; stale after "), F.coalesce(F.col("stale_after").cast("string"), F.lit("unknown")), F.lit(")"),
    )
    late = F.col("stale_after").isNull() | (F.col("stale_after") < as_of)
    grouped = facts.groupBy(*keys).agg(
        F.array_sort(F.collect_set("source_key")).alias("_keys"), F.array_sort(F.collect_list(F.when(late, text))).alias("stale_sources")
    )
    state = F.when(F.col("_keys") != expected, "invalid").when(F.size("stale_sources") > 0, "stale").otherwise("current")
    return grouped.withColumn("state", state).drop("_keys")


def regressions(previous: DataFrame, proposed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sources a release would move backwards, or that one side lacks."""
    a = previous.select(*keys, "source_key", F.col("source_observation_end").alias("previous_end"))
    b = proposed.select(*keys, "source_key", F.col("source_observation_end").alias("proposed_end"))
    state = F.when(F.col("previous_end").isNull() | F.col("proposed_end").isNull(), "incomplete").when(F.col("proposed_end") < F.col("previous_end"), "regressed")
    return a.join(b, [*keys, "source_key"], "full_outer").withColumn("finding", state).where("finding IS NOT NULL")


def workspace(runs: DataFrame, evidence: DataFrame, fields: Sequence[str] = HISTORY_FIELDS) -> DataFrame:
    """Rows of the latest run of every indicator, allow-listed columns only.

    The latest run ids are an aggregate of a few rows; the evidence is cut to them by a join on
    run_id, which prunes partitions of a run-partitioned table.
    """
    latest = latest_run(runs, ["indicator"]).select("run_id", "indicator")
    return evidence.join(latest, "run_id").select("indicator", "run_id", *fields)


def with_geometry(rows: DataFrame, geometry: DataFrame, keep_all_areas: bool = False) -> DataFrame:
    """Evidence with the geometry that is stored once per area.

    Rows without a released geometry fall out; ``keep_all_areas`` keeps areas without a row, too.
    """
    return geometry.select("area_id", "rings").join(rows, "area_id", "left" if keep_all_areas else "inner")


def completeness(rows: DataFrame, runs: DataFrame, full_coverage: Sequence[str], expected_areas: int) -> DataFrame:
    """Per indicator: rows, approved rows, and why it may not be published."""
    fit = release_usable(F.col("quality_status"), F.col("coverage_pct"))
    counted = rows.groupBy("indicator", "run_id").agg(F.count(F.lit(1)).alias("areas"), F.count_if(fit).alias("approved"))
    joined = counted.join(runs.select("run_id", "status"), "run_id")
    problem = (
        F.when(F.lower("status").isin("failed", "unavailable"), "source state is not publishable")
        .when(F.col("indicator").isin(list(full_coverage)) & (F.col("areas") != expected_areas), "not a full run over all areas")
        .when(F.col("approved") == 0, "no quality-approved area summaries")
    )
    return joined.withColumn("problem", problem)


def exposure_gaps(exposure: DataFrame, areas: DataFrame, measure: str) -> DataFrame:
    """Areas an exposure measure lacks or has in excess."""
    a, e = areas.select("area_id").distinct(), exposure.select("area_id").distinct()
    lacking = a.join(e, "area_id", "left_anti").withColumn("finding", F.lit("missing"))
    extra = e.join(a, "area_id", "left_anti").withColumn("finding", F.lit("unexpected"))
    return lacking.unionByName(extra).withColumn("measure", F.lit(measure))


def public_exposure(exposure: DataFrame, measure: str) -> DataFrame:
    return exposure.select(*[c for c in EXPOSURE_FIELDS[measure] if c in exposure.columns])


def asset_findings(declared: DataFrame, stored: DataFrame) -> DataFrame:
    """Declared assets against the stored files: missing, size, checksum, date order, names and ids."""
    files = stored.select("asset", F.col("byte_size").alias("_size"), F.col("sha256").alias("_sha"))
    joined = declared.join(files, "asset", "left")
    rules = [
        Rule("missing_file", F.col("_size").isNull()),
        Rule("byte_size", F.col("_size") != F.col("byte_size")),
        Rule("sha256", F.col("_sha") != F.col("sha256")),
        Rule("date_order", F.col("observation_end") < F.col("observation_start")),
        Rule("release_id", ~F.col("release_id").rlike(RELEASE_ID)),
    ]
    twice = declared.groupBy("release_id", "asset").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return check_rows(joined, rules, ["release_id", "asset"]).unionByName(twice.select("release_id", "asset", F.lit("duplicate_asset").alias("rule")))


def forbidden_fields(documents: DataFrame, ident: Sequence[str], properties: str) -> DataFrame:
    """Public features that expose internal fields, lack the neutral code, or carry planning wording."""
    members = F.json_object_keys(properties)
    exposed = F.array_intersect(members, F.array(*[F.lit(f) for f in FORBIDDEN_FIELDS]))
    wording = F.lower(properties).contains("immediate verification") | F.lower(properties).contains("coordinated response planning")
    rules = [
        Rule("forbidden_field", F.size(exposed) > 0),
        Rule("no_neutral_code", ~F.array_contains(members, "retrospective_draft_code")),
        Rule("planning_wording", wording),
    ]
    return check_rows(documents, rules, ident)


def freshness_findings(facts: DataFrame, cadence: DataFrame) -> DataFrame:
    """Declared freshness facts that do not follow from the contract."""
    c = cadence.select("source_key", F.col("label").alias("_label"), F.col("automation_state").alias("_state"), F.col("expected_after_days").alias("_e"), F.col("stale_after_days").alias("_s"))
    joined = facts.join(c, "source_key", "left")
    rules = [
        Rule("unknown_source", F.col("_label").isNull()),
        Rule("label", F.col("label") != F.col("_label")),
        Rule("automation_state", F.col("automation_state") != F.col("_state")),
        Rule("expected_next", F.col("expected_next") != F.date_add("source_observation_end", F.col("_e"))),
        Rule("stale_after", F.col("stale_after") != F.date_add("source_observation_end", F.col("_s"))),
    ]
    return check_rows(joined, rules, ["source_key"])
