"""Readiness of sources, probe states, and the draft decision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINIMUM_COVERAGE = 90.0


def source_states(sources: DataFrame, as_of: Column, boundary: str) -> DataFrame:
    """Ordered reasons and the state of each source.

    Input per source: run_id, run_status, observation_date, freshness_days, areas, usable_areas,
    mean_coverage_pct, boundary_set_version, baseline_ready, expected_areas. NULL means that a
    check does not apply.
    """
    age = F.datediff(as_of, F.col("observation_date"))
    old = F.col("freshness_days").isNotNull() & age.isNotNull() & (age > F.col("freshness_days"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("run_status").isin("failed", "degraded"), F.concat(F.lit("Latest run is "), F.col("run_status"), F.lit("."))),
            F.when(old, F.concat(F.lit("Observation is older than the "), F.col("freshness_days").cast("string"), F.lit("-day freshness policy."))),
            F.when((F.col("areas") == 0) | (F.col("usable_areas") == 0), "No area summaries meet the source quality rule."),
            F.when(
                (F.col("expected_areas") > 0) & (F.col("areas") < F.col("expected_areas")),
                F.concat(F.lit("Only "), F.col("areas").cast("string"), F.lit(" of "), F.col("expected_areas").cast("string"), F.lit(" canonical areas have a source summary.")),
            ),
            F.when((F.col("areas") > 0) & (F.col("mean_coverage_pct") < MINIMUM_COVERAGE), "Mean area coverage is below the readiness policy."),
            F.when(F.col("boundary_set_version") != boundary, "Boundary-set version does not match the current model contract."),
            F.when(~F.col("baseline_ready"), "A validated seasonal baseline is not available."),
        )
    )
    none = F.col("run_id").isNull()
    out = sources.withColumn("age_days", age).withColumn("reasons", F.when(none, F.array(F.lit("No local run is available."))).otherwise(reasons))
    state = (
        F.when(none, "unavailable")
        .when(F.size("reasons") == 0, "usable")
        .when(F.col("run_status") == "degraded", "degraded")
        .when(old, "stale")
        .otherwise("incomplete")
    )
    return out.withColumn("state", state)


def decision(states: DataFrame, capping: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Status, whether a draft matrix is allowed, the class cap and all reasons of failed sources.

    The sources of one decision are a fixed handful, so gathering their reasons is bounded.
    """
    bad = F.col("state") != "usable"
    failed = F.col("required_for_draft") & bad
    named = F.when(failed, F.struct("source_id", F.transform("reasons", lambda r: F.concat(F.col("source_id"), F.lit(": "), r)).alias("texts")))
    grouped = states.groupBy(*keys).agg(
        F.coalesce(F.bool_or(failed), F.lit(False)).alias("_failed"),
        F.coalesce(F.bool_or(F.col("source_id").isin(list(capping)) & bad), F.lit(False)).alias("_capped"),
        F.array_sort(F.collect_list(named)).alias("_named"),
        F.count_if(failed).alias("required_failures"),
    )
    return grouped.select(
        *keys,
        F.when(F.col("_failed"), "not_ready").otherwise("draft_evidence_only").alias("status"),
        (~F.col("_failed")).alias("draft_matrix_allowed"),
        F.when(F.col("_capped"), "Watch").otherwise("Not evaluated").alias("maximum_class"),
        "required_failures",
        F.flatten(F.transform("_named", lambda s: s["texts"])).alias("reasons"),
    )


def probe_states(latest: DataFrame, retained: DataFrame, key: str = "run_id") -> DataFrame:
    """degraded (too old), current (already retained), ready, unavailable (no catalogue item)."""
    held = retained.select(key).distinct().withColumn("_held", F.lit(True))
    state = (
        F.when(F.col("stamp").isNull(), "unavailable")
        .when(F.col("age_days") > F.col("max_age_days"), "degraded")
        .when(F.col("_held"), "current")
        .otherwise("ready")
    )
    return latest.join(held, key, "left").withColumn("probe_state", state).drop("_held")


def run_status(age_days: Column, max_age: Column) -> Column:
    return F.when(age_days <= max_age, "development").otherwise("degraded")
