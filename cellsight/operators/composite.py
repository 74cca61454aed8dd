"""Multi-scene composites: index, quality masks, temporal medians, evidence tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellsight.functions.classes import evidence_tier
from cellsight.functions.numeric import coverage_pct, py_round
from cellsight.functions.projection import equal_area_forward, rings_to
from cellsight.operators.ranking import exact_quantiles
from cellsight.operators.zonal import Grid, area_spans
from cellsight.session import cut

# Quality bits, fill, saturation, accepted scene classes.
STRICT_BITS = 0b00111110
OPERATIONAL_BITS = 0b00111010
AEROSOL_BITS = 0b11000000
QA_FILL = 255
BAND_FILL = -9999
SATURATED = 12000
CLEAR_CLASSES = (4, 5)
PROFILES = ("strict", "adjacency_allowed")


def normalised_difference(nir: Column, swir: Column) -> Column:
    """(nir - swir) / (nir + swir) where both are unfilled and unsaturated and the sum is positive."""
    usable = (nir > BAND_FILL) & (swir > BAND_FILL) & (nir < SATURATED) & (swir < SATURATED) & (nir + swir > 0)
    return F.when(usable, (nir - swir) / (nir + swir))


def mask_profiles(qa: Column) -> dict[str, Column]:
    """Accepted per profile; high aerosol means both of its bits."""
    basic = (qa != QA_FILL) & (qa.bitwiseAND(AEROSOL_BITS) != AEROSOL_BITS)
    return {
        "strict": basic & (qa.bitwiseAND(STRICT_BITS) == 0),
        "adjacency_allowed": basic & (qa.bitwiseAND(OPERATIONAL_BITS) == 0),
    }


def profile_observations(scenes: DataFrame) -> DataFrame:
    """One row per accepted observation and profile: the input of the composite.

    Adds ``index`` and ``adjacent_only`` (accepted by the wider profile alone).
    """
    index = normalised_difference(F.col("nir").cast("double"), F.col("swir").cast("double"))
    accepted = mask_profiles(F.col("qa"))
    tagged = scenes.withColumn("index", index).where(F.col("index").isNotNull())
    adjacent = accepted["adjacency_allowed"] & ~accepted["strict"]
    rows = F.array(*[F.when(accepted[p], F.struct(F.lit(p).alias("profile"), (F.lit(p == "adjacency_allowed") & adjacent).alias("adjacent_only"))) for p in PROFILES])
    return tagged.select("*", F.explode(F.array_compact(rows)).alias("_p")).select("*", "_p.profile", "_p.adjacent_only").drop("_p")


def pixel_composite(observations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median over scenes and number of observations per pixel.

    Scenes of one window over one pixel are bounded by the revisit cycle, so the built-in
    percentile holds few values per group.
    """
    return observations.groupBy(*keys, "row", "col").agg(F.percentile("index", F.lit(0.5)).alias("composite"), F.count(F.lit(1)).alias("observations"))


def composite_evidence(observations: DataFrame, eligible: DataFrame, candidates: DataFrame, area: str = "area_id") -> DataFrame:
    """Evidence per (area, profile); areas without eligible pixels or observations stay with zeros.

    ``eligible`` counts pixels per area (area, total_eligible_pixel_count) and ``candidates``
    scenes per area (area, candidate_acquisition_count).
    """
    keys = [area, "profile"]
    # three summaries read the pixels: checkpointed, the temporal median is computed once
    pixels = cut(pixel_composite(observations, keys))
    spatial = pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("valid_spatial_pixel_count"),
        F.count_if(F.col("observations") >= 2).alias("_twice"),
        F.sum("observations").alias("valid_observation_pixel_count"),
        F.avg("composite").alias("_mean"),
    )
    medians = exact_quantiles(pixels, keys, "composite", [0.5], ["_median"])
    counts = exact_quantiles(pixels, keys, "observations", [0.5], ["_median_n"])
    usable = acquisition_window(observations, keys)
    frame = (
        eligible.join(candidates, area, "left")
        .withColumn("profile", F.explode(F.array(*[F.lit(p) for p in PROFILES])))
        .join(spatial, keys, "left")
        .join(medians, keys, "left")
        .join(counts, keys, "left")
        .join(usable, keys, "left")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = F.col("total_eligible_pixel_count")
    out = frame.select(
        *keys,
        py_round(F.col("_mean"), 4).alias("ndmi_mean"),
        py_round(F.col("_median"), 4).alias("ndmi_median"),
        py_round(coverage_pct(zero("valid_spatial_pixel_count"), total), 1).alias("spatial_coverage_pct"),
        py_round(coverage_pct(zero("_twice"), total), 1).alias("two_observation_coverage_pct"),
        py_round(F.col("_median_n"), 1).alias("median_valid_observation_count"),
        zero("valid_spatial_pixel_count").alias("valid_spatial_pixel_count"),
        "total_eligible_pixel_count",
        zero("valid_observation_pixel_count").alias("valid_observation_pixel_count"),
        zero("candidate_acquisition_count").alias("candidate_acquisition_count"),
        zero("usable_acquisition_count").alias("usable_acquisition_count"),
        "first_acquisition_at",
        "last_acquisition_at",
        "median_acquisition_at",
        zero("adjacency_accepted_pixel_count").alias("adjacency_accepted_pixel_count"),
    )
    return out.withColumn("evidence_tier", evidence_tier(F.col("valid_spatial_pixel_count"), F.col("usable_acquisition_count"), F.col("spatial_coverage_pct")))


def acquisition_window(observations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First, last and upper-median acquisition over usable scenes, and adjacent pixels accepted."""
    scenes = observations.groupBy(*keys, "scene_id").agg(F.min("acquired_at").alias("acquired_at"), F.count_if("adjacent_only").alias("_adjacent"))
    ordered = W.partitionBy(*keys).orderBy("acquired_at", "scene_id")
    numbered = scenes.select("*", F.row_number().over(ordered).alias("_k"), F.count(F.lit(1)).over(W.partitionBy(*keys)).alias("_n"))
    return numbered.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("usable_acquisition_count"),
        F.min("acquired_at").alias("first_acquisition_at"),
        F.max("acquired_at").alias("last_acquisition_at"),
        F.max(F.when(F.col("_k") == F.floor(F.col("_n") / 2) + 1, F.col("acquired_at"))).alias("median_acquisition_at"),
        F.sum("_adjacent").alias("adjacency_accepted_pixel_count"),
    )


def clear_sky_median(scenes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Temporal median over pixels whose scene class is vegetation or bare ground and whose data mask is set."""
    index = (F.col("nir") - F.col("swir")) / (F.col("nir") + F.col("swir"))
    usable = F.col("scl").isin(*CLEAR_CLASSES) & (F.col("data_mask") == 1) & (F.col("nir") + F.col("swir") != 0)
    return scenes.where(usable).groupBy(*keys, "row", "col").agg(F.percentile(index, F.lit(0.5)).alias("composite"), F.count(F.lit(1)).alias("observations"))


STATISTICS = "mean double, sampleCount bigint, noDataCount bigint, percentiles map<string,double>"


def statistics_evidence(responses: DataFrame, body: str = "stats", minimum: float = 70.0) -> DataFrame:
    """Provider statistics JSON to an evidence row; missing counts mean nothing is valid."""
    parsed = responses.withColumn("_s", F.from_json(body, STATISTICS))
    total = F.coalesce(F.col("_s.sampleCount"), F.lit(0).cast("long"))
    valid = F.greatest(F.lit(0).cast("long"), total - F.coalesce(F.col("_s.noDataCount"), total))
    median = F.coalesce(F.col("_s.percentiles")["50.0"], F.col("_s.percentiles")["50"])
    out = parsed.withColumn("valid_pixel_count", valid).withColumn("grid_cell_count", total)
    out = out.withColumn("coverage_pct", py_round(coverage_pct(valid, total), 1))
    out = out.withColumn("ndmi_mean", F.when(valid > 0, py_round(F.col("_s.mean"), 4)))
    out = out.withColumn("ndmi_median", F.when(valid > 0, py_round(median, 4)))
    ok = (F.col("valid_pixel_count") > 0) & (F.col("coverage_pct") >= minimum)
    return out.withColumn("quality_status", F.when(ok, "ok").otherwise("insufficient_evidence")).drop("_s", body)


# One global 30 m equal-area grid. Its lines are multiples of the step, so the cells equal those
# of a grid snapped to each area's own box, and areas share one cell numbering.
ANALYSIS_STEP = 30.0
ANALYSIS_GRID = Grid(-17_400_000.0, 7_500_000.0, ANALYSIS_STEP, -ANALYSIS_STEP, 1_160_000, 500_000, crs=6933)


def analysis_spans(areas: DataFrame, area: str = "area_id", rings: str = "rings") -> DataFrame:
    """Spans of the analysis grid inside lon/lat areas."""
    projected = areas.select(area, rings_to(F.col(rings), equal_area_forward).alias("rings"))
    return area_spans(projected, ANALYSIS_GRID, ident=area)


def eligible_pixels(areas: DataFrame, spans: DataFrame, area: str = "area_id") -> DataFrame:
    """Pixels per area; an area too small to hold a cell centre stays with zero."""
    counted = spans.groupBy(area).agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("_n"))
    joined = areas.select(area).join(counted, area, "left")
    return joined.select(area, F.coalesce("_n", F.lit(0)).cast("long").alias("total_eligible_pixel_count"))
