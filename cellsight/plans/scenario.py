"""Scenario evidence packet and discussion finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsight.functions.numeric import deviation_pct

MINIMUM_YEARS = 6


def packet(cases: DataFrame, rainfall: DataFrame, greenness: DataFrame, water: DataFrame, greenness_reference: DataFrame, water_reference: DataFrame) -> DataFrame:
    """Values, reference medians, deviations and year counts of each case; all sides optional."""
    def side(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
        return df.select("area_id", *[F.col(c).alias(f"{prefix}_{c}") for c in columns])

    joined = (
        cases.join(side(rainfall, "rainfall", "rainfall_mm", "percentile", "quality_status"), "area_id", "left")
        .join(side(greenness, "ndvi", "value", "quality_status"), "area_id", "left")
        .join(side(greenness_reference, "ndvi", "median_value", "valid_year_count"), "area_id", "left")
        .join(side(water, "wapor", "value", "quality_status"), "area_id", "left")
        .join(side(water_reference, "wapor", "median_value", "valid_year_count"), "area_id", "left")
    )
    return joined.withColumn("ndvi_deviation_pct", deviation_pct(F.col("ndvi_value"), F.col("ndvi_median_value"))).withColumn(
        "wapor_deviation_pct", deviation_pct(F.col("wapor_value"), F.col("wapor_median_value"))
    )


def finding(cases: DataFrame, settings: DataFrame | None = None, null_as_zero: bool = False) -> DataFrame:
    """Ordered decision per case and setting.

    ``settings`` columns (already joined in when None): rainfall_limit, ndvi_limit, wapor_limit,
    logic ('rainfall', 'either', 'both'), category, reviewer, note. Missing evidence does not
    trigger a signal; ``null_as_zero`` gives the behaviour of the browser, where it reads as 0.
    """
    joined = cases if settings is None else cases.join(settings, "area_id")
    seen = (lambda c: F.coalesce(F.col(c), F.lit(0.0))) if null_as_zero else F.col
    low = lambda value, limit: F.coalesce(seen(value) <= F.col(limit), F.lit(False))
    rain, ndvi, wapor = low("rainfall_percentile", "rainfall_limit"), low("ndvi_deviation_pct", "ndvi_limit"), low("wapor_deviation_pct", "wapor_limit")
    years = F.least(F.coalesce("ndvi_valid_year_count", F.lit(0)), F.coalesce("wapor_valid_year_count", F.lit(0)))
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    agree = ((F.col("logic") == "both") & ndvi & wapor) | ((F.col("logic") == "either") & (ndvi | wapor))
    # The finding texts.
    result: Column = (
        F.when(years < MINIMUM_YEARS, "Insufficient reference evidence")
        .when(text("category") == "", "Withheld pending confounder review")
        .when(F.col("category") != "cleared", "Withheld pending confounder resolution")
        .when((F.length(text("reviewer")) < 2) | (F.length(text("note")) < 8), "Blocked pending reviewer record")
        .when(rain & (F.col("logic") == "rainfall"), "Rainfall-only discussion signal")
        .when(rain & agree, "Rainfall + land-surface signals agree (not independent)")
        .when(rain, "Rainfall signal without land-surface agreement")
        .when(ndvi | wapor, "Land-surface divergence to review")
        .otherwise("No selected discussion trigger")
    )
    return joined.withColumn("finding", result)
