"""Observed and preliminary rainfall: zonal depth, baseline comparison, class, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsight.functions.classes import rainfall_condition
from cellsight.functions.dates import pentad_ordinal
from cellsight.functions.numeric import py_round
from cellsight.operators.baseline import against_years, provisional_comparison
from cellsight.operators.runs import trailing_periods
from cellsight.operators.zonal import quality_of


def period_means(pairs: DataFrame, value: Column, valid: Column) -> DataFrame:
    """One row per (year, month, area): mean over the cells and number of cells.

    Current and baseline years come from this single aggregation over the cell pairs; the cells
    are read once and reduced before the only large shuffle.
    """
    usable = F.coalesce(valid, F.lit(False))
    return pairs.where(usable).groupBy("year", "month", "area_id").agg(F.avg(value).alias("period_mean"), F.count(F.lit(1)).alias("cells"))


def observed_condition(means: DataFrame, areas: DataFrame, year: int, months: list[int], baseline: tuple[int, int]) -> DataFrame:
    """Seasonal depth of ``year`` for every area against one depth per baseline year.

    A baseline year without cells counts as depth 0, as it does in the published method.
    """
    now, past = F.col("year") == year, F.col("year").between(*baseline)
    depth = means.where(F.col("month").isin(months) & (now | past)).groupBy("area_id", "year").agg(F.sum("period_mean").alias("depth"), F.sum("cells").alias("cells"))
    # one row per area: this year's depth beside the array of its baseline years
    per_area = depth.groupBy("area_id").agg(
        F.max(F.when(now, F.col("depth"))).alias("depth"), F.max(F.when(now, F.col("cells"))).alias("usable"), F.collect_list(F.when(past, F.col("depth"))).alias("_held")
    )
    held = F.coalesce("_held", F.array().cast("array<double>"))
    dry = F.array_repeat(F.lit(0.0), F.lit(baseline[1] - baseline[0] + 1) - F.size(held))
    joined = areas.select("area_id").join(per_area, "area_id", "left").withColumn("_years", F.concat(held, dry))
    compared = against_years(joined, "_years")
    have = F.coalesce("usable", F.lit(0))
    coverage = F.when(have > 0, 100.0).otherwise(0.0)
    shown = lambda c: F.when(have > 0, c)
    out = compared.select(
        "area_id",
        shown(py_round(F.col("depth"), 2)).alias("rainfall_mm"),
        shown(F.col("baseline_median")).alias("baseline_median_mm"),
        shown(F.col("percentile")).alias("percentile"),
        have.alias("grid_cell_count"),
        coverage.alias("coverage_pct"),
    )
    out = out.withColumn("condition_class", rainfall_condition(F.col("percentile")))
    return out.withColumn("quality_status", quality_of(F.col("grid_cell_count"), F.col("coverage_pct")))


def pentad_totals(means: DataFrame, periods: int = 6) -> DataFrame:
    """Trailing six-pentad total per area; NULL while a pentad is missing."""
    numbered = means.withColumn("ordinal", pentad_ordinal(F.col("year"), F.col("month"), F.col("pentad")))
    return trailing_periods(numbered, ["area_id"], "ordinal", "period_mean", periods)


def preliminary_comparison(totals: DataFrame, year: int, month: int, pentad: int, baseline: tuple[int, int], minimum_years: int = 25) -> DataFrame:
    """The window that ends at the given pentad against the same window of the baseline years."""
    same = totals.where((F.col("month") == month) & (F.col("pentad") == pentad))
    current = same.where(F.col("year") == year).select("area_id", F.col("trailing_total").alias("depth"))
    history = same.where(F.col("year").between(*baseline)).select("area_id", F.col("trailing_total").alias("depth"))
    return provisional_comparison(current, history, minimum_years)
