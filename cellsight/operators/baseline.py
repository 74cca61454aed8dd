"""Seasonal references and baselines, including the leave-own-year-out reference."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellsight.functions.numeric import array_quantile, deviation_pct, inclusive_pct, mid_rank_pct, py_round, upper_median
from cellsight.operators.ranking import exact_quantiles
from cellsight.operators.runs import REFERENCE_STATUS, reference_candidate, usable

MIN_ROWS = 6


def reference_rows(evidence: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Evidence that may enter a reference: (area_id, calendar_month, year, value)."""
    fit = (
        F.year("obs_end").between(*years)
        & F.col("status").isin(*REFERENCE_STATUS)
        & reference_candidate(F.col("candidate_only"), F.col("notes"))
        & usable(F.col("value"), F.col("quality_status"), F.col("coverage_pct"))
    )
    return evidence.where(fit).select("area_id", F.month("obs_end").alias("calendar_month"), F.year("obs_end").alias("year"), "value")


def seasonal_reference(rows: DataFrame, keys: Sequence[str] = ("area_id", "calendar_month"), minimum: int = MIN_ROWS) -> DataFrame:
    """Median, P20 and P80 over all rows of an area and calendar month; rows are counted, not years."""
    quantiles = exact_quantiles(rows, keys, "value", [0.5, 0.2, 0.8], ["median_value", "p20_value", "p80_value"], count="valid_year_count")
    return quantiles.where(F.col("valid_year_count") >= minimum)


def leave_own_year_out(targets: DataFrame, rows: DataFrame, years: tuple[int, int], keys: Sequence[str] = ("area_id", "calendar_month"), minimum: int = MIN_ROWS) -> DataFrame:
    """Every target with the reference of its area and month, its own year taken out.

    Order statistics with deletion over counts of (key, year, value); no reference is gathered and no target-by-reference pairs are made.
    Running counts over all years and over one year stand side by side on every row. With the own year placed last among equal
    values, the k-th remaining value has rank k plus the own values whose count of others at or below is at most k; that rank is then looked up
    in the running counts of all years. Fewer than ``minimum`` remaining rows leave the reference NULL.
    """
    keys = list(keys)
    columns = targets.columns
    held = rows.where(F.col("value").isNotNull()).dropna(subset=keys).groupBy(*keys, "year", "value").agg(F.count(F.lit(1)).alias("_n"))
    asked = targets.select(*keys, "year", "value", F.lit(0).cast("long").alias("_n"), F.struct(*columns).alias("_target"))
    both = held.withColumn("_target", F.lit(None).cast(asked.schema["_target"].dataType)).unionByName(asked)
    whole, one = W.partitionBy(*keys), W.partitionBy(*keys, "year")
    upto = lambda w: F.sum("_n").over(w.orderBy("value").rangeBetween(W.unboundedPreceding, W.currentRow))
    inside = F.col("year").between(*years)
    own = lambda c: F.when(inside, c).otherwise(F.lit(0))
    ranked = both.withColumns({"_below": upto(whole), "_own_below": own(upto(one)), "_left": F.sum("_n").over(whole) - own(F.sum("_n").over(one))})
    for side, rank in (("_low", F.floor((F.col("_left") - 1) / 2)), ("_high", F.ceil((F.col("_left") - 1) / 2))):
        passed = F.coalesce(F.sum(F.when(inside & (F.col("_below") - F.col("_own_below") <= rank), F.col("_n"))).over(one), F.lit(0))
        ranked = ranked.withColumn(side, rank + passed)

    wanted = ranked.where("_target IS NOT NULL AND _left > 0").groupBy(*keys, "year").agg(F.max("_low").alias("_low"), F.max("_high").alias("_high"))
    sides = wanted.select(*keys, "year", F.explode(F.array("_low", "_high")).alias("_at"))
    steps = ranked.where("_target IS NULL").groupBy(*keys, "value").agg((F.max("_below") - 1).alias("_at"))
    found = steps.withColumn("year", F.lit(None).cast(sides.schema["year"].dataType)).unionByName(sides.withColumn("value", F.lit(None).cast(steps.schema["value"].dataType)))
    down = whole.orderBy(F.desc("_at"), F.col("value").isNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    looked = found.withColumn("_value", F.last("value", True).over(down)).where("value IS NULL")
    middle = looked.groupBy(*keys, "year").agg((F.min("_value") + (F.max("_value") - F.min("_value")) * 0.5).alias("_median"))

    near = ranked.where("_target IS NOT NULL").select("_target", "_left", (F.col("_below") - F.col("_own_below")).alias("_reached"))
    kept = near.select("_target.*", "_left", "_reached").join(middle, [*keys, "year"], "left").withColumn("_n", F.coalesce("_left", F.lit(0)).cast("int"))
    enough = F.col("_n") >= minimum
    out = kept.withColumn("reference_count", F.when(enough, F.col("_n")))
    out = out.withColumn("reference_median", F.when(enough, F.col("_median")))
    out = out.withColumn("reference_percentile", F.when(enough & F.col("value").isNotNull(), inclusive_pct(F.col("_reached"), F.col("_n"))))
    out = out.withColumn("reference_deviation_pct", deviation_pct(F.col("value"), F.col("reference_median")))
    out = out.withColumn("baseline_status", F.when(enough, "candidate_review_required").otherwise("unavailable"))
    label = F.when(~enough, "Seasonal reference unavailable").when(inside, "same-month reference without own year").otherwise("same-month reference")
    return out.withColumn("baseline_label", label).select(*columns, "reference_count", "reference_median", "reference_percentile", "reference_deviation_pct", "baseline_status", "baseline_label")


def against_years(df: DataFrame, years: str, value: str = "depth", rounded: Callable[[Column, int], Column] = py_round) -> DataFrame:
    """Upper median and mid-rank percentile of a value against the array of its baseline years.

    The array has one entry per year, so the calendar bounds it. ``rounded`` decides the ties of the median.
    """
    below = F.size(F.filter(years, lambda y: y < F.col(value)))
    equal = F.size(F.filter(years, lambda y: y == F.col(value)))
    held = F.coalesce(F.size(years), F.lit(0)) > 0
    out = df.withColumn("baseline_median", F.when(held, rounded(upper_median(F.col(years)), 2)))
    return out.withColumn("percentile", F.when(held, mid_rank_pct(below, equal, F.size(years))))


def observed_against_years(
    current: DataFrame, baseline: DataFrame, keys: Sequence[str] = ("area_id",), value: str = "depth", rounded: Callable[[Column, int], Column] = py_round
) -> DataFrame:
    """``against_years`` for a baseline table with one row per area and year."""
    keys = list(keys)
    packed = baseline.groupBy(*keys).agg(F.collect_list(value).alias("_years"))
    return against_years(current.join(packed, keys, "left"), "_years", value, rounded).drop("_years")


def provisional_comparison(current: DataFrame, baseline: DataFrame, minimum_years: int = 25, keys: Sequence[str] = ("area_id",), value: str = "depth") -> DataFrame:
    """Interpolated median and mid-rank percentile when enough complete years exist.

    Years whose window is incomplete arrive as NULL and do not count.
    """
    keys = list(keys)
    packed = baseline.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_years"))
    joined = current.join(packed, keys, "left")
    count = F.coalesce(F.size("_years"), F.lit(0))
    enough = count >= minimum_years
    below = F.size(F.filter("_years", lambda y: y < F.col(value)))
    equal = F.size(F.filter("_years", lambda y: y == F.col(value)))
    out = joined.withColumn("baseline_median", F.when(enough, py_round(array_quantile(F.col("_years"), 0.5), 2)))
    out = out.withColumn("provisional_percentile", F.when(enough & F.col(value).isNotNull(), mid_rank_pct(below, equal, count)))
    status = F.when(enough, "provisional_preliminary_vs_final").otherwise("insufficient_historical_grid_coverage")
    return out.withColumn("comparison_status", status).drop("_years")


def distribution_breaks(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact break points with row count and sum; the groups may be whole tables."""
    names = [f"p{round(p * 100):02d}" for p in probs]
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("total"))
    breaks = exact_quantiles(df, keys, value, probs, names)
    if keys:
        return sums.join(breaks, list(keys))
    # a one-row result: one scalar subquery, not a cross join
    whole = sums.withColumn("_b", breaks.select(F.struct(*names)).scalar())
    return whole.select("rows", "total", *[F.col(f"_b.{n}").alias(n) for n in names])


def approximate_breaks(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """Sketch-based variant for a first look at very large tables; named so nobody takes it for exact."""
    return df.groupBy(*keys).agg(F.percentile_approx(value, list(probs), accuracy).alias("approximate_breaks"))
