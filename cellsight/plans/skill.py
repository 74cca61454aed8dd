"""Forecast skill: leave-one-year-out tercile Brier scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsight.functions.numeric import array_quantile

CATEGORIES = ("below", "near", "above")


def skill_records(members: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One record per year: members, ensemble mean and population spread, observed depth.

    ``members`` is (keys, year, member, depth). Members of one forecast are bounded by the ensemble.
    """
    ensemble = members.groupBy(*keys, "year").agg(
        F.avg("depth").alias("ensemble_mean_mm"), F.stddev_pop("depth").alias("ensemble_spread_mm"), F.array_sort(F.collect_list("depth")).alias("members_mm")
    )
    return ensemble.join(observed, [*[k for k in keys if k in observed.columns], "year"])


def _category(value: Column, low: Column, high: Column) -> Column:
    return F.when(value < low, "below").when(value > high, "above").otherwise("near")


def tercile_skill(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Brier, climatology Brier and skill per category.

    The records of one case are one per hindcast year, so they travel as one small array and each
    year filters itself out in place; no year pairs are shuffled.
    """
    keys = list(keys)
    packed = records.groupBy(*keys).agg(F.collect_list(F.struct("year", F.col("observed_mm").alias("o"), F.col("ensemble_mean_mm").alias("m"))).alias("_all"))
    joined = records.join(packed, keys).withColumn("_others", F.filter("_all", lambda r: r["year"] != F.col("year")))
    joined = joined.withColumn("_obs", F.array_sort(F.transform("_others", lambda r: r["o"]))).withColumn("_model", F.array_sort(F.transform("_others", lambda r: r["m"])))
    cut = lambda c, p: array_quantile(F.col(c), p)
    joined = joined.withColumn("_ol", cut("_obs", 1 / 3)).withColumn("_oh", cut("_obs", 2 / 3)).withColumn("_ml", cut("_model", 1 / 3)).withColumn("_mh", cut("_model", 2 / 3))
    happened = _category(F.col("observed_mm"), F.col("_ol"), F.col("_oh"))
    share = lambda array, test: F.size(F.filter(array, test)) / F.size(array)
    probability = {
        "below": share(F.col("members_mm"), lambda x: x < F.col("_ml")),
        "near": share(F.col("members_mm"), lambda x: (x >= F.col("_ml")) & (x <= F.col("_mh"))),
        "above": share(F.col("members_mm"), lambda x: x > F.col("_mh")),
    }
    climate = lambda name: share(F.col("_obs"), lambda x: _category(x, F.col("_ol"), F.col("_oh")) == name)
    cases = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("category"),
                    probability[c].alias("p"),
                    (happened == c).cast("double").alias("e"),
                    climate(c).alias("r"),
                )
                for c in CATEGORIES
            ]
        )
    )
    scored = joined.select(*keys, cases.alias("s")).groupBy(*keys, "s.category").agg(
        F.avg(F.pow(F.col("s.p") - F.col("s.e"), 2)).alias("_b"), F.avg(F.pow(F.col("s.r") - F.col("s.e"), 2)).alias("_c"), F.count(F.lit(1)).alias("years")
    )
    skill = F.when(F.col("_c") > 0, 1 - F.col("_b") / F.col("_c"))
    return scored.select(*keys, "category", "years", F.col("_b").alias("brier_score"), F.col("_c").alias("climatology_brier_score"), skill.alias("brier_skill_score"))


def lead_comparison(skill: DataFrame, keys: Sequence[str], lead: str, leads: Sequence[int]) -> DataFrame:
    """Skill of several leads side by side."""
    columns = [F.max(F.when(F.col(lead) == n, F.col("brier_skill_score"))).alias(f"lead_{n}") for n in leads]
    return skill.groupBy(*keys, "category").agg(*columns)
