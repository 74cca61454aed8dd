"""Exact ranks and quantiles that never put a whole group into one task.

Rows are first counted per distinct value (partial aggregation collapses copies before the
shuffle). Monotone value bins give a histogram whose size is bounded by the double format,
so the prefix sum over bins is small. Only the inside of a bin is ordered, and that work is
spread by (group, bin).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellsight.functions.numeric import fine_bin, order_bin, value_bin


def _histogram(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows before each bin and in all, per group. One row per used bin.

    Two levels: fine steps are summed up inside their coarse bin, coarse bins inside their group, so no window
    holds more rows than a bin has steps or a group has coarse bins.
    """
    per_step = counts.groupBy(*keys, "_bin", "_fine").agg(F.sum("_n").alias("_in_bin"))
    before = lambda order: F.coalesce(F.sum("_in_bin").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    steps = per_step.withColumn("_inside", before(W.partitionBy(*keys, "_bin").orderBy("_fine")))
    per_bin = per_step.groupBy(*keys, "_bin").agg(F.sum("_in_bin").alias("_in_bin"))
    bins = per_bin.select(*keys, "_bin", before(W.partitionBy(*keys).orderBy("_bin")).alias("_outside"), F.sum("_in_bin").over(W.partitionBy(*keys)).alias("_total"))
    joined = _null_safe_join(steps, bins, [*keys, "_bin"])
    return joined.select(*keys, "_bin", "_fine", "_in_bin", (F.col("_outside") + F.col("_inside")).alias("_before_bin"), "_total")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str], count: str | None = None) -> DataFrame:
    """Interpolated quantiles per group for groups of any size; NULL values are left out.

    ``count`` names a column for the number of values, which falls out of the same pass.
    Use the built-in ``percentile`` where the group is bounded by its meaning (years of a
    reference, scenes of one month); use this over cells or areas.
    """
    keys = list(keys)
    # Both readers of ``counts`` must leave it untouched, or Spark cannot reuse its exchange: the
    # bin is never NULL and the join below is NULL-safe, so no filter is pushed into one of them.
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumns({"_bin": F.coalesce(value_bin(F.col("_v")), F.lit(0)), "_fine": fine_bin(F.col("_v"))})
    )
    hist = _histogram(counts, keys)
    wanted = []
    for i, prob in enumerate(probs):
        position = (F.col("_total") - 1) * F.lit(float(prob))
        for side, rank in (("l", F.floor(position)), ("h", F.ceil(position))):
            wanted.append(F.struct(F.lit(f"{i}{side}").alias("tag"), rank.cast("long").alias("rank")))
    in_reach = lambda w: (w["rank"] >= F.col("_before_bin")) & (w["rank"] < F.col("_before_bin") + F.col("_in_bin"))
    targets = hist.withColumn("_want", F.filter(F.array(*wanted), in_reach)).where(F.size("_want") > 0)
    within = W.partitionBy(*keys, "_bin", "_fine").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    last = F.col("_before_bin") + F.col("_run")
    held = lambda w: (w["rank"] < last) & (w["rank"] >= last - F.col("_n"))
    wanted_bins = targets.select(*keys, "_bin", "_fine", "_before_bin", "_total", "_want")
    picked = (
        _null_safe_join(counts, wanted_bins, [*keys, "_bin", "_fine"])
        .withColumn("_run", F.sum("_n").over(within))
        .select(*keys, "_v", "_total", F.explode(F.filter("_want", held)).alias("_w"))
    )
    sides = [F.max(F.when(F.col("_w.tag") == f"{i}{s}", F.col("_v"))).alias(f"_{i}{s}") for i in range(len(probs)) for s in "lh"]
    wide = picked.groupBy(*keys).agg(F.max("_total").alias("_total"), *sides)
    columns = []
    for i, (prob, name) in enumerate(zip(probs, names)):
        position = (F.col("_total") - 1) * F.lit(float(prob))
        part = position - F.floor(position)
        low, high = F.col(f"_{i}l"), F.col(f"_{i}h")
        columns.append(F.when((part == 0) | (low == high), low).otherwise(low + (high - low) * part).alias(name))
    held = [F.col("_total").alias(count)] if count else []
    return wide.select(*keys, *held, *columns)


def coded_median(counts: DataFrame, keys: Sequence[str], code: str, weight: str, carried: Sequence[Column], name: str) -> DataFrame:
    """Median of integer codes together with other sums, in one pass over (keys, code) counts.

    The codes of a stored raster are 8 or 16 bit integers, so a group has at most 65,536 of them
    however many cells it holds, and ordering them in one task is bounded. ``carried`` are
    aggregates over the counted rows.
    """
    group = W.partitionBy(*keys)
    run = F.sum(weight).over(group.orderBy(code).rowsBetween(W.unboundedPreceding, 0))
    placed = counts.withColumn("_run", run).withColumn("_total", F.sum(weight).over(group))
    position = (F.col("_total") - 1) / 2
    holds = lambda rank: (F.col(weight) > 0) & (rank < F.col("_run")) & (rank >= F.col("_run") - F.col(weight))
    side = lambda rank: F.max(F.when(holds(rank), F.col(code)))
    return placed.groupBy(*keys).agg(*carried, ((side(F.floor(position)) + side(F.ceil(position))) / 2).alias(name))


def global_rank(df: DataFrame, value: str, ident: str, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``rank_position`` (1..n, ties by md5 of the id), ``rank_min`` and ``rank_total``.

    The order is (value, md5(id), id), over the whole table or within each group of ``keys``. The
    value keeps its type (numbers, dates, times, text); NULL comes last, NaN before it. Counts per
    (value, two digits of the md5) split even a value that a third of the rows share over 256 tasks.
    """
    keys = list(keys)
    # join keys that cannot be NULL: no filter is pushed into one reader of ``counts`` only, so its
    # exchange is reused
    fixed = lambda column, default: F.coalesce(column, F.lit(default))
    kind = df.schema[value].dataType.typeName()
    fine = F.lit(0).cast("long") if kind in ("string", "date", "timestamp", "timestamp_ntz") else fine_bin(F.col("_v"))
    tagged = df.withColumn("_v", F.col(value)).withColumn("_h", fixed(F.md5(F.col(ident).cast("string")), ""))
    tagged = tagged.withColumn("_sub", F.substring("_h", 1, 2))
    counts = tagged.groupBy(*keys, "_v", "_sub").agg(F.count(F.lit(1)).alias("_n")).withColumns({"_bin": order_bin(F.col("_v"), kind), "_fine": fine})
    hist = _histogram(counts, keys)
    step = [*keys, "_bin", "_fine"]
    ordered = W.partitionBy(*step).orderBy(F.asc_nulls_last("_v"), "_sub").rowsBetween(W.unboundedPreceding, 0)
    offsets = (
        _null_safe_join(counts, hist, step)
        .withColumn("_before", F.col("_before_bin") + F.sum("_n").over(ordered) - F.col("_n"))
        .select(*keys, "_v", "_sub", "_before", "_total", F.min("_before").over(W.partitionBy(*step, "_v")).alias("_first"))
    )
    local = W.partitionBy(*keys, "_v", "_sub").orderBy("_h", ident)
    return _null_safe_join(tagged, offsets, [*keys, "_v", "_sub"]).select(
        *df.columns,
        (F.col("_before") + F.row_number().over(local)).alias("rank_position"),
        (F.col("_first") + 1).alias("rank_min"),
        F.col("_total").alias("rank_total"),
    )


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys where NULL meets NULL; the right key columns are dropped."""
    renamed = right.select(*[F.col(c).alias(f"_r{c}") for c in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_r{c}"))
    return left.join(renamed, same).drop(*[f"_r{c}" for c in keys])


def ordinals(df: DataFrame, keys: Sequence[str], order: str, ident: str, name: str = "ordinal") -> DataFrame:
    """``row_number`` by a number, date, time or text within groups of any size."""
    return global_rank(df, order, ident, keys).withColumn(name, F.col("rank_position")).select(*df.columns, name)


def tile_of(position: Column, total: Column, tiles: int) -> Column:
    """``ntile``: the first ``total % tiles`` tiles hold one row more."""
    size, larger = F.floor(total / tiles), total % tiles
    edge = larger * (size + 1)
    later = larger + F.floor((position - 1 - edge) / F.greatest(size, F.lit(1))) + 1
    return F.when(position <= edge, F.floor((position - 1) / (size + 1)) + 1).otherwise(later).cast("int")


def ntile(df: DataFrame, tiles: int, value: str, ident: str, name: str) -> DataFrame:
    """Exact ``ntile`` over the whole table without a single-partition window."""
    ranked = global_rank(df, value, ident)
    return ranked.withColumn(name, tile_of(F.col("rank_position"), F.col("rank_total"), tiles)).select(*df.columns, name)


def quantile_class(df: DataFrame, value: str, ident: str, classes: int = 6, name: str = "quantile_class") -> DataFrame:
    """Class by the place of the first equal value in the sorted values, clamped to the last class."""
    ranked = global_rank(df, value, ident)
    place = F.floor((F.col("rank_min") - 1) * classes / F.col("rank_total"))
    return ranked.withColumn(name, F.greatest(F.lit(0), F.least(place, F.lit(classes - 1))).cast("int")).select(*df.columns, name)


def stratified_sample(df: DataFrame, value: str, ident: str, strata: int = 4, per_stratum: int = 5) -> DataFrame:
    """The first ids by md5 in each size class: repeatable, not a plain regional sample.

    Each md5 prefix keeps its own first ids before the strata are compared, so no task sees a
    whole stratum.
    """
    tiled = ntile(df, strata, value, ident, "stratum").withColumn("_h", F.md5(F.col(ident).cast("string")))
    local = W.partitionBy("stratum", F.substring("_h", 1, 2)).orderBy("_h", ident)
    final = W.partitionBy("stratum").orderBy("_h", ident)
    return (
        tiled.withColumn("_k", F.row_number().over(local))
        .where(F.col("_k") <= per_stratum)
        .withColumn("sample_rank", F.row_number().over(final))
        .where(F.col("sample_rank") <= per_stratum)
        .drop("_h", "_k")
    )
