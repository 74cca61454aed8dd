"""Mixing sources to target weights along a time-varying curriculum.

Each source has a demand: its share of all tokens, spread over training time by a linear schedule. The documents
of a source, in md5 order of their ids and cycled if the source repeats, supply that demand; a document's training
position is where the integrated schedule reaches the tokens before it. Rows are finally sorted by position.
Running totals are two-level (md5 bucket, then inside the bucket), so a source with a third of all rows is spread
over ``BUCKETS`` window groups. The table of sources is one row per source and is ranked as a whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellsight.llm.common import SPACE_CLASS, SPACES, fresh, stored

WEIGHTS = (5, 2, 1)
SLOPES = (-0.5, 0.0, 0.5)
MAX_REPEATS = 3
BUCKET_DIGITS = 3
BUCKETS = 16 ** BUCKET_DIGITS


def n_words(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACE_CLASS + "+"))).cast("long")


def _source_key(source: Column) -> Column:
    """Code-point order with null last, and never null."""
    return F.when(source.isNull(), "z").otherwise(F.concat(F.lit("a"), source.cast("string")))


def _cyclic(rank: Column, values: tuple) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), ((rank - 1) % len(values)).cast("int"))


def targets(source_sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``_key, source_size`` to ``_key, source_size, weight, slope, target``.

    Targets share the total of all sizes by weight; a target stops at ``max_repeats`` times the source's size and
    the excess goes to the others by weight. With sources ordered by cap / weight, the capped ones come first, so
    one running total settles what repeated resharing would. All comparisons are between exact integers.
    """
    common = math.lcm(*weights)
    big = lambda c: c.cast("decimal(38,0)")
    ranked = source_sizes.withColumn("_rank", F.row_number().over(W.orderBy("_key")))
    ranked = ranked.withColumns({"weight": _cyclic(F.col("_rank"), weights).cast("long"), "slope": _cyclic(F.col("_rank"), slopes).cast("double"), "_cap": max_repeats * F.col("source_size")})
    ranked = ranked.withColumn("_turn", F.col("_cap").cast("decimal(20,0)") * _cyclic(F.col("_rank"), tuple(common // w for w in weights)).cast("decimal(10,0)"))
    order, whole = W.orderBy("_turn", "_rank"), W.partitionBy()
    ranked = ranked.withColumns({
        "_before": F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "_weights": F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)),
        "_total": F.sum("source_size").over(whole),
    })
    short = lambda c: c.cast("decimal(19,0)")
    capped = big(short(F.col("_cap")) * short(F.col("_weights"))) <= big(short(F.col("_total") - F.col("_before")) * short(F.col("weight")))
    ranked = ranked.withColumn("_capped", capped)
    level = (F.max("_total").over(whole) - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))).over(whole), F.lit(0))).cast("double") / F.sum(F.when(~F.col("_capped"), F.col("weight"))).over(whole).cast("double")
    return ranked.withColumn("target", F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(level * F.col("weight"))).select("_key", "source_size", "weight", "slope", "target")


def position(share: Column, slope: Column) -> Column:
    """Training time in 0..1 at which the integral of the schedule 1 + slope * (2t - 1) reaches ``share``."""
    a = 1 - slope
    return F.when(slope == 0, share).otherwise((F.sqrt(a * a + 4 * slope * share) - a) / (2 * slope))


def plan_mix(docs: DataFrame, size: str = "size", weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per row of ``docs`` (needs doc_id, source and the size column), with ``source_size``, ``target``,
    ``positions`` (one training time per copy that the mix takes) and ``taken`` (size times copies).

    A copy is taken while its middle lies below the target, so a source misses its target by at most half a document.
    Documents of size 0 are placed like others and take nothing. Equal ids are ordered by size. No table: no rows.
    """
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = docs.withColumns({"_key": _source_key(F.col("source")), "_digest": digest, "_bucket": F.substring(digest, 1, BUCKET_DIGITS)})
    cells = keyed.groupBy("_key", "_bucket").agg(F.sum(size).alias("_cell"))
    cells = cells.withColumn("_offset", F.coalesce(F.sum("_cell").over(W.partitionBy("_key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    cells = stored(cells, "cells")
    sources = targets(cells.groupBy("_key").agg(F.sum("_cell").alias("source_size")), weights, slopes, max_repeats)
    offsets = cells.join(sources, "_key").select("_key", "_bucket", "_offset", "source_size", "slope", "target")
    inside = W.partitionBy("_key", "_bucket").orderBy("_digest", size).rowsBetween(W.unboundedPreceding, -1)
    rows = keyed.join(offsets, ["_key", "_bucket"]).withColumn("_start", F.col("_offset") + F.coalesce(F.sum(size).over(inside), F.lit(0)))
    middle = lambda k: 2 * (k.cast("long") * F.col("source_size") + F.col("_start")) + F.col(size)
    copies = F.filter(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda k: middle(k) <= 2 * F.col("target"))
    time = lambda k: position(F.when(F.col("target") > 0, middle(k) / (2 * F.col("target"))).otherwise(0.0), F.col("slope"))
    rows = rows.withColumn("positions", F.transform(copies, time)).withColumn("taken", F.col(size) * F.size("positions"))
    return rows.drop("_key", "_bucket", "_digest", "_offset", "_start", "slope")


def mix(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The taken copies of ``docs`` in training order, with the columns of ``docs`` only."""
    size, columns = fresh("size", docs.columns), docs.columns
    planned = plan_mix(docs.withColumn(size, n_words(F.col(text))), size, **options)
    at = fresh("position", columns)
    spread = planned.select(*columns, F.explode("positions").alias(at))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.repartitionByRange(n, at, "doc_id").sortWithinPartitions(at, "doc_id").select(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    planned = plan_mix(sized).select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("first_position"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return planned.repartitionByRange(n, "first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")


SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
c AS (SELECT *, ([5, 2, 1])[(rank - 1) % 3 + 1]::HUGEINT AS weight, {MAX_REPEATS} * source_size::HUGEINT AS cap, sum(source_size) OVER ()::HUGEINT AS total FROM s),
t AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before,
             sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS weights
      FROM c WINDOW o AS (ORDER BY cap * (10 // weight), rank)),
u AS (SELECT *, cap * weights <= (total - before) * weight AS capped FROM t),
v AS (SELECT (max(total) - coalesce(sum(cap) FILTER (capped), 0))::DOUBLE / (sum(weight) FILTER (NOT capped))::DOUBLE AS level FROM u),
g AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE level * weight::DOUBLE END AS target, ([-0.5, 0.0, 0.5])[(rank - 1) % 3 + 1]::DOUBLE AS slope FROM u, v),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.slope,
             (coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
q AS (SELECT *, len(list_filter(range({MAX_REPEATS}), lambda k: 2 * (k * source_size + start) + size <= 2 * target)) AS copies,
             CASE WHEN target > 0 THEN (2 * start + size)::DOUBLE / (2 * target) ELSE 0.0 END AS share FROM p)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken,
       CASE WHEN copies > 0 THEN CASE WHEN slope = 0 THEN share ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope) END END AS first_position FROM q"""
