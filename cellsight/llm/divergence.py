"""How far the sources of a language differ from each other and from the language as a whole.

Every language keeps the terms that enough of its documents hold. A CountVectorizer model over the kept terms (blocks of bounded size, one model
each) turns documents into exact sparse vectors, whose entries are summed over every (language, source) group. Shares of
terms are compared as integers: a term that neither of two sources holds gives the same value for all such terms, so only entries
that are there are compared, in cells of bounded numbers of sources and terms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellsight.llm.common import stored

MIN_DF, VOCAB_SIZE, TOP_TERMS = 10, 2**31 - 1, 10
SCALE = 1_000_000_000
BLOCK_TERMS, BLOCK_BYTES = 500_000, 32 << 20
CELL_SOURCES, CELL_TERMS = 256, 1_024
SPREAD = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """Runs of ASCII letters, A-Z lowered, and of characters beyond ASCII, in order; none for null."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))  # ASCII texts the quicker way
    return F.array_remove(F.split(lowered, NO_TERM), "")


def _named(docs: DataFrame, text: str) -> DataFrame:
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(known("lang"), known("source"), terms(F.col(text)).alias("terms"))


def vocabulary(docs: DataFrame, text: str = "text", min_df: int = MIN_DF) -> DataFrame:
    """``lang, term``: the terms in at least ``min_df`` documents of the language, as CountVectorizer's minDF keeps them."""
    held = _named(docs, text).select("lang", F.explode(F.array_distinct("terms")).alias("term"))
    return held.groupBy("lang", "term").count().filter(F.col("count") >= min_df).select("lang", "term")


def _blocks(kept: DataFrame) -> tuple[DataFrame, int]:
    """The distinct kept terms with their block; no block holds more than ``BLOCK_TERMS`` terms or ``BLOCK_BYTES`` bytes unless one term does."""
    distinct = kept.select("term").distinct()
    n, size = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / BLOCK_TERMS), math.ceil(size / BLOCK_BYTES))
    while True:
        dealt = distinct.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)))
        most = dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term")).alias("size")).agg(F.max("n"), F.max("size")).first()
        if blocks == 1 or most[0] <= BLOCK_TERMS and most[1] <= BLOCK_BYTES or blocks > n:
            return dealt, blocks
        blocks *= 2


def document_vectors(docs: DataFrame, block: DataFrame, text: str = "text", vocab_size: int = VOCAB_SIZE) -> tuple[DataFrame, DataFrame]:
    """Sparse vectors (``lang, source, indices, values``) of all documents over the terms of ``block``, and ``term, index``."""
    alone = block.select("term", F.array("term").alias("terms"))
    model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=1.0, vocabSize=vocab_size).fit(alone)
    entries = lambda df, *keep: model.transform(df).select(*keep, F.unwrap_udt("vector").alias("v"))
    places = entries(alone, "term").select("term", F.get("v.indices", F.lit(0)).alias("index"))
    return entries(_named(docs, text), "lang", "source").select("lang", "source", "v.indices", "v.values"), places


def _batch_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, index, count`` of the vectors (lang, source, indices, values) of a batch, summed for every group and index."""
    for batch in batches:
        lang, source = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        key = np.repeat(group, batch.column(2).value_lengths().to_numpy()) << 32 | batch.column(2).flatten().to_numpy()
        if not len(key):
            continue
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        count = np.add.reduceat(batch.column(3).flatten().to_numpy()[order].astype(np.int64), first)
        group = key[first] >> 32
        names = [d.dictionary.take(pa.array(codes)) for d, codes in ((lang, group // len(source.dictionary)), (source, group % len(source.dictionary)))]
        yield pa.RecordBatch.from_arrays([*names, pa.array((key[first] & 0xFFFFFFFF).astype(np.int32)), pa.array(count)], ["lang", "source", "index", "count"])


def group_sums(docs: DataFrame, kept: DataFrame, text: str = "text", vocab_size: int = VOCAB_SIZE) -> DataFrame:
    """``lang, source, term, count`` of the kept terms that a group holds: sparse vectors summed entry by entry, batch by batch before the shuffle."""
    dealt, blocks = _blocks(kept)
    dealt = stored(dealt, "terms") if blocks > 1 else dealt
    parts = []
    for b in range(blocks):
        vectors, places = document_vectors(docs, dealt.filter(F.col("block") == b), text, vocab_size)
        entries = vectors.mapInArrow(_batch_sums, "lang string, source string, index int, count long")
        summed = entries.groupBy("lang", "source", "index").agg(F.sum("count").alias("count"))
        parts.append(stored(summed.join(places, "index").join(kept, ["lang", "term"]).select("lang", "source", "term", "count"), "sums"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (n + 2 v)), in exact decimals; null without terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.when(v > 0, F.call_function("div", wide(F.lit(SCALE)) * wide(count + 2), wide(n + 2 * v)) + 1)


def contrast(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _cells(entries: pd.DataFrame) -> pd.DataFrame:
    """Of one cell (a language, two runs of sources, a share of the terms): what each pair differs beyond terms that neither holds."""
    marks, there = entries[entries["term"].isna()], entries[entries["term"].notna()]
    marks = marks.drop_duplicates("source_no").sort_values("source_no")
    numbers, none = marks["source_no"].to_numpy(), marks["p"].fillna(1).to_numpy(np.int64)
    codes, distinct = pd.factorize(there["term"])
    p = np.repeat(none[:, None], len(distinct), axis=1)
    p[np.searchsorted(numbers, there["source_no"].to_numpy()), codes] = there["p"].to_numpy(np.int64)
    first = marks["first"].to_numpy(bool)
    same = bool(marks["same"].iloc[0])
    a_all, b_all, value = [], [], []
    for a in range(len(numbers)) if same else np.flatnonzero(first):
        b = np.arange(a + 1, len(numbers)) if same else np.flatnonzero(~first)
        f0 = (none[b] - none[a]) ** 2 // (none[b] + none[a])
        f = (p[b] - p[a]) ** 2 // (p[b] + p[a])
        a_all.append(np.full(len(b), numbers[a]))
        b_all.append(numbers[b])
        value.append(f.sum(axis=1) - f0 * len(distinct))
    whole = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pd.DataFrame({"lang": entries["lang"].iloc[0], "a": whole(a_all), "b": whole(b_all), "value": whole(value)})


def pair_values(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every two sources of a language, both ways round.

    ``entries``: lang, source_no, term, p, slots, runs; ``groups``: lang, source, source_no, v, p_none, slots, runs. A cell takes the
    entries of at most two runs of ``CELL_SOURCES`` sources and about ``CELL_TERMS`` terms.
    """
    run = F.floor((F.col("source_no") - 1) / CELL_SOURCES)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("other")
    met = lambda df: df.withColumn("run", run).select("*", other).withColumns({"i": F.least("run", "other"), "j": F.greatest("run", "other")})
    sides = {"first": F.col("run") == F.col("i"), "same": F.col("i") == F.col("j")}
    there = met(entries).withColumn("slot", F.pmod(F.xxhash64("term"), "slots"))
    marks = met(groups.select("lang", "source_no", F.lit(None).cast("string").alias("term"), F.col("p_none").alias("p"), "slots", "runs"))
    marks = marks.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
    columns = ["lang", "i", "j", "slot", "source_no", "term", "p", "first", "same"]
    cells = there.withColumns(sides).select(*columns).unionByName(marks.withColumns(sides).select(*columns))
    parts = cells.groupBy("lang", "i", "j", "slot").applyInPandas(_cells, "lang string, a long, b long, value long")
    summed = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("beyond"))
    side = lambda s: groups.select("lang", F.col("source_no").alias(s), F.col("source").alias(f"source_{s}"), F.col("p_none").alias(f"p_{s}"), F.col("v").alias(f"v_{s}"))
    whole = summed.join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"])
    value = F.when(F.col("v_a") > 0, F.col("beyond") + F.col("v_a") * contrast(F.col("p_a"), F.col("p_b"))).otherwise(F.lit(0)).cast("long")
    both = F.explode(F.array(*[F.struct(F.col(f"source_{x}").alias("source"), F.col(f"source_{y}").alias("item")) for x, y in ("ab", "ba")])).alias("s")
    return whole.select("lang", both, value.alias("value")).select("lang", "s.source", "s.item", "value")


def audit(docs: DataFrame, text: str = "text", min_df: int = MIN_DF, vocab_size: int = VOCAB_SIZE, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` (``part`` is ``pair`` or ``term``) of all (lang, source) groups of ``docs``.

    Null text, lang and source count as ''. A group whose documents hold no kept term has pairs but no terms; in a language that keeps no
    term every pair has value 0; a language of one source has no pairs. Repeated rows count each. An empty table gives no rows. Other
    columns are not read.
    """
    kept = stored(vocabulary(docs, text, min_df), "vocabulary")
    sums = group_sums(docs, kept, text, vocab_size)
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    found = docs.select(known("lang"), known("source")).distinct()
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    words = sums.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = found.join(sizes, "lang", "left").join(words, ["lang", "source"], "left").fillna(0, ["v", "n"])
    groups = groups.withColumn("source_no", F.row_number().over(W.partitionBy("lang").orderBy("source")).cast("long"))
    groups = groups.withColumns({"runs": F.ceil(F.count(F.lit(1)).over(W.partitionBy("lang")) / CELL_SOURCES), "all_n": F.sum("n").over(W.partitionBy("lang"))})
    groups = stored(groups.withColumns({"p_none": share(F.lit(0), F.col("n"), F.col("v")), "slots": F.greatest(F.lit(1).cast("long"), F.ceil(F.col("v") / CELL_TERMS))}), "groups")
    entries = sums.join(groups, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("n"), F.col("v")))

    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(entries.select("lang", "source_no", "term", "p", "slots", "runs"), groups)
    pairs = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))

    totals = sums.groupBy("lang", "term").agg(F.sum("count").alias("all_count"))
    against = entries.join(totals, ["lang", "term"]).withColumn("q", share(F.col("all_count"), F.col("all_n"), F.col("v")))
    ahead = against.filter(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), contrast(F.col("p"), F.col("q")).alias("value"))
    dealt = ahead.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SPREAD))).repartition("lang", "source", "salt")  # else a group stays together from a join before
    part = W.partitionBy("lang", "source", "salt").orderBy(F.desc("value"), "item")
    first = dealt.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top_terms)
    best = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(best.select(*columns))


def query(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


_P = lambda count, n: f"1 + ({SCALE}::HUGEINT * ({count} + 2)) // ({n} + 2 * v)"
_F = "((p - q) * (p - q) // (p + q))::BIGINT"
SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  unnest(list_concat(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), [''])) AS term FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, term FROM d WHERE term <> '' GROUP BY lang, term HAVING count(DISTINCT rid) >= {MIN_DF}),
vs AS (SELECT g.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN k USING (lang) GROUP BY g.lang),
s AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM d JOIN k USING (lang, term) GROUP BY lang, source, term),
gn AS (SELECT g.lang, g.source, v, coalesce(sum(s.n), 0)::HUGEINT AS n FROM g JOIN vs USING (lang) LEFT JOIN s USING (lang, source) GROUP BY g.lang, g.source, v),
gp AS (SELECT gn.lang, gn.source, k.term, coalesce(s.n, 0) AS c, {_P('coalesce(s.n, 0)', 'gn.n')} AS p FROM gn JOIN k USING (lang) LEFT JOIN s USING (lang, source, term)),
lp AS (SELECT lang, term, {_P('c', 'n')} AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS c FROM s GROUP BY lang, term) JOIN (SELECT lang, sum(n)::HUGEINT AS n FROM s GROUP BY lang) USING (lang) JOIN vs USING (lang)),
pv AS (SELECT a.lang, a.source, b.source AS item, sum({_F})::BIGINT AS value FROM gp a JOIN (SELECT lang, source, term, p AS q FROM gp) b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pv.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
tops AS (SELECT lang, source, 'term' AS part, term AS item, {_F} AS value FROM gp JOIN lp USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM tops) QUALIFY part = 'pair' OR rank <= {TOP_TERMS}"""
