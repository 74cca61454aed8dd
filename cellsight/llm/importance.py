"""Importance resampling towards a target distribution, with a head-tail vocabulary.

Features are runs of one or two words; a feature's bucket is the CRC-32 of its bytes modulo ``BUCKETS``. Words are counted over all
documents; the most frequent ones form the head, whose exact CRC states (after the word, and after the word and a space)
are broadcast, together with the buckets of the most frequent pairs among the first of them. A pair of a head word continues that word's
state, and any other feature takes its CRC directly. The head only saves work: both ways give the bucket of the same bytes, so
bucket totals, gains and weights are exact for any head. Weights get Gumbel noise from the document's id, and the
highest scores are drawn.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsight.llm.common import fresh, stored

BUCKETS = 10_000
MIN_WORDS, DRAWN_PCT, SEED = 20, 25, 7
HEAD_WORDS, HEAD_WORD_BYTES = 65_536, 64  # at most 4 MB of words
PAIR_WORDS, HEAD_PAIRS = 1_024, 262_144  # at most 2 MB of pair buckets
HELD_WORDS = 200_000  # distinct words that a task counts before it passes them on
PIECE = 1 << 20
UNSEEN = 0xFFFF

_ALNUM = b"0123456789abcdefghijklmnopqrstuvwxyz"
WORD_BYTES = bytes(b if b in _ALNUM or b >= 0x80 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def pieces(raw: bytes | None) -> Iterator[list[bytes]]:
    """The A-Z-lowered words in order, in lists of at most about ``PIECE`` bytes, so a very long text is never held as one list."""
    text, at = (raw or b"").translate(WORD_BYTES), 0
    while at < len(text):
        cut = text.find(b" ", at + PIECE)
        cut = len(text) if cut < 0 else cut
        yield text[at:cut].split()
        at = cut


def _binary(column: pa.Array) -> pa.Array:
    return column.cast(pa.binary() if column.type == pa.string() else pa.large_binary())


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word`` (bytes), ``n``: occurrences in all documents of every word of at most ``HEAD_WORD_BYTES`` bytes."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            fit = [(w, n) for w, n in held.items() if len(w) <= HEAD_WORD_BYTES]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in fit], pa.binary()), pa.array([n for _, n in fit], pa.int64())], ["word", "n"])

        for batch in batches:
            for value in _binary(batch.column(0)):
                for words in pieces(value.as_py()):
                    held.update(words)
                    if len(held) > HELD_WORDS:
                        yield out()
        yield out()

    return docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Head:
    """CRC states of frequent words and buckets of frequent pairs; ``buckets`` answers for any text."""

    def __init__(self, words: list[bytes], pairs: np.ndarray | None = None) -> None:
        self.codes = {w: i for i, w in enumerate(words)}
        after = np.array([zlib.crc32(w) for w in words] + [0], np.uint32)
        self.single = (after % BUCKETS).astype(np.uint16)
        self.spaced = np.array([zlib.crc32(w + b" ") for w in words] + [0], np.uint32)
        self.pairs = np.full(PAIR_WORDS * PAIR_WORDS, UNSEEN, np.uint16)
        for p in (pairs if pairs is not None else []):
            self.pairs[p] = zlib.crc32(words[p % PAIR_WORDS], int(self.spaced[p // PAIR_WORDS])) % BUCKETS

    def coded(self, words: list[bytes]) -> np.ndarray:
        """Codes of head words, -1 for the tail."""
        return np.fromiter(map(self.codes.get, words, repeat(-1)), np.int64, len(words))

    def pair_codes(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which neighbours are both among the first ``PAIR_WORDS`` words, and the codes of these pairs."""
        first, second = codes[:-1], codes[1:]
        both = (first >= 0) & (second >= 0) & (first < PAIR_WORDS) & (second < PAIR_WORDS)
        return both, first[both] * PAIR_WORDS + second[both]

    def buckets(self, raw: bytes | None) -> tuple[int, np.ndarray]:
        """Number of words, and the buckets of all words and pairs of a text."""
        n, found, last = 0, [], None
        for words in pieces(raw):
            n += len(words)
            codes = self.coded(words)
            one = self.single[codes]
            for i in np.flatnonzero(codes < 0):
                one[i] = zlib.crc32(words[i]) % BUCKETS
            found.append(one)
            if last is not None and words:
                words = [last, *words]
                codes = np.concatenate([self.coded([last]), codes])
            if len(words) > 1:
                found.append(self._pairs(words, codes))
            last = words[-1] if words else last
        return n, np.concatenate(found) if found else np.zeros(0, np.uint16)

    def _pairs(self, words: list[bytes], codes: np.ndarray) -> np.ndarray:
        two = np.full(len(words) - 1, UNSEEN, np.uint16)
        both, known = self.pair_codes(codes)
        two[both] = self.pairs[known]
        rest = np.flatnonzero(two == UNSEEN)
        states = self.spaced[codes[rest]]
        tail = np.flatnonzero(codes[rest] < 0)
        for i in tail:
            states[i] = zlib.crc32(b" ", zlib.crc32(words[rest[i]]))
        two[rest] = np.fromiter(map(zlib.crc32, [words[i + 1] for i in rest.tolist()], states.tolist()), np.uint32, len(rest)) % BUCKETS
        return two


def head(docs: DataFrame, text: str = "text", n_words: int = HEAD_WORDS, n_pairs: int = HEAD_PAIRS) -> Head:
    """The ``n_words`` most frequent words and the ``n_pairs`` most frequent pairs of the first ``PAIR_WORDS`` of them, by exact counts, ties by bytes."""
    words = [r["word"] for r in word_counts(docs, text).orderBy(F.desc("n"), "word").limit(n_words).select("word").toLocalIterator()]
    shared = docs.sparkSession.sparkContext.broadcast(Head(words))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, held = shared.value, np.zeros(PAIR_WORDS * PAIR_WORDS, np.int64)
        for batch in batches:
            for value in _binary(batch.column(0)):
                last = None
                for ws in pieces(value.as_py()):
                    ws = [last, *ws] if last is not None else ws
                    np.add.at(held, h.pair_codes(h.coded(ws))[1], 1)
                    last = ws[-1] if ws else last
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(held[there])], ["pair", "n"])

    counted = docs.select(text).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = counted.orderBy(F.desc("n"), "pair").limit(n_pairs).select("pair").toPandas()["pair"].to_numpy(np.int64)
    return Head(words, pairs)


def features(docs: DataFrame, known: Head, text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, buckets`` (all feature buckets as unsigned 16-bit integers) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shared.value.buckets(v.as_py()) for v in _binary(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([len(b) for _, b in made], pa.int64()), pa.array([b.astype("<u2").tobytes() for _, b in made], pa.binary())],
                ["doc_id", "n_words", "n_features", "buckets"],
            )

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("buckets", T.BinaryType())])
    return docs.select("doc_id", F.col(text).alias("_text")).mapInArrow(of, schema)


def totals(featured: DataFrame) -> np.ndarray:
    """Exact number of features in every bucket; one row for each bucket and task is shuffled, ``BUCKETS`` rows come back."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for value in batch.column(0):
                held += np.bincount(np.frombuffer(value.as_buffer(), "<u2"), minlength=BUCKETS)
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(held[there])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in featured.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold log-ratio of the smoothed target and source shares of every bucket."""
    s_all, t_all = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighed(featured: DataFrame, gain: np.ndarray) -> DataFrame:
    """``weight``, the floored mean gain of a document's features (0 without features), in place of the buckets."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(gain[np.frombuffer(b.as_buffer(), "<u2")].sum()) for b in batch.column(3)]
            weights = [s // n if n else 0 for s, n in zip(sums, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weights, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    schema = T.StructType([*featured.schema.fields[:3], T.StructField("weight", T.LongType())])
    return featured.mapInArrow(of, schema)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandfold Gumbel noise from the first 32 bits of sha256(``seed:doc_id``)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", drawn_pct: int = DRAWN_PCT, min_words: int = MIN_WORDS, seed: int = SEED, n_words: int = HEAD_WORDS, n_pairs: int = HEAD_PAIRS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_features, weight, score, rank``; rank is null for rows that are not drawn.

    ``drawn_pct`` percent (rounded down) of the rows with at least ``min_words`` words are drawn, by score, ties by smaller doc_id
    (null last), then by the other columns. Null and empty texts, in ``docs`` and ``target`` alike, have no words, weight 0 and are
    never drawn. A null doc_id counts as the empty string in the noise. Rows that repeat a doc_id are judged by their own text.
    Empty ``docs`` give no rows, an empty ``target`` gives gains from the smoothing alone. Other columns are not read.

    Scores are integers of a range that the logarithms bound (about 100,000 values), so the ranks come from a
    running total over their counts and from an order inside each score.
    """
    known = head(docs, text, n_words, n_pairs)
    featured = stored(features(docs, known, text), "features")
    wanted = features(target.select(F.lit(0).alias("doc_id"), F.col(text).alias("_text")), known, "_text")
    gain = gains(totals(featured), totals(wanted))
    scored = stored(weighed(featured, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scores")

    allowed = F.col("n_words") >= min_words
    steps = scored.filter(allowed).groupBy("score").agg(F.count(F.lit(1)).alias("_n"))
    down = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    steps = steps.withColumns({"_before": F.coalesce(F.sum("_n").over(down), F.lit(0)), "_all": F.sum("_n").over(W.partitionBy())})
    steps = steps.withColumn("_draw", F.expr(f"{drawn_pct} * _all div 100")).filter("_before < _draw")
    inside = W.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_words", "n_features", "weight")
    reached = scored.filter(allowed).join(steps.select(F.col("score").alias("_score"), "_before", "_draw"), F.col("score") == F.col("_score"))
    ranked = reached.withColumn("_rank", F.col("_before") + F.row_number().over(inside)).withColumn("rank", F.when(F.col("_rank") <= F.col("_draw"), F.col("_rank")))
    least = steps.agg(F.min("score")).scalar()
    rest = scored.filter(~allowed | least.isNull() | (F.col("score") < least))
    columns = [*scored.columns, "rank"]
    return ranked.select(*columns).unionByName(rest.withColumn("rank", F.lit(None).cast("long")).select(*columns))


def draw(docs: DataFrame, target: DataFrame, text: str = "text", **options) -> DataFrame:
    """The drawn rows of ``docs``, whole, with their columns only. Where rows repeat a doc_id, as many of them as were drawn, by text."""
    one, many, row = (fresh(name, docs.columns) for name in ("id", "drawn", "row"))
    drawn = resample(docs, target, text, **options).filter("rank IS NOT NULL").groupBy(F.col("doc_id").alias(one)).agg(F.count(F.lit(1)).alias(many))
    rows = docs.join(drawn, docs["doc_id"].eqNullSafe(F.col(one))).withColumn(row, F.row_number().over(W.partitionBy("doc_id").orderBy(text)))
    return rows.filter(F.col(row) <= F.col(many)).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RUNS = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
SQL = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), e AS (SELECT {_WORDS} AS w FROM benchmark),
f AS (SELECT row_number() OVER () AS rid, doc_id, len(w) AS n_words, {_RUNS} AS fs FROM d), b AS (SELECT {_RUNS} AS fs FROM e),
df AS (SELECT rid, unnest(fs) AS f FROM f), bf AS (SELECT unnest(fs) AS f FROM b),
tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
hex AS (SELECT f, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM (SELECT f FROM df UNION SELECT f FROM bf)),
crc AS (SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, v: xor(c >> 8, t[xor(c & 255, v) + 1])), 4294967295) % {BUCKETS} AS bucket FROM hex, tab),
s AS (SELECT bucket, count(*) AS n FROM df JOIN crc USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM bf JOIN crc USING (f) GROUP BY bucket),
g AS (SELECT r.range AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS})::DOUBLE
        / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
      FROM range({BUCKETS}) r LEFT JOIN s ON s.bucket = r.range LEFT JOIN t ON t.bucket = r.range),
m AS (SELECT rid, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM df JOIN crc USING (f) JOIN g USING (bucket) GROUP BY rid),
h AS (SELECT f.rid, doc_id, n_words, len(fs)::BIGINT AS n_features, coalesce(m.weight, 0) AS weight,
             ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM f LEFT JOIN m ON m.rid = f.rid),
k AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM h),
o AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_words, n_features, weight) AS place, count(*) OVER () AS n FROM k WHERE n_words >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {DRAWN_PCT} * n // 100 THEN place END AS rank FROM k LEFT JOIN o USING (rid)"""
