"""Document fingerprints from improbable features: rare byte windows in chained Bloom filters.

Windows of ``WINDOW`` bytes start at every byte (one in ``SPACING`` places: all).
A window's entropy falls into one of ``CLASSES`` classes; the fewer windows of all documents a class holds, the rarer it is. In every run of
``RUN`` windows the rarest (the leftmost of equals) gets a vote, and windows with ``VOTES`` votes are features. Each feature sets ``BITS`` bits of a
filter of ``FILTER_BITS`` bits; after ``FILL`` features the next filter begins. Two digests are alike as far as the bits of their
filters overlap beyond chance.
"""

from __future__ import annotations

import base64
import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsight.llm import hashing

WINDOW, SPACING = 64, 1
CLASSES, LOWEST_BITS = 256, 1.0
RUN, VOTES = 64, 16
FILTER_BITS, BITS, FILL = 2048, 5, 160
NOISE = 3.0
STRETCH = 1 << 18

# log2 of how often a symbol occurs in its window, in 65536ths, alone and times as often: integers, so every machine finds the same classes
_LOGS = np.array([0] + [math.floor(math.log2(c) * 65536) for c in range(1, WINDOW + 1)], np.int64)
_WEIGHTS = _LOGS * np.arange(WINDOW + 1)
_GAINS = np.diff(_WEIGHTS, prepend=0)  # of a symbol's last occurrence in a window
_FULL = int(_LOGS[WINDOW])
_LANES = [np.array([np.uint64(1) << np.uint64(8 * (v & 31) - 64 * k) if (v & 31) // 8 == k else 0 for v in range(256)], np.uint64) for k in range(4)]


def starts(raw: np.ndarray) -> np.ndarray:
    """Where windows start: at every byte that has a whole window, in a short text at the first."""
    return np.arange(max(len(raw) - WINDOW + 1, min(len(raw), 1)))


def entropy_classes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Entropy class of the windows that start at ``at`` (ascending): 0 for evenly spread symbols, ``CLASSES - 1`` for one symbol alone.

    The symbols of the entropy are the low five bits of the bytes (letters without case). Eight symbols share one running total of
    64 bits, eight bits each: no window holds more than ``WINDOW`` of one symbol. From one window to the next a symbol leaves and one comes.
    """
    width = min(WINDOW, len(raw))
    classes = np.zeros(len(at), np.uint8)
    for low in range(0, len(raw), STRETCH):
        i, j = np.searchsorted(at, (low, low + STRETCH))
        if i == j:
            continue
        part = raw[low : low + STRETCH + width - 1]
        n = len(part) - width + 1
        total, counts = np.zeros(len(part) + 1, np.uint64), np.empty((n, len(_LANES)), "<u8")
        for k, lane in enumerate(_LANES):
            np.cumsum(lane.take(part), out=total[1:])
            np.subtract(total[width:], total[:n], out=counts[:, k])
        held, symbols, row = counts.view(np.uint8), part & 31, np.arange(n - 1)
        sums = np.empty(n, np.int64)
        sums[0] = _WEIGHTS.take(held[0]).sum()
        sums[1:] = _GAINS.take(held[row + 1, symbols[width:]]) - _GAINS.take(held[row, symbols[: n - 1]])
        # a quotient that is no whole number is far from one: the division of doubles gives the class of the whole numbers
        whole = (np.cumsum(sums) * CLASSES / (width * _FULL + 1)).astype(np.uint8)
        classes[i:j] = whole[at[i:j] - low]
    return classes


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer(hashing.raw_bytes(text), np.uint8)


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How many windows of all documents each entropy class holds; ``CLASSES`` rows come back. No documents: zeros."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(CLASSES, np.int64)
        for batch in batches:
            for value in batch.column(0):
                raw = _bytes(value.as_py())
                held += np.bincount(entropy_classes(raw, starts(raw)), minlength=CLASSES)
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(held[there])], ["class", "n"])

    out = np.zeros(CLASSES, np.int64)
    for r in docs.select(text).mapInArrow(count, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        out[r["class"]] = r["n"]
    return out


class Digest:
    """Fingerprints under given class counts. Fingerprints of one table of counts can be compared."""

    def __init__(self, counts: np.ndarray) -> None:
        classes = np.arange(CLASSES)
        low = classes * _FULL // CLASSES > (6 - LOWEST_BITS) * 65536  # hardly any entropy: taken only where there is nothing else
        self.rank = np.empty(CLASSES, np.int64)
        self.rank[np.lexsort((classes, counts, low))] = classes

    def features(self, text: str | None) -> np.ndarray:
        """Hashes of the selected windows, each once, in the order of the text."""
        raw = _bytes(text)
        at = starts(raw)
        if not len(at):
            return np.zeros(0, np.uint64)
        ranks = self.rank[entropy_classes(raw, at)]
        run = min(RUN, len(ranks))
        rarest, width = ranks << 40 | at, 1  # the leftmost of equals: the place decides
        while width < run:
            step = min(width, run - width)
            rarest, width = np.minimum(rarest[:-step], rarest[step:]), width + step
        votes = np.bincount(rarest & ((1 << 40) - 1), minlength=len(ranks))
        at = at[votes >= min(VOTES, int(votes.max()))]
        h = hashing.Ranges(raw).of(at, at + min(WINDOW, len(raw)))
        return h[np.sort(np.unique(h, return_index=True)[1])]

    def of(self, text: str | None) -> str:
        """Number of features, a colon, and the chained filters in base 64; ``0:`` without any byte."""
        h = self.features(text)
        filters = np.zeros((-(-len(h) // FILL), FILTER_BITS), np.uint8)
        for k in range(BITS):
            filters[np.arange(len(h)) // FILL, (h >> np.uint64(11 * k)) % np.uint64(FILTER_BITS)] = 1
        return f"{len(h)}:" + base64.b64encode(np.packbits(filters).tobytes()).decode()


def _filters(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    n, _, bits = fingerprint.partition(":")
    rows = np.frombuffer(base64.b64decode(bits), np.uint64).reshape(-1, FILTER_BITS // 64)
    sizes = np.full(len(rows), FILL)
    if len(rows):
        sizes[-1] = int(n) - FILL * (len(rows) - 1)
    return rows, sizes


def _towards(a: np.ndarray, sizes: np.ndarray, b: np.ndarray) -> float:
    """Mean over the features of ``a`` of the best normalised overlap of their filter with a filter of ``b``."""
    set_b = np.bitwise_count(b).sum(axis=1).astype(np.float64)
    best = np.zeros(len(a))
    for i, row in enumerate(a):
        set_a = float(np.bitwise_count(row).sum())
        common = np.bitwise_count(b & row).sum(axis=1)
        chance = set_a * set_b / FILTER_BITS
        most = np.minimum(set_a, set_b)
        spread = np.sqrt(chance * (1 - set_a / FILTER_BITS) * (1 - set_b / FILTER_BITS))
        beyond = np.where(common > chance + NOISE * spread, (common - chance) / np.maximum(most - chance, 1e-9), 0.0)
        best[i] = min(1.0, float(beyond.max()))
    return float((best * sizes).sum() / sizes.sum())


def likeness(one: str, other: str) -> float:
    """0 to 1, the same both ways round; 1 for equal fingerprints, 0 if only one has features."""
    if one == other:
        return 1.0
    (a, n), (b, m) = _filters(one), _filters(other)
    if not len(a) or not len(b):
        return 0.0
    return (_towards(a, n, b) + _towards(b, m, a)) / 2


def fingerprints(docs: DataFrame, counts: np.ndarray, text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every row of ``docs`` under the class counts ``counts``. Null texts count as empty."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = Digest(counts)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest.of(v.as_py()) for v in batch.column(1)], pa.string())], ["doc_id", "fingerprint"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fingerprint", T.StringType())])
    return docs.select("doc_id", F.col(text).alias("_text")).mapInArrow(of, schema)


def edited(text: str, following: str) -> str:
    """The last half of the characters (rounded down) replaced by as many first ones of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _key(doc_id, h: int) -> tuple:
    return (doc_id is not None, doc_id, h)


def in_order(docs: DataFrame, text: str = "text") -> DataFrame:
    """``part, visitor, doc_id, _text``: rows in ascending order (doc_id, nulls first, then the text's hash), part by part.

    Every part ends with its visitors: rows with the key of the first row of the next part (of the first part, for the last), so that each
    row finds its successor within its part. Only ids are sorted to find where parts begin; of these one for every part comes back.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    ranged = rows.select("doc_id", "_hash").repartitionByRange(n, "doc_id", "_hash")
    first = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("doc_id", "_hash")).alias("first")).collect()
    begins = sorted(_key(*r["first"]) for r in first)

    @F.pandas_udf("array<int>")
    def parts(doc_id: pd.Series, h: pd.Series) -> pd.Series:
        def of(key: tuple) -> list[int]:
            k = bisect_right(begins, key) - 1
            return [k, (k - 1) % len(begins)] if begins[k] == key else [k]

        ids = doc_id.astype(object).where(doc_id.notna(), None)
        return pd.Series([of(_key(i, x)) for i, x in zip(ids, h)])

    sent = rows.select("doc_id", "_hash", "_text", F.posexplode(parts("doc_id", "_hash")).alias("visitor", "part"))
    return sent.repartitionById(n, F.col("part")).sortWithinPartitions("part", "visitor", "doc_id", "_hash").select("part", "visitor", "doc_id", "_text")


def compare_with_edit(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text ends in the beginning of the next document, in ascending doc_id order (nulls first, equal ids by the hash of their text), the first
    one after the last. Null texts count as empty; an empty text stays empty and has the fingerprint ``0:``. A single row is its own
    successor. Repeated rows follow each other. An empty table gives no rows. Other columns are not read.
    """
    counts = rarity(docs, text)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, last, done = Digest(counts), None, None
        for batch in batches:
            out = []
            for part, visitor, i, value in zip(*batch.columns):
                part, value = part.as_py(), value.as_py()
                if part == done:
                    continue
                mark = digest.of(value)
                if last and last[0] == part:
                    _, before, whole, own = last
                    changed = edited(whole, value)
                    mark_changed = own if changed == whole else digest.of(changed)
                    sha = hashlib.sha256(hashing.raw_bytes(changed)).hexdigest()
                    out.append((before, len(whole), sha, own, mark_changed, likeness(own, mark_changed), likeness(own, mark)))
                last = (part, i, value, mark)
                if visitor.as_py():
                    done, last = part, None
            columns = list(zip(*out)) or [()] * 7
            ids = pa.array([i.as_py() for i in columns[0]], batch.column(2).type)
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(columns[1:], kinds)]], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    types = [docs.schema["doc_id"].dataType, T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.DoubleType(), T.DoubleType()]
    return in_order(docs, text).mapInArrow(of, T.StructType([T.StructField(c, t) for c, t in zip(names, types)]))


def query(spark, sf_dir: str) -> DataFrame:
    return compare_with_edit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = None  # a digest of hashed windows has no SQL form; tests compare with a plain version
