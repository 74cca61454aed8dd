"""Near-duplicate documents by HyperMinHash.

A document's distinct shingles (``width`` words each) fall by hash into ``REGISTERS`` buckets; a register keeps the leading-zero count
of the smallest hash of its bucket and the mantissa bits behind the leading one. Equal sets become one class first.
Bands of registers, empty ones filled from others, give candidate classes. In ``ROUNDS`` rounds every set is paired with one set, the
most central member of another group in the buckets that it is in; links merge groups, and a bucket with one group is done. Then members of different
groups that still share a bucket are paired with each other, so no link between two groups is lost while a group of thousands needs
a few pairs per member. In crowded buckets, members that share a rare shingle are paired through it; what all others can share is
bounded by how many frequent shingles each has in ``PARTS`` parts of the hash range, which settles most of these pairs before they are made,
in cells of at most two runs of about ``CELL_SETS`` sets of a bucket.
A pair whose collision-corrected estimate is clearly too low is dropped; all others are compared on their full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsight.llm import hashing
from cellsight.llm.common import SPACES, fresh, stored

WIDTH = 3
THRESHOLD_PCT = 85
REGISTERS = 256
SHARED, MISSED = 3, 1e-6
MANTISSA_BITS = 10
EMPTY = 0xFFFF
SIGMAS = 5.0
CROWDED, RARE, PARTS, ROUNDS = 64, 16, 64, 3
CELL_SETS = 512


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of the A-Z-lowered words; fewer words than ``width`` make one shingle."""
    raw = np.frombuffer(hashing.raw_bytes(text).lower(), np.uint8)
    starts, ends = hashing.word_ranges(raw)
    if not len(starts):
        return np.zeros(0, np.uint64)
    words = hashing.Ranges(raw).of(starts, ends)
    return np.unique(hashing.sequences(words, min(width, len(words))) ^ np.uint64(min(width, len(words))))


def registers(hashes: np.ndarray) -> np.ndarray:
    """Leading-zero count and mantissa of the least hash of every bucket, as 6 + 10 bits; all ones where a bucket is empty."""
    bits = int(math.log2(REGISTERS))
    x = np.sort(hashing.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))
    bounds = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - bits)
    first = np.searchsorted(x, bounds)
    there = first < len(x)
    least = x[np.minimum(first, len(x) - 1)] if len(x) else np.zeros(REGISTERS, np.uint64)
    there &= (least >> np.uint64(64 - bits)) == np.arange(REGISTERS, dtype=np.uint64)
    rest = least & np.uint64((1 << (64 - bits)) - 1)
    _, exponent = np.frexp(rest.astype(np.float64) + 0.5)
    high = np.maximum(exponent, 1).astype(np.int64)
    high -= (rest >> np.minimum(high - 1, 63).astype(np.uint64)) == 0  # rounding up to a power of two
    high = np.maximum(high, 1)
    zeros = (64 - bits - high).astype(np.uint64)
    below = rest & ((np.uint64(1) << (high - 1).astype(np.uint64)) - np.uint64(1))
    shift = high - 1 - MANTISSA_BITS
    mantissa = np.where(shift >= 0, below >> np.maximum(shift, 0).astype(np.uint64), below << np.maximum(-shift, 0).astype(np.uint64))
    return np.where(there, (zeros << np.uint64(MANTISSA_BITS)) | mantissa, np.uint64(EMPTY)).astype("<u2")


_donors = np.random.default_rng(17).integers(0, REGISTERS, (4 * REGISTERS, REGISTERS))


def filled(r: np.ndarray) -> np.ndarray:
    """Empty registers take the value of the first filled one of their own drawn sequence, so each register of two sets agrees with probability J."""
    out, empty = r.copy(), np.flatnonzero(r == EMPTY)
    for donors in _donors:
        if not len(empty):
            break
        value = r[donors[empty]]
        out[empty] = value
        empty = empty[value == EMPTY]
    return np.where(out == EMPTY, r.min(), out).astype("<u2")


def missed(threshold_pct: int, band: int) -> float:
    """Probability that a pair at the threshold shares fewer than ``SHARED`` bands of ``band`` registers."""
    p, n = (threshold_pct / 100) ** band, REGISTERS // band
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(SHARED))


def band_size(threshold_pct: int) -> int:
    """Registers of a band: as many as lose no more than ``MISSED`` of the pairs at the threshold (42 bands of 6 at 85 %, 51 of 5 at 80 %)."""
    return max((b for b in range(1, 17) if missed(threshold_pct, b) <= MISSED), default=1)


def band_keys(r: np.ndarray, band: int) -> np.ndarray:
    """A 64-bit key of every band of ``band`` registers, different for every place."""
    bands = filled(r)[: REGISTERS // band * band].reshape(-1, band).astype(np.uint64)
    key = np.arange(len(bands), dtype=np.uint64)
    for k in range(band):
        key = hashing.mix(key * hashing.BASE + bands[:, k] + np.uint64(1))
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> tuple[float, float]:
    """Collision-corrected Jaccard estimate from two rows of registers of sets with ``n`` and ``m`` elements, and its standard error."""
    used = (a != EMPTY) | (b != EMPTY)
    total = int(used.sum())
    if not total:
        return 0.0, 1.0
    same = int((used & (a == b)).sum())
    levels = np.exp2(-np.arange(0.0, 40.0))
    reach = lambda k: np.diff(-np.append((1 - levels) ** (k / REGISTERS), 1.0))
    chance = total * abs(float((reach(n) * reach(m)).sum())) * 2.0**-MANTISSA_BITS
    j = max(0.0, (same - chance) / max(total - chance, 1e-9))
    return j, math.sqrt(max(j * (1 - j), 1 / total) / total)


def sketches(docs: DataFrame, text: str, width: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, set_id`` (128-bit identity of the set, null for no shingles), ``registers``."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, rows = [], [], []
            for value in batch.column(2):
                h = shingles(value.as_py(), width)
                sizes.append(len(h))
                ids.append(set_identity(h) if len(h) else None)
                rows.append(registers(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(rows, pa.binary())], ["doc_id", "text_hash", "n_shingles", "set_id", "registers"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_hash", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.BinaryType()), T.StructField("registers", T.BinaryType())])
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text).mapInArrow(of, schema)


def set_identity(h: np.ndarray) -> bytes:
    one, two = hashing.mix(h + np.uint64(len(h))), hashing.mix(h ^ np.uint64(0xE7037ED1A0B428DB))
    return np.array([one.sum(dtype=np.uint64), (two * (two | np.uint64(1))).sum(dtype=np.uint64)], "<u8").tobytes()


def band_rows(classes: DataFrame, threshold_pct: int) -> DataFrame:
    """``key, set_id, n_shingles`` for every band. Sets too small for any other set to reach the threshold have none."""
    least = math.ceil(threshold_pct / (100 - threshold_pct)) if threshold_pct < 100 else 1 << 60
    band = band_size(threshold_pct)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [band_keys(np.frombuffer(r.as_py(), "<u2"), band) for r in batch.column(2)]
            at = np.repeat(np.arange(batch.num_rows), REGISTERS // band)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], ["key", "set_id", "n_shingles"])

    return classes.filter(F.col("n_shingles") >= least).select("set_id", "n_shingles", "registers").mapInArrow(of, "key long, set_id binary, n_shingles long")


def _estimated(pairs: DataFrame, classes: DataFrame, threshold_pct: int) -> DataFrame:
    """Pairs ``a, b`` whose sizes and registers allow the threshold."""
    side = lambda s: classes.select(F.col("set_id").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("registers").alias(f"r_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, r, s = (c.to_pylist() for c in batch.columns)
            found = []
            for i in range(len(a)):
                j, error = estimate(np.frombuffer(r[i], "<u2"), np.frombuffer(s[i], "<u2"), n[i], m[i])
                found.append(j + SIGMAS * error >= threshold_pct / 100)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, f in zip(v, found) if f], pa.binary()) for v in (a, b)], ["a", "b"])

    return both.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(keep, "a binary, b binary")


def verified(pairs: DataFrame, texts: DataFrame, threshold_pct: int, width: int) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets reach the threshold."""
    side = lambda s: texts.select(F.col("set_id").alias(s), F.col("text").alias(f"t_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            rows = []
            for a, b, ta, tb in zip(*batch.columns):
                if last != b.as_py():
                    last, known = b.as_py(), shingles(tb.as_py(), width)
                one = shingles(ta.as_py(), width)
                common = len(np.intersect1d(one, known, assume_unique=True))
                if 100 * common >= threshold_pct * (len(one) + len(known) - common):
                    rows.append((a.as_py(), last))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], ["a", "b"])

    return both.mapInArrow(keep, "a binary, b binary")


def _texts(docs: DataFrame, text: str, classes: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``set_id, text`` of the classes in ``ids``: the text of the class's first row, told by doc_id (null or not) and text hash."""
    wanted = ids.distinct().join(classes.select("set_id", "first.*"), "set_id").select("set_id", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # different texts under one id and hash are told apart here
            yield batch.filter(pa.array([set_identity(shingles(t.as_py(), width)) == s.as_py() for s, t in zip(*batch.columns)], pa.bool_()))

    rows = docs.select("doc_id", F.xxhash64(text).alias("_text_hash"), F.col(text).alias("text"))
    found = rows.join(wanted, (F.col("_text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("set_id", "text")
    return stored(found.mapInArrow(own, "set_id binary, text string").dropDuplicates(["set_id"]), "texts")


def rare_shingles(texts: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """``set_id, rare`` (those of a set's shingles that at most ``RARE`` sets of ``texts`` have), and ``set_id, h`` of those that two or more have."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(*batch.columns):
                h = shingles(t.as_py(), width)
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(h), pa.binary()), pa.array(h.view(np.int64))], ["set_id", "h"])

    rows = texts.select("set_id", "text").mapInArrow(spread, "set_id binary, h long")
    known = rows.groupBy("h").count().filter(F.col("count") <= RARE)
    found = stored(rows.join(known, "h"), "rare")
    return found.groupBy("set_id").agg(F.collect_list("h").alias("rare")), found.filter("count > 1").select("set_id", "h")


def profiles(texts: DataFrame, rare: DataFrame, width: int) -> DataFrame:
    """``set_id, profile``: how many shingles a set has in each of ``PARTS`` parts of the hash range, its rare ones left out."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t, rare in zip(batch.column(1), batch.column(2)):
                h = np.setdiff1d(shingles(t.as_py(), width), np.array(rare.as_py() or [], np.int64).view(np.uint64), assume_unique=True)
                found.append(np.bincount((hashing.mix(h) % np.uint64(PARTS)).astype(np.int64), minlength=PARTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["set_id", "profile"])

    return texts.select("set_id", "text").join(rare, "set_id", "left").mapInArrow(of, "set_id binary, profile array<int>")


def components(links: DataFrame) -> DataFrame:
    """``set_id, group`` of every set in ``links`` (a, b): each set takes the least label around it, then the label of its label, until nothing moves."""
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("set_id")).agg(F.least(F.min("b"), F.first("a")).alias("group")), "labels")
    while True:
        near = edges.join(labels.select(F.col("set_id").alias("b"), "group"), "b").groupBy(F.col("a").alias("set_id")).agg(F.min("group").alias("near"))
        least = labels.join(near, "set_id").select("set_id", F.col("group").alias("old"), F.least("group", "near").alias("group"))
        jump = labels.select(F.col("set_id").alias("group"), F.col("group").alias("further"))
        moved = stored(least.join(jump, "group", "left").select("set_id", "old", F.least("group", F.coalesce("further", "group")).alias("group")), "labels")
        labels = moved.select("set_id", "group")
        if moved.filter(F.col("old") != F.col("group")).isEmpty():
            return labels


def merged(groups: DataFrame | None, links: DataFrame) -> DataFrame:
    """``set_id, group`` after ``links`` (a, b) between sets that ``groups`` has or not: only the groups that links join are labelled anew."""
    if groups is None:
        return components(links)
    label = lambda s: groups.select(F.col("set_id").alias(s), F.col("group").alias(f"group_{s}"))
    ends = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("group_a", "a").alias("a"), F.coalesce("group_b", "b").alias("b"))
    joined = components(ends.filter("a <> b")).select(F.col("set_id").alias("group"), F.col("group").alias("least"))
    alone = joined.join(groups.select("group").distinct(), "group", "left_anti").select(F.col("group").alias("set_id"), F.col("least").alias("group"))
    return stored(groups.join(joined, "group", "left").select("set_id", F.coalesce("least", "group").alias("group")).unionByName(alone), "labels")


def _apart(scored: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Rows of the buckets that hold members of more than one group; before the first links every set is a group."""
    if groups is None:
        return scored.withColumn("group", F.col("set_id"))
    grouped = scored.join(groups, "set_id", "left").withColumn("group", F.coalesce("group", "set_id"))
    split = grouped.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low <> high").select("key")
    return grouped.join(split, "key")


def _stars(rest: DataFrame, threshold_pct: int) -> DataFrame:
    """One pair ``a, b`` for each set at most: with the bucket leader, of another group, that it meets most often, then the most central one."""
    leaders = rest.groupBy("key").agg(F.max(F.struct("score", "set_id", "n_shingles", "group")).alias("l"))
    met = rest.select("key", "set_id", "n_shingles", "group").join(leaders, "key")
    fit = (F.col("group") != F.col("l.group")) & (100 * F.least("n_shingles", "l.n_shingles") >= threshold_pct * F.greatest("n_shingles", "l.n_shingles"))
    counted = met.filter(fit).groupBy(F.col("set_id").alias("a"), F.col("l.set_id").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.first("l.score").alias("score"))
    return counted.groupBy("a").agg(F.max(F.struct("n", "score", "b")).alias("best")).select("a", "best.b")


def _reachable(bounded: DataFrame, threshold_pct: int) -> DataFrame:
    """``a, b`` for every two sets of different groups in a bucket of ``bounded`` whose profiles allow the threshold, once for each bucket.

    ``bounded``: key, set_id, n_shingles, group, profile. What two sets can have in common is the fewer of each part, against the least that
    they have together. A cell takes two runs of a bucket's sets, so no task holds a bucket whole.
    """
    counted = bounded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("group").alias("low"), F.max("group").alias("high")).filter("low <> high")
    placed = bounded.join(counted.select("key", F.ceil(F.col("n") / CELL_SETS).alias("runs")), "key").withColumn("run", F.pmod(F.xxhash64("set_id"), F.col("runs")))
    met = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("other"))
    cells = met.withColumns({"i": F.least("run", "other"), "j": F.greatest("run", "other")}).groupBy("key", "i", "j")

    def of(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by("set_id")
        sizes, run, same = cell["n_shingles"].to_numpy(), cell["run"].to_numpy(), cell["i"][0] == cell["j"][0]
        group = np.unique(np.array(cell["group"].to_pylist(), object), return_inverse=True)[1]
        profile = cell["profile"].combine_chunks().flatten().to_numpy().reshape(-1, PARTS)
        first, second = [], []
        for k in range(len(sizes) - 1):
            n, m = sizes[k], sizes[k + 1 :]
            fit = (group[k + 1 :] != group[k]) & (100 * np.minimum(n, m) >= threshold_pct * np.maximum(n, m))
            at = k + 1 + np.flatnonzero(fit if same else fit & (run[k + 1 :] != run[k]))
            common = np.minimum(profile[k], profile[at]).sum(axis=1, dtype=np.int64)
            at = at[(100 + threshold_pct) * common >= threshold_pct * (n + sizes[at])]
            first.append(np.full(len(at), k))
            second.append(at)
        pick = lambda parts: cell["set_id"].take(pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))
        return pa.table({"a": pick(first), "b": pick(second)})

    return cells.applyInArrow(of, "a binary, b binary")


def near_duplicates(docs: DataFrame, text: str = "text", threshold_pct: int = THRESHOLD_PCT, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id, kept``, and ``text_hash`` and ``group``, which tell rows with one doc_id apart.

    Links join documents with 100 * common >= threshold * all shingles; ``component_id`` is the least doc_id reachable
    by links, ``kept`` marks the document that has it. Null texts and texts without words have no shingles, link with
    nothing and are kept. Rows that repeat a doc_id are judged by their own text. Rows with a null doc_id link like others; a
    group of null ids alone has a null ``component_id``, and all its rows have ``kept``. Other columns are not read.
    """
    sketched = stored(sketches(docs, text, width), "sketches")
    classes = sketched.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    classes = stored(classes, "classes")
    bands = band_rows(classes, threshold_pct)
    shared = bands.groupBy("key").count().filter("count > 1")
    bucketed = stored(bands.join(shared, "key"), "buckets")
    often = lambda pairs: pairs.groupBy("a", "b").count().filter(F.col("count") >= SHARED).select("a", "b")
    central = bucketed.groupBy("set_id").agg(F.sum("count").alias("score"))
    scored = stored(bucketed.join(central, "set_id"), "scored")
    groups, tried = None, None
    rest = _apart(scored, None)
    for _ in range(ROUNDS):
        pairs = _stars(rest, threshold_pct)
        pairs = stored(_estimated(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), classes, threshold_pct), "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        ends = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b"))
        new = stored(verified(pairs, _texts(docs, text, classes, ends, width), threshold_pct, width), "links")
        if groups is not None and new.isEmpty():
            break
        groups = merged(groups, new)
        rest = stored(_apart(scored, groups), "rest")

    texts = _texts(docs, text, classes, rest.select("set_id"), width)
    crowded = rest.filter(F.col("count") > CROWDED)
    packed = texts.join(crowded.select("set_id").distinct(), "set_id")
    rare, shared_rare = rare_shingles(packed, width)
    profiled = profiles(packed, rare, width)
    sets = rest.select("set_id", "n_shingles", "group").distinct()
    sides = lambda df, *cs: [df.select(*[F.col(c).alias(f"{c}_{s}") for c in cs]) for s in "ab"]
    apart = (F.col("set_id_a") < F.col("set_id_b")) & (F.col("group_a") != F.col("group_b")) & (100 * F.least("n_shingles_a", "n_shingles_b") >= threshold_pct * F.greatest("n_shingles_a", "n_shingles_b"))
    named = lambda pairs: pairs.select(F.col("set_id_a").alias("a"), F.col("set_id_b").alias("b"))
    one, other = sides(shared_rare.join(sets, "set_id"), "h", "set_id", "n_shingles", "group")
    through_rare = named(one.join(other, (F.col("h_a") == F.col("h_b")) & apart))
    # without a common rare shingle
    held = F.aggregate("profile", F.lit(0), lambda n, k: n + k)
    bounded = crowded.join(profiled, "set_id").filter(100 * held >= threshold_pct * F.col("n_shingles"))
    in_crowded = _reachable(stored(bounded.select("key", "set_id", "n_shingles", "group", "profile"), "bounded"), threshold_pct)
    one, other = sides(rest.filter(F.col("count") <= CROWDED), "key", "set_id", "n_shingles", "group")
    through_bands = often(named(one.join(other, (F.col("key_a") == F.col("key_b")) & apart)).union(in_crowded))
    crossing = through_rare.union(through_bands).distinct()
    untried = crossing.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
    late = stored(_estimated(untried, classes, threshold_pct), "late")
    last = stored(verified(late, texts, threshold_pct, width), "links")
    groups = groups if last.isEmpty() else merged(groups, last)

    by_set = classes.select("set_id", "first_id").join(groups, "set_id", "left").select("set_id", "first_id", F.coalesce("group", "set_id").alias("group"))
    ids = by_set.groupBy("group").agg(F.min("first_id").alias("component_id"))
    final = sketched.select("doc_id", "text_hash", "n_shingles", "set_id").join(by_set.join(ids, "group").select("set_id", "component_id", "group"), "set_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return final.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").eqNullSafe(component)).alias("kept"), "text_hash", "group")


def deduplicate(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the least doc_id, then the least hash of its text.

    Rows without words are in no group and all stay; of rows that repeat both doc_id and text, one stays.
    """
    columns, hashed = docs.columns, fresh("text_hash", docs.columns)
    found = near_duplicates(docs, text, **options).filter("kept")
    first = found.filter("n_shingles > 0").groupBy("group").agg(F.first("doc_id").alias("_id"), F.min("text_hash").alias(hashed)).select("_id", hashed)
    rows = docs.withColumn(hashed, F.xxhash64(text))
    chosen = rows.join(first.withColumnRenamed(hashed, "_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col(hashed) == F.col("_hash")))
    chosen = chosen.dropDuplicates(["doc_id", hashed]).select(*columns)
    wordless = F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACES)) == ""
    return chosen.unionByName(docs.filter(wordless))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text_hash", "group")


SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least_ AS (SELECT x, min(y) AS y FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(y, d.doc_id)) AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_ ON x = d.doc_id"""
