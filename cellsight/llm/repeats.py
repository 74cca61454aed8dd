"""Finding repeated windows of a corpus without shipping the corpus: anchors, shared anchors, pieces.

Every window of ``window`` elements (bytes or words) has an anchor, its ``gram``-element run of least hash; equal
windows have equal anchors at equal places. Neighbouring windows with one anchor make a piece. Only pieces whose
anchor also stands in a different piece have to meet; equal pieces are settled by their 128-bit identity.

    documents in cells -> (anchor, piece) per cell -> shared anchors -> pieces to compare -> method -> documents

A cell is a bounded group of documents; a piece costs one row per cell however often the cell holds it, so a passage
that a third of all documents carry stays small. Anchors that are frequent in a bounded sample are not used: their
windows become pieces of their own, which meet nothing but their equals. The sample decides how work is cut, never
the result. All branches read the one shuffle of the documents by cell.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsight.llm import hashing

CELL_DOCUMENTS, PART_DOCUMENTS = 1000, 4000
BLOCK = 1 << 22
SAMPLE_DOCUMENTS = 2000
FREQUENT = 20
MISSING_ID = -(1 << 63)
PIECE = np.dtype([("h", "<u8"), ("piece", "<u8"), ("least", "<i8"), ("many", "u1")])
FLAG = np.dtype([("h", "<u8"), ("piece", "<u8"), ("least", "<i8"), ("kind", "u1")])
COVERED, ROUTED = 1, 2


@dataclass(frozen=True)
class Spec:
    """What is repeated: ``elements`` turns bytes into element hashes; ``by_id`` counts only repeats in documents with a smaller id."""

    window: int
    gram: int
    elements: Callable[[np.ndarray], np.ndarray]
    by_id: bool


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def pieces(elements: np.ndarray, spec: Spec, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, identity, first and last window of every piece of one document."""
    out = []
    for at in range(0, max(len(elements) - spec.window + 1, 0), BLOCK):
        part = elements[at : at + BLOCK + spec.window - 1]
        ranges = hashing.Ranges(part)
        grams = ranges.windows(spec.gram)
        place = np.uint64((1 << 24) - 1)
        least = _sliding_least((grams & ~place) | np.arange(len(grams), dtype=np.uint64), spec.window - spec.gram + 1)
        anchor = (least & place).astype(np.int64)
        lo = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        hi = np.append(lo[1:], len(anchor)) - 1
        h = grams[anchor[lo]]
        if len(frequent):
            split = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h
            if split.any():
                count = np.where(split, hi - lo + 1, 1)
                first = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
                single = np.repeat(split, count)
                lo, hi, h = np.where(single, first, np.repeat(lo, count)), np.where(single, first, np.repeat(hi, count)), np.repeat(h, count)
                h = np.where(single, ranges.of(lo, lo + spec.window) ^ np.uint64(0x2545F4914F6CDD1D), h)
        out.append((h, hashing.mix(ranges.of(lo, hi + spec.window) ^ np.uint64(0x9FB21C651E98DF25)), lo + at, hi + at))
    if not out:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate(c) for c in zip(*out))


def _documents(table: pa.Table, spec: Spec, frequent: np.ndarray):
    for i, (did, text) in enumerate(zip(table.column("did").to_pylist(), table.column("text"))):
        raw = np.frombuffer(hashing.raw_bytes(text.as_py()), np.uint8)
        yield i, did, raw, pieces(spec.elements(raw), spec, frequent)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys in sorted arrays."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def gathered(spec: Spec, frequent, parts: int):
    """Per cell: its distinct pieces, dealt to ``parts`` by anchor."""
    def of(table: pa.Table) -> pa.Table:
        cell = table.column("cell")[0].as_py()
        found = [(did, p) for _, did, _, p in _documents(table, spec, frequent.value)]
        h, piece = (np.concatenate([p[k] for _, p in found]) for k in (0, 1))
        did = np.repeat(np.array([d for d, _ in found], np.int64), [len(p[0]) for _, p in found])
        order = np.lexsort((did, piece, h))
        h, piece, did = h[order], piece[order], did[order]
        first = _runs(h, piece)
        rows = np.zeros(len(first), PIECE)
        rows["h"], rows["piece"], rows["least"] = h[first], piece[first], did[first]
        rows["many"] = np.minimum(np.diff(np.append(first, len(h))), 2)
        part = (rows["h"] % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        rows, part = rows[order], part[order]
        cuts = _runs(part) if len(part) else np.zeros(0, np.int64)
        blobs = [rows[a:b].tobytes() for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)])]
        return pa.table({"cell": pa.array([cell] * len(blobs), pa.int64()), "part": pa.array(part[cuts], pa.int64()), "rows": pa.array(blobs, pa.binary())})

    return of


def flagged(spec: Spec):
    """Per part: which pieces are repeated as a whole (to all their cells) and which must meet others of their anchor."""
    def of(table: pa.Table) -> pa.Table:
        blobs = [b.as_py() for b in table.column("rows")]
        rows = np.frombuffer(b"".join(blobs), PIECE)
        cell = np.repeat(table.column("cell").to_numpy(), [len(b) // PIECE.itemsize for b in blobs])
        order = np.lexsort((cell, rows["least"], rows["piece"], rows["h"]))
        rows, cell = rows[order], cell[order]
        first = _runs(rows["h"], rows["piece"])
        size = np.diff(np.append(first, len(rows)))
        anchor = _runs(rows["h"][first])
        different = np.repeat(np.diff(np.append(anchor, len(first))), np.diff(np.append(anchor, len(first)))) > 1
        least = np.repeat(rows["least"][first], size)
        repeated = np.repeat(np.add.reduceat(rows["many"].astype(np.int64), first) > 1, size) if len(rows) else np.zeros(0, bool)
        routed = np.repeat(different, size)
        if spec.by_id:
            routed &= rows["least"] == least
        else:
            lead = np.zeros(len(rows), bool)
            lead[first] = True
            routed &= lead
        kind = np.where(repeated, COVERED, 0) | np.where(routed, ROUTED, 0)
        keep = kind > 0
        out = np.zeros(int(keep.sum()), FLAG)
        out["h"], out["piece"], out["least"], out["kind"] = rows["h"][keep], rows["piece"][keep], least[keep], kind[keep]
        cell = cell[keep]
        order = np.argsort(cell, kind="stable")
        out, cell = out[order], cell[order]
        cuts = _runs(cell) if len(cell) else np.zeros(0, np.int64)
        return pa.table({"cell": pa.array(cell[cuts], pa.int64()), "rows": pa.array([out[a:b].tobytes() for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(out)])], pa.binary())})

    return of


def _lookup(flags: np.ndarray, h: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Row of ``flags`` (sorted by piece) of each piece, -1 where none."""
    if not len(flags):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(flags["piece"], piece), len(flags) - 1)
    return np.where((flags["piece"][at] == piece) & (flags["h"][at] == h), at, -1)


def _flags(table: pa.Table) -> np.ndarray:
    flags = np.frombuffer(b"".join(b for b in table.column("rows").to_pylist()), FLAG)
    return flags[np.argsort(flags["piece"], kind="stable")]


def routed(spec: Spec, frequent, content: Callable[[np.ndarray, np.ndarray, np.ndarray], list[bytes]]):
    """Per cell: the pieces that must meet others, with their content. Repeated whole pieces go once, as reference."""
    def of(docs: pa.Table, flags: pa.Table) -> pa.Table:
        found, known = [], _flags(flags)
        sent: set[tuple[int, int]] = set()
        for i, did, raw, (h, piece, lo, hi) in _documents(docs, spec, frequent.value) if docs.num_rows and len(known) else ():
            at = _lookup(known, h, piece)
            wanted = np.flatnonzero((at >= 0) & ((known["kind"][at] & ROUTED) > 0) & ((known["least"][at] == did) | (not spec.by_id)))
            if not spec.by_id:
                wanted = wanted[[(k := (int(h[w]), int(piece[w]))) not in sent and not sent.add(k) for w in wanted.tolist()]] if len(wanted) else wanted
            for w, text in zip(wanted.tolist(), content(raw, lo[wanted], hi[wanted] + spec.window)):
                found.append((int(h[w].view(np.int64)), docs.column("cell")[0].as_py(), docs.column("rid")[i].as_py(), did, int(lo[w]), int(hi[w]), not spec.by_id and bool(known["kind"][at[w]] & COVERED), text))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        return pa.table([pa.array([f[k] for f in found], t) for k, t in enumerate(types)], ["h", "cell", "rid", "did", "lo", "hi", "reference", "content"])

    return of


MARKS = "cell long, rid long, did long, lo long, hi long"


def finished(spec: Spec, frequent, finish: Callable[[bytes, np.ndarray, np.ndarray], tuple], names: list[str]):
    """Per cell: every document with the windows that are repeated, handed to ``finish(raw, first windows, last windows)``."""
    def of(docs: pa.Table, more: pa.Table) -> pa.Table:
        known = _flags(more.filter(pa.compute.is_valid(more.column("rows"))))
        marks: dict[tuple[int, int], list[tuple[int, int]]] = {}
        settled = more.filter(pa.compute.is_null(more.column("rows")))
        for rid, did, lo, hi in zip(*(settled.column(c).to_pylist() for c in ("rid", "did", "lo", "hi"))):
            marks.setdefault((rid, did), []).append((lo, hi))
        out = []
        for i, did, raw, (h, piece, lo, hi) in _documents(docs, spec, frequent.value):
            at = _lookup(known, h, piece)
            whole = (at >= 0) & ((known["kind"][at] & COVERED) > 0) if len(known) else np.zeros(len(h), bool)
            if spec.by_id and len(known):
                whole &= known["least"][at] < did
            own = np.array(marks.get((docs.column("rid")[i].as_py(), did), []), np.int64).reshape(-1, 2)
            out.append((None if did == MISSING_ID else did, *finish(raw, np.concatenate([lo[whole], own[:, 0]]), np.concatenate([hi[whole], own[:, 1]]))))
        return pa.table([pa.array([o[k] for o in out], pa.string() if isinstance(out[0][k], str) else pa.int64()) for k in range(len(names))], names) if out else pa.table([pa.array([], pa.string() if n.endswith("sha256") else pa.int64()) for n in names], names)

    return of


def frequent_anchors(docs: DataFrame, spec: Spec) -> np.ndarray:
    """Sorted anchors found in ``FREQUENT`` or more different pieces of about ``SAMPLE_DOCUMENTS`` documents, drawn by hash."""
    rows = docs.count()
    share = min(1.0, SAMPLE_DOCUMENTS / max(rows, 1))
    sample = docs.filter(F.pmod(F.xxhash64(F.lit("sample"), "rid"), F.lit(1_000_003)) < share * 1_000_003)
    nothing = np.zeros(0, np.uint64)

    def of(batches):
        for batch in batches:
            for _, _, _, p in _documents(pa.Table.from_batches([batch]), spec, nothing):
                h = np.unique(p[0])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    counts = sample.select("did", "rid", "text").mapInArrow(of, "h long").groupBy("h").count().filter(F.col("count") >= FREQUENT)
    return np.sort(np.array([r["h"] for r in counts.select("h").collect()], np.int64).view(np.uint64))


def find(docs: DataFrame, text: str, spec: Spec, content, method, finish, schema: str, names: list[str]) -> DataFrame:
    """Rows of ``finish`` for every document. ``method`` maps batches of pieces sorted by anchor to ``MARKS`` rows."""
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(MISSING_ID)).alias("did"), F.col(text).alias("text"))
    base = base.withColumn("rid", F.xxhash64("did", "text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = base.count()
    cells, parts_of_anchors = -(-rows // CELL_DOCUMENTS) or 1, -(-rows // PART_DOCUMENTS) or 1
    frequent = spark.sparkContext.broadcast(frequent_anchors(base, spec))
    celled = base.withColumn("cell", F.pmod("rid", F.lit(cells)).cast("long")).repartition(n, "cell")
    parts = celled.groupBy("cell").applyInArrow(gathered(spec, frequent, parts_of_anchors), "cell long, part long, rows binary")
    flags = parts.groupBy("part").applyInArrow(flagged(spec), "cell long, rows binary")
    sent = celled.groupBy("cell").cogroup(flags.groupBy("cell")).applyInArrow(routed(spec, frequent, content), "h long, cell long, rid long, did long, lo long, hi long, reference boolean, content binary")
    marks = sent.repartition(n, "h").sortWithinPartitions("h", "did").mapInArrow(method, MARKS)
    empty = {c: F.lit(None).cast("long") for c in ("rid", "did", "lo", "hi")}
    more = flags.withColumns(empty).unionByName(marks.withColumn("rows", F.lit(None).cast("binary")))
    return celled.groupBy("cell").cogroup(more.groupBy("cell")).applyInArrow(finished(spec, frequent, finish, names), schema)
