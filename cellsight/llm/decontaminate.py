"""Benchmark decontamination: training words streamed through a generalised suffix automaton of the test items.

The benchmark is a stated query set. Its normalised items, cut into overlapping pieces where they are long, are dealt
to blocks of at most about ``BLOCK_WORDS`` words (counted, not assumed); each block becomes one automaton that goes to
every task, and the documents pass the automata one after the other in the same stage. Documents are never shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsight.llm.common import fresh, stored

WINDOW = 10
BLOCK_WORDS = 1_000_000
PIECE_WORDS = 50_000
MAX_COVERAGE_PCT = 50
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal_words(text: str | None) -> list[bytes]:
    """Words of the A-Z-lowered text as UTF-8; none for null."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Automaton:
    """Generalised suffix automaton of word sequences that knows which items hold a window, or are shorter than one."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws]) for name, ws in items]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.items_of: dict[int, set[str | None]] = {}
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        for name, ids in coded:
            at = matched = 0
            size = min(window, len(ids))
            for c in ids:
                at, matched = self.step(at, matched, c)
                at, matched = self._shorten(at, matched, size)
                if matched == window:
                    self.items_of.setdefault(at, set()).add(name)
            if 0 < size < window:
                self.short.setdefault(at, []).append((size, name))
        self.shortest = min([window] + [n for found in self.short.values() for n, _ in found])
        self.next_short = [0] * len(self.link)  # nearest state up the links, the state included, that ends a short item
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.next_short[s] = s if s in self.short else self.next_short[self.link[s]]

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(0)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def step(self, at: int, matched: int, c: int) -> tuple[int, int]:
        """The longest suffix of what was read that occurs in an item."""
        while at and c not in self.next[at]:
            at = self.link[at]
            matched = self.length[at]
        following = self.next[at].get(c)
        return (0, 0) if following is None else (following, matched + 1)

    def _shorten(self, at: int, matched: int, size: int) -> tuple[int, int]:
        while at and self.length[self.link[at]] >= size:
            at = self.link[at]
        return at, min(matched, size)

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Mask of the words inside an occurrence of a window, and the named items whose windows occur."""
        marks = np.zeros(len(words) + 1, np.int32)
        found: set[str | None] = set()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):  # runs of known words; any other word resets the automaton
            if end - begin < self.shortest:
                continue
            at = matched = 0
            for e, c in enumerate(ids[begin:end].tolist(), begin):
                at, matched = self.step(at, matched, c)
                if matched >= self.window:
                    state, _ = self._shorten(at, matched, self.window)
                    found |= self.items_of[state]
                    marks[e - self.window + 1] += 1
                    marks[e + 1] -= 1
                s = self.next_short[at]
                while s:
                    for n, name in self.short[s]:
                        if n <= matched:
                            found.add(name)
                            marks[e - n + 1] += 1
                            marks[e + 1] -= 1
                    s = self.next_short[self.link[s]]
        return np.cumsum(marks[:-1]) > 0, found - {None}


def _pieces(window: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(name, ws[i : i + PIECE_WORDS + window - 1]) for name, text in zip(*(c.to_pylist() for c in batch.columns)) for ws in [normal_words(text)] if ws for i in range(0, max(1, len(ws) - window + 1), PIECE_WORDS)]
            out = [(name, ws, piece) for name, ws in out for piece in [hashlib.md5(repr((name, ws)).encode()).hexdigest()]]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([b" ".join(o[1]) for o in out], pa.binary()), pa.array([len(o[1]) for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())], ["item", "words", "n", "piece"])

    return of


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0])))).tolist()
    return list(zip(edges[::2], edges[1::2]))


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (maximal hit runs as word positions from, until) and ``items`` (sorted ids as strings).

    A window is ``window`` consecutive words of an item; an item with fewer words, but not none, is one window. Null
    and empty texts have no words; an item without an id hits words but is not among ``items``; items without words match nothing; an empty benchmark leaves every document clean.
    Repeated rows and repeated items are judged one by one. Columns of ``docs`` with the result names are replaced.
    """
    docs = docs.drop(*[c for c in ("n_words", "spans", "items") if c in docs.columns])
    named = benchmark.select(F.col("item_id").cast("string"), "text")
    pieces = stored(named.mapInArrow(_pieces(window), "item string, words binary, n long, piece string").dropDuplicates(["item", "piece"]), "pieces")
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_words))
    span = T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("until", T.LongType())]))
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast(span), "items": F.array().cast("array<string>")})
    schema = out.schema
    for block in range(blocks):
        rows = pieces.filter(F.pmod(F.conv(F.substring("piece", 1, 8), 16, 10).cast("long"), F.lit(blocks)) == block).select("item", "words").collect()
        automaton = docs.sparkSession.sparkContext.broadcast(Automaton([(r["item"], bytes(r["words"]).split(b" ")) for r in rows], window))
        out = out.mapInArrow(_streamed(automaton, text), schema)
    return out


def _streamed(automaton, text: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = automaton.value.hits
        for batch in batches:
            names = batch.schema.names
            n_words, spans, items = [], [], []
            before = zip(batch.column(names.index("spans")).to_pylist(), batch.column(names.index("items")).to_pylist())
            for value, (old, known) in zip(batch.column(names.index(text)), before):
                ws = normal_words(value.as_py())
                mask, found = hits(ws)
                for s in old:
                    mask[s["from"] : s["until"]] = True
                n_words.append(len(ws))
                spans.append([{"from": a, "until": b} for a, b in _runs(mask)])
                items.append(sorted(found | set(known)))
            new = {"n_words": n_words, "spans": spans, "items": items}
            yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else batch.column(i) for i, f in enumerate(batch.schema)], schema=batch.schema)

    return of


def _cut(text: str, spans: list[dict]) -> str:
    """``text`` without the hit words and what lies between the words of one span."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORD.finditer(raw.lower())]
    kept, at = [], 0
    for s in spans:
        kept.append(raw[at : places[s["from"]][0]])
        at = places[s["until"] - 1][1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, max_coverage_pct: int = MAX_COVERAGE_PCT) -> DataFrame:
    """``docs`` with every hit span cut out of the text; documents with over ``max_coverage_pct`` percent of their words hit go."""
    spanned = contaminated_spans(docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("_text")), benchmark, "_text", window)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["until"] - x["from"])
    kept = spanned.filter(100 * n_hit <= max_coverage_pct * F.col("n_words"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_cut(t, s) if s else t for t, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(2)], ["_text", "row"])

    cleaned = kept.select("_text", "spans", "row").mapInArrow(cut, T.StructType([T.StructField("_text", T.StringType()), T.StructField("row", kept.schema["row"].dataType)]))
    return cleaned.select(*[F.col("_text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    spanned = contaminated_spans(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["until"] - x["from"])
    return spanned.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
        FROM (SELECT item_id, w, least({WINDOW}, len(w)) AS n, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT rid, i, occ.n, item_id FROM occ JOIN win ON occ.n = win.n AND occ.s = win.s),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)"""
