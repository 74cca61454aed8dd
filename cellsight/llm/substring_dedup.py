"""Substring deduplication by relative Lempel-Ziv parsing of word sequences.

The corpus is its own reference, split into blocks by anchor: each block indexes the pieces of documents with smaller
ids, and every piece is factored greedily against all indexed text of its block. A factor of ``WINDOW`` or more words
is a duplicate span; greedy factors hide windows that straddle their ends, so those are looked up one by one. A piece
that is identical to a reference piece is one factor and is settled by identity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cellsight.llm import hashing, repeats

WINDOW = 13


def word_hashes(raw: np.ndarray) -> np.ndarray:
    starts, ends = hashing.word_ranges(raw)
    return hashing.Ranges(raw).of(starts, ends) if len(starts) else np.zeros(0, np.uint64)


SPEC = repeats.Spec(window=WINDOW, gram=5, elements=word_hashes, by_id=True)


class Reference:
    """Indexed text of one block: words in one list, and where each run of ``WINDOW`` words first begins."""

    def __init__(self) -> None:
        self.words: list[bytes] = []
        self.index: dict[tuple[bytes, ...], int] = {}

    def add(self, words: list[bytes]) -> None:
        base = len(self.words)
        self.words += words
        self.words.append(b"")  # no run crosses the end of a piece: no word is empty
        for i in range(len(words) - WINDOW + 1):
            self.index.setdefault(tuple(words[i : i + WINDOW]), base + i)

    def longest(self, words: list[bytes], i: int) -> int:
        """Length of the match of ``words`` from ``i`` at its indexed place; 0 if shorter than a window."""
        at = self.index.get(tuple(words[i : i + WINDOW]))
        if at is None:
            return 0
        n = WINDOW
        while i + n < len(words) and words[i + n] == self.words[at + n]:
            n += 1
        return n


def factor_spans(words: list[bytes], reference: Reference) -> list[tuple[int, int]]:
    """First and last window of every run of windows found in the reference."""
    out, i, last = [], 0, len(words) - WINDOW
    while i <= last:
        n = reference.longest(words, i)
        if n:
            out.append((i, i + n - WINDOW))
            i += n - WINDOW + 1  # the windows across the factor's end come next
        else:
            i += 1
    return out


def _method(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces arrive by anchor and id; pieces of one document are factored before any of them is indexed."""
    anchor, owner, waiting, reference = None, None, [], Reference()
    for batch in batches:
        found = []
        for h, cell, rid, did, lo, _, _, content in zip(*(c.to_pylist() for c in batch.columns)):
            if h != anchor:
                anchor, owner, waiting, reference = h, did, [], Reference()
            if did != owner:
                for words in waiting:
                    reference.add(words)
                owner, waiting = did, []
            words = content.split(b" ")
            found += [(cell, rid, did, lo + a, lo + b) for a, b in factor_spans(words, reference)]
            waiting.append(words)
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(5)], ["cell", "rid", "did", "lo", "hi"])


def _content(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    if not len(starts):
        return []
    words = raw.tobytes().split()
    return [b" ".join(words[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]


def _finish(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple:
    words = raw.tobytes().split()
    if not len(lo):
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()
    gone = hashing.covered(lo, hi + WINDOW, len(words))
    kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
    return len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()


def drop_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256``.

    A word goes if a window of ``WINDOW`` words that covers it also starts in a document with a smaller doc_id. Null and
    empty texts have no words. A null doc_id counts as smaller than all others. Rows that share a doc_id are judged by
    their own text and do not count as smaller than each other. Other columns are not read.
    """
    return repeats.find(docs, text, SPEC, _content, _method, _finish, "doc_id long, n_words long, n_removed long, kept_sha256 string", ["doc_id", "n_words", "n_removed", "kept_sha256"])


def query(spark, sf_dir: str) -> DataFrame:
    return drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT rid, doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
h AS (SELECT DISTINCT rid, unnest(range(i, i + {WINDOW})) AS p FROM g JOIN f USING (s) WHERE g.doc_id > f.first),
r AS (SELECT rid, list(p) AS gone FROM h GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN r USING (rid)"""
