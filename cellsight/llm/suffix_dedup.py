"""Suffix-array deduplication of byte strings, with linear grouping construction.

Pieces that share an anchor come together in batches of bounded size. A batch is cut into tokens that end at content-
defined places; suffixes that begin at tokens are grouped by Lyndon prefix, groups are processed in descending order
with previous-smaller pointers, and the order within every group is emitted in one ascending pass, without renaming.
From the suffix array and common-prefix lengths of the tokens, the windows that begin at any byte follow: two windows
are equal if the ends of their first tokens are, and the suffixes behind them lie in one run of common prefixes that are
long enough.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cellsight.llm import hashing, repeats

WINDOW = 200
BATCH_BYTES = 1 << 20
# A token ends behind a space that follows a byte divisible by 4: both bytes lie inside the token, so no token begins another.
TOKEN = re.compile(rb"(?s).*?(?:[" + b"".join(re.escape(bytes([b])) for b in range(0, 256, 4) if b != 0x20) + rb"] |\Z)")


def byte_hashes(raw: np.ndarray) -> np.ndarray:
    return raw


SPEC = repeats.Spec(window=WINDOW, gram=32, elements=byte_hashes, by_id=False)


def lyndon_groups(s: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Groups of the suffixes of ``s`` by their longest Lyndon prefix; the last symbol is the least and occurs once.

    Returns each suffix's group, its previous smaller suffix (-1: none), the groups in ascending order and their sizes.
    A group is taken from the top; the previous smaller suffixes of its members, those nearest to the left that are not
    yet done, move up into new groups behind their own, most frequently met first.
    """
    n = len(s)
    symbols = sorted(set(s))
    place = {c: k for k, c in enumerate(symbols)}
    group = [place[c] for c in s]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [len(m) for m in members]
    below = list(range(-1, len(symbols) - 1))
    above = [*range(1, len(symbols)), -1]
    before, done, met = [-1] * n, bytearray(n), [0] * n
    g = len(symbols) - 1
    while g != -1:
        listed = members[g]
        own = [i for i in listed if group[i] == g] if len(listed) > size[g] else listed
        if len(own) == 1:
            i = own[0]
            done[i] = 1
            j = i - 1
            while j >= 0 and done[j]:
                j = before[j]
            before[i] = j
            if j >= 0 and size[h := group[j]] > 1:
                new = len(members)
                members.append([j])
                size.append(1)
                size[h] -= 1
                group[j] = new
                up = above[h]
                below.append(h)
                above.append(up)
                above[h] = new
                below[up] = new
        else:
            own.sort()
            for i in own:
                done[i] = 1
            moved = []
            for i in own:
                j = i - 1
                while j >= 0 and done[j]:
                    j = before[j]
                before[i] = j
                if j >= 0:
                    if not met[j]:
                        moved.append(j)
                    met[j] += 1
            levels: dict[int, dict[int, list[int]]] = {}
            for j in moved:
                levels.setdefault(met[j], {}).setdefault(group[j], []).append(j)
                met[j] = 0
            for count in sorted(levels, reverse=True):
                for h, together in levels[count].items():
                    if len(together) == size[h]:
                        continue
                    new = len(members)
                    members.append(together)
                    size.append(len(together))
                    size[h] -= len(together)
                    for j in together:
                        group[j] = new
                    up = above[h]
                    below.append(h)
                    above.append(up)
                    above[h] = new
                    below[up] = new
        g = below[g]
    ascending, g = [], 0
    while g != -1:
        ascending.append(g)
        g = above[g]
    return group, before, ascending, size


def suffix_array(s: list[int]) -> list[int]:
    """Start of every suffix in lexicographic order; the last symbol is the least and occurs once."""
    n = len(s)
    group, before, ascending, size = lyndon_groups(s)
    free, at = [0] * len(size), 0
    for g in ascending:
        free[g] = at
        at += size[g]
    order, placed = [-1] * n, bytearray(n)
    order[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = before[j]
    return order


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Common prefix length of the places ``a`` and ``b``, at most ``limit`` (itself at most ``WINDOW``)."""
    out = np.zeros(len(a), np.int64)
    steps = np.arange(WINDOW)
    for at in range(0, len(a), 4096):
        part = slice(at, at + 4096)
        same = text[a[part, None] + steps] == text[b[part, None] + steps]
        out[part] = np.where(same.all(1), WINDOW, same.argmin(1))
    return np.minimum(out, limit)


def repeated_windows(contents: list[bytes], reference: list[bool]) -> list[np.ndarray]:
    """For each piece, which of its windows occur in another piece, twice in it, or anywhere in a reference piece."""
    text = np.frombuffer(b"".join(contents) + b"\0" * WINDOW, np.uint8)
    first = np.concatenate(([0], np.cumsum([len(c) for c in contents]))).astype(np.int64)
    tokens, begin, end_of = [], [], []
    for k, c in enumerate(contents):
        cut = [t for t in TOKEN.findall(c) if t]
        tokens += [*cut, None]
        ends = first[k] + np.cumsum([len(t) for t in cut])
        begin += [*(ends - [len(t) for t in cut]).tolist(), int(first[k + 1])]
        end_of += [int(first[k + 1])] * (len(cut) + 1)
    known = {t: i + 2 for i, t in enumerate(sorted({t for t in tokens if t is not None}))}
    order = np.array(suffix_array([1 if t is None else known[t] for t in tokens] + [0])[1:], np.int64)
    begin, left = np.array(begin, np.int64), np.array(end_of, np.int64)
    left -= begin
    common = _common(text, begin[order[:-1]], begin[order[1:]], np.minimum(left[order[:-1]], left[order[1:]]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))

    count = np.array([len(c) - WINDOW + 1 for c in contents])
    owner = np.repeat(np.arange(len(contents)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[owner]
    token = np.searchsorted(begin, place, side="right") - 1
    token += begin[token + 1] - place < 2  # the end of a token is seen only by windows that hold both its bytes
    tail = begin[token + 1] - place
    ranges = hashing.Ranges(text)
    key = ranges.of(place, place + np.minimum(tail, WINDOW))
    short = np.flatnonzero(tail < WINDOW)
    by_tail = short[np.argsort(tail[short], kind="stable")]
    cuts = np.flatnonzero(np.concatenate(([True], np.diff(tail[by_tail]) != 0))) if len(by_tail) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by_tail)]):
        some = by_tail[a:b]
        run = np.concatenate(([0], np.cumsum(common < WINDOW - tail[some[0]])))
        key[some] = hashing.mix(key[some] ^ (run[rank[token[some] + 1]].astype(np.uint64) + np.uint64(1)) * hashing.BASE)
    weight = np.where(np.array(reference, bool)[owner], 2, 1)
    _, inverse = np.unique(key, return_inverse=True)
    often = np.bincount(inverse, weights=weight)[inverse] > 1
    return np.split(often, np.cumsum(count)[:-1])


def _method(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole anchors are gathered until a batch is full; an anchor with more text than a batch holds makes a larger one."""
    waiting: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size > BATCH_BYTES and row[0] != waiting[-1][0]:
                yield _settled(waiting)
                waiting, size = [], 0
            waiting.append(row)
            size += len(row[7])
    if waiting:
        yield _settled(waiting)


def _settled(rows: list[tuple]) -> pa.RecordBatch:
    found = []
    for (_, cell, rid, did, lo, _, reference, _), often in zip(rows, repeated_windows([r[7] for r in rows], [r[6] for r in rows])):
        if not reference and often.any():
            edges = np.flatnonzero(np.diff(np.concatenate(([0], often.view(np.int8), [0])))).tolist()
            found += [(cell, rid, did, lo + a, lo + b - 1) for a, b in zip(edges[::2], edges[1::2])]
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(5)], ["cell", "rid", "did", "lo", "hi"])


def _content(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    text = raw.tobytes()
    return [text[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def _finish(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple:
    if not len(lo):
        return len(raw), 0, 0, hashlib.sha256(raw.tobytes()).hexdigest()
    gone = hashing.covered(lo, hi + WINDOW, len(raw))
    spans = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
    return len(raw), int(gone.sum()), spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()


def drop_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    A byte of the UTF-8 text goes if a ``WINDOW``-byte string that covers it also starts anywhere else in the corpus, the
    same document included. Null and empty texts have no bytes. Repeated rows count as separate places. Other columns are
    not read.
    """
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return repeats.find(docs, text, SPEC, _content, _method, _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", names)


def query(spark, sf_dir: str) -> DataFrame:
    return drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT rid, unnest(range(0, len(h) // 2 - 199, 500)) AS b0, h FROM d WHERE len(h) >= 400),
c AS (SELECT rid, b0, substr(h, 2 * b0 + 1, 1398) AS piece FROM b),
p AS (SELECT rid, b0, piece, unnest(range(len(piece) // 2 - 199)) AS i FROM c),
k AS (SELECT rid, b0 + i AS pos, md5(substr(piece, 2 * i + 1, 400)) AS m FROM p),
hit AS (SELECT rid, pos FROM k JOIN (SELECT m FROM k GROUP BY m HAVING count(*) > 1) USING (m)),
gaps AS (SELECT rid, pos, lag(pos) OVER (PARTITION BY rid ORDER BY pos) AS before FROM hit),
runs AS (SELECT rid, pos, sum(CASE WHEN before IS NULL OR pos > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY pos) AS run FROM gaps),
spans AS (SELECT rid, run, min(pos) AS a, max(pos) + 200 AS b FROM runs GROUP BY ALL),
kept AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS last FROM (SELECT rid, a, b FROM spans UNION ALL SELECT rid, len(h) // 2, len(h) // 2 FROM d) z),
text_ AS (SELECT rid, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS rest FROM kept JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(s, 0)::BIGINT AS n_spans, sha256(unhex(rest)) AS kept_sha256
FROM d JOIN text_ USING (rid) LEFT JOIN (SELECT rid, sum(b - a) AS n, count(*) AS s FROM spans GROUP BY rid) USING (rid)"""
