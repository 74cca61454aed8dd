"""Importance resampling against a plain version; head-tail buckets against direct CRCs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from llm_cases import LOWER, odd_rows, random_rows, table

from cellsight.llm import importance as I

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def buckets(text):
    w = words(text)
    return [zlib.crc32(f.encode()) % I.BUCKETS for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def plain(rows, items, pct=I.DRAWN_PCT, least=I.MIN_WORDS):
    found = [buckets(r[1]) for r in rows]
    s, t = Counter(b for f in found for b in f), Counter(b for x in items for b in buckets(x))
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + I.BUCKETS) / ((s[b] + 1) * (m + I.BUCKETS))))
    out = []
    for r, f in zip(rows, found):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(words(r[1])), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    order = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[1], x[2], x[3]))
    for k, x in enumerate(order[: pct * len(order) // 100]):
        x[5] = k + 1
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [*odd_rows(), *random_rows(21)]
    items = [rows[-3][1], rows[-9][1], None, ""]
    target = spark.createDataFrame([(k, x, "clash") for k, x in enumerate(items)], "item_id long, text string, weight string")
    return rows, items, table(spark, rows), target


@pytest.mark.parametrize("heads", [(I.HEAD_WORDS, I.HEAD_PAIRS), (7, 5)])
def test_equals_the_plain_version(corpus, heads):
    rows, items, docs, target = corpus
    got = I.resample(docs, target, n_words=heads[0], n_pairs=heads[1])
    assert ordered(got.collect()) == ordered(plain(rows, items))


def test_other_share_and_drawn_rows(corpus):
    rows, items, docs, target = corpus
    want = plain(rows, items, 50, 5)
    drawn = I.draw(docs, target, drawn_pct=50, min_words=5)
    assert drawn.columns == docs.columns
    assert Counter(r.doc_id for r in drawn.collect()) == Counter(x[0] for x in want if x[5])


def test_empty_tables(spark, corpus):
    rows, _, docs, target = corpus
    assert I.resample(docs.filter("false"), target).count() == 0
    assert ordered(I.resample(docs, target.filter("false")).collect()) == ordered(plain(rows, []))


def test_buckets_of_pieces(monkeypatch):
    """A text cut into pieces has the pairs across the cuts; words beyond ASCII and very long ones are tail words."""
    monkeypatch.setattr(I, "PIECE", 16)
    text = "The naïve 日本語 fox " * 40 + "x" * 500 + " the FOX"
    for known in (I.Head([]), I.Head([b"fox", b"the"], [0, 1, I.PAIR_WORDS])):
        n, got = known.buckets(text.encode())
        assert n == len(words(text)) and Counter(got.tolist()) == Counter(buckets(text))
    assert I.Head([]).buckets(None)[0] == 0
