"""op2 and op6: the grouping construction, the parser, and whole corpora against comparing all windows."""

import random

import pytest
from llm_cases import byte_repeats, odd_rows, random_rows, table, word_repeats

from cellsight.llm import repeats
from cellsight.llm import substring_dedup as L
from cellsight.llm import suffix_dedup as S


def corpora():
    loop = [(1, "ab " * 400, "en", "a"), (2, "ab " * 90, "en", "a"), (3, "x", "en", "a"), (4, "ba " * 300 + "end", "en", "a")]
    return {"odd": odd_rows(), "loop": loop, "none": [], **{f"random{k}": random_rows(k) for k in range(3)}}


def test_suffix_array_is_the_sorted_order():
    rng = random.Random(5)
    for _ in range(400):
        s = [rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(0, 40))] + [0]
        assert S.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_groups_are_lyndon_prefixes():
    s = [3, 1, 2, 1, 2, 1, 3, 0]
    group, before, ascending, _ = S.lyndon_groups(s)
    place = {g: k for k, g in enumerate(ascending)}
    order = sorted(range(len(s)), key=lambda i: s[i:])
    assert [place[group[i]] for i in order] == sorted(place[group[i]] for i in order)
    assert all(before[i] == max([j for j in range(i) if s[j:] < s[i:]], default=-1) for i in range(len(s)))


@pytest.mark.parametrize("name", corpora())
def test_bytes(spark, name):
    rows = corpora()[name]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in S.drop_repeats(table(spark, rows)).collect()), key=key) == sorted(byte_repeats(rows), key=key)


@pytest.mark.parametrize("name", corpora())
def test_words(spark, name):
    rows = corpora()[name]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in L.drop_repeats(table(spark, rows)).collect()), key=key) == sorted(word_repeats(rows), key=key)


def test_the_sample_of_frequent_anchors_changes_nothing(spark, monkeypatch):
    rows = random_rows(7)
    monkeypatch.setattr(repeats, "FREQUENT", 2)
    assert len(repeats.frequent_anchors(table(spark, rows).selectExpr("doc_id AS did", "text", "xxhash64(doc_id, text) AS rid"), L.SPEC))
    assert sorted(map(tuple, L.drop_repeats(table(spark, rows)).collect())) == sorted(word_repeats(rows))
    assert sorted(map(tuple, S.drop_repeats(table(spark, rows)).collect())) == sorted(byte_repeats(rows))


def test_long_texts_are_cut_into_blocks(spark, monkeypatch):
    rows = random_rows(8)
    monkeypatch.setattr(repeats, "BLOCK", 64)
    pieces = lambda t: repeats.pieces(L.word_hashes(__import__("numpy").frombuffer(t.encode(), "u1")), L.SPEC, __import__("numpy").zeros(0, "u8"))
    for r in rows:
        _, _, lo, hi = pieces(r[1])
        assert [w for a, b in zip(lo, hi) for w in range(a, b + 1)] == list(range(max(0, len(r[1].split()) - 12)))


def test_factors_and_their_ends():
    reference = L.Reference()
    a, b = [b"%d" % k for k in range(20)], [b"%d" % k for k in range(12, 40)]
    reference.add(a)
    reference.add(b)
    assert L.factor_spans([b"%d" % k for k in range(40)], reference) == [(0, 7), (12, 27)]
    assert L.factor_spans([b"%d" % k for k in range(8, 40)], reference) == [(4, 19)]
