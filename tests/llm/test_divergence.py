"""The audit of sources against a plain version, with one cell and with many."""

import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from llm_cases import LOWER, odd_rows, random_rows, table

from cellsight.llm import divergence as D

SUMMED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, min_df):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for _, text, lang, source in rows]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
        counts[lang, None].update(terms)
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, source in {d[:2] for d in docs}:
        kept = [t for t, n in df[lang].items() if n >= min_df]
        def shares(s):
            n = sum(counts[lang, s][t] for t in kept)
            return {t: 1 + 10**9 * (counts[lang, s][t] + 2) // (n + 2 * len(kept)) for t in kept}
        p, whole = shares(source), shares(None)
        others = [(sum(f(p[t], q[t]) for t in kept), s) for s in {d[1] for d in docs if d[0] == lang} - {source} for q in [shares(s)]]
        ahead = [(f(p[t], whole[t]), t) for t in kept if counts[lang, source][t] and p[t] > whole[t]]
        for part, found, upto in (("pair", others, None), ("term", ahead, 10)):
            best = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:upto]
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(best)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    return [*odd_rows(), *random_rows(31, vocabulary=60), (900, "solo terms", "xx", "only"), (901, None, "en", "empty")]


@pytest.mark.parametrize("cells", [(256, 1024, 500_000), (2, 7, 40)])
def test_equals_the_plain_version(spark, rows, cells, monkeypatch):
    for name, value in zip(("CELL_SOURCES", "CELL_TERMS", "BLOCK_TERMS"), cells):
        monkeypatch.setattr(D, name, value)
    got = D.audit(table(spark, rows).withColumnRenamed("row", "term"), min_df=3)
    assert sorted(map(tuple, got.collect())) == plain(rows, 3)


def test_no_kept_term_and_no_rows(spark, rows):
    docs = table(spark, rows)
    assert sorted(map(tuple, D.audit(docs, min_df=10**6).collect())) == plain(rows, 10**6)
    assert D.audit(docs.filter("false")).count() == 0


def test_shares_beyond_64_bits(spark):
    big = spark.range(1).selectExpr("9000000000000000 AS c", "20000000000000000 AS n", "1000 AS v")
    assert big.select(D.share(*(big[c] for c in "cnv"))).first()[0] == 1 + 10**9 * (9 * 10**15 + 2) // (2 * 10**16 + 2000)


def test_vectors_are_summed_by_group_within_a_batch():
    batch = lambda *rows: pa.RecordBatch.from_pylist([dict(zip(("lang", "source", "indices", "values"), r)) for r in rows], SUMMED)
    whole = batch(("", "x", [9], [9.0]), ("en", "b", [0, 2, 2**31 - 1], [1.0, 2.0, 3.0]), ("en", "a", [2], [5.0]), ("", "b", [2], [7.0]), ("en", "b", [], []), ("en", "b", [2], [2.0**52]))
    out = [r for b in D._batch_sums(iter([whole.slice(1), batch(("en", "b", [], [])), batch()])) for r in zip(*b.to_pydict().values())]
    assert sorted(out) == [("", "b", 2, 7), ("en", "a", 2, 5), ("en", "b", 0, 1), ("en", "b", 2, 2**52 + 2), ("en", "b", 2**31 - 1, 3)]
