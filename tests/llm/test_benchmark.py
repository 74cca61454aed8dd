"""op3: the automaton and whole documents against comparing all windows."""

import hashlib
import random

import pytest
from llm_cases import benchmark_hits, odd_rows, random_rows, table

from cellsight.llm import decontaminate as D


def items_of(rows):
    rng = random.Random(2)
    out = [(1, None), (2, ""), (3, "..."), (4, "quick brown FOX"), (4, "old river"), (5, rows[-1][1])]
    for k in range(12):
        w = (rng.choice(rows)[1] or "").split()
        at = rng.randrange(max(1, len(w)))
        out.append((10 + k, " ".join(w[at : at + rng.randint(1, 25)])))
    return out


@pytest.mark.parametrize("block_words", [1_000_000, 40])
@pytest.mark.parametrize("rows", [odd_rows()[:-1], random_rows(3)])
def test_hits(spark, rows, block_words):
    items = items_of(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = D.contaminated_spans(table(spark, rows), bench, block_words=block_words).collect()
    got = sorted((str(r.text), r.n_words, sum(s["until"] - s["from"] for s in r.spans), tuple(r["items"])) for r in out)
    want = []
    for r in rows:
        w, hit, found = benchmark_hits(r[1], items)
        want.append((str(r[1]), len(w), sum(hit), tuple(sorted(found))))
    assert got == sorted(want)


def test_cut_texts(spark):
    text = "Keep this. " + " ".join(f"w{k}" for k in range(12)) + ", and keep that too, as it is a part of the text itself."
    bench = spark.createDataFrame([(1, " ".join(f"W{k}" for k in range(12)))], "item_id long, text string")
    docs = table(spark, [(1, text, "en", "a"), (2, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9", "en", "a"), (3, None, "en", "a")])
    out = {r.doc_id: r for r in D.decontaminate(docs, bench).collect()}
    assert out[1].text == "Keep this. , and keep that too, as it is a part of the text itself." and out[1].score == 0.5
    assert set(out) == {1, 3} and out[3].text is None


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated_spans(table(spark, []), bench).count() == 0
    assert all(not r.spans for r in D.contaminated_spans(table(spark, odd_rows()), bench).collect())


def test_digest_of_no_items(spark):
    from conftest import SMALL

    r = D.query(spark, SMALL).filter("n_items = 0").first()
    assert r.items_sha256 == hashlib.sha256(b"").hexdigest() and not r.contaminated
