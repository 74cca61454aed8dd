"""op3: items without an id, and items longer than one piece."""

import pyarrow as pa
import pytest
from llm_cases import benchmark_hits, table

from cellsight.llm import decontaminate as D


def hits(spark, rows, items):
    out = D.contaminated_spans(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    return {r.doc_id: (r.n_words, sum(s["until"] - s["from"] for s in r.spans), set(r["items"])) for r in out}


def test_items_without_an_id_hit_but_are_not_counted(spark):
    passage = " ".join(f"w{k}" for k in range(12))
    items = [(None, passage), (None, "short one"), (7, " ".join(f"v{k}" for k in range(10)))]
    rows = [(1, f"before {passage} after", "en", "a"), (2, "a short one here", "en", "a"), (3, items[2][1], "en", "a"), (4, "clean words only", "en", "a")]
    want = {r[0]: benchmark_hits(r[1], items) for r in rows}
    assert hits(spark, rows, items) == {i: (len(w), sum(hit), found - {"None"}) for i, (w, hit, found) in want.items()}
    kept = D.decontaminate(table(spark, rows), spark.createDataFrame(items[1:2], "item_id long, text string")).collect()
    assert {r.doc_id: r.text for r in kept}[2] == "a  here"


@pytest.mark.parametrize("n", [1, 9, 10, 20, 21, 23, 29, 30, 40, 41])
def test_pieces_hold_every_window_and_no_tail(monkeypatch, n):
    monkeypatch.setattr(D, "PIECE_WORDS", 20)
    words = [f"w{k}" for k in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(["1"]), pa.array([" ".join(words)])], ["item", "text"])
    pieces = [p.split() for out in D._pieces(10)([batch]) for p in (v.as_py().decode() for v in out.column(1))]
    windows = lambda ws: {tuple(ws[i : i + 10]) for i in range(max(1, len(ws) - 9))}
    assert set().union(*map(windows, pieces)) == windows(words)


def test_item_without_words_has_no_piece():
    batch = pa.RecordBatch.from_arrays([pa.array(["1", "2"]), pa.array([None, "..."], pa.string())], ["item", "text"])
    assert sum(out.num_rows for out in D._pieces(10)([batch])) == 0
