"""op4: no language is left out, and a table without languages goes through the pipeline's stage."""

from llm_cases import odd_rows, table

import corpus_pipeline as P
from cellsight.llm import language_id as L


def test_every_language_is_learned(spark):
    names = [f"l{k:03d}" for k in range(520)]
    rows = [(k, f"{name} wort{k} text", name, "a") for k, name in enumerate(names)]
    assert L.train(table(spark, rows)).languages == names


def test_documents_without_any_language_are_passed_on(spark):
    rows = [(i, t, None, s) for i, t, _, s in odd_rows()]
    assert P.identify_language(spark, table(spark, rows), "").count() == len(rows)
