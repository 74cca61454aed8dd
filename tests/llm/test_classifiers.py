"""op4 and op10: held-out accuracy, codewords, odd rows, no training rows."""

import numpy as np
from conftest import SMALL
from llm_cases import odd_rows, table
from pyspark.sql import functions as F

from cellsight.llm import compression_quality as C
from cellsight.llm import language_id as G


def test_language_accuracy_on_held_out_rows(spark):
    out = G.query(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert out.count() > 20 and out.filter("lang = lang_pred").count() >= 0.97 * out.count()
    assert out.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_codewords_differ_in_half_of_the_bits():
    for k in (2, 3, 5, 7, 8, 40):
        code = G.codewords(k)
        apart = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
        assert min(apart) >= (1 if k < 3 else 2 if k < 8 else code.shape[1] // 5)


def test_a_wrong_bit_is_corrected():
    rows = {name: G.gram_counts(text) for name, text in (("a", "abab" * 50), ("b", "cdcd" * 50), ("c", "efef" * 50), ("d", "ghgh" * 50))}
    model = G.Model(rows)
    model.weights[:, 2] *= -0.3
    assert [p[0] for p in model.predict(["abababab", "cdcdcd", "efef", "ghghghgh"])] == ["a", "b", "c", "d"]


def test_language_of_odd_rows(spark):
    docs = table(spark, odd_rows())
    out = G.identify(docs, G.train(docs)).collect()
    assert len(out) == len(odd_rows())
    for r in out:
        assert (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text))
        assert 0 <= r.score <= 1
    assert G.identify(table(spark, []), G.train(docs)).count() == 0
    assert {r.lang_pred for r in G.identify(docs, G.train(table(spark, []))).collect()} == {"und"}


def test_blocks_of_a_long_text_count_every_gram(monkeypatch):
    text = "añb cd" * 500
    whole = G.gram_counts(text)
    monkeypatch.setattr(G, "BLOCK_BYTES", 97)
    assert np.array_equal(whole, G.gram_counts(text))


def test_quality_accuracy_on_held_out_rows(spark):
    folder = SMALL.replace("0.001", "0.01")
    out = C.query(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out")
    good = out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert good > 0.9
    assert out.filter("score < 0 OR score > 1 OR (score >= 0.5) <> (predicted = 1)").count() == 0


def test_quality_of_odd_rows(spark):
    docs = table(spark, odd_rows())
    labels = spark.createDataFrame([(6, 1), (7, 1), (12, 0), (9, 0), (4, None), (None, 1), (10, 1), (11, 0)], "doc_id long, quality int")
    out = C.score(docs, C.train(docs, labels)).collect()
    assert len(out) == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out)
    none = C.train(docs, labels.filter("quality > 5"))
    assert {r.score for r in C.score(docs, none).collect()} == {0.5}
    assert C.score(table(spark, []), none).count() == 0


def test_the_same_model_twice(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    a, b = C.train(docs, labels), C.train(docs, labels)
    assert (a.good, a.bad, a.curve) == (b.good, b.bad, b.curve)
