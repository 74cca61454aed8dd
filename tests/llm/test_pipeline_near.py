"""Near duplicates of the pipeline: five words at 80 %, and the bands that this needs."""

import random

import test_pipeline
from llm_cases import random_rows, shingle_set, table
from pyspark.sql import functions as F
from test_pipeline import corpus  # noqa: F401

import corpus_pipeline as P
from cellsight.llm import language_id, near_dup


def near_groups(rows, width=5, pct=80):
    """doc_id -> (set size, component id), by comparing all pairs."""
    sets = {r[0]: shingle_set(r[1], width) for r in rows}
    group = {i: i for i in sets}
    for i in sets:
        for j in sets:
            common = len(sets[i] & sets[j])
            if i < j and sets[i] and sets[j] and 100 * common >= pct * (len(sets[i]) + len(sets[j]) - common) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    return {i: (len(sets[i]), g) for i, g in group.items()}


def copies():
    """Texts of 100 distinct words, each with a copy that has 20 words appended, cut or inserted, and one with 40 appended."""
    rng = random.Random(5)
    rows = []
    for k in range(8):
        w = [f"w{k}x{n}" for n in range(160)]
        at = rng.randint(5, 75)
        other = [w[:120], w[:80], w[:at] + w[140:160] + w[at:100]][k % 3]
        rows += [(10 * k, " ".join(w[:100]), "en", "a"), (10 * k + 1, " ".join(other), "en", "a"), (10 * k + 2, " ".join(w[60:160]), "en", "a")]
    return rows


def test_appended_passage_is_a_near_duplicate(spark):
    words = [f"w{k}" for k in range(120)]
    rows = [(1, " ".join(words[:100]), "en", "a"), (2, " ".join(words), "en", "a")]
    assert [r.doc_id for r in P.drop_near_duplicates(spark, table(spark, rows), "").collect()] == [1]
    assert near_dup.near_duplicates(table(spark, rows)).filter("kept").count() == 2  # op9: three words at 85 %


def test_near_duplicate_stage_equals_all_pairs(spark):
    for rows in (copies(), random_rows(9)):
        got = sorted(r.doc_id for r in P.drop_near_duplicates(spark, table(spark, rows), "").select("doc_id").collect())
        assert got == sorted(i for i, (_, g) in near_groups(rows).items() if i == g)


def test_bands_miss_one_pair_in_a_million_at_most():
    assert near_dup.band_size(85) == 6 and near_dup.band_size(80) == 5
    assert all(near_dup.missed(t, near_dup.band_size(t)) <= 1e-6 for t in range(50, 100))


def test_run_holds_the_documents_of_the_plain_version(spark, corpus, monkeypatch):  # noqa: F811
    at, rows, items = corpus
    monkeypatch.setattr(test_pipeline, "near_components", near_groups)
    model = language_id.train(spark.read.parquet(f"{at}/documents.parquet"))
    got = P.run(spark, at).select("doc_id", "n_tokens", F.col("ids_crc32").alias("crc")).collect()
    assert got and sorted(map(tuple, got)) == sorted((i, n, c) for i, _, n, c in test_pipeline.plain(model, rows, items))
