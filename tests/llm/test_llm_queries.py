"""The registered queries of the package on the smallest folder: SQL twins, and rows and columns of the rest."""

import pytest
from compare import duck, mismatch
from conftest import SMALL

import __spark_entry__ as entry
from cellsight.llm import queries

COLUMNS = {
    "op2_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op4_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op5_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op9_near_dup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op10_compression_quality": {"doc_id", "held_out", "score", "predicted"},
    "op13_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert mismatch(entry.queries()[name](spark, SMALL), duck(SMALL), entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_one_row_for_every_document(spark, name):
    out = entry.queries()[name](spark, SMALL)
    assert COLUMNS[name] <= set(out.columns)
    assert out.count() == out.select("doc_id").distinct().count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(queries.SQL) | set(COLUMNS) == set(queries.QUERIES)


@pytest.mark.parametrize("name", ["op1_quality_rules", "op7_mix_sources", "op8_url_filters"])
def test_native_plans_have_no_python(spark, name):
    text = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in text for w in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
