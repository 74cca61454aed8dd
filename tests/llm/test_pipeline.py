"""The pipeline against the plain versions of its stages, one after the other."""

import hashlib
import random

import public_tokenizers
import pytest
from llm_cases import WORD, benchmark_hits, near_components, odd_rows, random_rows, token_rows
from test_mixing import reshared
from tokenizers import Tokenizer

import corpus_pipeline as P
from cellsight.llm import decontaminate, language_id


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with odd and random documents and a benchmark cut from them; ids are unique."""
    at = tmp_path_factory.mktemp("corpus")
    rows = {r[0]: r for r in [*odd_rows(), *random_rows(11)] if r[0] is not None}
    rows = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows.values()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    rng = random.Random(3)
    items = [(k, " ".join((rng.choice(rows)[1] or "").split()[:14])) for k in range(8)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, items


def plain(model, rows, items):
    judged = dict(zip((r[0] for r in rows), model.predict([r[1] for r in rows])))
    rows = [r for r in rows if judged[r[0]][0] != "und" and judged[r[0]][1] >= P.LEAST_SCORE]
    groups = near_components(rows, P.SIMILAR_PCT, P.SHINGLE_WORDS)
    rows = [r for r in rows if groups[r[0]][1] == r[0]]
    clean = []
    for r in rows:
        w, hit, _ = benchmark_hits(r[1], items)
        if 100 * sum(hit) <= decontaminate.MAX_COVERAGE_PCT * len(w):
            edges = [k for k in range(len(w)) if hit[k] and (k == 0 or not hit[k - 1])]
            spans = [{"from": a, "until": next((k for k in range(a, len(w)) if not hit[k]), len(w))} for a in edges]
            clean.append((r[0], decontaminate._cut(r[1], spans), r[3]))
    sources = sorted({r[2] for r in clean}, key=lambda s: (s is None, s or ""))
    size = lambda r: len(WORD.findall(r[1]))
    totals = [sum(size(r) for r in clean if r[2] == s) for s in sources]
    mixed = []
    for rank, (s, total, target) in enumerate(zip(sources, totals, reshared(totals))):
        start, slope = 0, (-0.5, 0.0, 0.5)[rank % 3]
        for r in sorted((r for r in clean if r[2] == s), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
            for k in range(3):
                middle = 2 * (k * total + start) + size(r)
                if middle <= 2 * target:
                    share = middle / (2 * target) if target > 0 else 0.0
                    time = share if slope == 0 else (((1 - slope) ** 2 + 4 * slope * share) ** 0.5 - (1 - slope)) / (2 * slope)
                    mixed.append((time, r[0], r))
            start += size(r)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ordered = [r for _, _, r in sorted(mixed, key=lambda m: m[:2])]
    return token_rows(ordered, lambda t: tokenizer.encode(t, add_special_tokens=False).ids, ordered=True)


def test_run_equals_the_plain_version(spark, corpus):
    at, rows, items = corpus
    model = language_id.train(spark.read.parquet(f"{at}/documents.parquet"))
    got = sorted((tuple(r) for r in P.run(spark, at).collect()), key=lambda r: r[1])
    assert got and got == plain(model, rows, items)


def test_stages_keep_the_columns(spark, corpus):
    at, _, _ = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, left = docs.columns, [docs.count()]
    for _, stage in P.STAGES[:-1]:
        docs = P.stored(stage(spark, docs, at), "stage")
        left.append(docs.count())
        assert docs.columns == columns
    assert left[1] < left[0] and left[2] < left[1] and left[3] < left[2]


def test_stages_on_an_empty_table(spark, corpus):
    at, _, _ = corpus
    for _, stage in P.STAGES:
        assert stage(spark, spark.read.parquet(f"{at}/documents.parquet").filter("false"), at).count() == 0
