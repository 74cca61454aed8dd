"""From raw documents to packed token sequences, stage by stage.

Every stage works on all rows that the stage before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsight.llm import decontaminate, language_id, mixing, near_dup, token_files
from cellsight.llm.common import small_batches, stored, written_order

LEAST_SCORE = 0.5
SHINGLE_WORDS, SIMILAR_PCT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those for which no language holds half of the odds. Where no row names a language, all are passed on."""
    small_batches(spark)
    model = language_id.train(docs)
    if not model.languages:
        return docs
    judged = language_id.identify(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    return judged.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share at least ``SIMILAR_PCT`` percent of their runs of ``SHINGLE_WORDS`` words, directly or in a chain, become one."""
    small_batches(spark)
    return near_dup.deduplicate(docs, width=SHINGLE_WORDS, threshold_pct=SIMILAR_PCT)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts; documents that are mostly such passages go."""
    small_batches(spark)
    cleaned = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return cleaned.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix takes it."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Arrow files of token ids in the order in which the mix was written; one row per document, read back from them."""
    small_batches(spark)
    return token_files.write_and_check(docs, order=written_order())


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]
ORACLE_SQL = None  # language model, component search and tokenizer have no SQL form; tests compare with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
