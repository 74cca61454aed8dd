"""Helpers of the training-data operators: columns, word patterns, written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsight.session import shared_dir

SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
BATCH_BYTES = 4 << 20


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: inside other lambdas a plain column would be evaluated per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The maximal runs without ASCII white space, in order; no words for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once by bytes, for this session: a batch of long texts is as large as one of short ones. No result depends on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def folder(spark: SparkSession, name: str) -> str:
    """A new folder name inside the shared folder of the cluster."""
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: computed once, safe from lost executors."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_order() -> list[Column]:
    """Columns of a table read from Parquet files that sort its rows as they were written: partition by partition, row by row."""
    name = F.col("_metadata.file_name")
    return [F.regexp_extract(name, r"^part-(\d+)", 1).cast("long"), name, F.col("_metadata.row_index")]


def fresh(name: str, taken: list[str]) -> str:
    """``name``, lengthened until it clashes with no column of the caller's table."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name
