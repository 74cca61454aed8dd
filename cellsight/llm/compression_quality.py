"""Quality classifier by compression: two zstandard dictionaries, one of good and one of bad text.

A text is cut into blocks, each compressed with either dictionary. The difference of the compressed sizes per
byte of text is the raw score, and a logistic curve fitted on labelled documents outside the dictionaries makes it a
probability. Where a text is too short for the difference to say much, the curve also sees its shortness.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PER_CLASS = 1500
BLOCKS_PER_CLASS = 4000
BLOCK = 2048
DICTIONARY_BYTES = 110_000
SHORT = 100
LEVEL = 3


def blocks(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the samples in byte order; where they are too few for that, the samples themselves."""
    samples = sorted(samples)
    try:
        made = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        made = zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:] or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return made


class Model:
    """Bytes of both dictionaries and the logistic curve; a worker builds its compressors once."""

    def __init__(self, good: bytes, bad: bytes, curve: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> None:
        self.good, self.bad, self.curve = good, bad, curve

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_compressors"}

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        if "_compressors" not in self.__dict__:
            self._compressors = []
            for raw in (self.good, self.bad):
                kind = zstandard.DICT_TYPE_AUTO if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
                known = zstandard.ZstdCompressionDict(raw, dict_type=kind)
                known.precompute_compress(level=LEVEL)
                self._compressors.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))
        return self._compressors

    def features(self, text: str | None) -> tuple[float, float]:
        """(size with the bad dictionary - size with the good one) / bytes, and a shortness from 1 (no text) to 0."""
        cut = blocks(text)
        n = sum(map(len, cut))
        good, bad = (sum(len(c.compress(b)) for b in cut) for c in self.compressors())
        return (bad - good) / max(n, 1), SHORT / (SHORT + n)

    def calibrate(self, features: np.ndarray, good: np.ndarray) -> None:
        """Logistic regression by Newton steps; the slopes are held back a little, so separable classes stay finite."""
        if not len(good) or good.all() or not good.any():
            return
        spread = np.append(features.std(0), 1.0)
        spread[spread == 0] = 1.0
        x = np.column_stack([features, np.ones(len(good))]) / spread
        w, hold = np.zeros(3), np.diag([0.05, 0.05, 1e-6])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + hold, x.T @ (good - p) - hold @ w)
            w += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-9:
                break
        self.curve = tuple((w / spread).tolist())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, text: str = "text", per_class: int = PER_CLASS, blocks_per_class: int = BLOCKS_PER_CLASS) -> Model:
    """Learns from ``labels`` (doc_id, quality 0 or 1; other values teach nothing) and their ``docs``.

    About ``per_class`` documents of each class are drawn by hash of the id, half for the dictionaries, half for the
    curve; ``blocks_per_class`` blocks of their whole texts, again by hash, make a dictionary. These bounds limit what
    is broadcast (ids) and what comes to the driver (blocks, one number per document).
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    size = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    share = F.when(F.col("quality") == 1, min(1.0, per_class / size.get(1, 1))).otherwise(min(1.0, per_class / size.get(0, 1)))
    lot = F.pmod(F.xxhash64(F.lit("draw"), "doc_id"), F.lit(1_000_003))
    drawn = known.filter(lot < share * 1_000_003).withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)))
    sample = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(drawn), "doc_id").select("text", "quality", "half")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(b, q) for t, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for b in blocks(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32())], ["block", "quality"])

    pieces = sample.filter("half = 0").select("text", F.col("quality").cast("int").alias("quality")).mapInArrow(cut, "block binary, quality int")
    by_class = [[bytes(r["block"]) for r in pieces.filter(F.col("quality") == q).orderBy(F.xxhash64("block"), "block").limit(blocks_per_class).collect()] for q in (1, 0)]
    model = Model(*(dictionary(found).as_bytes() for found in by_class))
    if all(by_class):
        rows = _measured(sample.filter("half = 1").select("text", "quality"), model, "text").select("_difference", "_short", "quality").collect()
        rows = sorted(tuple(r) for r in rows)
        model.calibrate(np.array([r[:2] for r in rows]).reshape(-1, 2), np.array([float(r[2]) for r in rows]))
    return model


def _measured(docs: DataFrame, model: Model, text: str) -> DataFrame:
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.features(v.as_py()) for v in batch.column(at)]
            new = [pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "_difference", "_short"])

    return docs.mapInArrow(measure, T.StructType([*docs.schema, T.StructField("_difference", T.DoubleType()), T.StructField("_short", T.DoubleType())]))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of good text (0 to 1), and ``predicted`` (1 from 0.5 on).

    Whole texts are read. Null and empty texts get the curve's value at difference 0; a model that knew only one class
    or none gives 0.5 throughout. Columns of ``docs`` with the result names are replaced.
    """
    measured = _measured(docs.drop(*[c for c in ("score", "predicted") if c in docs.columns]), model, text)
    a, b, c = model.curve
    x = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), a * F.col("_difference") + b * F.col("_short") + c))
    return measured.withColumn("score", 1 / (1 + F.exp(-x))).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop("_difference", "_short")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.filter(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
