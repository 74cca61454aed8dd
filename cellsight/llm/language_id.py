"""Language identification by error-correcting output codes.

Every language gets a codeword; each bit has one binary naive-Bayes classifier over hashed byte n-grams. A text's
bit margins are compared with every codeword by logistic loss, each bit weighted by how well it separated the
training counts; the least loss names the language, and a close runner-up marks the text as ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNDETERMINED = "und"
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
PER_LANGUAGE = 2000
SHARPNESS = 8.0
AMBIGUOUS = 0.6
BLOCK_BYTES = 1 << 20
LETTER = re.compile(r"[^\W\d_]")


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed byte 1-, 2- and 3-grams of the lower-cased whole text, runs of digits and marks included."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(raw), BLOCK_BYTES):  # blocks overlap by the longest gram less one
        block = raw[at : at + BLOCK_BYTES + ORDERS[-1] - 1].astype(np.uint32)
        for n in ORDERS:
            many = min(len(block) - n + 1, BLOCK_BYTES)
            if many > 0:
                code = np.full(many, n, np.uint32)
                for k in range(n):
                    code = code * np.uint32(0x01000193) + block[k : k + many]
                code *= np.uint32(0x9E3779B1)
                total += np.bincount(code >> np.uint32(17), minlength=BUCKETS)
    return total


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1, no two columns equal or opposite: all such columns for up to 7 languages, else 16 log2(k) drawn ones."""
    if k <= 7:
        columns = range(1, 2 ** (k - 1)) if k > 1 else [0]
        return np.array([[1 if i == 0 or not c >> (i - 1) & 1 else -1 for c in columns] for i in range(k)], np.float64)
    rng = np.random.default_rng(k)
    drawn = rng.choice([-1.0, 1.0], (k, 64 * int(np.ceil(np.log2(k)))))
    drawn = drawn[:, np.abs(drawn.sum(0)) < k] * drawn[0, np.abs(drawn.sum(0)) < k]
    _, at = np.unique(drawn, axis=1, return_index=True)
    return drawn[:, np.sort(at)[: 16 * int(np.ceil(np.log2(k)))]]


class Model:
    """Bit classifiers and codewords; ``languages`` sorted."""

    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        self.languages = sorted(counts)
        k = len(self.languages)
        self.code = codewords(k) if k else np.zeros((0, 1))
        table = np.array([counts[name] for name in self.languages], np.float64).reshape(k, BUCKETS)
        table /= np.maximum(table.sum(1, keepdims=True), 1)  # every language counts alike
        bits = self.code.shape[1]
        self.weights = np.zeros((BUCKETS, bits), np.float32)
        self.trust = np.ones(bits)
        for b in range(bits):
            ones, zeros = table[self.code[:, b] > 0].mean(0) if k else 0, table[self.code[:, b] < 0].mean(0) if (self.code[:, b] < 0).any() else np.zeros(BUCKETS)
            w = np.log(ones + 1e-6) - np.log(zeros + 1e-6)
            self.weights[:, b] = np.clip(w, -4, 4)
            self.trust[b] = max(1e-3, np.abs(table @ self.weights[:, b]).mean()) if k > 1 else 1.0
        self.trust /= self.trust.mean()

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, score and ambiguity of each text."""
        out = [(UNDETERMINED, 0.0, True)] * len(texts)
        known = [i for i, t in enumerate(texts) if t and self.languages and LETTER.search(t)]
        for at in range(0, len(known), 128):
            part = known[at : at + 128]
            counts = np.array([gram_counts(texts[i]) for i in part], np.float32)
            margins = counts @ self.weights / counts.sum(1, keepdims=True) * SHARPNESS
            loss = np.log1p(np.exp(-np.clip(margins[:, None, :] * self.code[None], -50, 50))) @ self.trust
            odds = np.exp(loss.min(1, keepdims=True) - loss)
            best = loss.argmin(1)
            score = 1 / odds.sum(1)
            for i, b, s in zip(part, best, score):
                out[i] = (self.languages[b], float(s), bool(s < AMBIGUOUS))
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 4 == 2


def train(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learns from ``docs`` with text and language, about ``per_language`` documents of each language, drawn by hash of the text.

    N-grams are counted in the tasks and summed by (language, bucket); only that table, at most ``BUCKETS`` rows
    for each language, comes to the driver. Every language is learned. Rows without text or language teach nothing; without any such row
    the model answers ``und``.
    """
    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model({})
    share = F.element_at(F.create_map(*[F.lit(v) for name, n in sizes.items() for v in (name, min(1.0, per_language / n))]), F.col("lang"))
    sample = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < share * 1_000_003)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(*(c.to_pylist() for c in batch.columns)):
                total.setdefault(name, np.zeros(BUCKETS, np.int64))
                total[name] += gram_counts(value)
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "bucket", "n"])

    summed = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = {name: np.zeros(BUCKETS, np.int64) for name in sizes}
    for r in summed.collect():
        counts[r["lang"]][r["bucket"]] = r["n"]
    return Model({name: c for name, c in counts.items() if c.any()})


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` (``und`` for null texts and texts without a letter), ``score`` (0 to 1; 0 for ``und``) and ``ambiguous``.

    Whole texts are read, ties go to the first language by name, repeated rows are judged one by one. Columns of
    ``docs`` with the result names are replaced; only the text is an input.
    """
    docs = docs.drop(*[c for c in ("lang_pred", "score", "ambiguous") if c in docs.columns])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, flags = zip(*shared.value.predict(batch.column(at).to_pylist())) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())], [*batch.schema.names, "lang_pred", "score", "ambiguous"])

    return docs.mapInArrow(predict, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
