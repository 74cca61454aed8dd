"""Token ids in the Arrow file format: record batches of fixed-size lists, read back by memory map.

Documents are range-sorted, by id or by a given order; each task encodes its range and writes one file of equal-length sequences with a
mask. A file counts only if the task's rows reach the manifest, so a lost or repeated attempt leaves nothing but an
unread file. Ids take 16 bits where the vocabulary allows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsight.llm.common import folder, stored

END = 2
SEQUENCE = 2048
BATCH_SEQUENCES = 64
VOCABULARY = "word_bpe_49k.json"
CACHED_WORDS = 200_000

# The vocabulary's own word pattern, for texts whose characters all lie below U+0100.
LETTERS, DIGITS, BLANKS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
WORD = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[{DIGITS}]|[^{BLANKS}{LETTERS}{DIGITS}]+")


class Encoder(dict):
    """Ids of texts as little-endian bytes. As a dict: ids of words already met.

    The vocabulary encodes each word of its word pattern alone. In a text of Latin-1 characters without special
    tokens the words can be told apart here, so each distinct word is encoded once; any other text goes whole
    through the tokenizer. Both ways give the tokenizer's ids.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        chars = [chr(i) for i in range(256)]
        self.as_bytes = str.maketrans({c: "".join(p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c)) or c for c in chars})
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = np.array([t.id for t in self.tokenizer.model.tokenize(word.translate(self.as_bytes))], self.type).tobytes()
        self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            plain = False
        else:
            plain = not any(s in text for s in self.special)
        if plain:
            return b"".join(map(self.__getitem__, WORD.findall(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One per worker process. ``name`` is a file of the installed vocabularies or a path."""
    if name not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if os.path.sep in name:
            path = name
        else:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _encoders[name] = Encoder(path)
    return _encoders[name]


class _File:
    """One Arrow file of sequences; ids arrive document by document."""

    def __init__(self, uri: str, kind: np.dtype, sequence: int) -> None:
        self.kind, self.sequence = kind, sequence
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        where, path = fs.FileSystem.from_uri(uri)
        where.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = where.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.waiting: list[bytes] = []
        self.size = self.total = 0

    def add(self, ids: bytes) -> int:
        """Appends ids; where they start in the file."""
        at = self.total
        self.waiting.append(ids)
        self.size += len(ids)
        self.total += len(ids) // self.kind.itemsize
        if self.size >= self._batch():
            self._write(self.size // self._batch() * self._batch())
        return at

    def _batch(self) -> int:
        return BATCH_SEQUENCES * self.sequence * self.kind.itemsize

    def _write(self, upto: int) -> None:
        raw = b"".join(self.waiting)
        self.waiting, self.size = [raw[upto:]], len(raw) - upto
        for i in range(0, upto, self._batch()):
            self._put(np.frombuffer(raw[i : min(upto, i + self._batch())], self.kind))

    def _put(self, ids: np.ndarray) -> None:
        short = -len(ids) % self.sequence
        values = np.concatenate([ids, np.zeros(short, self.kind)])
        mask = np.arange(len(values)) < len(ids)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.sequence) for v in (values, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        self._write(self.size)
        self.writer.close()
        self.out.close()


class Sequences:
    """Random access to a written file: ids of any range without copying unless it crosses a batch."""

    def __init__(self, uri: str) -> None:
        where, path = fs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if where.type_name == "local" else where.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.sequence = self.file.schema.field("ids").type.list_size
        self.at, self.values = -1, None

    def sequence_at(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``k``."""
        batch, i = self.file.get_batch(k // BATCH_SEQUENCES), k % BATCH_SEQUENCES
        return tuple(batch.column(c).slice(i, 1).flatten().to_numpy(zero_copy_only=c == 0) for c in (0, 1))

    def parts(self, start: int, n: int) -> Iterator[np.ndarray]:
        size = BATCH_SEQUENCES * self.sequence
        while n > 0:
            k, i = divmod(start, size)
            if k != self.at:
                self.at, self.values = k, self.file.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
            part = self.values[i : i + n]
            yield part
            start, n = start + len(part), n - len(part)

    def close(self) -> None:
        self.values = self.file = None
        self.source.close()


def write(docs: DataFrame, out: str, text: str = "text", vocabulary: str = VOCABULARY, sequence: int = SEQUENCE, end: int = END, order: Sequence[Column] | None = None) -> DataFrame:
    """Writes the sequences below the folder ``out`` and returns the manifest: ``doc_id, part, file, start, n_tokens`` (start within the file).

    Ids stand in ascending doc_id order, nulls first, equal ids by text, or in the ascending ``order`` of columns of ``docs``. A null or empty text gives the end id alone.
    The last sequence of a file is padded with zeros and masked. No documents: no files. Other columns are not read.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get(), None
        part, uri = task.partitionId(), f"{out}/part-{task.partitionId():06d}-{task.taskAttemptId()}.arrow"
        e = encoder(vocabulary)
        last = np.array([end], e.type).tobytes()
        for batch in batches:
            made = made or _File(uri, e.type, sequence)
            starts, sizes = [], []
            for value in batch.column(1):
                ids = e.encode(value.as_py()) + last
                starts.append(made.add(ids))
                sizes.append(len(ids) // e.type.itemsize)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * n, pa.int32()), pa.array([uri] * n, pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], ["doc_id", "part", "file", "start", "n_tokens"])
        if made:
            made.close()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = {f"_order{i}": c for i, c in enumerate(order or [])}
    rows = docs.select("doc_id", F.col(text).alias("_text"), *[c.alias(k) for k, c in keys.items()])
    ranges, within = (list(keys), list(keys)) if keys else (["doc_id", F.xxhash64("_text")], ["doc_id", "_text"])
    ordered = rows.repartitionByRange(n, *ranges).sortWithinPartitions(*within).select("doc_id", "_text")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("part", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return stored(ordered.mapInArrow(encode, schema), "manifest")


def read_back(manifest: DataFrame) -> DataFrame:
    """Per document of the manifest, from the files: ``doc_id, start`` (ids before it in all files), ``n_tokens, ids_crc32``."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, opened = None, None
        for batch in batches:
            crcs = []
            for file, start, n in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if file != name:
                    if opened:
                        opened.close()
                    name, opened = file, Sequences(file)
                crc = 0
                for ids in opened.parts(start, n):
                    crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crcs, pa.int64())], ["doc_id", "file", "start", "n_tokens", "ids_crc32"])
        if opened:
            opened.close()

    columns = ["doc_id", "file", "start", "n_tokens"]
    files = manifest.groupBy("part", "file").agg(F.sum("n_tokens").alias("_n"))  # one row per file
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    files = files.select(F.col("file").alias("_file"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    schema = T.StructType([manifest.schema[c] for c in columns] + [T.StructField("ids_crc32", T.LongType())])
    read = manifest.select(*columns).repartition("file").sortWithinPartitions("file", "start").mapInArrow(check, schema)
    return read.join(files, read["file"] == files["_file"]).select("doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def write_and_check(docs: DataFrame, vocabulary: str = VOCABULARY, order: Sequence[Column] | None = None) -> DataFrame:
    return read_back(write(docs, folder(docs.sparkSession, "tokens"), vocabulary=vocabulary, order=order))


def query(spark, sf_dir: str) -> DataFrame:
    return write_and_check(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
