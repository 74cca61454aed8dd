"""op5: ids equal the tokenizer's, files read back exactly, order and odd rows."""

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from conftest import SMALL
from llm_cases import odd_rows, random_rows, table, token_rows
from tokenizers import Tokenizer

from cellsight.llm import token_files as K
from cellsight.llm.common import folder


@pytest.fixture(scope="module")
def encode():
    tokenizer = Tokenizer.from_file(public_tokenizers.path(K.VOCABULARY))
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer(encode):
    own = K.encoder(K.VOCABULARY)
    texts = ["it's 12²½ don't  naïve ÀÉÎÕÜß µm x\x85y\xa0z", "<|endoftext|> a", "日本語 text", "ΑΣ Ⅷ", "áb 'tis rock'n'roll \x1c\x1d x", "\x00\x7f a", "áb", "'S 'T 'LL", "¼-¾ ªº ×÷", ""]
    texts += ["".join(map(chr, range(256))), *pq.read_table(f"{SMALL}/documents.parquet").column("text").to_pylist()]
    for text in texts:
        assert np.frombuffer(own.encode(text), own.type).tolist() == encode(text), text[:80]


@pytest.mark.parametrize("rows", [odd_rows(), random_rows(4), []])
def test_round_trip(spark, encode, rows):
    got = [tuple(r) for r in K.write_and_check(table(spark, rows)).collect()]
    assert sorted(got, key=lambda r: r[1]) == token_rows(rows, encode)


def test_sequences_and_masks(spark, encode):
    rows = random_rows(5)
    manifest = K.write(table(spark, rows), folder(spark, "tokens"), sequence=16)
    for name, part in manifest.toPandas().groupby("file"):
        file, total = K.Sequences(name), int(part.n_tokens.sum())
        pairs = [file.sequence_at(k) for k in range(-(-total // 16))]
        ids, mask = (np.concatenate([p[c] for p in pairs]) for c in (0, 1))
        assert mask.sum() == total and mask[:total].all() and not ids[total:].any()
        text = dict((r[0], r[1]) for r in rows)
        want = [i for d in part.sort_values("start").doc_id for i in encode(text[d]) + [2]]
        assert ids[:total].tolist() == want
        file.close()


def test_full_cache_is_emptied(encode, monkeypatch):
    monkeypatch.setattr(K, "CACHED_WORDS", 3)
    own = K.Encoder(public_tokenizers.path(K.VOCABULARY))
    assert np.frombuffer(own.encode("a few more words than three"), own.type).tolist() == encode("a few more words than three") and len(own) <= 3
