"""The token stage writes the sequences in the order of the mix."""

import hashlib
import math

import public_tokenizers
from llm_cases import WORD, random_rows, table
from test_mixing import reshared
from tokenizers import Tokenizer

import corpus_pipeline as P
from cellsight.llm import mixing
from cellsight.llm.common import stored


def test_tokens_stand_in_the_order_of_the_mix(spark):
    rows = sorted({r[0]: r for r in random_rows(4, n=80)}.values())
    mixed = stored(P.mix_sources(spark, table(spark, rows), ""), "mixing")
    got = sorted((tuple(r) for r in P.write_tokens(spark, mixed, "").collect()), key=lambda r: r[1])
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    size = lambda r: len(WORD.findall(r[1]))
    totals = [sum(size(r) for r in rows if r[3] == s) for s in sources]
    order = []
    for rank, (s, total, target) in enumerate(zip(sources, totals, reshared(totals))):
        slope, start = mixing.SLOPES[rank % 3], 0
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
            for k in range(3):
                middle = 2 * (k * total + start) + size(r)
                if middle <= 2 * target:
                    share, a = middle / (2 * target), 1 - slope
                    order.append((share if slope == 0 else (math.sqrt(a * a + 4 * slope * share) - a) / (2 * slope), r[0]))
            start += size(r)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = {r[0]: len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1 for r in rows}
    want, at = [], 0
    for _, i in sorted(order):
        want.append((i, at, n[i]))
        at += n[i]
    assert [r[:3] for r in got] == want and [r[0] for r in got] != sorted(r[0] for r in got)
