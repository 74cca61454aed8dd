"""Improbable-feature digests against a plain version, and what likeness says of copies, edits and strangers."""

import base64
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from llm_cases import odd_rows, random_rows, table

from cellsight.llm import digest as D
from cellsight.llm import hashing


def plain_windows(text):
    """(start, window bytes, entropy class) of all windows."""
    b = (text or "").encode()
    width = min(D.WINDOW, len(b))
    at = []
    for i in range(max(len(b) - width + 1, 0)):
        if len(b) > D.WINDOW:
            h = ((b[i] * 0x9E3779B1 & 0xFFFFFFFF) ^ (b[i + 1] * 0x85EBCA77 & 0xFFFFFFFF) ^ (b[i + 2] * 0xC2B2AE3D & 0xFFFFFFFF)) * 0x27D4EB2F & 0xFFFFFFFF
            if (h >> 16) % D.SPACING == 0:
                at.append(i)
    at = at or ([0] if b else [])
    out = []
    for i in at:
        w = b[i : i + width]
        total = sum(c * math.floor(math.log2(c) * 65536) for c in Counter(x & 31 for x in w).values())
        out.append((i, w, total * D.CLASSES // (width * 6 * 65536 + 1)))
    return out


def plain_fingerprint(text, counts):
    windows = plain_windows(text)
    low = lambda c: c * 6 * 65536 // D.CLASSES > (6 - D.LOWEST_BITS) * 65536
    order = sorted(range(D.CLASSES), key=lambda c: (low(c), counts[c], c))
    rank = {c: k for k, c in enumerate(order)}
    votes, run = Counter(), min(D.RUN, len(windows))
    for k in range(len(windows) - run + 1 if windows else 0):
        votes[min(range(k, k + run), key=lambda j: (rank[windows[j][2]], j))] += 1
    need = min(D.VOTES, max(votes.values(), default=0))
    chosen = list(dict.fromkeys(windows[k][1] for k in sorted(votes) if votes[k] >= need))
    bits = np.zeros((-(-len(chosen) // D.FILL), D.FILTER_BITS), np.uint8)
    for k, w in enumerate(chosen):
        raw = np.frombuffer(w, np.uint8)
        h = int(hashing.Ranges(raw).of(np.array([0]), np.array([len(w)]))[0])
        for j in range(D.BITS):
            bits[k // D.FILL, (h >> (11 * j)) % D.FILTER_BITS] = 1
    return f"{len(chosen)}:" + base64.b64encode(np.packbits(bits).tobytes()).decode()


@pytest.mark.parametrize("n_rows", [None, 1])
def test_equals_the_plain_version(spark, n_rows):
    rows = list({r[0]: r for r in [*odd_rows()[:-1], *((i + 5000, *r) for i, *r in random_rows(41, 30))]}.values())[:n_rows]  # every id once
    counts = Counter(c for r in rows for _, _, c in plain_windows(r[1]))
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = {}
    for k, r in enumerate(ordered):
        text, after = r[1] or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        marks = [plain_fingerprint(x, counts) for x in (text, changed, after)]
        want[r[0]] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), marks[0], marks[1], D.likeness(marks[0], marks[1]), D.likeness(marks[0], marks[2]))
    got = D.compare_with_edit(table(spark, rows))
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want


def test_many_parts_repeated_rows_and_long_texts(spark):
    rows = odd_rows() * 3
    got = D.compare_with_edit(table(spark, rows).repartition(7)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert all(r.fingerprint == "0:" and r.n_chars == 0 for r in got if r.doc_id in (1, 2))
    assert len({r.fingerprint for r in got if r.doc_id == 6}) == 1
    assert D.compare_with_edit(table(spark, rows).filter("false")).count() == 0


def test_likeness_of_copies_edits_and_strangers():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(300, 2500))) for _ in range(30)]
    counts = np.bincount([c for t in texts for _, _, c in plain_windows(t)], minlength=D.CLASSES)
    digest = D.Digest(counts)
    marks = [digest.of(t) for t in texts]
    for k, t in enumerate(texts):
        other = (k + 1) % len(texts)
        half = D.likeness(marks[k], digest.of(D.edited(t, texts[other])))
        small = D.likeness(marks[k], digest.of(t[:200] + " inserted words " + t[200:]))
        assert D.likeness(marks[k], digest.of(t)) == 1.0 and D.likeness(marks[k], marks[other]) < 0.15
        assert 0.3 < half < 0.8 and small > 0.6
        assert D.likeness(marks[k], marks[other]) == D.likeness(marks[other], marks[k])
    assert D.likeness("0:", "0:") == 1.0 and D.likeness("0:", marks[0]) == 0.0


def test_long_texts_are_summed_in_stretches(monkeypatch):
    raw = np.frombuffer(("Some words, and others; " * 400 + "zebra " * 50).encode(), np.uint8)
    at = D.starts(raw)
    whole = D.entropy_classes(raw, at)
    monkeypatch.setattr(D, "STRETCH", 256)
    assert (D.entropy_classes(raw, at) == whole).all()


def test_every_position_starts_a_window():
    """only one place in eight was looked at."""
    rng = random.Random(7)
    for n in (1, 63, 64, 65, 200, 3000):
        raw = np.frombuffer(bytes(rng.choice(b"aabcde fgZ\xc3\xa9") for _ in range(n)), np.uint8)
        at = D.starts(raw)
        assert at.tolist() == list(range(max(n - D.WINDOW + 1, 1)))
        width, got = min(n, D.WINDOW), D.entropy_classes(raw, at)
        for i in at:
            total = sum(c * math.floor(math.log2(c) * 65536) for c in Counter(int(x) & 31 for x in raw[i : i + width]).values())
            assert got[i] == total * D.CLASSES // (width * 6 * 65536 + 1)
    assert not len(D.starts(np.zeros(0, np.uint8)))
