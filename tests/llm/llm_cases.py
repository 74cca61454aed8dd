"""Odd rows, random corpora and plain versions of the operators."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, n_words long, size long, host string, position double, row string"


def table(spark, rows):
    """Rows (doc_id, text, lang, source) with further columns whose names clash with results."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), None, 0.5, -1, -1, "h", 9.0, "r") for i, t, lang, s in rows], SCHEMA)


def odd_rows():
    sentence = "The quick brown fox jumps over the lazy dog near the old river bank today. "
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one", None, "a"), (5, "A b C", "en", "b"),
        (6, sentence * 3, "en", "b"), (6, sentence * 3, "en", "b"), (7, sentence * 3 + "more", "en", None), (8, "Ümläut ß — 日本語 '12' <|endoftext|>\n" * 2, "de", "c"),
        (9, "x" * 5000, "en", "a"), (10, "naïve café. " * 40, "fr", "a"), (11, sentence.upper() * 3, "en", "a"), (None, sentence * 2, "en", "z"), (12, "wort " * 30000, "de", "b"),
    ]


def random_rows(seed, n=60, vocabulary=400):
    """Texts with shared passages, edits, repeats and copies."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij éß%") .strip() or "a" for _ in range(rng.randint(1, 8))) for _ in range(vocabulary)]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    passages = [text(rng.randint(10, 90)) for _ in range(6)]
    rows = []
    for i in range(n):
        w = text(rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        if rows and rng.random() < 0.5:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i * 7 % n + 1000 * (i % 2), " ".join(w), rng.choice(["en", "de"]), rng.choice(["s1", "s2", None])))
    return rows


def shingle_set(text, width=3):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*(w[k:] for k in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else [])


def near_components(rows, pct=85, width=3):
    """doc_id -> (set size, component id) for unique ids."""
    sets = {r[0]: shingle_set(r[1], width) for r in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= pct * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def byte_repeats(rows, window=200):
    """Per row (doc_id, bytes, removed, spans, sha256)."""
    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    count = Counter(b[p : p + window] for _, b in raw for p in range(len(b) - window + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            if count[b[p : p + window]] > 1:
                gone[p : p + window] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def word_repeats(rows, window=13):
    """Per row (doc_id, words, removed, sha256); null ids come before all others."""
    key = lambda i: (i is not None, i or 0)
    first = {}
    split = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    for i, w in split:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, key(i)), key(i))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < key(i):
                gone[p : p + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def benchmark_hits(text, items, window=10):
    """(words, hit mask, item ids) of one text by comparing every window."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w = split(text)
    windows = defaultdict(set)
    for i, t in items:
        x = split(t)
        n = min(window, len(x))
        for p in range(len(x) - n + 1):
            if n:
                windows[tuple(x[p : p + n])].add(str(i))
    hit, found = [False] * len(w), set()
    for n in {len(k) for k in windows}:
        for p in range(len(w) - n + 1):
            names = windows.get(tuple(w[p : p + n]))
            if names:
                found |= names
                hit[p : p + n] = [True] * n
    return w, hit, found


def token_rows(rows, encode, ordered=False):
    """(doc_id, start, n_tokens, crc) for rows in id order, then text order, or as they are."""
    out, at = [], 0
    pairs = [(r[0], r[1]) for r in rows]
    for i, t in pairs if ordered else sorted(pairs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = (encode(t) if t else []) + [2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out
