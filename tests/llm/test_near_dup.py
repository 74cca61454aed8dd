"""op9: registers, estimates, components and odd rows against comparing all pairs."""

import random

import numpy as np
import pytest
from llm_cases import near_components, odd_rows, random_rows, table

from cellsight.llm import near_dup as N


def families(seed, groups=12, copies=14):
    """Edited copies around the threshold, and chains whose ends are far apart."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, i = [], 0
    for g in range(groups):
        base = [word() for _ in range(rng.choice([4, 7, 9, 15, 40, 120]))]
        for _ in range(copies):
            rows.append((i * 7 % 1009, " ".join(base), "en", "a"))
            i += 1
            if g % 2:
                base = list(base)
            edited = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 30)):
                edited[rng.randrange(len(base))] = word()
            base = edited
    return rows


@pytest.mark.parametrize("rows", [families(1), families(2), random_rows(9), []])
def test_components(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(table(spark, rows)).collect()}
    assert got == near_components(rows)


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(N, "CROWDED", 2)
    monkeypatch.setattr(N, "RARE", 3)
    rows = families(3, groups=5, copies=30)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(table(spark, rows)).collect()}
    assert got == near_components(rows)


def test_odd_rows(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    out = N.near_duplicates(table(spark, rows)).collect()
    want = near_components(rows)
    assert len(out) == len(rows) and all((r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in out)


def test_one_row_of_each_group_stays(spark):
    rows = [r for r in odd_rows() if r[0] is not None] + [(6, "another text under a known id", "en", "b")]
    out = N.deduplicate(table(spark, rows))
    assert out.columns == table(spark, []).columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(6) == 2 and ids.count(7) == 1 - (near_components(rows[:-1])[7][1] == 6) and {1, 2, 3} <= set(ids)
    assert N.deduplicate(table(spark, [])).count() == 0


def test_registers_hold_the_least_hash():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    x = N.hashing.mix(h ^ np.uint64(0x5851F42D4C957F2D))
    for b, r in enumerate(N.registers(h).tolist()):
        own = [int(v) & ((1 << 56) - 1) for v in x if int(v) >> 56 == b]
        least = min(own, default=None)
        if least is None:
            assert r == N.EMPTY
        else:
            bits = least.bit_length()
            assert r >> N.MANTISSA_BITS == 56 - max(bits, 1) and r & ((1 << N.MANTISSA_BITS) - 1) == (least - (1 << bits - 1)) >> max(0, bits - 1 - N.MANTISSA_BITS)


def test_filled_registers_agree_like_the_sets():
    rng = np.random.default_rng(3)
    same = []
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 22).astype(np.uint64)
        a, b = (N.filled(N.registers(s)) for s in (x[:20], x[2:]))
        same.append((a == b).mean())
    assert abs(np.mean(same) - 18 / 22) < 0.02


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(2)
    for j in (0.0, 0.5, 0.9):
        n = 4000
        common = int(2 * n * j / (1 + j))
        x = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        a, b = x[:n], np.concatenate([x[:common], x[n : 2 * n - common]])
        found, error = N.estimate(N.registers(a), N.registers(b), n, n)
        assert abs(found - j) < 5 * max(error, 0.02)


def test_null_ids_link_like_others(spark):
    """Three texts that are 97 % alike, two of them without an id; and two such texts without any id."""
    words = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    rows = [(None, " ".join(words)), (None, " ".join([*words, "x"])), (5, " ".join(["y", *words])), (None, " ".join(other)), (None, " ".join([*other, "z"])), (9, "something else here")]
    docs = table(spark, [(i, t, "en", "a") for i, t in rows])
    got = sorted((r.n_shingles, r.doc_id is None, r.kept) for r in N.near_duplicates(docs).collect() if r.component_id == 5)
    assert got == [(58, True, False), (59, False, True), (59, True, False)]
    left = [r.text for r in N.deduplicate(docs).collect()]
    assert len(left) == 3 and " ".join(["y", *words]) in left and "something else here" in left


def test_large_group_of_independent_edits(spark):
    """300 copies of one text, each with one to eight words of its own: every link between two groups is found."""
    rng = random.Random(6)
    base = [f"b{rng.randint(0, 10**6)}" for _ in range(150)]
    rows = []
    for i in range(300):
        w = base.copy()
        for _ in range(rng.randint(1, 8)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w), "en", "a"))
    want = near_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(table(spark, rows)).collect()}
    assert got == want and len({c for _, c in want.values()}) > 20


@pytest.mark.parametrize("cell", [3, 512])
def test_sets_of_a_crowded_bucket_meet_in_cells(spark, monkeypatch, cell):
    monkeypatch.setattr(N, "CELL_SETS", cell)
    draw = random.Random(5)
    sets = [(bytes([200 - i]), draw.randint(60, 70), bytes([i % 4]), [draw.randint(0, 2) for _ in range(N.PARTS)]) for i in range(40)]
    rows = [(key, *s) for key in (7, 8) for s in sets] + [(9, *s) for s in sets if s[2] == b"\x01"]
    got = N._reachable(spark.createDataFrame(rows, "key long, set_id binary, n_shingles long, `group` binary, profile array<int>"), 40).collect()
    common = lambda p, q: sum(map(min, p, q))
    fits = lambda a, b: a[2] != b[2] and 100 * min(a[1], b[1]) >= 40 * max(a[1], b[1]) and 140 * common(a[3], b[3]) >= 40 * (a[1] + b[1])
    want = [(a[0], b[0]) for a in sets for b in sets if a[0] < b[0] and fits(a, b)]
    assert 0 < len(want) < 600 and sorted((bytes(a), bytes(b)) for a, b in got) == sorted(2 * want)


def test_new_links_merge_whole_groups(spark):
    table_ = lambda links: spark.createDataFrame([(a.encode(), b.encode()) for a, b in links], "a binary, b binary")
    rounds = [["ab", "cd", "ef"], ["bx", "yc", "xz"], ["zw", "dw", "uv"]]
    groups = None
    for links in rounds:
        groups = N.merged(groups, table_(links))
    got = sorted(map(tuple, groups.collect()))
    assert got == sorted(map(tuple, N.components(table_(sum(rounds, []))).collect())) and len(got) == 12
