"""Morton layout: key ranges and row groups read. Search by postings against trying every name."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cellsight.operators import search as S
from cellsight.sources import layout as Y


def plain_morton(r, c):
    return sum(((r >> k & 1) << (2 * k + 1)) | ((c >> k & 1) << (2 * k)) for k in range(31))


def test_morton_interleaves(spark):
    pairs = [(0, 0), (1, 0), (0, 1), (5, 9), (2**31 - 1, 0), (2**31 - 1, 2**31 - 1), (123456, 987654)]
    rows = spark.createDataFrame(pairs, "r int, c int").select("r", "c", Y.morton(F.col("r"), F.col("c")).alias("k")).collect()
    assert all(x.k == plain_morton(x.r, x.c) for x in rows)


@pytest.mark.parametrize("limit", [4, 16, 64, 4096])
def test_key_ranges_cover_the_window(limit):
    rng = random.Random(limit)
    for _ in range(40):
        row0, col0, rows, cols, tile = rng.randint(0, 90), rng.randint(0, 90), rng.randint(1, 60), rng.randint(1, 60), rng.choice([1, 3, 8])
        found = Y.key_ranges(row0, col0, rows, cols, tile, limit)
        keys = {plain_morton(r // tile, c // tile) for r in range(row0, row0 + rows) for c in range(col0, col0 + cols)}
        assert len(found) <= limit and all(a <= b for a, b in found) and all(p[1] + 1 < q[0] for p, q in zip(found, found[1:]))
        assert all(any(a <= k <= b for a, b in found) for k in keys)
        if limit == 4096:
            assert sum(b - a + 1 for a, b in found) == len(keys)
    assert Y.key_ranges(0, 0, 0, 5) == []


def test_windows_read_few_row_groups(spark, tmp_path):
    """A strip of rows, a strip of columns and a square: each reads a small part of the row groups and gives all its cells."""
    cells = spark.range(512 * 512).select((F.col("id") / 512).cast("int").alias("row"), (F.col("id") % 512).cast("int").alias("col"), F.rand(3).alias("value"))
    path = str(tmp_path / "cells")
    Y.write_cells(cells, path, tile=8, group_bytes=16_000)
    groups = []
    for f in (tmp_path / "cells").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.names.index(Y.KEY)
        groups += [(s.min, s.max) for s in (meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups))]
    assert len(groups) > 60
    for window in ((200, 0, 8, 512), (0, 200, 512, 8), (100, 300, 64, 64)):
        ranges = Y.key_ranges(*window, tile=8)
        read = sum(any(low <= b and a <= high for a, b in ranges) for low, high in groups)
        assert read <= len(groups) / 5
        found = Y.read_window(spark, path, *window, tile=8)
        assert found.columns == ["row", "col", "value"] and found.count() == found.distinct().count() == window[2] * window[3]
        text = found._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: " in text and "Or(" in text.split("PushedFilters: ")[1]


def test_cells_outside_the_grid_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="outside the grid"):
        Y.write_cells(spark.createDataFrame([(-1, 2)], "row int, col int"), str(tmp_path / "bad"))


def test_the_key_is_not_computed_inside_a_condition(spark, tmp_path, monkeypatch):
    """there every step of the key was computed 64 times, five times the whole write."""
    written = []
    cells = spark.range(64).selectExpr("int(id DIV 8) AS row", "int(id % 8) AS col")
    monkeypatch.setattr(type(cells), "repartitionByRange", lambda df, *_: written.append(df) or df)
    Y.write_cells(cells, str(tmp_path / "cells"), tile=1)
    plan = written[0]._jdf.queryExecution().analyzed().toString()
    assert "shiftleft" in plan and "coalesce(" not in plan
    got = {(r.row, r.col): r[Y.KEY] for r in spark.read.parquet(str(tmp_path / "cells")).collect()}
    assert got[0, 0] == 0 and got[1, 1] == 3 and got[7, 7] == 63 and len(got) == 64


@pytest.mark.parametrize("row, col", [(-1, 2), (2, -1), (None, 2), (2, None)])
def test_every_cell_outside_the_grid_is_refused(spark, tmp_path, row, col):
    with pytest.raises(Exception, match="outside the grid"):
        Y.write_cells(spark.createDataFrame([(1, 1), (row, col)], "row int, col int"), str(tmp_path / "bad"))


def test_search_by_postings_equals_trying_every_name(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abÄé_%x ") for _ in range(rng.randint(0, 7)))
    places = [("t", str(i), word(), rng.choice([None, word()])) for i in range(150)] + [("t", "none", None, None), ("u", "1", "Ab", "ab")]
    queries = [(str(i), q) for i, q in enumerate([word() for _ in range(40)] + ["", "  ", None, "AB", "_%", "zz"])]
    frame = spark.createDataFrame(places, "type string, id string, name_en string, name_ti string")
    got = S.search_many(frame, S.postings(frame, ["name_en", "name_ti"]), spark.createDataFrame(queries, "query_id string, query string"), ["name_en", "name_ti"], limit=6)
    want = []
    for k, q in queries:
        if not q or not q.strip(" "):
            continue
        low, best = q.lower(), []
        for p in places:
            names = [(n or "").lower() for n in p[2:]]
            rank = 1 if low in names else 2 if any(n.startswith(low) for n in names) else 3 if any(low in n for n in names) else None
            if rank:
                best.append((rank, p[2] is not None, (p[2] or "").encode(), p[0], p[1], p))
        want += [(k, b[0], *b[5]) for b in sorted(best)[:6]]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
