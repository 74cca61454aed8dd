"""Cells stored along a Morton curve, so that a window reads few row groups whichever way it lies."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TILE, RANGES, ROW_GROUP_BYTES = 8, 64, 1 << 20
KEY = "tile_key"


def _spread(value: Column) -> Column:
    """The 31 bits of a number with a zero between any two."""
    x = value.cast("long")
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(row: Column, col: Column) -> Column:
    """Place of a tile on the curve: bits of row and column in turn. Rows and columns from 0 below 2^31."""
    return F.shiftleft(_spread(row), 1).bitwiseOR(_spread(col))


def write_cells(cells: DataFrame, path: str, tile: int = TILE, group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Writes (row, col, ...) with the key of the tile, range-partitioned and sorted by it: files and row groups hold stretches of the curve.

    A tile with very many cells spreads over several partitions (the range takes the cell as well). Cells outside the grid, with a
    negative row or column, are refused.
    """
    # refused inside the key: Spark finds no common subexpressions in the branch of a condition, and the key repeats each step 64 times
    inside = lambda c: F.when(F.col(c) >= 0, F.col(c)).otherwise(F.raise_error(F.lit("a cell lies outside the grid")).cast("long"))
    key = morton(F.floor(inside("row") / tile), F.floor(inside("col") / tile))
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cells.withColumn(KEY, key).repartitionByRange(n, KEY, "row", "col").sortWithinPartitions(KEY, "row", "col")
    ordered.write.option("parquet.block.size", group_bytes).parquet(path)


def key_ranges(row0: int, col0: int, rows: int, cols: int, tile: int = TILE, limit: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of the key that cover a window of cells, ascending, at most ``limit``.

    Quarters of the plane are ranges of the curve. The largest quarter that lies only partly in the window is quartered again while the
    number of ranges allows it; quarters outside are dropped, neighbours merged.
    """
    if rows <= 0 or cols <= 0:
        return []
    low, high = (row0 // tile, col0 // tile), ((row0 + rows - 1) // tile, (col0 + cols - 1) // tile)
    bits = max(v.bit_length() for v in high)

    def state(r: int, c: int, size: int) -> int:
        """0 outside, 1 partly inside, 2 inside."""
        if r > high[0] or c > high[1] or r + size <= low[0] or c + size <= low[1]:
            return 0
        return 2 if r >= low[0] and c >= low[1] and r + size - 1 <= high[0] and c + size - 1 <= high[1] else 1

    whole: list[tuple[int, int]] = []
    partly = [(-(1 << bits), 0, 0, 0)]  # size (largest first), start on the curve, row, col
    while partly and len(whole) + len(partly) + 3 <= limit:
        size, start, r, c = heapq.heappop(partly)
        size = -size
        inside = state(r, c, size)
        if inside == 2:
            whole.append((start, start + size * size - 1))
        elif inside == 1:
            half = size // 2
            for q in range(4):
                part = (-half, start + q * half * half, r + half * (q // 2), c + half * (q % 2))
                if state(part[2], part[3], half):
                    heapq.heappush(partly, part)
    found = sorted([*whole, *((start, start + size * size - 1) for size, start, _, _ in partly)])
    merged: list[tuple[int, int]] = []
    for start, end in found:
        if merged and start == merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], end)
        else:
            merged.append((start, end))
    return merged


def read_window(spark: SparkSession, path: str, row0: int, col0: int, rows: int, cols: int, tile: int = TILE, limit: int = RANGES) -> DataFrame:
    """The stored cells of a window. The key ranges reach the Parquet scan, which skips row groups without any of them."""
    stored = spark.read.parquet(path)
    reached = F.lit(False)
    for start, end in key_ranges(row0, col0, rows, cols, tile, limit):
        reached = reached | F.col(KEY).between(start, end)
    exact = F.col("row").between(row0, row0 + rows - 1) & F.col("col").between(col0, col0 + cols - 1)
    return stored.where(reached & exact).drop(KEY)
