"""Cells inside areas, by scanline spans instead of a cell-by-edge test.

Every polygon edge is turned into its crossings with the grid rows it spans; sorted crossings
pair up to column spans (even-odd rule). Spans are cut at tile borders and met with the cells
by an equi-join on (row, tile). Polygon size therefore spreads over rows, cell count over tiles.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellsight.functions.numeric import coverage_pct, finite, py_round
from cellsight.operators.ranking import coded_median

TILE = 64


@dataclass(frozen=True)
class Grid:
    """Affine grid: cell (row, col) has its centre at x0 + (col + .5) dx, y0 + (row + .5) dy."""

    x0: float
    y0: float
    dx: float
    dy: float
    width: int
    height: int
    crs: int = 4326
    nodata: float | None = None

    def centre_x(self, col: Column) -> Column:
        return self.x0 + (col + 0.5) * self.dx

    def centre_y(self, row: Column) -> Column:
        return self.y0 + (row + 0.5) * self.dy

    def u(self, x: Column) -> Column:
        return (x - self.x0) / self.dx

    def v(self, y: Column) -> Column:
        return (y - self.y0) / self.dy

    def col_of(self, x: Column) -> Column:
        return F.floor(self.u(x)).cast("int")

    def row_of(self, y: Column) -> Column:
        return F.floor(self.v(y)).cast("int")

    def window(self, xmin: float, ymin: float, xmax: float, ymax: float) -> tuple[int, int, int, int]:
        """Rounded (row0, col0, rows, cols) of a bounding box, as a windowed read rounds it."""
        cols = sorted(((xmin - self.x0) / self.dx, (xmax - self.x0) / self.dx))
        rows = sorted(((ymin - self.y0) / self.dy, (ymax - self.y0) / self.dy))
        col0, row0 = int(cols[0] // 1), int(rows[0] // 1)
        width, height = -int(-(cols[1] - cols[0]) // 1), -int(-(rows[1] - rows[0]) // 1)
        c1, r1 = min(col0 + width, self.width), min(row0 + height, self.height)
        col0, row0 = max(col0, 0), max(row0, 0)
        if c1 <= col0 or r1 <= row0:
            raise ValueError("the window does not meet the grid")
        return row0, col0, r1 - row0, c1 - col0


def window_scan(cells: DataFrame, grid: Grid, box: tuple[float, float, float, float]) -> DataFrame:
    """Only the cells of a bounding-box window; a plain range filter, so Parquet can skip row groups."""
    row0, col0, rows, cols = grid.window(*box)
    return cells.where(F.col("row").between(row0, row0 + rows - 1) & F.col("col").between(col0, col0 + cols - 1))


def edges(features: DataFrame, ident: str = "area_id", rings: str = "rings") -> DataFrame:
    """(id, ring, seq, x1, y1, x2, y2) with every ring closed."""
    ring = features.select(ident, F.posexplode(rings).alias("ring", "pts"))
    first, last = F.get("pts", F.lit(0)), F.get("pts", F.size("pts") - 1)
    closed = F.when(first == last, F.col("pts")).otherwise(F.concat("pts", F.array(first)))
    steps = ring.where(F.size("pts") > 0).withColumn("pts", closed)
    return _segments(steps, ident)


def line_segments(features: DataFrame, ident: str, rings: str = "rings") -> DataFrame:
    """Segments of lines: like ``edges`` but open."""
    return _segments(features.select(ident, F.posexplode(rings).alias("ring", "pts")), ident)


def _segments(parts: DataFrame, ident: str) -> DataFrame:
    count = F.size("pts") - 1
    pairs = F.zip_with(F.slice("pts", F.lit(1), count), F.slice("pts", F.lit(2), count), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    stepped = parts.where(count > 0).select(ident, "ring", F.posexplode(pairs).alias("seq", "s"))
    return stepped.select(
        ident, "ring", "seq", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2")
    )


def _row_range(first: Column, last: Column, height: int) -> Column:
    low, high = F.greatest(first, F.lit(0)), F.least(last, F.lit(height - 1))
    return F.explode(F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>")))


def _clip(spans: DataFrame, width: int) -> DataFrame:
    return spans.withColumn("c0", F.greatest("c0", F.lit(0))).withColumn("c1", F.least("c1", F.lit(width - 1))).where("c0 <= c1")


def centre_spans(edge: DataFrame, grid: Grid, ident: str = "area_id") -> DataFrame:
    """Spans (id, row, c0, c1) of cells whose centre lies inside.

    Half-open rule: an edge counts for ``ymin <= y < ymax``, a centre on a left border is
    inside and on a right border outside, so areas that share a border share no cell.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    if grid.dy > 0:
        first, last = F.ceil(grid.v(low) - 0.5), F.ceil(grid.v(high) - 0.5) - 1
    else:
        first, last = F.floor(grid.v(high) - 0.5) + 1, F.floor(grid.v(low) - 0.5)
    hits = edge.where("y1 <> y2").select("*", _row_range(first, last, grid.height).alias("row"))
    cross = F.col("x1") + (grid.centre_y(F.col("row")) - F.col("y1")) * ((F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    scan = W.partitionBy(ident, "row").orderBy("x")
    ordered = hits.select(ident, "row", cross.alias("x")).select(
        ident, "row", "x", F.lead("x").over(scan).alias("x_next"), F.row_number().over(scan).alias("k")
    )
    left, right = (F.col("x"), F.col("x_next")) if grid.dx > 0 else (F.col("x_next"), F.col("x"))
    paired = ordered.where((F.col("k") % 2 == 1) & F.col("x_next").isNotNull())
    if grid.dx > 0:
        c0, c1 = F.ceil(grid.u(left) - 0.5), F.ceil(grid.u(right) - 0.5) - 1
    else:
        c0, c1 = F.floor(grid.u(left) - 0.5) + 1, F.floor(grid.u(right) - 0.5)
    return _clip(paired.select(ident, "row", c0.cast("int").alias("c0"), c1.cast("int").alias("c1")), grid.width)


def edge_spans(edge: DataFrame, grid: Grid, ident: str = "area_id") -> DataFrame:
    """Spans of the cells an edge passes through (cells are half-open squares)."""
    g = edge.select(
        ident, grid.u(F.col("x1")).alias("u1"), grid.v(F.col("y1")).alias("v1"), grid.u(F.col("x2")).alias("u2"), grid.v(F.col("y2")).alias("v2")
    )
    low, high = F.least("v1", "v2"), F.greatest("v1", "v2")
    rows = g.select("*", _row_range(F.floor(low), F.floor(high), grid.height).alias("row"))
    at = lambda v: F.col("u1") + (v - F.col("v1")) * (F.col("u2") - F.col("u1")) / (F.col("v2") - F.col("v1"))
    ua = F.when(F.col("v1") == F.col("v2"), F.col("u1")).otherwise(at(F.greatest(low, F.col("row").cast("double"))))
    ub = F.when(F.col("v1") == F.col("v2"), F.col("u2")).otherwise(at(F.least(high, F.col("row") + F.lit(1.0))))
    cut = rows.select(ident, "row", F.floor(F.least(ua, ub)).cast("int").alias("c0"), F.floor(F.greatest(ua, ub)).cast("int").alias("c1"))
    return _clip(cut, grid.width)


def merge_spans(spans: DataFrame, ident: str = "area_id") -> DataFrame:
    """Overlapping spans of one area and row become one, so no cell counts twice."""
    scan = W.partitionBy(ident, "row").orderBy("c0", "c1")
    reach = F.max("c1").over(scan.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.select(ident, "row", "c0", "c1", F.when(F.col("c0") <= reach, 0).otherwise(1).alias("new"))
    grouped = marked.withColumn("island", F.sum("new").over(scan.rowsBetween(W.unboundedPreceding, 0)))
    return grouped.groupBy(ident, "row", "island").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("island")


def area_spans(features: DataFrame, grid: Grid, all_touched: bool = False, ident: str = "area_id", rings: str = "rings") -> DataFrame:
    """Spans by the pixel-centre rule, or the all-touched rule."""
    edge = edges(features, ident, rings)
    inside = centre_spans(edge, grid, ident)
    if not all_touched:
        return inside
    return merge_spans(inside.unionByName(edge_spans(edge, grid, ident)), ident)


def tile_spans(spans: DataFrame, ident: str = "area_id") -> DataFrame:
    """Spans cut at tile borders, with the ``tile`` join key."""
    tiles = F.explode(F.sequence(F.floor(F.col("c0") / TILE), F.floor(F.col("c1") / TILE)))
    return spans.select("*", tiles.alias("tile")).select(
        ident,
        "row",
        "tile",
        F.greatest("c0", F.col("tile") * TILE).alias("c0"),
        F.least("c1", F.col("tile") * TILE + (TILE - 1)).alias("c1"),
    )


def cells_in_areas(cells: DataFrame, spans: DataFrame, ident: str = "area_id") -> DataFrame:
    """Every (area, cell) pair; a cell in no area falls out, areas may overlap.

    No broadcast hint: Spark broadcasts the spans while they are below its size threshold and
    otherwise shuffles both sides by (row, tile).
    """
    keyed = cells.withColumn("tile", F.floor(F.col("col") / TILE))
    return keyed.join(tile_spans(spans, ident), ["row", "tile"]).where(F.col("col").between(F.col("c0"), F.col("c1"))).drop("tile", "c0", "c1")


def enumerate_cells(spans: DataFrame, ident: str = "area_id") -> DataFrame:
    """(id, row, col) of the spans, for an analysis grid that has no cell table of its own."""
    return spans.select(ident, "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def quality_of(valid: Column, coverage: Column, minimum: float = 90.0) -> Column:
    return F.when((valid > 0) & (coverage >= minimum), "ok").otherwise("insufficient_grid_coverage")


def frame(areas: DataFrame, ident: str = "area_id", **periods) -> DataFrame:
    """Every area with every listed period: the rows that a summary must have, with or without cells."""
    out = areas.select(ident)
    for name, values in periods.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return out


def _in_frame(stats: DataFrame, wanted: DataFrame | None, keys: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Rows of ``wanted`` with their figures; where there are none, counts are 0 and all else is NULL."""
    if wanted is None:
        return stats
    return wanted.select(*keys).join(stats, list(keys), "left").fillna(0, list(counts))


def zonal_stats(
    pairs: DataFrame,
    keys: Sequence[str],
    means: dict[str, tuple[Column, str | None, int]],
    valid: Column,
    *,
    median_of: tuple[str, Column, str | None, int] | None = None,
    flags: Column | None = None,
    gate_rounded: bool = True,
    minimum: float = 90.0,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Means under one shared validity mask, counts, coverage and quality per group.

    With ``wanted`` (see ``frame``) every row of it is in the result: an area without a cell has 0 cells, NULL means
    and insufficient coverage. Without it, only groups with cells are.

    ``means`` is {name: (stored value, decoding, digits)}. The stored integers are averaged and
    the mean is decoded: their sums are exact, so the result does not depend on how the cells
    are spread over tasks. ``median_of`` is (name, stored integer, decoding, digits). Cells are
    counted per stored value first, so means, counts and median come from one pass.
    ``gate_rounded`` tells whether the coverage gate sees the rounded figure (vegetation, newer
    thermal, water use) or the unrounded one (soil water, older thermal).
    """
    ok = F.coalesce(valid, F.lit(False))
    shown = lambda total, n, band, digits: py_round(decode(F.when(n > 0, total / n), band), digits)
    sums = {name: F.sum(F.when(F.col("_ok"), value)).alias(f"_s_{name}") for name, (value, _, _) in means.items()}
    flagged = [] if flags is None else [F.count_if(F.col("_ok") & (flags != 0)).alias("qflag_nonzero_count")]
    counted = [F.count_if("_ok").alias("valid_pixel_count"), F.count(F.lit(1)).alias("grid_cell_count"), *sums.values(), *flagged]
    tagged = pairs.withColumn("_ok", ok)
    if median_of is None:
        stats = tagged.groupBy(*keys).agg(*counted)
    else:
        median, code, band, digits = median_of
        per_code = tagged.groupBy(*keys, F.when(F.col("_ok"), code).alias("_code")).agg(*counted)
        carried = [F.sum(c).alias(c) for c in per_code.columns if c not in (*keys, "_code")]
        stats = coded_median(per_code, keys, "_code", "valid_pixel_count", carried, median)
        stats = stats.withColumn(median, py_round(decode(F.col(median), band), digits))
    stats = _in_frame(stats, wanted, keys, [c for c in ("valid_pixel_count", "grid_cell_count", "qflag_nonzero_count") if c in stats.columns])
    for name, (_, band, digits) in means.items():
        stats = stats.withColumn(name, shown(F.col(f"_s_{name}"), F.col("valid_pixel_count"), band, digits)).drop(f"_s_{name}")
    raw = coverage_pct(F.col("valid_pixel_count"), F.col("grid_cell_count"))
    stats = stats.withColumn("coverage_pct", py_round(raw, 1))
    gate = F.col("coverage_pct") if gate_rounded else raw
    return stats.withColumn("quality_status", quality_of(F.col("valid_pixel_count"), gate, minimum))


# ---- provider decoding: (divisor, offset) from stored integers to physical units, fixed values
DECODE = {
    "ndvi": (250.0, -0.08),
    "swi": (2.0, 0.0),
    "lst": (100.0, 0.0),
    "fobs": (100.0, 0.0),
}


def decode(raw: Column, band: str | None) -> Column:
    if band is None:
        return raw.cast("double")
    divisor, offset = DECODE[band]
    return raw.cast("double") / divisor + offset


def valid_cell(raw: Column, mask: Column | None = None, nodata: float | None = None) -> Column:
    """Finite, not nodata, and available according to the mask band."""
    ok = finite(raw.cast("double"))
    if nodata is not None:
        ok = ok & (raw != nodata)
    return ok & (mask > 0) if mask is not None else ok


def bands_wide(cells: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Long (run, band, row, col, value) cells to one row per cell, with the bands named up front."""
    picks = [F.max(F.when((F.col("band") == b) & ~F.col("is_masked"), F.col("value"))).alias(b) for b in bands]
    return cells.where(F.col("band").isin(list(bands))).groupBy("run_id", "row", "col").agg(*picks)


def ndvi_stats(pairs: DataFrame, keys: Sequence[str], wanted: DataFrame | None = None) -> DataFrame:
    """Vegetation summary over bands ndvi, qflag, data_mask."""
    return zonal_stats(
        pairs, keys, {"ndvi_mean": (F.col("ndvi"), "ndvi", 4)}, valid_cell(F.col("ndvi"), F.col("data_mask")),
        median_of=("ndvi_median", F.col("ndvi"), "ndvi", 4), flags=F.col("qflag"), wanted=wanted,
    )


def swi_stats(pairs: DataFrame, keys: Sequence[str], wanted: DataFrame | None = None) -> DataFrame:
    """Soil-water summary; the 40-day band decides validity."""
    means = {f"{b}_mean": (F.col(b), "swi", 3) for b in ("swi010", "swi040", "swi100", "qflag040")}
    return zonal_stats(pairs, keys, means, valid_cell(F.col("swi040"), F.col("data_mask")), gate_rounded=False, wanted=wanted)


def lst_v2_stats(pairs: DataFrame, keys: Sequence[str], wanted: DataFrame | None = None) -> DataFrame:
    means = {
        "lst_c_mean": (F.col("lst"), "lst", 2),
        "errorbar_c_mean": (F.col("errorbar"), "lst", 2),
        "ppp_mean": (F.col("ppp"), None, 2),
        "qflag_mean": (F.col("qflag"), None, 2),
    }
    return zonal_stats(pairs, keys, means, valid_cell(F.col("lst"), F.col("data_mask")), gate_rounded=False, wanted=wanted)


def lst_v3_stats(pairs: DataFrame, keys: Sequence[str], wanted: DataFrame | None = None) -> DataFrame:
    means = {"lst_c_mean": (F.col("lst"), "lst", 2), "fobs_mean": (F.col("fobs"), "fobs", 3)}
    return zonal_stats(pairs, keys, means, valid_cell(F.col("lst"), F.col("data_mask")), wanted=wanted)


def paired_stats(first: DataFrame, second: DataFrame, keys: Sequence[str], names: tuple[str, str], minimum: float = 90.0, wanted: DataFrame | None = None) -> DataFrame:
    """Two single-raster summaries as one row: fewest valid, most cells, both values needed; ``wanted`` as in ``zonal_stats``."""
    a = first.select(*keys, F.col("mean").alias(names[0]), F.col("valid").alias("va"), F.col("cells").alias("ca"))
    b = second.select(*keys, F.col("mean").alias(names[1]), F.col("valid").alias("vb"), F.col("cells").alias("cb"))
    both = _in_frame(a.join(b, list(keys), "full_outer"), wanted, keys, ["va", "vb", "ca", "cb"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = both.withColumn("valid_pixel_count", F.least(zero("va"), zero("vb"))).withColumn("grid_cell_count", F.greatest(zero("ca"), zero("cb")))
    both = both.withColumn("coverage_pct", py_round(coverage_pct(F.col("valid_pixel_count"), F.col("grid_cell_count")), 1))
    present = F.col(names[0]).isNotNull() & F.col(names[1]).isNotNull() & (F.col("coverage_pct") >= minimum)
    return both.withColumn("quality_status", F.when(present, "ok").otherwise("insufficient_grid_coverage")).drop("va", "vb", "ca", "cb")


def band_mean(pairs: DataFrame, keys: Sequence[str], value: Column, valid: Column, scale: float = 1.0, digits: int = 3) -> DataFrame:
    """mean / valid / cells of one raster with the grid's own scale, the input of ``paired_stats``."""
    return pairs.groupBy(*keys).agg(
        py_round(F.avg(F.when(valid, value)) * scale, digits).alias("mean"), F.count_if(valid).alias("valid"), F.count(F.lit(1)).alias("cells")
    )


def period_depth(pairs: DataFrame, keys: Sequence[str], period: str, value: Column, valid: Column, expected: int | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Depth of several periods: the sum of the period means, never the sum of pixels; ``wanted`` as in ``zonal_stats``.

    Without ``expected`` an empty period adds nothing. With it, the depth is NULL unless that
    many periods have cells (the strict form of the historical baseline). Masked cells are not
    part of the grid here, so usable and counted cells are the same and coverage is 100 or 0.
    """
    usable = F.coalesce(valid, F.lit(False))
    monthly = pairs.groupBy(*keys, period).agg(F.avg(F.when(usable, value)).alias("_mean"), F.count_if(usable).alias("_n"))
    depth = F.coalesce(F.sum("_mean"), F.lit(0.0))
    if expected is not None:
        depth = F.when(F.count("_mean") == expected, F.sum("_mean"))
    out = monthly.groupBy(*keys).agg(depth.alias("depth"), F.sum("_n").alias("usable"))
    out = _in_frame(out, wanted, keys, ["usable"] if expected is not None else ["usable", "depth"])
    coverage = F.when(F.col("usable") > 0, 100.0).otherwise(0.0)
    return out.withColumn("coverage_pct", coverage).withColumn("quality_status", quality_of(F.col("usable"), F.col("coverage_pct")))


def class_share(pairs: DataFrame, keys: Sequence[str], cls: Column, wanted: int, hectares: Column, wanted_rows: DataFrame | None = None) -> DataFrame:
    """Share and hectares of a land-cover class; class 0 is no data, tiles are simply unioned before.

    ``wanted_rows`` as in ``zonal_stats``: an area without a cell is reported as unavailable.
    """
    usable = cls.isNotNull() & (cls != 0)
    crop = usable & (cls == wanted)
    out = pairs.groupBy(*keys).agg(
        F.count_if(crop).alias("_crop"),
        F.coalesce(F.sum(F.when(crop, hectares)), F.lit(0.0)).alias("class_area_ha"),
        F.count_if(usable).alias("valid_pixel_count"),
        F.count(F.lit(1)).alias("total_pixel_count"),
    )
    out = _in_frame(out, wanted_rows, keys, ["_crop", "class_area_ha", "valid_pixel_count", "total_pixel_count"])
    out = out.withColumn("class_pct", coverage_pct(F.col("_crop"), F.col("valid_pixel_count")))
    out = out.withColumn("coverage_pct", coverage_pct(F.col("valid_pixel_count"), F.col("total_pixel_count")))
    return _share_quality(out).drop("_crop")


def _share_quality(out: DataFrame, minimum: float = 90.0) -> DataFrame:
    state = F.when(F.col("coverage_pct") >= minimum, "ok").when(F.col("valid_pixel_count") > 0, "insufficient_coverage").otherwise("unavailable")
    return out.withColumn("quality_status", state)


def zonal_sum(pairs: DataFrame, keys: Sequence[str], value: Column, area_km2: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Sum and density per square kilometre; no data inside the source extent means zero.

    ``wanted`` as in ``zonal_stats``: an area without a cell has total 0 and is unavailable.
    """
    out = pairs.groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total"), F.count(F.lit(1)).alias("valid_pixel_count"))
    out = _in_frame(out, wanted, keys, ["total", "valid_pixel_count"])
    out = out.withColumn("total_pixel_count", F.col("valid_pixel_count")).withColumn("coverage_pct", F.when(F.col("valid_pixel_count") > 0, 100.0).otherwise(0.0))
    out = out.join(area_km2, [k for k in keys if k in area_km2.columns], "left")
    density = F.when(F.coalesce(F.col("area_km2"), F.lit(0.0)) > 0, F.col("total") / F.col("area_km2")).otherwise(0.0)
    return _share_quality(out.withColumn("density_per_km2", density))


# ---- local algebra

NODATA = -9999.0


def physical_band(raw: Column, scale: float, offset: float, valid: Column) -> Column:
    """Display raster value in physical units; -9999 where it is not usable."""
    value = raw * scale + offset
    return F.when(valid & finite(value), value).otherwise(NODATA)


def complete_sum(cells: DataFrame, value: Column, valid: Column, expected: int) -> DataFrame:
    """Cell-wise sum over same-grid rasters, kept only where all ``expected`` are valid."""
    total = cells.groupBy("row", "col").agg(F.sum(F.when(valid, value)).alias("_sum"), F.count_if(valid).alias("_n"))
    return total.select("row", "col", F.when(F.col("_n") == expected, F.col("_sum")).otherwise(NODATA).alias("total"))


def grids_match(grids: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Whether all grids of a group share size, transform and CRS."""
    shape = F.struct("width", "height", "x0", "y0", "dx", "dy", "crs")
    return grids.groupBy(*keys).agg((F.min(shape) == F.max(shape)).alias("grids_match"), F.count(F.lit(1)).alias("grid_count"))


def region_mean(cells: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Unweighted mean of the finite, unmasked cells."""
    return cells.where(finite(F.col(value))).groupBy(*keys).agg(F.avg(value).alias("mean"))


def slope(cells: DataFrame, cell_x: float, cell_y: float, value: str = "value") -> DataFrame:
    """Horn slope in degrees and percent from the 3x3 neighbourhood; border cells have none.

    Cells go to square tiles, those on a tile's edge also to the neighbours they border on. One shuffle by tile, then
    two ordered passes inside it: along the rows for the left and right neighbours, along the columns for the rest.
    """
    edge = lambda c: F.array_distinct(F.array(F.floor((F.col(c) - 1) / TILE), F.floor(F.col(c) / TILE), F.floor((F.col(c) + 1) / TILE)))
    known = cells.where(F.col(value).isNotNull()).select("row", "col", F.col(value).cast("double").alias("z"))
    tiled = known.select("row", "col", "z", F.explode(edge("row")).alias("_tr"))
    tiled = tiled.select("row", "col", "z", "_tr", F.explode(edge("col")).alias("_tc")).repartition("_tr", "_tc")
    along = lambda line, order: W.partitionBy("_tr", "_tc", line).orderBy(order)
    near = lambda c, line, order, step: F.sum(c).over(along(line, order).rangeBetween(step, step))
    sides = tiled.withColumns({"_left": near("z", "row", "col", -1), "_right": near("z", "row", "col", 1)})
    # Horn weights 1, 2, 1 across the other direction
    sides = sides.withColumns({"_dx": F.col("_right") - F.col("_left"), "_sx": F.col("_left") + 2 * F.col("z") + F.col("_right")})
    stencil = sides.withColumns({
        "gx": near("_dx", "col", "row", -1) + 2 * F.col("_dx") + near("_dx", "col", "row", 1),
        "gy": near("_sx", "col", "row", 1) - near("_sx", "col", "row", -1),
    })
    own = (F.floor(F.col("row") / TILE) == F.col("_tr")) & (F.floor(F.col("col") / TILE) == F.col("_tc"))
    rise = F.sqrt(F.pow(F.col("gx") / (8 * cell_x), 2) + F.pow(F.col("gy") / (8 * cell_y), 2))
    return stencil.where(own & F.col("gx").isNotNull() & F.col("gy").isNotNull()).select("row", "col", F.degrees(F.atan(rise)).alias("slope_deg"), (rise * 100).alias("slope_pct"))


def resample_nearest(target: DataFrame, source: DataFrame, source_grid: Grid, x: Column, y: Column) -> DataFrame:
    """Nearest source cell for every target cell; x and y are target centres in the source CRS."""
    placed = target.withColumn("s_row", source_grid.row_of(y)).withColumn("s_col", source_grid.col_of(x))
    renamed = source.withColumnRenamed("row", "s_row").withColumnRenamed("col", "s_col")
    return placed.join(renamed, ["s_row", "s_col"], "left").drop("s_row", "s_col")
