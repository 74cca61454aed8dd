"""Raster and zonal queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cellsight.functions import classes as C
from cellsight.functions.dates import rate_to_depth
from cellsight.functions.geometry import pixel_hectares, planar_area
from cellsight.functions.projection import equal_area_forward, rings_to
from cellsight.operators import composite as K
from cellsight.operators import quality as Q
from cellsight.operators import zonal as Z
from cellsight.plans import rainfall
from cellsight.registry import query
from cellsight.registry.inputs import (
    AREAS_SQL, BAND_CELLS_SQL, CELLS_SQL, EDGES_SQL, EVIDENCE_SQL, GRID, INSIDE_SQL, RUNS_SQL, SCENES_SQL, pyround, with_,
)
from cellsight.session import shared_dir
from cellsight.sources import layout

BASE = (AREAS_SQL, EDGES_SQL, CELLS_SQL, INSIDE_SQL)
BAND_GRID = INSIDE_SQL.replace("FROM cells)", "FROM band_cells)")
BAND_BASE = (AREAS_SQL, EDGES_SQL, BAND_CELLS_SQL, BAND_GRID)
PAIRS_SQL = 'pairs AS (SELECT i.area_id, b.* FROM band_cells b JOIN inside i ON i."row" = b."row" AND i.col = b.col)'


def band_pairs(t):
    return Z.cells_in_areas(t.band_cells(), Z.area_spans(t.areas(), GRID))


YEARS, MONTHS = range(1991, 2000), range(1, 13)
FRAMES_SQL = {
    "area_id": "SELECT area_id FROM areas",
    'area_id, "year"': f'SELECT area_id, y AS "year" FROM areas CROSS JOIN (SELECT CAST(range AS INTEGER) AS y FROM range({YEARS.start}, {YEARS.stop}) UNION SELECT "year" FROM band_cells WHERE "year" IS NOT NULL) r',
    'area_id, "month"': f'SELECT area_id, m AS "month" FROM areas CROSS JOIN range({MONTHS.start}, {MONTHS.stop}) r(m)',
}


def framed(keys, sql, columns, defaults):
    """SQL: every row of the frame with the figures of ``sql``; ``defaults`` are {column: text} where there are none."""
    shown = ", ".join(f"coalesce({c}, {defaults[c]}) AS {c}" if c in defaults else c for c in columns)
    return f"SELECT {keys}, {shown} FROM ({FRAMES_SQL[keys]}) fr LEFT JOIN ({sql}) st USING ({keys})"


def yearly(t):
    """Every area with the years of ``YEARS`` and with every other year that has cells."""
    found = t.band_cells().agg(F.collect_set("year")).scalar()
    listed = F.array(*[F.lit(y) for y in YEARS])
    return Z.frame(t.areas()).withColumn("years", F.array_union(listed, F.coalesce(found, F.array().cast("array<int>")))).select("area_id", F.explode("years").alias("year"))


def monthly(t):
    return Z.frame(t.areas(), month=MONTHS)


def cell_pairs(t, all_touched=False):
    return Z.cells_in_areas(t.cells(), Z.area_spans(t.areas(), GRID, all_touched))


@query(
    "window_scan",
    with_(CELLS_SQL, then='SELECT "row", col, value FROM cells WHERE "row" BETWEEN 3 AND 21 AND col BETWEEN 10 AND 34'),
)
def window_scan(t):
    return Z.window_scan(t.cells(), GRID, (10.4, 3.2, 35.0, 21.9)).select("row", "col", "value")


@query(
    "window_scan_layout",
    with_(BAND_CELLS_SQL, then='SELECT "row", col, "year", "month", value, line, count(*) AS n FROM band_cells WHERE "row" BETWEEN 3 AND 21 AND col BETWEEN 10 AND 34 GROUP BY ALL'),
)
def window_scan_layout(t):
    """The window from cells that were written along a Morton curve: a few key ranges reach the scan."""
    path = f"{shared_dir(t.spark)}/layout/cells-{uuid.uuid4().hex}"
    layout.write_cells(t.band_cells(), path)
    found = layout.read_window(t.spark, path, *GRID.window(10.4, 3.2, 35.0, 21.9))
    return found.groupBy("row", "col", "year", "month", "value", "line").agg(F.count(F.lit(1)).alias("n"))


@query(
    "zonal_mask_centre",
    with_(*BASE, then='SELECT area_id, count(*) AS cells, min("row") AS first_row, max(col) AS last_col, CAST(sum(col) AS BIGINT) AS col_sum FROM inside GROUP BY area_id'),
)
def zonal_mask_centre(t):
    return cell_pairs(t).groupBy("area_id").agg(
        F.count(F.lit(1)).alias("cells"), F.min("row").alias("first_row"), F.max("col").alias("last_col"), F.sum("col").alias("col_sum")
    )


TOUCHED_SQL = """touched AS (
  SELECT area_id, "row", col FROM inside
  UNION
  SELECT DISTINCT area_id, "row", col FROM (
    SELECT e.area_id, g."row", g.col,
      CASE WHEN y1 = y2 THEN x1 ELSE x1 + (greatest(least(y1, y2), g."row") - y1) * (x2 - x1) / (y2 - y1) END AS ua,
      CASE WHEN y1 = y2 THEN x2 ELSE x1 + (least(greatest(y1, y2), g."row" + 1) - y1) * (x2 - x1) / (y2 - y1) END AS ub
    FROM grid g JOIN edges e ON g."row" BETWEEN floor(least(y1, y2)) AND floor(greatest(y1, y2))) s
  WHERE col BETWEEN floor(least(ua, ub)) AND floor(greatest(ua, ub)))"""


@query("zonal_mask_all_touched", with_(*BASE, TOUCHED_SQL, then='SELECT area_id, count(*) AS cells, CAST(sum(col) AS BIGINT) AS col_sum, CAST(sum("row") AS BIGINT) AS row_sum FROM touched GROUP BY area_id'))
def zonal_mask_all_touched(t):
    return cell_pairs(t, True).groupBy("area_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("col").alias("col_sum"), F.sum("row").alias("row_sum"))


def _zonal_sql(keys, means, valid, *, extra="", median=None, gate="rounded"):
    """SQL of one zonal summary over ``pairs``: means {name: (expression, digits)}."""
    inner = ", ".join(f"avg(CASE WHEN ok THEN {e} END){u} AS m_{n}" for n, (e, u, _) in means.items())
    med = f", quantile_cont(CASE WHEN ok THEN {median[1]} END, 0.5){median[2]} AS m_{median[0]}" if median else ""
    outer = ", ".join(f"{pyround('m_' + n, d)} AS {n}" for n, (_, _, d) in means.items())
    outer += f", {pyround('m_' + median[0], median[3])} AS {median[0]}" if median else ""
    passed = pyround("cov", 1) if gate == "rounded" else "cov"
    own = f"""SELECT {keys}, {outer}, valid_pixel_count, grid_cell_count{', qflag_nonzero_count' if extra else ''}, {pyround('cov', 1)} AS coverage_pct,
      CASE WHEN valid_pixel_count > 0 AND {passed} >= 90 THEN 'ok' ELSE 'insufficient_grid_coverage' END AS quality_status
    FROM (SELECT *, 100.0::DOUBLE * valid_pixel_count / grid_cell_count AS cov FROM (
      SELECT {keys}, {inner}{med}{extra}, count(*) FILTER (WHERE ok) AS valid_pixel_count, count(*) AS grid_cell_count
      FROM (SELECT *, {valid} AS ok FROM pairs) p GROUP BY {keys}) a) b"""
    counts = ["valid_pixel_count", "grid_cell_count", *(["qflag_nonzero_count"] if extra else []), "coverage_pct"]
    figures = [*means, *([median[0]] if median else []), *counts, "quality_status"]
    return framed(keys, own, figures, {**{c: "0" for c in counts}, "quality_status": "'insufficient_grid_coverage'"})


@query(
    "ndvi_zonal_stats",
    with_(
        *BAND_BASE, PAIRS_SQL,
        then=_zonal_sql(
            'area_id, "year"', {"ndvi_mean": ("raw", " / 250.0::DOUBLE - 0.08::DOUBLE", 4)}, "data_mask > 0",
            extra=", count(*) FILTER (WHERE ok AND qflag <> 0) AS qflag_nonzero_count",
            median=("ndvi_median", "raw", " / 250.0::DOUBLE - 0.08::DOUBLE", 4),
        ),
    ),
)
def ndvi_zonal_stats(t):
    return Z.ndvi_stats(band_pairs(t).withColumnRenamed("raw", "ndvi"), ["area_id", "year"], yearly(t))


@query(
    "swi_zonal_stats",
    with_(
        *BAND_BASE, PAIRS_SQL,
        then=_zonal_sql(
            'area_id, "year"',
            {"swi010_mean": ("raw", " / 2.0::DOUBLE", 3), "swi040_mean": ("value", " / 2.0::DOUBLE", 3), "swi100_mean": ("line", " / 2.0::DOUBLE", 3), "qflag040_mean": ("qflag", " / 2.0::DOUBLE", 3)},
            "data_mask > 0", gate="raw",
        ),
    ),
)
def swi_zonal_stats(t):
    named = band_pairs(t).withColumn("swi010", F.col("raw")).withColumn("swi040", F.col("value")).withColumn("swi100", F.col("line")).withColumn("qflag040", F.col("qflag"))
    return Z.swi_stats(named, ["area_id", "year"], yearly(t))


@query(
    "lst_v2_zonal_stats",
    with_(
        *BAND_BASE, PAIRS_SQL,
        then=_zonal_sql(
            'area_id, "month"',
            {"lst_c_mean": ("(raw * 10)", " / 100.0::DOUBLE", 2), "errorbar_c_mean": ("line", " / 100.0::DOUBLE", 2), "ppp_mean": ("value", "", 2), "qflag_mean": ("qflag", "", 2)},
            "data_mask > 0", gate="raw",
        ),
    ),
)
def lst_v2_zonal_stats(t):
    named = band_pairs(t).withColumn("lst", F.col("raw") * 10).withColumn("errorbar", F.col("line")).withColumn("ppp", F.col("value"))
    return Z.lst_v2_stats(named, ["area_id", "month"], monthly(t))


@query(
    "lst_v3_zonal_stats",
    with_(
        *BAND_BASE, PAIRS_SQL,
        then=_zonal_sql('area_id, "month"', {"lst_c_mean": ("(raw * 10)", " / 100.0::DOUBLE", 2), "fobs_mean": ("value", " / 100.0::DOUBLE", 3)}, "data_mask > 0"),
    ),
)
def lst_v3_zonal_stats(t):
    return Z.lst_v3_stats(band_pairs(t).withColumn("lst", F.col("raw") * 10).withColumn("fobs", F.col("value")), ["area_id", "month"], monthly(t))


@query(
    "wapor_paired_stats",
    with_(
        *BAND_BASE, PAIRS_SQL,
        then=framed('area_id, "year"', f"""SELECT area_id, "year", {pyround('ta', 3)} AS transpiration_mm, {pyround('tb', 3)} AS aeti_mm,
          least(va, vb) AS valid_pixel_count, greatest(ca, cb) AS grid_cell_count, {pyround('cov', 1)} AS coverage_pct,
          CASE WHEN ta IS NOT NULL AND tb IS NOT NULL AND {pyround('cov', 1)} >= 90 THEN 'ok' ELSE 'insufficient_grid_coverage' END AS quality_status
        FROM (SELECT *, CASE WHEN greatest(ca, cb) > 0 THEN 100.0::DOUBLE * least(va, vb) / greatest(ca, cb) ELSE 0 END AS cov FROM (
          SELECT area_id, "year", avg(CASE WHEN line % 2 = 0 AND value <> 7 THEN value END) * 0.1::DOUBLE AS ta, avg(CASE WHEN line % 2 = 1 AND value <> 7 THEN value END) * 0.1::DOUBLE AS tb,
            count(*) FILTER (WHERE line % 2 = 0 AND value <> 7) AS va, count(*) FILTER (WHERE line % 2 = 1 AND value <> 7) AS vb,
            count(*) FILTER (WHERE line % 2 = 0) AS ca, count(*) FILTER (WHERE line % 2 = 1) AS cb FROM pairs GROUP BY area_id, "year") a) b""",
            ["transpiration_mm", "aeti_mm", "valid_pixel_count", "grid_cell_count", "coverage_pct", "quality_status"],
            {"valid_pixel_count": "0", "grid_cell_count": "0", "coverage_pct": "0", "quality_status": "'insufficient_grid_coverage'"}),
    ),
)
def wapor_paired_stats(t):
    pairs = band_pairs(t)
    keys = ["area_id", "year"]
    side = lambda odd: Z.band_mean(pairs.where(F.col("line") % 2 == odd), keys, F.col("value"), Z.valid_cell(F.col("value"), nodata=7.0), 0.1)
    return Z.paired_stats(side(0), side(1), keys, ("transpiration_mm", "aeti_mm"), wanted=yearly(t))


DEPTH_SQL = """monthly AS (
  SELECT area_id, "year", "month", avg(CASE WHEN data_mask > 0 THEN value END) AS m, count(*) FILTER (WHERE data_mask > 0) AS n
  FROM pairs WHERE "month" IN (6, 7) GROUP BY 1, 2, 3)"""


@query(
    "seasonal_depth",
    with_(
        *BAND_BASE, PAIRS_SQL, DEPTH_SQL,
        then=framed('area_id, "year"', """SELECT area_id, "year", round(coalesce(sum(m), 0), 6) AS depth, CAST(sum(n) AS BIGINT) AS usable,
          CAST(CASE WHEN sum(n) > 0 THEN 100.0 ELSE 0.0 END AS DOUBLE) AS coverage_pct, CASE WHEN sum(n) > 0 THEN 'ok' ELSE 'insufficient_grid_coverage' END AS quality_status
        FROM monthly GROUP BY 1, 2""",
            ["depth", "usable", "coverage_pct", "quality_status"], {"depth": "0", "usable": "0", "coverage_pct": "0", "quality_status": "'insufficient_grid_coverage'"}),
    ),
)
def seasonal_depth(t):
    season = band_pairs(t).where(F.col("month").isin(6, 7))
    out = Z.period_depth(season, ["area_id", "year"], "month", F.col("value"), F.col("data_mask") > 0, wanted=yearly(t))
    return out.withColumn("depth", F.round("depth", 6))


@query(
    "seasonal_depth_strict",
    with_(
        *BAND_BASE, PAIRS_SQL, DEPTH_SQL,
        then=framed('area_id, "year"', 'SELECT area_id, "year", round(CASE WHEN count(m) = 2 THEN sum(m) END, 6) AS depth FROM monthly GROUP BY 1, 2', ["depth"], {}),
    ),
)
def seasonal_depth_strict(t):
    season = band_pairs(t).where(F.col("month").isin(6, 7))
    out = Z.period_depth(season, ["area_id", "year"], "month", F.col("value"), F.col("data_mask") > 0, expected=2, wanted=yearly(t))
    return out.select("area_id", "year", F.round("depth", 6).alias("depth"))


OBSERVED_SQL = with_(
    *BAND_BASE, PAIRS_SQL,
    """means AS (SELECT "year", "month", area_id, avg(value) AS m, count(*) AS n FROM pairs WHERE data_mask > 0 AND "month" IN (6, 7) GROUP BY 1, 2, 3)""",
    """depth AS (SELECT area_id, "year", sum(m) AS depth, sum(n) AS n FROM means GROUP BY 1, 2)""",
    """years AS (SELECT a.area_id, y AS "year", coalesce(d.depth, 0) AS depth FROM areas a CROSS JOIN range(1995, 2001) r(y)
       LEFT JOIN depth d ON d.area_id = a.area_id AND d."year" = y)""",
    """cur AS (SELECT a.area_id, d.depth, coalesce(d.n, 0) AS n FROM areas a LEFT JOIN depth d ON d.area_id = a.area_id AND d."year" = 2001)""",
    """cmp AS (SELECT c.area_id, c.depth, c.n, list_sort(list(y.depth))[len(list(y.depth)) // 2 + 1] AS med,
         100.0::DOUBLE * (count(*) FILTER (WHERE y.depth < c.depth) + 0.5 * count(*) FILTER (WHERE y.depth = c.depth)) / count(*) AS pct
       FROM cur c JOIN years y ON y.area_id = c.area_id GROUP BY 1, 2, 3)""",
    f"""fin AS (SELECT area_id, n, CASE WHEN n > 0 THEN {pyround('depth', 2)} END AS rainfall_mm, CASE WHEN n > 0 THEN {pyround('med', 2)} END AS baseline_median_mm,
         CASE WHEN n > 0 THEN {pyround('pct', 1)} END AS percentile FROM cmp)""",
    then="""SELECT area_id, rainfall_mm, baseline_median_mm, percentile, CAST(n AS BIGINT) AS grid_cell_count, CAST(CASE WHEN n > 0 THEN 100.0 ELSE 0.0 END AS DOUBLE) AS coverage_pct,
      CASE WHEN percentile IS NULL THEN 'unavailable' WHEN percentile <= 10 THEN 'exceptionally_dry' WHEN percentile <= 20 THEN 'drier_than_typical'
           WHEN percentile < 80 THEN 'typical_range' WHEN percentile < 90 THEN 'wetter_than_typical' ELSE 'exceptionally_wet' END AS condition_class,
      CASE WHEN n > 0 THEN 'ok' ELSE 'insufficient_grid_coverage' END AS quality_status FROM fin""",
)


@query("observed_rainfall_condition", OBSERVED_SQL)
def observed_rainfall_condition(t):
    """Cells to areas, monthly means, season depth, comparison with 1995-2000, class and quality."""
    means = rainfall.period_means(band_pairs(t).where(F.col("month").isin(6, 7)), F.col("value"), F.col("data_mask") > 0)
    return rainfall.observed_condition(means, t.areas(), 2001, [6, 7], (1995, 2000))


@query(
    "cropland_share",
    with_(
        *BASE, TOUCHED_SQL,
        then=framed("area_id", """SELECT area_id, CASE WHEN valid > 0 THEN 100.0::DOUBLE * crop / valid ELSE 0 END AS class_pct, round(ha, 4) AS class_area_ha, valid AS valid_pixel_count, total AS total_pixel_count,
          100.0::DOUBLE * valid / total AS coverage_pct,
          CASE WHEN 100.0::DOUBLE * valid / total >= 90 THEN 'ok' WHEN valid > 0 THEN 'insufficient_coverage' ELSE 'unavailable' END AS quality_status
        FROM (SELECT area_id, count(*) AS total, count(*) FILTER (WHERE cls % 10 <> 0) AS valid, count(*) FILTER (WHERE cls % 10 = 4) AS crop,
          coalesce(sum(CASE WHEN cls % 10 = 4 THEN greatest(0.01, abs(cos(radians(14 - (t."row" + 0.5) * 0.01)))) * 111320 * 0.01 * 110574 * 0.01 / 10000 END), 0) AS ha
          FROM touched t JOIN cells c ON c."row" = t."row" AND c.col = t.col GROUP BY area_id) s""",
            ["class_pct", "class_area_ha", "valid_pixel_count", "total_pixel_count", "coverage_pct", "quality_status"],
            {**{c: "0" for c in ("class_pct", "class_area_ha", "valid_pixel_count", "total_pixel_count", "coverage_pct")}, "quality_status": "'unavailable'"}),
    ),
)
def cropland_share(t):
    hectares = pixel_hectares(14 - (F.col("row") + 0.5) * 0.01, 0.01, 0.01)
    out = Z.class_share(cell_pairs(t, True), ["area_id"], F.col("cls") % 10, 4, hectares, Z.frame(t.areas()))
    return out.withColumn("class_area_ha", F.round("class_area_ha", 4))


@query(
    "population_density",
    with_(
        *BASE, TOUCHED_SQL,
        """sizes AS (SELECT area_id, abs(sum(CASE WHEN hole = 0 THEN x1 * y2 - x2 * y1 ELSE 0 END)) / 2 - abs(sum(CASE WHEN hole = 1 THEN x1 * y2 - x2 * y1 ELSE 0 END)) / 2 AS km2 FROM edges GROUP BY area_id)""",
        then=framed("area_id", """SELECT t.area_id, round(coalesce(sum(CASE WHEN cls % 5 <> 0 THEN value END), 0), 4) AS total, count(*) AS total_pixel_count, round(coalesce(sum(CASE WHEN cls % 5 <> 0 THEN value END), 0) / km2, 4) AS density_per_km2, 'ok' AS quality_status
        FROM touched t JOIN cells c ON c."row" = t."row" AND c.col = t.col JOIN sizes s ON s.area_id = t.area_id GROUP BY t.area_id, km2""",
            ["total", "total_pixel_count", "density_per_km2", "quality_status"], {"total": "0", "total_pixel_count": "0", "density_per_km2": "0", "quality_status": "'unavailable'"}),
    ),
)
def population_density(t):
    size = t.areas().select("area_id", planar_area(F.col("rings")).alias("area_km2"))
    out = Z.zonal_sum(cell_pairs(t, True), ["area_id"], F.when(F.col("cls") % 5 != 0, F.col("value")), size, Z.frame(t.areas()))
    return out.select("area_id", F.round("total", 4).alias("total"), "total_pixel_count", F.round("density_per_km2", 4).alias("density_per_km2"), "quality_status")


@query(
    "physical_raster",
    with_(CELLS_SQL, then='SELECT "row", col, CASE WHEN cls > 5 AND value <> 900 THEN round(value * 0.01::DOUBLE + -0.5, 6) ELSE -9999 END AS physical FROM cells'),
)
def physical_raster(t):
    valid = Z.valid_cell(F.col("value"), F.col("cls") - 5, nodata=900.0)
    physical = Z.physical_band(F.col("value"), 0.01, -0.5, valid)
    return t.cells().select("row", "col", F.round(physical, 6).alias("physical"))


@query(
    "rainfall_total_raster",
    with_(
        BAND_CELLS_SQL,
        """rasters AS (SELECT "row", col, "month", max(CASE WHEN data_mask > 0 THEN value END) AS v FROM band_cells WHERE "year" = 2000 GROUP BY 1, 2, 3)""",
        then='SELECT "row", col, CASE WHEN count(v) = 12 THEN sum(v) ELSE -9999 END AS total FROM rasters GROUP BY 1, 2',
    ),
)
def rainfall_total_raster(t):
    year = t.band_cells().where("year = 2000")
    rasters = year.groupBy("row", "col", "month").agg(F.max(F.when(F.col("data_mask") > 0, F.col("value"))).alias("value"))
    return Z.complete_sum(rasters, F.col("value"), F.col("value").isNotNull(), 12)


@query(
    "mask_profiles",
    with_(
        SCENES_SQL,
        """idx AS (SELECT *, (nir - swir) / (nir + swir) AS ndmi, qa <> 255 AND (qa & 192) <> 192 AND (qa & 62) = 0 AS strict, qa <> 255 AND (qa & 192) <> 192 AND (qa & 58) = 0 AS wide
           FROM scenes WHERE nir > -9999 AND swir > -9999 AND nir < 12000 AND swir < 12000 AND nir + swir > 0)""",
        then="""SELECT area_id, 'strict' AS profile, count(*) AS observations, round(avg(ndmi), 8) AS mean_index, 0 AS adjacent_only FROM idx WHERE strict GROUP BY 1
        UNION ALL SELECT area_id, 'adjacency_allowed', count(*), round(avg(ndmi), 8), CAST(count(*) FILTER (WHERE NOT strict) AS INTEGER) FROM idx WHERE wide GROUP BY 1""",
    ),
)
def mask_profiles(t):
    obs = K.profile_observations(t.scenes())
    return obs.groupBy("area_id", "profile").agg(
        F.count(F.lit(1)).alias("observations"), F.round(F.avg("index"), 8).alias("mean_index"), F.count_if("adjacent_only").cast("int").alias("adjacent_only")
    )


COMPOSITE_SQL = with_(
    SCENES_SQL,
    """idx AS (SELECT *, (nir - swir) / (nir + swir) AS ndmi, (qa & 62) = 0 AS strict, (qa & 58) = 0 AS wide
       FROM scenes WHERE nir < 12000 AND swir < 12000 AND nir + swir > 0 AND qa <> 255 AND (qa & 192) <> 192)""",
    """obs AS (SELECT *, 'strict' AS profile, false AS adj FROM idx WHERE strict UNION ALL SELECT *, 'adjacency_allowed', NOT strict FROM idx WHERE wide)""",
    """eligible AS (SELECT area_id, count(DISTINCT "row") AS total, count(DISTINCT scene_id) AS candidates FROM scenes GROUP BY 1)""",
    """frame AS (SELECT area_id, total, candidates, profile FROM eligible CROSS JOIN (VALUES ('strict'), ('adjacency_allowed')) p(profile))""",
    """pix AS (SELECT area_id, profile, "row", col, quantile_cont(ndmi, 0.5) AS med, count(*) AS n FROM obs GROUP BY 1, 2, 3, 4)""",
    """spat AS (SELECT area_id, profile, count(*) AS valid, count(*) FILTER (WHERE n >= 2) AS twice, sum(n) AS total_obs, avg(med) AS mean, quantile_cont(med, 0.5) AS median, quantile_cont(n, 0.5) AS med_n FROM pix GROUP BY 1, 2)""",
    """sc AS (SELECT area_id, profile, scene_id, min(acquired_at) AS acq_at, count(*) FILTER (WHERE adj) AS adj FROM obs GROUP BY 1, 2, 3)""",
    """num AS (SELECT *, row_number() OVER (PARTITION BY area_id, profile ORDER BY acq_at, scene_id) AS k, count(*) OVER (PARTITION BY area_id, profile) AS n FROM sc)""",
    """acq AS (SELECT area_id, profile, count(*) AS usable, min(acq_at) AS first_at, max(acq_at) AS last_at, max(CASE WHEN k = n // 2 + 1 THEN acq_at END) AS med_at, sum(adj) AS adj FROM num GROUP BY 1, 2)""",
    """full_ AS (SELECT f.*, coalesce(valid, 0) AS valid, coalesce(total_obs, 0) AS total_obs, mean, median, med_n, coalesce(usable, 0) AS usable, first_at, last_at, med_at, coalesce(adj, 0) AS adj,
         100.0::DOUBLE * coalesce(valid, 0) / total AS cov, 100.0::DOUBLE * coalesce(twice, 0) / total AS cov2
       FROM frame f LEFT JOIN spat s USING (area_id, profile) LEFT JOIN acq a USING (area_id, profile))""",
    then=f"""SELECT area_id, profile, round(mean, 4) AS ndmi_mean, round(median, 4) AS ndmi_median, {pyround('cov', 1)} AS spatial_coverage_pct, {pyround('cov2', 1)} AS two_observation_coverage_pct,
      med_n AS median_valid_observation_count, valid AS valid_spatial_pixel_count, total AS total_eligible_pixel_count, CAST(total_obs AS BIGINT) AS valid_observation_pixel_count,
      candidates AS candidate_acquisition_count, usable AS usable_acquisition_count, strftime(first_at, '%Y-%m-%d %H:%M:%S') AS first_acquisition_at, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_acquisition_at,
      strftime(med_at, '%Y-%m-%d %H:%M:%S') AS median_acquisition_at, CAST(adj AS BIGINT) AS adjacency_accepted_pixel_count,
      CASE WHEN valid < 30 OR usable < 2 OR {pyround('cov', 1)} < 30 THEN 'insufficient' WHEN {pyround('cov', 1)} < 70 THEN 'limited' ELSE 'adequate' END AS evidence_tier FROM full_""",
)


@query("composite_evidence", COMPOSITE_SQL)
def composite_evidence(t):
    scenes = t.scenes()
    eligible = scenes.groupBy("area_id").agg(F.countDistinct("row").alias("total_eligible_pixel_count"))
    candidates = scenes.groupBy("area_id").agg(F.countDistinct("scene_id").alias("candidate_acquisition_count"))
    out = K.composite_evidence(K.profile_observations(scenes), eligible, candidates)
    for c in ("first_acquisition_at", "last_acquisition_at", "median_acquisition_at"):
        out = out.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return out


@query(
    "clear_sky_median",
    with_(SCENES_SQL, then='SELECT area_id, "row", col, round(quantile_cont((nir - swir) / (nir + swir), 0.5), 8) AS composite, count(*) AS observations FROM scenes WHERE scl IN (4, 5) AND data_mask = 1 GROUP BY 1, 2, 3'),
)
def clear_sky_median(t):
    return K.clear_sky_median(t.scenes(), ["area_id"]).withColumn("composite", F.round("composite", 8))


@query(
    "statistics_evidence",
    with_(
        EVIDENCE_SQL,
        """st AS (SELECT run_id, area_id, count(*) AS total, count(*) FILTER (WHERE quality_status <> 'ok') AS missing, avg(value) AS mean, max(value) AS med FROM evidence GROUP BY 1, 2)""",
        """nn AS (SELECT *, greatest(0, total - missing) AS valid FROM st)""",
        """cc AS (SELECT *, 100.0::DOUBLE * valid / total AS cov FROM nn)""",
        then=f"""SELECT run_id, area_id, CAST(valid AS BIGINT) AS valid_pixel_count, total AS grid_cell_count, {pyround('cov', 1)} AS coverage_pct, CASE WHEN valid > 0 THEN {pyround('mean', 4)} END AS ndmi_mean,
          CASE WHEN valid > 0 THEN {pyround('med', 4)} END AS ndmi_median, CASE WHEN valid > 0 AND {pyround('cov', 1)} >= 70 THEN 'ok' ELSE 'insufficient_evidence' END AS quality_status FROM cc""",
    ),
)
def statistics_evidence(t):
    stats = t.evidence().groupBy("run_id", "area_id").agg(
        F.count(F.lit(1)).alias("sampleCount"), F.count_if(F.col("quality_status") != "ok").alias("noDataCount"), F.avg("value").alias("mean"), F.max("value").alias("m")
    )
    body = F.to_json(F.struct("mean", "sampleCount", "noDataCount", F.create_map(F.lit("50.0"), F.col("m")).alias("percentiles")))
    return K.statistics_evidence(stats.select("run_id", "area_id", body.alias("stats")))


LON, LAT, STEP = 36.5, 12.3, 0.0007
ANALYSIS_SQL = with_(
    AREAS_SQL, EDGES_SQL,
    """k AS (SELECT 6378137.0::DOUBLE AS a, 0.0066943799901413165::DOUBLE AS e2)""",
    """kk AS (SELECT *, sqrt(e2) AS e, cos(radians(30)) / sqrt(1 - e2 * sin(radians(30)) * sin(radians(30))) AS k0 FROM k)""",
    f"""geo AS (SELECT area_id, radians({LON} + x1 * {STEP}) AS l1, sin(radians({LAT} + y1 * {STEP})) AS s1, radians({LON} + x2 * {STEP}) AS l2, sin(radians({LAT} + y2 * {STEP})) AS s2 FROM edges)""",
    """pe AS (SELECT area_id, l1 * a * k0 AS px1, l2 * a * k0 AS px2,
        (1 - e2) * (s1 / (1 - e2 * s1 * s1) - ln((1 - e * s1) / (1 + e * s1)) / (2 * e)) * a / (2 * k0) AS py1,
        (1 - e2) * (s2 / (1 - e2 * s2 * s2) - ln((1 - e * s2) / (1 + e * s2)) / (2 * e)) * a / (2 * k0) AS py2 FROM geo CROSS JOIN kk)""",
    """box AS (SELECT area_id, floor(min(least(px1, px2)) / 30)::BIGINT AS ca, floor(max(greatest(px1, px2)) / 30)::BIGINT AS cb, floor(min(least(py1, py2)) / 30)::BIGINT AS ra, floor(max(greatest(py1, py2)) / 30)::BIGINT AS rb FROM pe GROUP BY 1)""",
    """px AS (SELECT area_id, c, unnest(range(ra, rb + 1)) AS r FROM (SELECT area_id, ra, rb, unnest(range(ca, cb + 1)) AS c FROM box) q)""",
    """ins AS (SELECT px.area_id, c, r FROM px JOIN pe ON pe.area_id = px.area_id AND py1 <> py2 AND least(py1, py2) <= (r + 0.5) * 30 AND (r + 0.5) * 30 < greatest(py1, py2)
        AND px1 + ((r + 0.5) * 30 - py1) * ((px2 - px1) / (py2 - py1)) > (c + 0.5) * 30 GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)""",
    then="SELECT a.area_id, count(i.c) AS total_eligible_pixel_count FROM areas a LEFT JOIN ins i ON i.area_id = a.area_id GROUP BY 1",
)


@query("analysis_grid_pixels", ANALYSIS_SQL)
def analysis_grid_pixels(t):
    """Areas in lon/lat on the 30 m equal-area grid."""
    to_geo = lambda x, y: F.struct((LON + x * STEP).alias("x"), (LAT + y * STEP).alias("y"))
    areas = t.areas().select("area_id", rings_to(F.col("rings"), to_geo).alias("rings"))
    return K.eligible_pixels(areas, K.analysis_spans(areas))


@query(
    "resample_nearest",
    with_(
        CELLS_SQL,
        """targets AS (SELECT DISTINCT "row" * 2 + i AS "row", col * 2 + j AS col FROM cells CROSS JOIN (VALUES (0), (1)) a(i) CROSS JOIN (VALUES (0), (1)) b(j))""",
        then='SELECT t."row", t.col, c.value FROM targets t LEFT JOIN cells c ON c."row" = floor((t."row" + 0.5) * 0.5 + 0.3) AND c.col = floor((t.col + 0.5) * 0.5 + 0.3)',
    ),
)
def resample_nearest(t):
    """Half-size target cells, shifted by 0.3, from the part grid."""
    cells = t.cells()
    both = lambda c: F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1)).alias(c)
    target = cells.select(both("row"), "col").select("row", both("col"))
    fine = Z.Grid(0.3, 0.3, 0.5, 0.5, 2 * GRID.width, GRID.height)
    return Z.resample_nearest(target, cells.select("row", "col", "value"), GRID, fine.centre_x(F.col("col")), fine.centre_y(F.col("row")))


@query(
    "region_monthly_depth",
    with_(
        BAND_CELLS_SQL,
        then="""SELECT "year", "month", line AS member, round(avg(value / 1e9) * (day(last_day(make_date("year", "month", 1))) * 86400 * 1000), 6) AS depth_mm FROM band_cells WHERE data_mask > 0 GROUP BY 1, 2, 3""",
    ),
)
def region_monthly_depth(t):
    """Mean rate per ensemble member over the region, as monthly depth."""
    cells = t.band_cells().where("data_mask > 0").withColumn("rate", F.col("value") / 1e9)
    means = Z.region_mean(cells, ["year", "month", "line"], "rate")
    day = F.make_date("year", "month", F.lit(1))
    return means.select("year", "month", F.col("line").alias("member"), F.round(rate_to_depth(F.col("mean"), day), 6).alias("depth_mm"))


_W = {(-1, -1): (-1, -1), (-1, 0): (0, -2), (-1, 1): (1, -1), (0, -1): (-2, 0), (0, 1): (2, 0), (1, -1): (-1, 1), (1, 0): (0, 2), (1, 1): (1, 1)}


@query(
    "terrain_slope",
    with_(
        CELLS_SQL,
        """nb AS (SELECT a."row", a.col, count(*) AS n, """
        + ", ".join(
            f"sum(CASE " + " ".join(f"WHEN b.\"row\" - a.\"row\" = {r} AND b.col - a.col = {c} THEN b.value * {w[i]}" for (r, c), w in _W.items()) + f" ELSE 0 END) AS g{n}"
            for i, n in enumerate("xy")
        )
        + """ FROM cells a JOIN cells b ON b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1, 2)""",
        then="""SELECT "row", col, round(degrees(atan(sqrt((gx / 240) * (gx / 240) + (gy / 240) * (gy / 240)))), 6) AS slope_deg, round(100 * sqrt((gx / 240) * (gx / 240) + (gy / 240) * (gy / 240)), 6) AS slope_pct FROM nb WHERE n = 9""",
    ),
)
def terrain_slope(t):
    out = Z.slope(t.cells(), 30.0, 30.0)
    return out.select("row", "col", F.round("slope_deg", 6).alias("slope_deg"), F.round("slope_pct", 6).alias("slope_pct"))


def _display_case() -> str:
    whens = []
    for name, limits in C.DISPLAY_LIMITS.items():
        for i, limit in enumerate(limits):
            whens.append(f"WHEN indicator = '{name}' AND v < {limit} THEN {i}")
        whens.append(f"WHEN indicator = '{name}' THEN {len(limits)}")
    return "CASE WHEN quality_status <> 'ok' OR v IS NULL THEN NULL " + " ".join(whens) + " END"


def _change_case() -> str:
    whens = []
    for name, (small, large) in C.CHANGE_LIMITS.items():
        if name is not None:
            whens.append(f"WHEN indicator = '{name}' AND abs(d) < {small} THEN 'steady' WHEN indicator = '{name}' AND d < 0 AND abs(d) < {large} THEN 'decrease' WHEN indicator = '{name}' AND d >= 0 AND abs(d) < {large} THEN 'increase'")
    return "CASE WHEN d IS NULL THEN NULL " + " ".join(whens) + " WHEN d < 0 THEN 'strong_decrease' ELSE 'strong_increase' END"


@query(
    "display_classes",
    with_(
        EVIDENCE_SQL, RUNS_SQL,
        """j AS (SELECT indicator, quality_status, CASE WHEN indicator = 'ndvi' THEN value / 50 WHEN indicator = 'wapor' THEN value / 10 WHEN indicator = 'rainfall' THEN value * 10 ELSE value END AS v, value - 25 AS d FROM evidence e JOIN runs r USING (run_id))""",
        then=f"SELECT indicator, {_display_case()} AS display_class, {_change_case()} AS change_class, count(*) AS areas FROM j GROUP BY 1, 2, 3",
    ),
)
def display_classes(t):
    j = t.evidence().join(t.runs().select("run_id", "indicator"), "run_id")
    i = F.col("indicator")
    v = F.when(i == "ndvi", F.col("value") / 50).when(i == "wapor", F.col("value") / 10).when(i == "rainfall", F.col("value") * 10).otherwise(F.col("value"))
    classed = j.select(i, C.display_class(i, v, F.col("quality_status")).alias("display_class"), C.change_class(i, F.col("value") - 25).alias("change_class"))
    return classed.groupBy("indicator", "display_class", "change_class").agg(F.count(F.lit(1)).alias("areas"))


@query(
    "grids_match",
    """SELECT o_orderpriority, min(w) = max(w) AS grids_match, count(*) AS grid_count FROM (SELECT o_orderpriority, CASE WHEN o_orderpriority = '2-HIGH' AND o_orderkey % 1000 = 7 THEN 51 ELSE 50 END AS w FROM orders) o GROUP BY 1""",
)
def grids_match(t):
    o = t.raw("orders")
    odd = (F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderkey") % 1000 == 7)
    grids = o.select("o_orderpriority", F.when(odd, 51).otherwise(50).alias("width"), *[F.lit(v).alias(n) for n, v in (("height", 10), ("x0", 0.0), ("y0", 0.0), ("dx", 1.0), ("dy", 1.0), ("crs", 4326))])
    return Z.grids_match(grids, ["o_orderpriority"])


@query(
    "slope_classes",
    with_(CELLS_SQL, then='SELECT CASE WHEN cls - 3 BETWEEN 0 AND 7 THEN cls - 3 END AS slope_class, count(*) AS cells FROM cells GROUP BY 1'),
)
def slope_classes(t):
    return t.cells().groupBy(C.slope_class(F.col("cls") - 3).alias("slope_class")).agg(F.count(F.lit(1)).alias("cells"))


@query(
    "wide_bands",
    """SELECT l_orderkey AS run_id, CAST(l_partkey // 50 AS INTEGER) AS "row", CAST(l_partkey % 50 AS INTEGER) AS col, """
    + ", ".join(f"max(CASE WHEN l_linenumber = {k} AND l_returnflag <> 'R' THEN l_quantity END) AS b{k}" for k in range(1, 8))
    + " FROM lineitem GROUP BY 1, 2, 3",
)
def wide_bands(t):
    """Long cells (run, band, row, col) to one row per cell."""
    li = t.raw("lineitem")
    cells = li.select(
        F.col("l_orderkey").alias("run_id"), F.concat(F.lit("b"), "l_linenumber").alias("band"), F.floor(F.col("l_partkey") / 50).cast("int").alias("row"), (F.col("l_partkey") % 50).cast("int").alias("col"),
        F.col("l_quantity").alias("value"), (F.col("l_returnflag") == "R").alias("is_masked"),
    )
    return Z.bands_wide(cells, [f"b{k}" for k in range(1, 8)])


COMPOSITE_ROWS = COMPOSITE_SQL[: COMPOSITE_SQL.rindex("SELECT area_id, profile, round(mean")]


@query(
    "composite_violations",
    COMPOSITE_ROWS
    + """SELECT rule, count(*) AS rows FROM (SELECT CASE WHEN NOT area_id LIKE 'area-1%' THEN 'area_id_prefix' END AS rule FROM full_ UNION ALL SELECT CASE WHEN valid > total - 5 THEN 'pixel_counts' END FROM full_) v WHERE rule IS NOT NULL GROUP BY 1""",
)
def composite_violations(t):
    """Profile and evidence rules over the composite, with the eligible pixels understated by five."""
    rows = composite_evidence(t)
    short = rows.withColumn("total_eligible_pixel_count", F.col("total_eligible_pixel_count") - 5)
    profile = Q.check_rows(short, Q.profile_rules(), ["area_id", "profile"])
    quality = rows.select(
        "area_id", F.col("spatial_coverage_pct").alias("coverage_pct"), F.col("valid_spatial_pixel_count").alias("valid_observation_pixel_count"), F.col("total_eligible_pixel_count").alias("candidate_observation_pixel_count"),
        "usable_acquisition_count", "candidate_acquisition_count", C.tier_quality(F.col("evidence_tier")).alias("quality_status"),
    )
    evidence = Q.check_rows(quality, Q.composite_rules("area-1"), ["area_id"]).select("rule")
    return profile.select("rule").unionByName(evidence).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))
