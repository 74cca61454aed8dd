"""The yearly queries report every year that has cells, also years outside the listed frame."""

import pytest
from compare import canonical, duck
from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cellsight.registry import raster

YEARLY = ["ndvi_zonal_stats", "swi_zonal_stats", "wapor_paired_stats", "seasonal_depth", "seasonal_depth_strict"]


@pytest.mark.parametrize("name", YEARLY)
def test_no_area_and_year_of_the_cells_is_missing(spark, tables, name):
    rows = [(r.area_id, r.year) for r in entry.queries()[name](spark, SMALL).select("area_id", "year").collect()]
    cells = {(r.area_id, r.year) for r in raster.band_pairs(tables).select("area_id", "year").distinct().collect()}
    assert {y for _, y in cells} - set(raster.YEARS) and cells <= set(rows)
    assert len(rows) == len(set(rows))


@pytest.mark.parametrize("name", YEARLY)
def test_rows_of_the_listed_years_equal_sql(spark, name):
    out = entry.queries()[name](spark, SMALL).where(F.col("year").isin(list(raster.YEARS)))
    found = duck(SMALL).execute(f'SELECT * FROM ({entry.oracle_sql()[name]}) WHERE "year" BETWEEN {min(raster.YEARS)} AND {max(raster.YEARS)}')
    names = [d[0] for d in found.description]
    close = lambda rows: [tuple(pytest.approx(v, rel=1e-8, abs=1e-9) if isinstance(v, float) else v for v in r) for r in rows]
    got, want = canonical(out.columns, [tuple(r) for r in out.collect()]), canonical(names, found.fetchall())
    assert got == close(want)


def test_figures_of_a_late_year(spark, tables):
    """Counts of 2001 by plain Python over the pairs."""
    want = {}
    for r in raster.band_pairs(tables).where("year = 2001").select("area_id", "data_mask").collect():
        valid, cells = want.get(r.area_id, (0, 0))
        want[r.area_id] = (valid + r.data_mask, cells + 1)
    rows = entry.queries()["ndvi_zonal_stats"](spark, SMALL).where("year = 2001").collect()
    assert want and {r.area_id: (r.valid_pixel_count, r.grid_cell_count) for r in rows if r.grid_cell_count} == want
