"""Plans: no cross joins, no Python in the hot path, no whole table in one window task, pushed filters."""

import re

import pytest
from conftest import SMALL

import __spark_entry__ as entry
from cellsight import registry
from cellsight.operators import ranking as R
from cellsight.operators import zonal as Z

PYTHON_OK = {"index_names", "normalised_names", "scored_search"}  # name decomposition
QUERIES = {n: q for n, q in entry.queries().items() if n in registry.QUERIES and not n.startswith("stream")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON_OK:
        assert "EvalPython" not in text and "InPandas" not in text


def test_scaled_rank_windows_over_the_histogram_only(spark, tables):
    text = plan(R.ntile(tables.raw("customer"), 10, "c_acctbal", "c_custkey", "d"))
    single = [line for line in text.splitlines() if re.search(r"Exchange SinglePartition", line)]
    rows = plan(tables.raw("customer"))
    assert len(single) == 1 and "c_custkey" not in single[0] and rows
    for line in text.splitlines():
        if re.search(r"\+- Window|: +Window|^Window", line) and "c_custkey" in line:
            assert "_sub" in line  # the row-level window is partitioned by value and md5 prefix


def test_window_scan_reaches_parquet(spark, tmp_path):
    cells = spark.range(1000).selectExpr("cast(id / 50 as int) as row", "cast(id % 50 as int) as col", "id * 1.0 as value", "id as other")
    cells.write.parquet(str(tmp_path / "cells"))
    grid = Z.Grid(0.0, 0.0, 1.0, 1.0, 50, 20)
    text = plan(Z.window_scan(spark.read.parquet(str(tmp_path / "cells")), grid, (10, 5, 20, 8)).select("row", "col", "value"))
    assert "GreaterThanOrEqual(row,5)" in text and "ReadSchema: struct<row:int,col:int,value:decimal" in text and "other" not in text.split("ReadSchema")[1]


def test_observed_condition_reads_the_lines_once(spark, tables):
    text = plan(QUERIES["observed_rainfall_condition"](spark, SMALL))
    scans = set(re.findall(r"lineitem.parquet\]", text))
    assert scans and "l_extendedprice" not in text and "l_comment" not in text


def test_leave_own_year_out_gathers_no_reference(spark):
    text = plan(QUERIES["leave_own_year_out"](spark, SMALL))
    assert "collect_list" not in text and "collect_set" not in text


def test_nearest_in_time_has_no_window_over_all_slices(spark):
    text = plan(QUERIES["nearest_in_time"](spark, SMALL))
    alone = [i for i, line in enumerate(text.splitlines()) if "Exchange SinglePartition" in line]
    below = [next(line for line in text.splitlines()[i + 1 :] if "Aggregate" in line) for i in alone]
    assert below and all("=[_g#" in line for line in below)


def test_set_differences_is_one_aggregation(spark):
    """four distincts and two exceptAll held their tables in the same task."""
    text = plan(QUERIES["set_differences"](spark, SMALL))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1 and "REPARTITION_BY_NUM" in text


def test_evidence_history_is_dealt_by_the_size_of_its_table(spark, tables):
    """F8: the join and the ordering took the session's few partitions however large the table."""
    text = plan(QUERIES["evidence_history"](spark, SMALL))
    parts = tables.parts("lineitem")
    assert parts >= 16 and f"hashpartitioning(run_id#" in text and len(re.findall(rf", {parts}\), REPARTITION_BY_NUM", text)) >= 3
