"""op7: targets against repeated resharing, totals, order, odd rows against the SQL twin."""

import duckdb
import pytest
from llm_cases import WORD, odd_rows, random_rows, table
from pyspark.sql import functions as F

from cellsight.llm import mixing as M


def reshared(sizes, weights=(5, 2, 1), most=3):
    """Sizes by source in rank order -> targets, by taking away excess until none is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    capped, total = set(), sum(sizes)
    while True:
        rest, open_ = total - sum(most * sizes[i] for i in capped), [i for i in range(len(sizes)) if i not in capped]
        share = {i: rest * w[i] / sum(w[k] for k in open_) for i in open_}
        over = {i for i in open_ if share[i] > most * sizes[i]}
        if not over:
            return [float(most * s) if i in capped else share[i] for i, s in enumerate(sizes)]
        capped |= over


@pytest.mark.parametrize("sizes", [[10, 1000, 1000], [1, 2, 3, 100000], [0, 5, 0], [7], [3] * 11, [1, 1000000, 5, 9, 20, 300]])
def test_targets(spark, sizes):
    got = M.targets(spark.createDataFrame([(f"a{i:02d}", s) for i, s in enumerate(sizes)], "_key string, source_size long")).orderBy("_key").collect()
    assert [r.target for r in got] == pytest.approx(reshared(sizes))


@pytest.mark.parametrize("rows", [odd_rows(), random_rows(6), []])
def test_odd_rows_equal_sql(spark, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    docs = table(spark, rows).withColumn("size", M.n_words(F.col("text")))
    got = M.plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(M.SQL).fetchall()))


def test_taken_is_near_the_target_and_positions_follow_the_schedule(spark):
    rows = random_rows(6, n=120)
    docs = table(spark, rows).withColumn("size", M.n_words(F.col("text")))
    out = M.plan_mix(docs).collect()
    for source in {r.source for r in out}:
        own = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2
    assert all(0 <= p <= 1 for r in out for p in r.positions) and all(r.taken <= 3 * r.size for r in out)


def test_position_inverts_the_integral(spark):
    grid = spark.range(101).select((F.col("id") / 100).alias("x"), F.explode(F.array(*[F.lit(s) for s in (-0.5, 0.0, 0.5, 1.0)])).alias("s"))
    for r in grid.select("x", "s", M.position(F.col("x"), F.col("s")).alias("t")).collect():
        assert r.s * r.t**2 + (1 - r.s) * r.t == pytest.approx(r.x, abs=1e-9)


def test_mix_keeps_columns_and_counts(spark):
    rows = odd_rows() + [(20 + k, f"word{k} " * (k + 1), "en", "a") for k in range(20)]
    docs = table(spark, rows)
    out = M.mix(docs)
    assert out.columns == docs.columns
    words = lambda found: sum(len(WORD.findall(r.text or "")) for r in found)
    taken = M.plan_mix(docs.withColumn("size", M.n_words(F.col("text")))).agg(F.sum("taken")).first()[0]
    assert words(out.collect()) == taken
    assert M.mix(table(spark, [])).count() == 0
