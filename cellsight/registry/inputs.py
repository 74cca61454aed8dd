"""The library's inputs, derived from the given tables; every derivation also exists as SQL.

evidence = lineitem (run = order, area = supplier), runs = orders, areas = supplier with a polygon
over the grid, cells = part or lineitem by part, roads = customer, scenes = events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsight.functions.geometry import ring_from_xy
from cellsight.operators.zonal import Grid

GRID_WIDTH = 50
GRID = Grid(0.0, 0.0, 1.0, 1.0, GRID_WIDTH, 1_000_000_000)

# Order priority and status to indicator and run status.
INDICATORS = {"1-URGENT": "rainfall", "2-HIGH": "ndvi", "3-MEDIUM": "swi", "4-NOT SPECIFIED": "lst", "5-LOW": "wapor"}
STATUSES = {"F": "development", "O": "degraded", "P": "validated"}

# Polygon shapes as rings of (column, row) offsets: box, triangle, concave L, box with a hole, two boxes.
SHAPES = (
    (((0, 0), (6, 0), (6, 5), (0, 5), (0, 0)),),
    (((0, 0), (7, 0), (0, 6), (0, 0)),),
    (((0, 0), (6, 0), (6, 2), (3, 2), (3, 6), (0, 6), (0, 0)),),
    (((0, 0), (7, 0), (7, 6), (0, 6), (0, 0)), ((2, 2), (4, 2), (4, 4), (2, 4), (2, 2))),
    (((0, 0), (3, 0), (3, 3), (0, 3), (0, 0)), ((4, 2), (7, 2), (7, 6), (4, 6), (4, 2))),
)
HOLED, TWO_PARTS = 3, 4
CROSSED = (((0, 0), (5, 5), (5, 0), (0, 5), (0, 0)),)
FAULTY = (
    CROSSED,
    (((0, 0), (4, 0), (4, 4), (2, 4), (2, 6), (2, 4), (0, 4), (0, 0)),),  # a spike
    (((0, 0), (4, 0), (2, 2), (4, 4), (0, 4), (2, 2), (0, 0)),),  # touches itself
    (((0, 0), (6, 0), (6, 4), (4, 4), (4, 0), (2, 0), (2, 4), (0, 4), (0, 0)),),  # runs back along its own edge
    (((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))),  # a ring twice
    (((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), ((2, 2), (6, 2), (6, 3), (2, 3), (2, 2))),  # one ring crosses the other
)


def _pick(column: Column, table: dict[str, str]) -> Column:
    ladder = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, value in table.items():
        ladder = ladder.when(column == key, value)
    return ladder


def shape_rings(index: Column, x0: Column, y0: Column, shapes=SHAPES) -> Column:
    """Rings of the indexed shape, moved to (x0, y0)."""
    point = lambda p: f"named_struct('x', {p[0]}D, 'y', {p[1]}D)"
    array = lambda parts: "array(" + ", ".join(parts) + ")"
    literal = array(array(array(point(p) for p in ring) for ring in rings) for rings in shapes)
    moved = lambda p: F.struct((p["x"] + x0).alias("x"), (p["y"] + y0).alias("y"))
    return F.transform(F.get(F.expr(literal), index.cast("int")), lambda ring: F.transform(ring, moved))


class Tables:
    """Derived tables of one data folder."""

    _schemas: dict[str, object] = {}

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        """The schema of a file is read once, not by a footer job per query."""
        path = f"{self.folder}/{name}.parquet"
        if path not in self._schemas:
            self._schemas[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schemas[path]).parquet(path)

    def parts(self, name: str) -> int:
        """Tasks for a shuffle of a table's rows: sixteen for each split of its scan, so a task's share stays the same as the table grows."""
        return max(16 * self.raw(name).rdd.getNumPartitions(), int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def evidence(self) -> DataFrame:
        li = self.raw("lineitem")
        return li.select(
            F.concat(F.lit("run-"), "l_orderkey").alias("run_id"),
            F.concat(F.lit("area-"), "l_suppkey").alias("area_id"),
            F.when(~((F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "R")), F.col("l_quantity")).alias("value"),
            (F.lit(100.0) - 2 * F.round(F.col("l_discount") * 100)).alias("coverage_pct"),
            F.when(F.col("l_returnflag") == "R", "insufficient_grid_coverage").otherwise("ok").alias("quality_status"),
        )

    def runs(self) -> DataFrame:
        o = self.raw("orders")
        pilot = F.when(F.col("o_custkey") % 3 == 1, "Baseline pilot only; for review").otherwise("routine")
        return o.select(
            F.concat(F.lit("run-"), "o_orderkey").alias("run_id"),
            _pick(F.col("o_orderpriority"), INDICATORS).alias("indicator"),
            F.col("o_orderdate").alias("obs_end"),
            F.dateadd(F.to_date("o_orderdate"), (F.col("o_orderkey") % 30).cast("int")).cast("timestamp").alias("created_at"),
            _pick(F.col("o_orderstatus"), STATUSES).alias("status"),
            (F.col("o_custkey") % 3 == 0).alias("candidate_only"),
            pilot.alias("notes"),
            F.trunc("o_orderdate", "month").alias("source_latest_month"),
            F.sequence(F.lit(1), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("season_months"),
            F.when(F.col("o_custkey") % 10 == 0, "areas-v0").otherwise("areas-v1").alias("boundary_set_version"),
        )

    def areas(self) -> DataFrame:
        s = self.raw("supplier")
        key = F.col("s_suppkey")
        x0, y0 = (key % 10) * 5, F.floor(key / 10) * 4
        return s.select(
            F.concat(F.lit("area-"), key).alias("area_id"),
            key.alias("area_key"),
            F.col("s_name").alias("name_en"),
            F.concat(F.lit("NATION_"), "s_nationkey").alias("district_en"),
            F.col("s_nationkey").alias("district_key"),
            F.when(key % 41 != 0, F.concat(F.lit("K"), key % 37)).alias("source_key"),
            shape_rings(F.when(key % 8 == 5, TWO_PARTS).otherwise(key % 4), x0, y0).alias("rings"),
        )

    def cells(self) -> DataFrame:
        """One cell per part: value, class."""
        p = self.raw("part")
        return p.select(
            F.floor(F.col("p_partkey") / GRID_WIDTH).cast("int").alias("row"),
            (F.col("p_partkey") % GRID_WIDTH).cast("int").alias("col"),
            F.col("p_retailprice").alias("value"),
            F.col("p_size").alias("cls"),
        )

    def band_cells(self) -> DataFrame:
        """Dated multi-band cells: one per order line, placed by part."""
        li = self.raw("lineitem")
        return li.select(
            F.floor(F.col("l_partkey") / GRID_WIDTH).cast("int").alias("row"),
            (F.col("l_partkey") % GRID_WIDTH).cast("int").alias("col"),
            F.year("l_shipdate").alias("year"),
            F.month("l_shipdate").alias("month"),
            F.col("l_quantity").alias("value"),
            (F.col("l_quantity") * 5).cast("int").alias("raw"),
            (F.col("l_linenumber") % 2).alias("qflag"),
            F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("data_mask"),
            F.col("l_linenumber").alias("line"),
        )

    def roads(self) -> DataFrame:
        c = self.raw("customer")
        n = F.col("c_custkey")
        x1, y1 = (n * 7) % 50 + 0.25, F.floor(n * 4 / 150) + 0.25
        return c.select(
            F.concat(F.lit("line-"), n).alias("line_id"),
            F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("owner"),
            x1.alias("x1"),
            y1.alias("y1"),
            (x1 + n % 3 + 0.5).alias("x2"),
            (y1 + n % 2 + 0.5).alias("y2"),
        )

    def road_features(self) -> DataFrame:
        r = self.roads()
        return r.select("line_id", F.array(ring_from_xy((F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2")))).alias("rings"))

    def scenes(self) -> DataFrame:
        e = self.raw("events")
        k = F.get_json_object("props", "$.k").cast("int")
        qa = F.when(k % 4 == 0, (k * 3) % 256).when(k % 4 == 1, 4).otherwise(0)
        day = F.to_date("ts")
        return e.select(
            F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("-"), "event_type").alias("scene_id"),
            (day.cast("timestamp") + F.expr("INTERVAL 10 HOURS 30 MINUTES")).alias("acquired_at"),
            F.concat(F.lit("area-"), F.col("user_id") % 10).alias("area_id"),
            F.col("user_id").cast("int").alias("row"),
            F.lit(0).alias("col"),
            (1000 + F.col("value") * 20).alias("nir"),
            (500 + k * 15).cast("double").alias("swir"),
            qa.cast("short").alias("qa"),
            (k % 8).alias("scl"),
            F.when(F.col("event_type") == "error", 0).otherwise(1).alias("data_mask"),
        )


# ---- the same derivations for the SQL side

EVIDENCE_SQL = """evidence AS (
  SELECT 'run-' || l_orderkey AS run_id, 'area-' || l_suppkey AS area_id,
         CASE WHEN NOT (l_linenumber = 7 AND l_returnflag = 'R') THEN l_quantity END AS value,
         100.0::DOUBLE - 2 * round(l_discount * 100) AS coverage_pct,
         CASE WHEN l_returnflag = 'R' THEN 'insufficient_grid_coverage' ELSE 'ok' END AS quality_status
  FROM lineitem)"""

RUNS_SQL = """runs AS (
  SELECT 'run-' || o_orderkey AS run_id,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'rainfall' WHEN '2-HIGH' THEN 'ndvi' WHEN '3-MEDIUM' THEN 'swi'
              WHEN '4-NOT SPECIFIED' THEN 'lst' WHEN '5-LOW' THEN 'wapor' END AS indicator,
         o_orderdate AS obs_end, o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)) AS created_at,
         CASE o_orderstatus WHEN 'F' THEN 'development' WHEN 'O' THEN 'degraded' WHEN 'P' THEN 'validated' END AS status,
         o_custkey % 3 = 0 AS candidate_only,
         CASE WHEN o_custkey % 3 = 1 THEN 'Baseline pilot only; for review' ELSE 'routine' END AS notes,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS source_latest_month, o_orderkey % 3 + 1 AS season_size,
         CASE WHEN o_custkey % 10 = 0 THEN 'areas-v0' ELSE 'areas-v1' END AS boundary_set_version
  FROM orders)"""

AREAS_SQL = """areas AS (
  SELECT 'area-' || s_suppkey AS area_id, s_suppkey AS area_key, s_name AS name_en, 'NATION_' || s_nationkey AS district_en,
         s_nationkey AS district_key, CASE WHEN s_suppkey % 41 <> 0 THEN 'K' || (s_suppkey % 37) END AS source_key,
         CASE WHEN s_suppkey % 8 = 5 THEN 4 ELSE s_suppkey % 4 END AS shape, (s_suppkey % 10) * 5 AS x0, (s_suppkey // 10) * 4 AS y0
  FROM supplier)"""


def _edge_values(shapes) -> str:
    rows = []
    for s, rings in enumerate(shapes):
        for r, ring in enumerate(rings):
            for q, ((ax, ay), (bx, by)) in enumerate(zip(ring, ring[1:])):
                rows.append(f"({s},{r},{q},{ax},{ay},{bx},{by})")
    return ", ".join(rows)


EDGES_SQL = f"""edges AS (
  SELECT area_id, area_key, ring, seq, CASE WHEN s = {HOLED} AND ring = 1 THEN 1 ELSE 0 END AS hole, (x0 + px)::DOUBLE AS x1, (y0 + py)::DOUBLE AS y1, (x0 + qx)::DOUBLE AS x2, (y0 + qy)::DOUBLE AS y2
  FROM areas JOIN (VALUES {_edge_values(SHAPES)}) AS shapes(s, ring, seq, px, py, qx, qy) ON s = shape)"""

CELLS_SQL = """cells AS (
  SELECT CAST(p_partkey // 50 AS INTEGER) AS "row", CAST(p_partkey % 50 AS INTEGER) AS col, p_retailprice AS value, p_size AS cls FROM part)"""

BAND_CELLS_SQL = """band_cells AS (
  SELECT CAST(l_partkey // 50 AS INTEGER) AS "row", CAST(l_partkey % 50 AS INTEGER) AS col, year(l_shipdate) AS "year", month(l_shipdate) AS "month",
         l_quantity AS value, CAST(l_quantity * 5 AS INTEGER) AS raw, l_linenumber % 2 AS qflag,
         CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS data_mask, l_linenumber AS line
  FROM lineitem)"""

# Even-odd test of every grid cell centre against every edge: the plain definition.
INSIDE_SQL = """grid AS (SELECT DISTINCT "row", col FROM cells),
inside AS (
  SELECT area_id, "row", col FROM grid JOIN edges
    ON y1 <> y2 AND least(y1, y2) <= "row" + 0.5 AND "row" + 0.5 < greatest(y1, y2)
   AND x1 + ("row" + 0.5 - y1) * ((x2 - x1) / (y2 - y1)) > col + 0.5
  GROUP BY area_id, "row", col HAVING count(*) % 2 = 1)"""

ROADS_SQL = """roads AS (
  SELECT 'line-' || c_custkey AS line_id, ' ' || lower(c_mktsegment) AS owner,
         (c_custkey * 7) % 50 + 0.25::DOUBLE AS x1, (c_custkey * 4) // 150 + 0.25::DOUBLE AS y1,
         (c_custkey * 7) % 50 + 0.25::DOUBLE + c_custkey % 3 + 0.5 AS x2, (c_custkey * 4) // 150 + 0.25::DOUBLE + c_custkey % 2 + 0.5 AS y2
  FROM customer)"""

SCENES_SQL = """scenes AS (
  SELECT strftime(ts, '%Y-%m-%d') || '-' || event_type AS scene_id, date_trunc('day', ts) + INTERVAL 630 MINUTE AS acquired_at,
         'area-' || (user_id % 10) AS area_id, CAST(user_id AS INTEGER) AS "row", 0 AS col, 1000 + value * 20 AS nir,
         CAST(500 + k * 15 AS DOUBLE) AS swir, CASE WHEN k % 4 = 0 THEN (k * 3) % 256 WHEN k % 4 = 1 THEN 4 ELSE 0 END AS qa,
         k % 8 AS scl, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS data_mask
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INTEGER) AS k FROM events) e)"""


def with_(*parts: str, then: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + then


def pyround(column: str, digits: int) -> str:
    """SQL text of the exact half-even rounding for a plain column name (same arithmetic as in Spark)."""
    s = f"CAST({10 ** digits} AS DOUBLE)"
    k = "CAST(134217729 AS DOUBLE)"
    x = f"CAST({column} AS DOUBLE)"
    p = f"({x} * {s})"
    h = f"({x} * {k} - ({x} * {k} - {x}))"
    e = f"(({h} * {s} - {p}) + ({x} - {h}) * {s})"
    d = f"({p} - floor({p}))"
    up = f"({d} > 0.5 OR ({d} = 0.5 AND ({e} > 0 OR ({e} = 0 AND floor({p}) % 2 <> 0))))"
    return f"((floor({p}) + CASE WHEN {up} THEN 1.0 ELSE 0.0 END) / {s})"
