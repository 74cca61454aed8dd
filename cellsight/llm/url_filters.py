"""URL filters by a sort-merge range join.

The canonical key of a host is its labels in reverse, each closed by a dot, so a rule on a host and its subdomains
is the interval of the keys that begin with the rule's key. Rules and pages are sorted together; sweeping down, the
latest rule start of each label depth is the stack of rules that may still be open, and those whose key begins the
page's key are open. The sorted rows are cut into even chunks, also inside one host; each chunk inherits the stack
of the chunks before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellsight.llm.common import stored

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lowered; path from there up to ``?`` or ``#``. Both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    return F.when(host != "", F.concat(F.array_join(F.reverse(F.split(host, "[.]", -1)), "."), F.lit("."))).otherwise("")


def rules_table(spark: SparkSession, rules) -> DataFrame:
    """(verdict, host, path) tuples as a table."""
    text = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if not rules:
        return spark.sql("SELECT '' AS verdict, '' AS host, '' AS path WHERE false")
    return spark.sql("SELECT * FROM VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rules) + " AS r(verdict, host, path)")


def apply_rules(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``; the longest fitting rule wins.

    Null urls and urls without ``://`` have an empty host, which no rule fits. Repeated rows are judged one by one;
    of two rules with the same host and path the alphabetically last verdict wins. Columns of ``pages`` with the
    names of the results are replaced. The rules may be a large table; the list of their label depths is collected
    (a host has at most 127 labels), and the path rules of one host travel together.
    """
    host, path = host_and_path(F.col(url))
    pages = pages.withColumns({"host": host, "path": path})
    names = pages.columns
    entry = F.struct(F.length(F.concat("host", "path")).alias("n"), F.concat("host", "path").alias("rule"), "verdict", "path")
    starts = rules.groupBy("host").agg(F.collect_list(entry).alias("_rules")).select(key_of(F.col("host")).alias("_key"), F.size(F.split("host", "[.]", -1)).alias("_depth"), "_rules")
    depths = sorted(r[0] for r in starts.select("_depth").distinct().collect())
    if not depths:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    row = pages.select(key_of(F.col("host")).alias("_key"), F.struct(*names).alias("_page"), F.xxhash64(url).alias("_tie"))
    both = starts.withColumns({"_page": F.lit(None).cast(row.schema["_page"].dataType), "_tie": F.lit(0).cast("long"), "_kind": F.lit(0)})
    both = both.unionByName(row.withColumns({"_depth": F.lit(None).cast("int"), "_rules": F.lit(None).cast(starts.schema["_rules"].dataType), "_kind": F.lit(1)}))
    order = ["_key", "_kind", "_tie", "_salt"]
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.withColumn("_salt", F.when(F.col("_kind") == 1, F.xxhash64("_page")))
    chunks = stored(both.repartitionByRange(n, *order).withColumn("_chunk", F.spark_partition_id()), "sweep")
    start = lambda d: F.when((F.col("_kind") == 0) & (F.col("_depth") == d), F.struct("_key", "_rules"))
    ends = chunks.groupBy("_chunk").agg(*[F.max_by(start(d), F.when(start(d).isNotNull(), F.col("_key"))).alias(f"_end{d}") for d in depths])
    before = W.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)  # one row per chunk
    carried = ends.select("_chunk", *[F.last(f"_end{d}", ignorenulls=True).over(before).alias(f"_carry{d}") for d in depths])
    sweep = W.partitionBy("_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = chunks.select("*", *[F.last(start(d), ignorenulls=True).over(sweep).alias(f"_open{d}") for d in depths]).filter("_kind = 1").join(carried, "_chunk")
    stack = [F.coalesce(f"_open{d}", f"_carry{d}") for d in depths]
    open_rules = [F.when(F.col("_key").startswith(s["_key"]), s["_rules"]) for s in stack]
    fitting = F.concat(*[F.filter(F.coalesce(r, F.array().cast(starts.schema["_rules"].dataType)), lambda x: F.col("_page.path").startswith(x["path"])) for r in open_rules])
    best = swept.withColumn("_best", F.array_max(fitting))
    return best.select(*[F.col(f"_page.`{c}`").alias(c) for c in names if c not in ("rule", "verdict")], F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return apply_rules(pages, rules_table(spark, RULES)).drop("url")


SQL = f"""WITH r(verdict, host, path) AS (VALUES {", ".join(map(str, RULES))}),
q AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT rid, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM q),
f AS (SELECT p.rid, p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.rid ORDER BY length(r.host || r.path) DESC) AS k
      FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM f WHERE k = 1"""
