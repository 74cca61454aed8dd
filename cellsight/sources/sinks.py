"""Writers: artifacts, upserts, partition replacement, GeoJSON/JSON documents, manifests, fingerprints."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsight.functions.geometry import geojson_multipolygon, geojson_polygon, polygon_parts
from cellsight.session import shared_dir


LISTED = 1000


def write_artifact(rows: DataFrame, manifest: DataFrame, path: str) -> None:
    """CSV part files with a header, and the manifest as JSON beside them."""
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/rows")
    manifest.write.mode("overwrite").json(f"{path}/manifest")


def _staging(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/staging/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _removed(spark: SparkSession, path: str) -> None:
    """Deletes a staging folder of this module."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def replace_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replace the partitions present in ``df`` and leave all others as they are.

    Rows are rebalanced by partition first: few files per partition, and a partition that holds a third of all rows
    is still written by several tasks.
    """
    df.hint("rebalance", F.col(partition)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def merged(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """New rows, and old rows whose key is not among them."""
    return new.unionByName(old.select(*new.columns).join(new.select(*key), list(key), "left_anti"))


def upsert(new: DataFrame, path: str, key: Sequence[str], partition: str = "run_id") -> None:
    """Insert or update by key.

    Only partitions that occur in ``new`` are read: up to ``LISTED`` are named in the scan's partition filter, more
    are left to the semi-join. The merged rows are written to the shared staging folder first, so the target is never
    read and written by one job, and a lost executor or a failed job leaves the target whole.
    """
    spark = new.sparkSession
    if not exists(spark, path):
        replace_partitions(new, path, partition)
        return
    touched = new.select(partition).distinct()
    # the schema is given: a run id that looks like a date or a number must stay text
    old = spark.read.schema(new.schema).parquet(path)
    listed = [r[0] for r in touched.limit(LISTED + 1).collect()]
    old = old.join(touched, partition, "left_semi") if len(listed) > LISTED else old.where(F.col(partition).isin(listed))
    staged = _staging(spark, "upsert")
    merged(old, new, key).write.parquet(staged)
    replace_partitions(spark.read.schema(new.schema).parquet(staged), path, partition)
    _removed(spark, staged)


def insert_absent(new: DataFrame, path: str, key: Sequence[str]) -> None:
    """Append the rows whose key is not stored yet; the first copy of a key in ``new`` by all columns wins."""
    spark = new.sparkSession
    row = F.struct(*[F.col(c) for c in new.columns])
    unique = new.groupBy(*key).agg(F.min(row).alias("_row")).select("_row.*").select(*new.columns)
    if exists(spark, path):
        unique = unique.join(spark.read.schema(new.schema).parquet(path).select(*key), list(key), "left_anti")
    staged = _staging(spark, "insert")
    unique.write.parquet(staged)
    spark.read.schema(new.schema).parquet(staged).write.mode("append").parquet(path)
    _removed(spark, staged)


def update_columns(target: DataFrame, values: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Join-update: matched rows take the new values (also NULL), the others keep theirs."""
    renamed = values.select(*key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = target.join(renamed, list(key), "left")
    for c in columns:
        joined = joined.withColumn(c, F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)))
    return joined.select(*target.columns)


def features_json(df: DataFrame, ident: str, properties: Sequence[str], rings: str = "rings") -> DataFrame:
    """One GeoJSON Feature text per row, a Polygon or MultiPolygon; properties keep their order, NULLs are written out."""
    def text(geometry: Column) -> Column:
        body = F.struct(F.lit("Feature").alias("type"), F.col(ident).alias("id"), geometry.alias("geometry"), F.struct(*[F.col(p) for p in properties]).alias("properties"))
        return F.to_json(body, {"ignoreNullFields": "false"})

    parted = df.withColumn("_parts", polygon_parts(F.col(rings)))
    several = F.size("_parts") > 1
    return parted.withColumn("feature", F.when(several, text(geojson_multipolygon(F.col("_parts")))).otherwise(text(geojson_polygon(F.col("_parts"))))).drop("_parts")


def page_of(ident: Column, rows: Column, page_size: int) -> Column:
    """Page by md5 of the id, so a page holds about ``page_size`` rows whatever the group's size."""
    pages = F.greatest(F.ceil(rows / page_size), F.lit(1)).cast("long")
    return F.pmod(F.conv(F.substring(F.md5(ident.cast("string")), 1, 8), 16, 10).cast("long"), pages)


def feature_collections(groups: DataFrame, features: DataFrame, key: str, ident: str, feature: str = "feature", page_size: int = 1000) -> DataFrame:
    """FeatureCollection documents per group, paged; a group without features gets an empty one.

    A document never gathers more than about ``page_size`` features, so one group with a third of
    all features becomes many documents and not one oversized row. ``feature_total`` is the group's number of
    features, so a reader can tell whether all pages are there.
    """
    sizes = features.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    paged = features.join(sizes, key).withColumn("page", page_of(F.col(ident), F.col("_rows"), page_size))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(ident).alias("i"), F.col(feature).alias("f")))), lambda s: s["f"])
    docs = paged.groupBy(key, "page").agg(ordered.alias("_f"))
    whole = groups.select(key).join(docs, key, "left").join(sizes, key, "left")
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.coalesce(F.concat_ws(",", "_f"), F.lit("")), F.lit("]}"))
    return whole.select(key, F.coalesce("page", F.lit(0)).alias("page"), F.coalesce(F.size("_f"), F.lit(0)).alias("feature_count"), F.coalesce("_rows", F.lit(0)).alias("feature_total"), text.alias("document"))


def row_payloads(run: DataFrame, rows: DataFrame, key: str, ident: str, fields: Sequence[str], page_size: int = 1000) -> DataFrame:
    """``{run, rows[]}`` payloads per run, paged like the feature documents; ``row_total`` is the run's number of rows."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    paged = rows.join(sizes, key).withColumn("page", page_of(F.col(ident), F.col("_rows"), page_size))
    packed = paged.groupBy(key, "page").agg(F.array_sort(F.collect_list(F.struct(ident, *[f for f in fields if f != ident]))).alias("rows"))
    header = F.struct(*[F.col(c) for c in run.columns])
    joined = run.withColumn("run", header).select(key, "run").join(packed, key, "left").join(sizes, key, "left")
    body = F.struct("run", F.coalesce("rows", F.array().cast(packed.schema["rows"].dataType)).alias("rows"))
    return joined.select(key, F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("_rows", F.lit(0)).alias("row_total"), F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def write_documents(docs: DataFrame, path: str, partition: str, column: str = "document") -> None:
    """Documents as gzip text, one per line, in a folder per group."""
    docs.select(partition, F.col(column).alias("value")).write.mode("overwrite").partitionBy(partition).option("compression", "gzip").text(path)


def asset_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Size and sha256 of every file below a release folder.

    A file is one row and must be below 2 GB; larger ones are refused before any content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    large = files.select("path", "length").where(F.col("length") >= 2**31 - 1).take(1)
    if large:
        raise ValueError(f"{large[0]['path']} has {large[0]['length']} bytes; files of 2 GB or more have no manifest row")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("asset"), "path", F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"))


def text_manifest(documents: DataFrame, ident: str, text: str) -> DataFrame:
    """Size in bytes and sha256 of documents that are still rows, before they are written."""
    return documents.select(F.col(ident).alias("asset"), F.octet_length(text).alias("byte_size"), F.sha2(F.encode(text, "UTF-8"), 256).alias("sha256"))


def fingerprint(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Order-free content hash: row hashes are summed word by word, so nothing is gathered.

    Equal rows in any order and partitioning give the same text; a changed, missing or doubled
    row gives another. Four 28-bit words are summed as integers per (group, last md5 digit), and
    these few sums as decimals; an overflow (5e11 rows in one group) would raise, not wrap.
    """
    text = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])
    hashed = df.select(*keys, F.md5(text).alias("_h"))
    words = ["_w0", "_w1", "_w2", "_w3"]
    value = lambda i: F.conv(F.substring("_h", 1 + 7 * i, 7), 16, 10).cast("long")
    parts = hashed.groupBy(*keys, F.substring("_h", 32, 1).alias("_part")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(value(i)).alias(w) for i, w in enumerate(words)]
    )
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(28,0)")), F.lit(0)).cast("string")
    out = parts.groupBy(*keys).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), *[total(w).alias(w) for w in words])
    joined = F.concat_ws("|", F.col("rows").cast("string"), *words)
    return out.select(*keys, "rows", F.sha2(joined, 256).alias("fingerprint"))


def unchanged(current: DataFrame, last: DataFrame) -> bool:
    """True when the new fingerprint equals the last receipt: publishing can be skipped."""
    return not current.select("fingerprint").exceptAll(last.select("fingerprint")).take(1)
