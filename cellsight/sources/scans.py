"""Readers: stored tables, artifacts, feature collections, catalogue listings, link harvest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsight.sources import schemas


def table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A stored Parquet table; filters and columns of the caller reach the scan."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def jdbc_table(spark: SparkSession, url: str, name: str, partition_column: str, lower: str, upper: str, partitions: int, **options: str) -> DataFrame:
    """A relational table read in parallel ranges of one column."""
    return spark.read.jdbc(url, name, column=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=options)


def artifact(spark: SparkSession, rows_path: str, manifest_path: str, schema: str = schemas.RAINFALL_ARTIFACT) -> DataFrame:
    """CSV rows with the run id and status of their own manifest; empty text is NULL.

    Both paths may name one run or, as patterns, many. Rows and manifest belong together by the run's folder: that of
    the file itself, or the one above where the files lie in ``rows`` and ``manifest``. Rows without a manifest keep
    NULL ids; several manifests in one folder give the last one by (run_id, status).
    """
    run_folder = F.regexp_replace(F.col("_metadata.file_path"), "(/(rows|manifest))?/[^/]*$", "")
    rows = spark.read.schema(schema).option("header", True).option("nullValue", "").csv(rows_path)
    rows = rows.select("*", run_folder.alias("_folder"))
    manifest = spark.read.option("multiLine", True).schema("run_id string, status string").json(manifest_path).select("*", run_folder.alias("_folder"))
    one = manifest.groupBy("_folder").agg(F.max(F.struct("run_id", "status")).alias("_run"))
    return rows.join(one, "_folder", "left").withColumn("run_id", F.col("_run.run_id")).withColumn("run_status", F.col("_run.status")).drop("_folder", "_run")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Whole manifest documents as text, for member checks."""
    return spark.read.option("wholetext", True).text(path).withColumnRenamed("value", "manifest")


def feature_id(feature: Column, properties: Column, geometry: Column) -> Column:
    """Own id, else the property, else the first 16 digits of the geometry's sha1."""
    return F.coalesce(F.nullif(feature, F.lit("")), F.nullif(F.get_json_object(properties, "$.id"), F.lit("")), F.substring(F.sha1(geometry), 1, 16))


def feature_collections(spark: SparkSession, path: str) -> DataFrame:
    """(source, feature_id, geometry, properties) from GeoJSON files, geometry and properties as JSON."""
    raw = spark.read.option("multiLine", True).schema(schemas.GEOJSON).json(path)
    rows = raw.select(F.input_file_name().alias("source"), F.explode("features").alias("f"))
    return rows.select(
        "source",
        feature_id(F.col("f.id"), F.col("f.properties"), F.col("f.geometry")).alias("feature_id"),
        F.col("f.geometry").alias("geometry"),
        F.col("f.properties").alias("properties"),
    )


def polygon_rings(geometry: Column) -> Column:
    """Rings of a GeoJSON Polygon or MultiPolygon text; parts and holes follow from how the rings lie in one another."""
    to_ring = lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    single = F.from_json(F.get_json_object(geometry, "$.coordinates"), "array<array<array<double>>>")
    multi = F.from_json(F.get_json_object(geometry, "$.coordinates"), "array<array<array<array<double>>>>")
    return F.when(F.get_json_object(geometry, "$.type") == "Polygon", F.transform(single, to_ring)).otherwise(F.transform(F.flatten(multi), to_ring))


def listing_matches(pages: DataFrame, ident: str, text: str, pattern: str, names: list[str]) -> DataFrame:
    """Every match of a listing pattern, its groups as integer columns; whole texts are searched."""
    groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)) for i in range(len(names))]
    zipped = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, names)])
    rows = pages.select(ident, F.explode(zipped).alias("m"))
    return rows.select(ident, *[F.col("m").getField(n).cast("int").alias(n) for n in names])


# Fixed value: file name pattern of the pentad listing.
PENTAD_FILE = r"chirps-v3\.0\.(\d{4})\.(\d{2})\.([1-6])\.tif"


def pentad_listing(pages: DataFrame, ident: str, text: str) -> DataFrame:
    return listing_matches(pages, ident, text, PENTAD_FILE, ["year", "month", "pentad"]).distinct()


# Fixed value: three-month season labels of an outlook catalogue page.
SEASON_LABEL = r"\b((?:JFM|FMA|MAM|AMJ|MJJ|JJA|JAS|ASO|SON|OND|NDJ|DJF)\s*-\s*20\d{2})\b"


def season_labels(pages: DataFrame, ident: str, text: str) -> DataFrame:
    """Distinct season labels named on a page."""
    found = pages.select(ident, F.explode(F.regexp_extract_all(text, F.lit(SEASON_LABEL), F.lit(1))).alias("season_label"))
    return found.distinct()


def catalogue_items(documents: DataFrame, body: str = "body") -> DataFrame:
    """Items of search responses: stamp is datetime, else end, else start; one row per id."""
    parsed = documents.select(F.explode(F.from_json(body, f"features array<struct<{schemas.CATALOGUE_ITEM}>>")["features"]).alias("i"))
    p = "i.properties"
    stamp = F.coalesce(*[F.nullif(F.col(f"{p}.{c}"), F.lit("")) for c in ("datetime", "end_datetime", "start_datetime")])
    items = parsed.select(F.col("i.id").alias("item_id"), F.col("i.collection").alias("collection"), stamp.try_cast("timestamp").alias("stamp"))
    # min keeps the choice among copies the same on every run
    return items.where("item_id IS NOT NULL").groupBy("item_id").agg(F.min("collection").alias("collection"), F.min("stamp").alias("stamp"))


# Fixed value: attributes that carry links.
LINK_ATTRIBUTE = r"""(?i)\s(?:href|button-url|src)\s*=\s*(?:"([^"]+)"|'([^']+)')"""


START_TAG = r"<[a-zA-Z][^>]*>"
COMMENT = r"(?s)<!--.*?-->"
RAW_TEXT = ("script", "style")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def _unescape(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def absolute_url(base: Column, link: Column) -> Column:
    """Join a link to its page: full link, protocol-relative, host-absolute, query/fragment, or relative."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    host = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(page.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*$"), F.concat(page, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
    return (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(host, link))
        .when(link.startswith("?"), F.concat(page, link))
        .when(link.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), link))
        .otherwise(F.concat(folder, link))
    )


def harvest_links(pages: DataFrame, ident: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page, url, position) of every distinct link in order of first appearance, over whole pages."""
    markup = F.regexp_replace(html, COMMENT, "")
    for element in RAW_TEXT:
        markup = F.regexp_replace(markup, rf"(?is)<{element}\b([^>]*)>.*?</{element}\s*>", f"<{element}$1>")
    tags = F.array_join(F.regexp_extract_all(markup, F.lit(START_TAG), F.lit(0)), "\n")
    double, single = (F.regexp_extract_all(tags, F.lit(LINK_ATTRIBUTE), F.lit(i)) for i in (1, 2))
    links = F.zip_with(double, single, lambda d, s: F.when(F.length(d) > 0, d).otherwise(s))
    rows = pages.select(ident, F.col(url).alias("_base"), F.posexplode(links).alias("position", "raw"))
    rows = rows.withColumn("link", _unescape(F.col("raw")))
    full = rows.select(ident, "position", absolute_url(F.col("_base"), F.col("link")).alias("link_url"))
    return full.groupBy(ident, "link_url").agg(F.min("position").alias("position"))


# Publication path and data file endings.
PUBLICATION = r"(?i)/ethiopia-(?:acute-)?food-insecurity-classification-"
DATA_FILE = r"(?i)\.(geojson|json|zip|kml)$"


def publications(links: DataFrame) -> DataFrame:
    return links.where(F.col("link_url").rlike(PUBLICATION))


def data_files(links: DataFrame) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("link_url", r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    return links.where(path.rlike(DATA_FILE))


def remaining(areas: DataFrame, done: DataFrame, key: str = "area_id") -> DataFrame:
    """Areas a resumed job still has to process."""
    return areas.join(done.select(key).distinct(), key, "left_anti")


def checkpoint_problems(done: DataFrame, areas: DataFrame, key: str = "area_id") -> DataFrame:
    """Duplicate and foreign ids in a partial result; a resume is refused unless this is empty."""
    counted = done.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    twice = counted.where("_n > 1").select(key, F.lit("duplicate").alias("problem"))
    foreign = counted.join(areas.select(key), key, "left_anti").select(key, F.lit("unexpected").alias("problem"))
    return twice.unionByName(foreign)
