"""Vector layer audit: inventory, bounds flags, CRS resolution, gold or quarantine, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsight.functions import geometry as G
from cellsight.functions.numeric import finite
from cellsight.functions.text import epsg_code

ABSURD = 1e8
BOX = ("xmin", "ymin", "xmax", "ymax")


def layer_inventory(features: DataFrame) -> DataFrame:
    """Count, geometry types, CRS, bounds, Z flag and attribute names per layer.

    ``features`` has (layer, feature_id, geom_type, crs, rings, attrs[, has_z]). Types and
    attribute names are sets of a few members; everything else is a partial aggregate, so a layer
    that holds a third of all features is reduced before the shuffle. The Z flag is true if any
    feature of the layer has a third coordinate.
    """
    box = G.envelope(F.col("rings"))
    boxed = features.withColumn("_b", box)
    out = boxed.groupBy("layer").agg(
        F.count(F.lit(1)).alias("feature_count"),
        F.concat_ws("|", F.array_sort(F.collect_set("geom_type"))).alias("geom_types"),
        F.max("crs").alias("crs"),
        *[(F.min if c.endswith("min") else F.max)(f"_b.{c}").alias(c) for c in BOX],
        F.avg(F.coalesce(F.size(F.flatten("rings")) <= 0, F.lit(True)).cast("double")).alias("empty_geom_ratio"),
        *([F.bool_or("has_z").alias("has_z")] if "has_z" in features.columns else []),
    )
    if "attrs" in features.columns:
        names = features.select("layer", F.explode(F.map_keys("attrs")).alias("name")).distinct()
        out = out.join(names.groupBy("layer").agg(F.array_sort(F.collect_list("name")).alias("fields")), "layer", "left")
    return out


def field_rows(features: DataFrame) -> DataFrame:
    """One row per layer and attribute with its inferred type."""
    entries = features.select("layer", F.explode("attrs").alias("field_name", "v"))
    kinds = entries.groupBy("layer", "field_name").agg(
        F.count_if(F.col("v").isNotNull()).alias("present"),
        F.count_if(F.col("v").rlike(r"^-?\d+$")).alias("ints"),
        F.count_if(F.col("v").rlike(r"^-?\d*\.?\d+([eE][-+]?\d+)?$")).alias("reals"),
    )
    kind = F.when(F.col("present") == 0, "String").when(F.col("ints") == F.col("present"), "Integer").when(F.col("reals") == F.col("present"), "Real").otherwise("String")
    return kinds.select("layer", "field_name", kind.alias("field_type"))


def _no_box() -> Column:
    missing = F.lit(True)
    for c in BOX:
        missing = missing & F.col(c).isNull()
    return missing


def _nonfinite() -> Column:
    bad = F.lit(False)
    for c in BOX:
        bad = bad | ~finite(F.col(c))
    return bad


def _within(x: float = 180, y: float = 90) -> Column:
    return (F.col("xmin") >= -x) & (F.col("xmax") <= x) & (F.col("ymin") >= -y) & (F.col("ymax") <= y)


def _absurd() -> Column:
    big = F.lit(False)
    for c in BOX:
        big = big | (F.abs(F.col(c)) > ABSURD)
    return big


def bounds_flag(crs: Column) -> Column:
    """First matching flag in audit order; NULL when the bounds are plausible."""
    return (
        F.when(_no_box(), "NO_BOUNDS")
        .when(_nonfinite(), "NONFINITE_BOUNDS")
        .when((F.col("xmin") > F.col("xmax")) | (F.col("ymin") > F.col("ymax")), "INVERTED_BOUNDS")
        .when((F.col("xmin") == F.col("xmax")) & (F.col("ymin") == F.col("ymax")), "ZERO_EXTENT")
        .when((crs == 4326) & ~_within(), "OUT_OF_RANGE_FOR_4326")
        .when(crs == 4326, F.lit(None).cast("string"))
        .when(crs.isNull() & _within(), "CRS_MISSING_BUT_BOUNDS_LOOK_GEOGRAPHIC")
        .when(_absurd(), "ABSURD_MAGNITUDE_BOUNDS")
    )


def bounds_flag_geographic() -> Column:
    """The shorter check after reprojection."""
    return F.when(_no_box(), "NO_BOUNDS").when(_nonfinite(), "NONFINITE_BOUNDS").when(~_within(), "OUT_OF_RANGE_FOR_4326")


def resolve_crs(layers: DataFrame, overrides: DataFrame) -> DataFrame:
    """Override first, then the declared code, then 4326 when the bounds look geographic."""
    joined = layers.join(overrides.select("layer", epsg_code(F.col("epsg")).alias("_override")), "layer", "left")
    looks = F.when(_within() & ~_no_box(), F.lit(4326))
    return joined.withColumn("assigned_crs", F.coalesce(F.col("_override"), F.col("crs").cast("int"), looks)).drop("_override")


def normalisation_decision(layers: DataFrame, minimum_valid: float = 0.98) -> DataFrame:
    """GOLD or QUARANTINE with the reason.

    Needs (read_ok, assigned_crs, bounds, post_* bounds after reprojection, valid_geom_ratio).
    Geometry is not repaired here: a layer below the valid share is quarantined.
    """
    post = {c: F.col(f"post_{c}") for c in BOX}
    lost = F.lit(True)
    bad = F.lit(False)
    for c in post.values():
        lost, bad = lost & c.isNull(), bad | ~finite(c)
    inside = (post["xmin"] >= -180) & (post["xmax"] <= 180) & (post["ymin"] >= -90) & (post["ymax"] <= 90)
    geographic = F.col("assigned_crs") == 4326
    reason = (
        F.when(~F.col("read_ok"), "READ_FAILED")
        .when(F.col("assigned_crs").isNull(), "CRS_MISSING_NO_OVERRIDE")
        .when(geographic & ~_no_box() & (_nonfinite() | _absurd()), "ABSURD_BOUNDS_CLAIMS_4326")
        .when(lost, "BOUNDS_NO_BOUNDS")
        .when(bad, "BOUNDS_NONFINITE_BOUNDS")
        .when(~inside & geographic, "CRS_CLAIMS_4326_BUT_OUT_OF_RANGE")
        .when(~inside, "BOUNDS_OUT_OF_RANGE_FOR_4326")
        .when(F.col("valid_geom_ratio") < minimum_valid, "GEOM_INVALID_POST_REPAIR")
    )
    return layers.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "GOLD").otherwise("QUARANTINE"))


def inventory_report(layers: DataFrame) -> DataFrame:
    return layers.agg(
        F.count(F.lit(1)).alias("layers"),
        F.count_if("read_ok").alias("read_ok"),
        F.count_if(~F.col("read_ok")).alias("failed"),
        F.count_if(F.col("crs").isNull()).alias("missing_crs"),
        F.count_if(F.col("bounds_flag").isNotNull()).alias("bounds_flagged"),
    )


def top_values(layers: DataFrame, label: str, n: int = 10) -> DataFrame:
    """Most frequent labels: a top-k report."""
    return layers.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("layers")).orderBy(F.desc("layers"), label).limit(n)


def screen(layers: DataFrame) -> DataFrame:
    """Suspicious layers first: unknown CRS, non-finite bounds, degrees that are none, outside the country box."""
    finite_box = ~_no_box() & ~_nonfinite()
    degrees = finite_box & _within() & (F.col("xmax") >= -180) & (F.col("xmin") <= 180) & (F.col("ymax") >= -90) & (F.col("ymin") <= 90)
    country = degrees & F.col("xmin").between(20, 55) & F.col("xmax").between(20, 55) & F.col("ymin").between(-5, 20) & F.col("ymax").between(-5, 20)
    claims = F.coalesce(F.col("crs") == 4326, F.lit(False))
    suspicious = F.col("crs").isNull() | ~finite_box | (claims & (~degrees | ~country))
    return layers.withColumn("looks_like_degrees", F.coalesce(degrees, F.lit(False))).withColumn("looks_like_country", F.coalesce(country, F.lit(False))).withColumn("suspicious", F.coalesce(suspicious, F.lit(True)))


def verify_normalised(layers: DataFrame) -> DataFrame:
    state = F.when(F.col("crs").isNull() | (F.col("crs") != 4326), "ERROR").when(F.col("feature_count") == 0, "WARN").otherwise("OK")
    return layers.withColumn("verification", state)
