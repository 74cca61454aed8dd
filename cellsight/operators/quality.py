"""Rule engine: a rule is a name and a violation test; the result lists every violation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    violated: Column


def check_rows(df: DataFrame, rules: Sequence[Rule], ident: Sequence[str]) -> DataFrame:
    """One row per (row id, violated rule), in a single pass over the data."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(r.violated, F.lit(False)), F.lit(r.name)) for r in rules]))
    return df.select(*ident, F.explode(hits).alias("rule"))


def duplicates(df: DataFrame, key: Sequence[str], rule: str = "duplicate_key") -> DataFrame:
    """Keys that occur more than once; copies are counted before the shuffle."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*key, F.lit(rule).alias("rule"))


def orphans(df: DataFrame, parent: DataFrame, key: Sequence[str], rule: str) -> DataFrame:
    """Keys without a parent row; distinct first, so a hot key is checked once."""
    return df.select(*key).distinct().join(parent.select(*key).distinct(), list(key), "left_anti").withColumn("rule", F.lit(rule))


def row_count(df: DataFrame, keys: Sequence[str], expected: int, rule: str = "area_count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") != expected).select(*keys, F.lit(rule).alias("rule"))


def require_empty(violations: DataFrame, what: str) -> None:
    """Fail closed: stop the job at the first violation; only a few examples reach the driver."""
    examples = violations.take(3)
    if examples:
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in examples))


# Domains and required members of artifacts.
RAINFALL_CLASSES = ("exceptionally_dry", "drier_than_typical", "typical_range", "wetter_than_typical", "exceptionally_wet", "unavailable")
RAINFALL_MANIFEST = (
    "run_id", "status", "source_product", "source_version", "source_url_template", "analysis_year", "months", "baseline_years",
    "boundary_set_version", "included_tabias", "method", "publication_note", "source_latest_month", "source_acquisition",
)
PRELIMINARY_MANIFEST = (
    "run_id", "status", "source_product", "source_version", "native_resolution", "period_start", "period_end", "selected_pentads",
    "boundary_set_version", "included_tabias", "method", "publication_note", "source_acquisition",
)
TIERS = ("adequate", "limited", "insufficient")
COMPOSITE_QUALITY = ("ok", "limited_observation_coverage", "insufficient_observation_coverage")


def _outside(c: str, low: float, high: float) -> Column:
    return F.col(c).isNull() | ~F.col(c).between(low, high)


def rainfall_rules(prefix: str, preliminary: bool = False) -> list[Rule]:
    incomplete = (F.col("quality_status") == "ok") & F.col("rainfall_mm").isNull()
    rules = [
        Rule("area_id_prefix", ~F.col("area_id").startswith(prefix) | F.col("area_id").isNull()),
        Rule("coverage_range", _outside("coverage_pct", 0, 100)),
        Rule("cell_count", F.col("grid_cell_count").isNull() | (F.col("grid_cell_count") < 0)),
    ]
    if preliminary:
        return [*rules, Rule("ok_but_incomplete", incomplete)]
    complete = incomplete | ((F.col("quality_status") == "ok") & F.col("percentile").isNull())
    return [*rules, Rule("condition_class", ~F.col("condition_class").isin(*RAINFALL_CLASSES)), Rule("ok_but_incomplete", complete)]


def pixel_rules(prefix: str) -> list[Rule]:
    """Vegetation, soil water, thermal and water-use evidence."""
    return [
        Rule("area_id_prefix", ~F.col("area_id").startswith(prefix)),
        Rule("coverage_range", _outside("coverage_pct", 0, 100)),
        Rule("pixel_counts", (F.col("valid_pixel_count") < 0) | (F.col("valid_pixel_count") > F.col("grid_cell_count"))),
        Rule("ok_without_value", (F.col("quality_status") == "ok") & F.col("value").isNull()),
    ]


def composite_rules(prefix: str, pixels: int = 30, coverage: float = 70.0, acquisitions: int = 2) -> list[Rule]:
    weak = (F.col("valid_observation_pixel_count") < pixels) | (F.col("coverage_pct") < coverage) | (F.col("usable_acquisition_count") < acquisitions)
    return [
        Rule("area_id_prefix", ~F.col("area_id").startswith(prefix)),
        Rule("coverage_range", _outside("coverage_pct", 0, 100)),
        Rule("pixel_counts", (F.col("valid_observation_pixel_count") < 0) | (F.col("valid_observation_pixel_count") > F.col("candidate_observation_pixel_count"))),
        Rule("acquisition_counts", F.col("usable_acquisition_count") > F.col("candidate_acquisition_count")),
        Rule("quality_domain", ~F.col("quality_status").isin(*COMPOSITE_QUALITY)),
        Rule("ok_below_thresholds", (F.col("quality_status") == "ok") & weak),
    ]


def profile_rules() -> list[Rule]:
    return [
        Rule("spatial_range", _outside("spatial_coverage_pct", 0, 100)),
        Rule("two_observation_range", _outside("two_observation_coverage_pct", 0, 100)),
        Rule("pixel_counts", F.col("valid_spatial_pixel_count") > F.col("total_eligible_pixel_count")),
        Rule("acquisition_counts", F.col("usable_acquisition_count") > F.col("candidate_acquisition_count")),
        Rule("adjacency_count", F.col("adjacency_accepted_pixel_count") < 0),
        Rule("tier_domain", ~F.col("evidence_tier").isin(*TIERS)),
    ]


def outlook_rules() -> list[Rule]:
    share = [Rule(f"{c}_range", ~F.col(c).between(0, 1)) for c in ("below_normal_probability", "near_normal_probability", "above_normal_probability")]
    return [*share, Rule("validity_order", F.col("valid_to") < F.col("valid_from")), Rule("coverage_range", ~F.col("coverage_pct").between(0, 100))]


def configuration_rules(document: str = "configuration") -> list[Rule]:
    """Exactly 12 monthly profiles, 1..16 factors, 1..12 rules, in a JSON document."""
    size = lambda member: F.coalesce(F.json_array_length(F.get_json_object(document, f"$.{member}")), F.lit(-1))
    return [
        Rule("monthly_profiles", size("monthly_profiles") != 12),
        Rule("factors_or_rules_empty", (size("factors") < 1) | (size("priority_rules") < 1)),
        Rule("matrix_too_large", (size("factors") > 16) | (size("priority_rules") > 12)),
    ]


def missing_members(document: Column, required: Sequence[str]) -> Column:
    """Required top-level members a JSON object lacks, sorted."""
    wanted = F.array(*[F.lit(r) for r in sorted(required)])
    return F.array_except(wanted, F.coalesce(F.json_object_keys(document), F.array().cast("array<string>")))


def manifest_rules(document: str = "manifest") -> list[Rule]:
    product = F.coalesce(F.get_json_object(document, "$.source_product"), F.lit(""))
    preliminary = product.startswith("CHIRPS v3 preliminary")
    missing = F.when(preliminary, F.size(missing_members(F.col(document), PRELIMINARY_MANIFEST))).otherwise(F.size(missing_members(F.col(document), RAINFALL_MANIFEST)))
    receipts = F.when(preliminary, F.get_json_object(document, "$.source_acquisition")).otherwise(F.get_json_object(document, "$.source_acquisition.current_period_files"))
    parsed = F.from_json(receipts, "array<struct<url:string,http_status:int>>")
    return [
        Rule("missing_member", missing > 0),
        Rule("status", ~F.coalesce(F.get_json_object(document, "$.status"), F.lit("")).isin("development", "validated")),
        Rule("no_receipt", F.coalesce(F.size(parsed), F.lit(0)) < 1),
        Rule("receipt_not_confirmed", F.exists(parsed, lambda r: (F.coalesce(r["url"], F.lit("")) == "") | (F.coalesce(r["http_status"], F.lit(0)) != 200))),
    ]


def one_active(configurations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """At most one configuration per group may be active."""
    active = configurations.where("active_for_review").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return active.where("_n > 1").select(*keys, F.lit("one_active").alias("rule"))


def grid_contract(grids: DataFrame, expected: DataFrame, box: tuple[float, float, float, float], min_bytes: int) -> DataFrame:
    """Runs whose grid breaks its contract: band count, CRS, byte size, meeting the extent."""
    xmin, ymin, xmax, ymax = box
    far = lambda o, step, n: o + F.col(step) * F.col(n)
    per_run = grids.groupBy("run_id", "product").agg(
        F.countDistinct("band").alias("bands"),
        F.min("crs").alias("crs"),
        F.max("crs").alias("crs_max"),
        F.min("byte_size").alias("byte_size"),
        F.min(F.least("x0", far(F.col("x0"), "dx", "width"))).alias("left"),
        F.max(F.greatest("x0", far(F.col("x0"), "dx", "width"))).alias("right"),
        F.min(F.least("y0", far(F.col("y0"), "dy", "height"))).alias("bottom"),
        F.max(F.greatest("y0", far(F.col("y0"), "dy", "height"))).alias("top"),
    )
    rules = [
        Rule("band_count", F.col("bands") != F.col("expected_bands")),
        Rule("crs", F.col("crs").isNull() | (F.col("crs") != 4326) | (F.col("crs_max") != 4326)),
        Rule("byte_size", F.col("byte_size") < min_bytes),
        Rule("outside_extent", (F.col("right") <= xmin) | (F.col("left") >= xmax) | (F.col("top") <= ymin) | (F.col("bottom") >= ymax)),
    ]
    return check_rows(per_run.join(expected, "product"), rules, ["run_id"])
