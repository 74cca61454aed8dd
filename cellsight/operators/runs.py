"""Selecting, filtering, joining and counting runs and their evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Statuses each indicator's history accepts.
HISTORY_STATUS = {
    "rainfall": ("development", "validated", "published"),
    "rapid": ("development", "degraded", "validated", "published"),
    "ndvi": ("development", "degraded"),
    "swi": ("development", "degraded"),
    "lst": ("development", "degraded"),
    "wapor": ("development", "degraded"),
}
REFERENCE_STATUS = ("development", "degraded", "validated")
INVENTORY_STATUS = ("development", "degraded", "validated", "published")
PILOT_NOTE = "Baseline pilot only"


# ---- predicates

def history_allowed(indicator: Column, status: Column) -> Column:
    allowed = F.lit(False)
    for name, statuses in HISTORY_STATUS.items():
        allowed = allowed | ((indicator == name) & status.isin(*statuses))
    return allowed


def usable(value: Column, quality: Column, coverage: Column, minimum: float = 90.0) -> Column:
    return (quality == "ok") & (coverage >= minimum) & value.isNotNull()


def release_usable(quality: Column, coverage: Column, minimum: float = 90.0) -> Column:
    return F.lower(quality).isin("ok", "validated") & (coverage.isNull() | (coverage >= minimum))


def reference_candidate(candidate_only: Column, notes: Column) -> Column:
    return F.coalesce(candidate_only, F.lit(False)) | F.coalesce(notes.startswith(PILOT_NOTE), F.lit(False))


def owner_in(owner: Column, allowed: Sequence[str]) -> Column:
    return F.upper(F.trim(owner)).isin(list(allowed))


def json_contains(document: Column, wanted: dict[str, str]) -> Column:
    """All given members equal, like a flat JSON containment test."""
    hit = F.lit(True)
    for key, value in wanted.items():
        hit = hit & (F.get_json_object(document, f"$.{key}") == value)
    return F.coalesce(hit, F.lit(False))


def names_contain(needle: str, *names: Column) -> Column:
    joined = F.lower(F.concat_ws(" ", *[F.coalesce(n, F.lit("")) for n in names]))
    wanted = needle.strip().lower()
    return F.lit(True) if not wanted else joined.contains(F.lit(wanted))


def bounded_limit(df: DataFrame, order: Sequence[Column], n: int, most: int) -> DataFrame:
    """Top-n report with the range check of the request parameter."""
    if not 1 <= n <= most:
        raise ValueError(f"n must be within 1..{most}")
    return df.orderBy(*order).limit(n)


# ---- latest-of selections: aggregates, no global sort

def latest_by(runs: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The whole row with the largest ``order`` tuple per group."""
    row = F.struct(*[F.col(c) for c in runs.columns])
    best = runs.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_best"))
    return best.select("_best.*")


def latest_run(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return latest_by(runs, keys, [F.col("obs_end"), F.col("created_at"), F.col("run_id")])


def latest_rainfall_run(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Latest source month; then more season months; then the newer run."""
    return latest_by(runs, keys, [F.col("source_latest_month"), F.size("season_months"), F.col("created_at"), F.col("run_id")])


def static_run(runs: DataFrame, boundary: str, prefix: str = "", keys: Sequence[str] = ()) -> DataFrame:
    """Newest approved run of a static table for one boundary set."""
    fit = runs.where(F.col("status").isin("development", "validated") & (F.col("boundary_set_version") == boundary) & F.col("run_id").startswith(prefix))
    return latest_by(fit, keys, [F.col("created_at"), F.col("run_id")])


def active_configuration(configurations: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Active for review first, published before draft, then version and age."""
    fit = configurations.where(F.col("status").isin("draft", "published"))
    order = [F.col("active_for_review").cast("int"), (F.col("status") == "published").cast("int"), F.col("version"), F.col("created_at")]
    return latest_by(fit, keys, order)


def outlook_state(valid_from: Column, valid_to: Column, as_of: Column) -> Column:
    return F.when(valid_from > as_of, "upcoming").when(valid_to < as_of, "archived").otherwise("active")


def order_outlooks(outlooks: DataFrame, as_of: Column) -> DataFrame:
    """Active, upcoming, archived; then start ascending, newest issue first."""
    staged = outlooks.withColumn("state", outlook_state(F.col("valid_from"), F.col("valid_to"), as_of))
    return staged.orderBy(_state_rank(), F.asc("valid_from"), F.desc("issued_at"), F.asc("run_id"))


def _state_rank() -> Column:
    return F.when(F.col("state") == "active", 0).when(F.col("state") == "upcoming", 1).otherwise(2)


def current_outlook(outlooks: DataFrame, as_of: Column, keys: Sequence[str] = ()) -> DataFrame:
    """First active, else first upcoming outlook per group."""
    staged = outlooks.withColumn("state", outlook_state(F.col("valid_from"), F.col("valid_to"), as_of)).where("state <> 'archived'")
    issued = -F.unix_micros("issued_at")
    row = F.struct(*[F.col(c) for c in staged.columns])
    best = staged.groupBy(*keys).agg(F.min_by(row, F.struct(_state_rank(), F.col("valid_from"), issued, F.col("run_id"))).alias("_best"))
    return best.select("_best.*")


def hash_sample(df: DataFrame, ident: str, n: int) -> DataFrame:
    """The n rows with the smallest md5 of their id: a repeatable sample."""
    return df.orderBy(F.md5(F.col(ident).cast("string")), F.col(ident)).limit(n)


def evenly_spaced(df: DataFrame, keys: Sequence[str], stamp: str, count: int) -> DataFrame:
    """``count`` distinct stamps at evenly spaced places per group, ends included.

    The distinct stamps of a provider catalogue group are bounded by its cadence.
    """
    stamps = df.select(*keys, stamp).distinct()
    numbered = stamps.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(stamp)) - 1)
    sized = numbered.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    if count == 1:
        return sized.where("_i = 0").drop("_i", "_n")
    picks = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.bround(k * (F.col("_n") - 1) / (count - 1), 0).cast("int"))
    return sized.where((F.col("_n") <= count) | F.array_contains(picks, F.col("_i"))).drop("_i", "_n")


def slots(spark, years: tuple[int, int], months: Sequence[int]) -> DataFrame:
    """(year, month) slots of a fixed plan: parameters, not data."""
    year = spark.range(years[0], years[1] + 1).select(F.col("id").cast("int").alias("year"))
    return year.select("year", F.explode(F.array(*[F.lit(m) for m in months])).alias("month"))


def first_available_month(available: DataFrame, keys: Sequence[str], month: str, start: str, look_back: int) -> DataFrame:
    """Latest available month at or before ``start`` within the look-back, per group."""
    first = F.to_date(F.lit(start))
    window = available.where((F.col(month) <= F.trunc(first, "month")) & (F.col(month) > F.add_months(F.trunc(first, "month"), -look_back)))
    return window.groupBy(*keys).agg(F.max(month).alias("first_available"))


# ---- joins

def evidence_of_runs(evidence: DataFrame, runs: DataFrame, areas: DataFrame) -> DataFrame:
    """Evidence with its run and area. No broadcast hint: Spark checks the sizes itself."""
    return evidence.join(runs, "run_id").join(areas, "area_id")


def with_optional(cases: DataFrame, tables: dict[str, tuple[DataFrame, str]], key: str = "area_id") -> DataFrame:
    """Left join of several tables, each first cut to its pinned run; columns get the table's name."""
    out = cases
    for name, (table, run_id) in tables.items():
        pinned = table.where(F.col("run_id") == run_id).drop("run_id")
        renamed = pinned.select(key, *[F.col(c).alias(f"{name}_{c}") for c in pinned.columns if c != key])
        out = out.join(renamed, key, "left")
    return out


def ordered_cases(areas: DataFrame, wanted: Sequence[str], key: str = "area_id") -> DataFrame:
    """Areas of a parameter list, with the list position."""
    place = F.array_position(F.array(*[F.lit(w) for w in wanted]), F.col(key))
    return areas.where(F.col(key).isin(list(wanted))).withColumn("ord", place.cast("int"))


def run_difference(evidence: DataFrame, first: Column, second: Column, value: str = "value", key: str = "area_id", keys: Sequence[str] = ()) -> DataFrame:
    """value(first) - value(second) per area by conditional aggregation: one shuffle, no self-join."""
    side = lambda flag: F.max(F.when(flag, F.col(value)))
    both = evidence.where(first | second).groupBy(*keys, key).agg(side(first).alias("first_value"), side(second).alias("second_value"))
    return both.withColumn("difference", F.col("first_value") - F.col("second_value"))


def compare_values(stored: DataFrame, source: DataFrame, key: Sequence[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """Rows missing on one side or differing by more than the tolerance."""
    a = stored.select(*key, F.col(value).alias("stored_value"), F.lit(True).alias("_a"))
    b = source.select(*key, F.col(value).alias("source_value"), F.lit(True).alias("_b"))
    gap = F.abs(F.col("stored_value") - F.col("source_value")) > tolerance
    one_null = F.col("stored_value").isNull() != F.col("source_value").isNull()
    state = F.when(F.col("_a").isNull(), "missing_in_store").when(F.col("_b").isNull(), "missing_in_source").when(gap | one_null, "different")
    return a.join(b, list(key), "full_outer").withColumn("finding", state).where("finding IS NOT NULL").drop("_a", "_b")


def comparison_summary(findings: DataFrame, ident: str, sample: int = 5) -> DataFrame:
    """Counts per finding with the first few ids; only ``sample`` ids are ever gathered."""
    ranked = findings.withColumn("_h", F.pmod(F.xxhash64(ident), F.lit(64)))
    local = W.partitionBy("finding", "_h").orderBy(ident)
    first = W.partitionBy("finding").orderBy(ident)
    few = ranked.withColumn("_k", F.row_number().over(local)).where(F.col("_k") <= sample)
    few = few.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= sample)
    ids = few.groupBy("finding").agg(F.array_sort(F.collect_list(ident)).alias("sample_ids"))
    return findings.groupBy("finding").agg(F.count(F.lit(1)).alias("rows")).join(ids, "finding")


def pair_products(items: DataFrame, first: str, second: str, code: str = "code", url: str = "url") -> DataFrame:
    """Records of two products with the same code suffix, both with a link."""
    linked = items.where(F.coalesce(F.length(url), F.lit(0)) > 0)
    suffix = lambda product: F.regexp_replace(code, f"^{product.replace('.', chr(92) + '.')}\\.", "")
    a = linked.where(F.col(code).startswith(f"{first}.")).select(suffix(first).alias("suffix"), F.col(code).alias("first_code"), F.col(url).alias("first_url"))
    b = linked.where(F.col(code).startswith(f"{second}.")).select(suffix(second).alias("suffix"), F.col(code).alias("second_code"), F.col(url).alias("second_url"))
    return a.join(b, "suffix")


# ---- aggregations

def run_inventory(runs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rows and usable rows per run; a run without evidence stays with zero.

    Evidence is counted per run before the join, so a run with a third of all rows meets the
    join as one row.
    """
    counts = evidence.groupBy("run_id").agg(F.count(F.lit(1)).alias("area_count"), F.count_if(F.col("quality_status") == "ok").alias("usable_count"))
    joined = runs.join(counts, "run_id", "left")
    return joined.withColumn("area_count", F.coalesce("area_count", F.lit(0))).withColumn("usable_count", F.coalesce("usable_count", F.lit(0)))


def counts_map(df: DataFrame, keys: Sequence[str], label: str, name: str) -> DataFrame:
    """Counts by a class as a map; the class has a fixed, small domain."""
    counted = df.groupBy(*keys, F.coalesce(F.col(label), F.lit("unavailable")).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    entries = F.array_sort(F.collect_list(F.struct("_label", "_n")))
    return counted.groupBy(*keys).agg(F.map_from_entries(entries).alias(name))


def class_counts(df: DataFrame, keys: Sequence[str], label: str, classes: Sequence[str]) -> DataFrame:
    """One count column per class; unlike ``pivot`` it needs a single aggregation."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("areas"), *[F.count_if(F.col(label) == c).alias(c) for c in classes])


def quality_summary(evidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    return evidence.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("areas"),
        F.count_if(F.col("quality_status") == "ok").alias("usable_areas"),
        F.coalesce(F.round(F.avg("coverage_pct"), 2), F.lit(0.0)).alias("mean_coverage_pct"),
    )


def retained_months(runs: DataFrame, evidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct runs and months with evidence, first and last date, and the sorted list of months."""
    kept = runs.where(F.col("status").isin(*INVENTORY_STATUS)).join(evidence.select("run_id").distinct(), "run_id", "left_semi")
    # run_id is the key of runs; counting per month first keeps the list of months small
    monthly = kept.groupBy(*keys, F.date_format("obs_end", "yyyy-MM").alias("_month")).agg(
        F.count(F.lit(1)).alias("_runs"), F.min(F.to_date("obs_end")).alias("_first"), F.max(F.to_date("obs_end")).alias("_last")
    )
    return monthly.groupBy(*keys).agg(
        F.sum("_runs").alias("retained_runs"),
        F.count(F.lit(1)).alias("retained_months"),
        F.min("_first").alias("first_observation"),
        F.max("_last").alias("latest_observation"),
        F.array_sort(F.collect_list("_month")).alias("calendar_months"),
    )


def availability_matrix(records: DataFrame, keys: Sequence[str], years: tuple[int, int]) -> DataFrame:
    """Years present and missing per calendar month, and whether all twelve are complete."""
    wanted = F.sequence(F.lit(years[0]), F.lit(years[1]))
    present = records.where(F.col("year").between(*years)).groupBy(*keys, "month").agg(F.collect_set(F.col("year").cast("int")).alias("_years"))
    months = records.select(*keys).distinct().withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    held = F.coalesce(F.col("_years"), F.array().cast("array<int>"))
    out = months.join(present.withColumn("month", F.col("month").cast("int")), [*keys, "month"], "left").select(
        *keys, "month", F.array_sort(held).alias("years_available"), F.array_except(wanted, held).alias("years_missing")
    )
    out = out.withColumn("complete", F.size("years_missing") == 0)
    whole = F.min("complete").over(W.partitionBy(*keys)) if keys else F.min("complete").over(W.partitionBy(F.lit(1)))
    return out.withColumn("status", F.when(whole, "candidate_coverage_complete").otherwise("candidate_coverage_incomplete"))


def value_range(evidence: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    ok = (F.col("quality_status") == "ok") & F.col(value).isNotNull()
    return evidence.groupBy(*keys).agg(
        F.min(F.when(ok, F.col(value))).alias("lowest"), F.max(F.when(ok, F.col(value))).alias("highest"), F.count_if(ok).alias("usable"), F.count(F.lit(1)).alias("total")
    )


def identity_census(identities: DataFrame) -> DataFrame:
    return identities.agg(
        F.count(F.lit(1)).alias("identities"),
        F.count_if("review_required").alias("review_required"),
        F.coalesce(F.max("boundary_set_version"), F.lit("unknown")).alias("boundary_set_version"),
    )


def key_occurrences(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows per key on every row; NULL keys form a group of their own.

    Counted first and joined back, instead of a window: a key that a third of the rows share is
    then one count, and the join splits or broadcasts it.
    """
    counts = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias(name))
    return df.join(counts, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, bucket: Column, name: str, parts: int | None = None) -> DataFrame:
    """``lag`` over groups of any size; ``parts`` tasks share the ordering.

    ``bucket`` rises with the order (a year, a day). Rows are ordered inside (group, bucket) only;
    the last value of each bucket is one row per group and bucket, and is handed to the next.
    """
    keys = list(keys)
    split = df.withColumn("_b", bucket).withColumn("_x", F.struct(F.col(value).alias("v")))
    if parts:
        split = split.repartition(parts, *keys, "_b")
    inner = W.partitionBy(*keys, "_b").orderBy(*order)
    lasts = split.groupBy(*keys, "_b").agg(F.max_by("_x", F.struct(*order)).alias("_last"))
    handed = lasts.select(*keys, "_b", F.lag("_last").over(W.partitionBy(*keys).orderBy("_b")).alias("_handed"))
    joined = split.withColumn("_prev", F.lag("_x").over(inner)).join(handed, [*keys, "_b"])
    return joined.withColumn(name, F.coalesce("_prev", "_handed")["v"]).select(*df.columns, name)


def history(indicator_evidence: DataFrame, bucket: Column, key: str = "area_id", parts: int | None = None) -> DataFrame:
    """Series per area with deviation from the expected value and change since the last observation."""
    deviation = F.when(F.col("expected_median") > 0, 100 * (F.col("value") - F.col("expected_median")) / F.col("expected_median"))
    known = previous_value(indicator_evidence, ["indicator", key], ["observation_at", "run_id"], "value", bucket, "_before", parts)
    return known.withColumn("deviation_pct", deviation).withColumn("change", F.col("value") - F.col("_before")).drop("_before")


def trailing_periods(totals: DataFrame, keys: Sequence[str], ordinal: str, value: str, periods: int = 6) -> DataFrame:
    """Sum of the trailing consecutive periods; NULL unless all of them are present."""
    window = W.partitionBy(*keys).orderBy(ordinal).rangeBetween(-(periods - 1), 0)
    present = F.count(value).over(window)
    return totals.withColumn("periods_present", present).withColumn("trailing_total", F.when(present == periods, F.sum(value).over(window)))


# ---- set operations

def first_occurrence(items: DataFrame, keys: Sequence[str], value: str, position: str) -> DataFrame:
    """Distinct values with the place of their first occurrence."""
    return items.groupBy(*keys, value).agg(F.min(position).alias(position))


def set_differences(left: DataFrame, right: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows of one set that the other lacks; empty when the sets are equal.

    One aggregation over both sides says which of them holds a row (bits 1 and 2); NULL equals NULL. ``parts`` tasks share it.
    """
    columns = left.columns
    both = left.withColumn("_side", F.lit(1)).unionByName(right.withColumn("_side", F.lit(2)))
    if parts:
        both = both.repartition(parts, *columns)
    held = both.groupBy(*columns).agg(F.bit_or("_side").alias("_side")).where("_side < 3")
    return held.select(*columns, F.when(F.col("_side") == 1, "left_only").otherwise("right_only").alias("side"))
