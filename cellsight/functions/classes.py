"""Value to class ladders. Thresholds and labels are fixed values of the products."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper limits of the first nine of ten display classes per indicator.
DISPLAY_LIMITS = {
    "rainfall": (50, 100, 150, 200, 250, 300, 350, 400, 450),
    "rapid": (50, 100, 150, 200, 250, 300, 350, 400, 450),
    "ndvi": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "swi": (10, 20, 30, 40, 50, 60, 70, 80, 90),
    "lst": (15, 20, 25, 30, 35, 40, 45, 50, 55),
    "wapor": (0.5, 1, 1.5, 2, 2.5, 3, 3.5, 4, 5),
}
# Small and large change per indicator; the last entry is the default.
CHANGE_LIMITS = {
    "rainfall": (25, 75),
    "rapid": (25, 75),
    "ndvi": (0.03, 0.10),
    "swi": (5, 15),
    "lst": (1, 3),
    "wapor": (0.25, 0.75),
    "reference": (10, 30),
    None: (0.1, 0.3),
}
OPACITY_LIMITS = ((0.40, 0.32), (0.50, 0.48), (0.60, 0.65), (0.70, 0.80))
OPACITY_TOP = 0.92


def first_below(value: Column, limits: Sequence[float]) -> Column:
    """Index of the first limit above the value; ``len(limits)`` when there is none."""
    ladder = F.when(value.isNull() | F.isnan(value), F.lit(None).cast("int"))
    for index, limit in enumerate(limits):
        ladder = ladder.when(value < limit, F.lit(index))
    return ladder.otherwise(F.lit(len(limits)))


def display_class(indicator: Column, value: Column, quality: Column | None = None) -> Column:
    ladder = F.when(F.lit(False), F.lit(None).cast("int"))
    if quality is not None:
        ladder = ladder.when(quality.isNull() | (quality != "ok"), F.lit(None).cast("int"))
    for name, limits in DISPLAY_LIMITS.items():
        ladder = ladder.when(indicator == name, first_below(value.cast("double"), limits))
    return ladder


def slope_class(value: Column) -> Column:
    """The slope raster stores its eight display classes 0..7; anything else is no data."""
    return F.when((value >= 0) & (value <= 7) & (value == F.floor(value)), value.cast("int"))


def change_class(indicator: Column, delta: Column) -> Column:
    """steady, decrease/increase and their strong forms, with limits per indicator."""
    small = F.when(F.lit(False), F.lit(None).cast("double"))
    large = F.when(F.lit(False), F.lit(None).cast("double"))
    for name, (low, high) in CHANGE_LIMITS.items():
        if name is not None:
            small, large = small.when(indicator == name, float(low)), large.when(indicator == name, float(high))
    small, large = small.otherwise(CHANGE_LIMITS[None][0]), large.otherwise(CHANGE_LIMITS[None][1])
    size = F.abs(delta)
    return (
        F.when(delta.isNull(), F.lit(None).cast("string"))
        .when(size < small, "steady")
        .when((delta < 0) & (size < large), "decrease")
        .when(delta < 0, "strong_decrease")
        .when(size < large, "increase")
        .otherwise("strong_increase")
    )


def rainfall_condition(percentile: Column) -> Column:
    return (
        F.when(percentile.isNull(), "unavailable")
        .when(percentile <= 10, "exceptionally_dry")
        .when(percentile <= 20, "drier_than_typical")
        .when(percentile < 80, "typical_range")
        .when(percentile < 90, "wetter_than_typical")
        .otherwise("exceptionally_wet")
    )


def gate_closed(percentile: Column, quality: Column, coverage: Column, minimum: float = 90.0) -> Column:
    return (quality != "ok") | (coverage < minimum) | percentile.isNull()


def rainfall_band(percentile: Column, quality: Column, coverage: Column, minimum: float = 90.0) -> Column:
    return (
        F.when(gate_closed(percentile, quality, coverage, minimum), "unavailable")
        .when(percentile <= 10, "very_low")
        .when(percentile <= 20, "low")
        .when(percentile <= 33, "watch")
        .otherwise("no_signal")
    )


def road_context(quality: Column, distance_m: Column) -> Column:
    """A missing road row has NULL quality and distance and so falls through to 'far'."""
    return (
        F.when(quality != "ok", "unavailable")
        .when(distance_m < 900, "near")
        .when(distance_m < 5500, "intermediate")
        .otherwise("far")
    )


def evidence_state(quality: Column, coverage: Column, minimum: float = 90.0) -> Column:
    return (
        F.when((quality == "ok") & (coverage >= minimum), "eligible_for_review")
        .when(quality == "ok", "insufficient_coverage")
        .otherwise("unavailable")
    )


def evidence_tier(pixels: Column, scenes: Column, coverage: Column) -> Column:
    """Composite tier: at least 30 pixels and 2 scenes; below 30 % insufficient, below 70 % limited."""
    return (
        F.when((pixels < 30) | (scenes < 2) | (coverage < 30.0), "insufficient")
        .when(coverage < 70.0, "limited")
        .otherwise("adequate")
    )


def tier_quality(tier: Column, full_run: bool = True) -> Column:
    """Quality status of a tier; the pilot run does not keep the limited tier apart."""
    limited = "limited_observation_coverage" if full_run else "insufficient_observation_coverage"
    return F.when(tier == "adequate", "ok").when(tier == "limited", limited).otherwise("insufficient_observation_coverage")


def outlook_category(below: Column, near: Column, above: Column) -> Column:
    """struct(category, probability) of the largest probability; the first wins a tie, NULLs are left out."""
    top = F.greatest(below, near, above)
    category = (
        F.when(top.isNull(), "Unavailable")
        .when(below == top, "Below normal")
        .when(near == top, "Near normal")
        .otherwise("Above normal")
    )
    return F.struct(category.alias("category"), F.coalesce(top.cast("double"), F.lit(0.0)).alias("probability"))


def opacity(probability: Column) -> Column:
    ladder = F.when(F.lit(False), F.lit(0.0))
    for limit, value in OPACITY_LIMITS:
        ladder = ladder.when(probability < limit, value)
    return ladder.otherwise(OPACITY_TOP)


# Provider phase labels and scenario labels.
PHASE_LABELS = {"1": "Minimal", "2": "Stressed", "3": "Crisis", "4": "Emergency", "5": "Catastrophe"}
SCENARIO_LABELS = {"ML1": "Current assessment", "ML2": "Projected assessment"}
PHASE_FIELDS = ("phase", "ipc_phase", "ml1", "value", "classification")
SCENARIO_FIELDS = ("scenario", "scenario_name")
PERIOD_START_FIELDS = ("projection_start", "valid_from", "start_date")
PERIOD_END_FIELDS = ("projection_end", "valid_to", "end_date")


def json_first(properties: Column, names: Sequence[str]) -> Column:
    """First non-empty property among alternative names."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(properties, f"$.{n}")), F.lit("")) for n in names])


def _month_label(value: Column) -> Column:
    iso = F.regexp_extract(value, r"^(\d{4})-(\d{2})", 0)
    return F.when(value.isNull(), "unspecified").when(iso != "", F.date_format(F.to_date(F.concat(iso, F.lit("-01"))), "MMM yyyy")).otherwise(value)


def provider_context(features: DataFrame, properties: str = "properties") -> DataFrame:
    """Add value, label, scenario and period read from open provider properties.

    The properties are parsed in one select and classified in the next, so no JSON path is
    evaluated more than once per row.
    """
    parsed = features.withColumns(
        {
            "_v": json_first(F.col(properties), PHASE_FIELDS),
            "_s": json_first(F.col(properties), SCENARIO_FIELDS),
            "_from": json_first(F.col(properties), PERIOD_START_FIELDS),
            "_to": json_first(F.col(properties), PERIOD_END_FIELDS),
        }
    ).withColumns({"_first": _month_label(F.col("_from")), "_last": _month_label(F.col("_to"))})
    label = F.coalesce(
        *[F.when(F.col("_v") == key, text) for key, text in PHASE_LABELS.items()],
        F.when(F.col("_v").isNotNull(), "Provider classification"),
        F.lit("Classification not supplied"),
    )
    named = F.coalesce(*[F.when(F.col("_s") == key, text) for key, text in SCENARIO_LABELS.items()], F.col("_s"), F.lit("Assessment type not supplied"))
    same_year = F.substring("_from", 1, 4) == F.substring("_to", 1, 4)
    period = (
        F.when(F.col("_from").isNull() & F.col("_to").isNull(), "Period not supplied")
        .when(F.col("_first") == F.col("_last"), F.col("_first"))
        .when(same_year, F.concat_ws("\u2013", F.regexp_replace("_first", r" \d{4}$", ""), "_last"))
        .otherwise(F.concat_ws("\u2013", "_first", "_last"))
    )
    out = parsed.withColumns({"value": F.coalesce("_v", F.lit("")), "label": label, "scenario": named, "period": period})
    return out.drop("_v", "_s", "_from", "_to", "_first", "_last")
