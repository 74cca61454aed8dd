"""Rounding, medians, percentiles and order-preserving bins as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Veltkamp constant: splits a double into two halves whose products are exact.
SPLITTER = 134217729.0
SUB_BINS = 1024
BIN_OFFSET = 1200 * SUB_BINS


def py_round(value: Column, digits: int) -> Column:
    """Round half to even on the exact binary value, as published figures are.

    ``round``/``bround`` decide ties on the shortest decimal text, which differs for
    values such as 62.45. The product with 10**digits is split into its double and its
    exact remainder, so the tie decision sees the true value.
    """
    scale = float(10**digits)
    x = value.cast("double")
    product = x * scale
    high = x * SPLITTER - (x * SPLITTER - x)
    remainder = (high * scale - product) + (x - high) * scale
    low = F.floor(product).cast("double")
    part = product - low
    up = (part > 0.5) | ((part == 0.5) & ((remainder > 0) | ((remainder == 0) & (low % 2 != 0))))
    return F.when(x.isNotNull(), (low + F.when(up, 1.0).otherwise(0.0)) / scale)


def sql_round(value: Column, digits: int) -> Column:
    """Round half away from zero on the product with 10**digits, as SQL's ``round`` of a double does in DuckDB."""
    scale = float(10**digits)
    return F.round(value.cast("double") * scale) / scale


def coverage_pct(valid: Column, cells: Column) -> Column:
    """100 * valid / cells, unrounded; 0 when there are no cells."""
    return F.when(cells > 0, F.lit(100) * valid / cells).otherwise(F.lit(0.0))


def mid_rank_pct(below: Column, equal: Column, total: Column) -> Column:
    """Mid-rank percentile with half weight for ties, one decimal."""
    return py_round(100 * (below + 0.5 * equal) / total, 1)


def inclusive_pct(at_or_below: Column, total: Column) -> Column:
    """Inclusive empirical CDF in percent; NULL for an empty reference."""
    return F.when(total > 0, F.lit(100.0) * at_or_below / total)


def deviation_pct(value: Column, reference: Column) -> Column:
    """Percent deviation, only where the reference is positive."""
    return F.when(reference > 0, F.lit(100) * (value - reference) / reference)


def upper_median(values: Column) -> Column:
    """Element ``n div 2`` (zero based) of the sorted array; for bounded arrays only."""
    ordered = F.array_sort(values)
    return F.when(F.size(values) > 0, F.get(ordered, F.floor(F.size(values) / 2).cast("int")))


def array_quantile(ordered: Column, prob: float) -> Column:
    """Linear interpolation quantile of a sorted, bounded array."""
    position = (F.size(ordered) - 1) * F.lit(float(prob))
    low = F.floor(position).cast("int")
    below = F.get(ordered, low)
    above = F.get(ordered, F.ceil(position).cast("int"))
    return F.when(F.size(ordered) > 0, below + (above - below) * (position - low))


def value_bin(value: Column) -> Column:
    """Monotone integer bin of a double: 1,024 bins per power of two, mirrored for negatives.

    The bin depends on the value alone, so no min/max join is needed and a recomputed
    task always puts a row into the same bin. The infinities and NaN, the greatest value, have
    bins of their own.
    """
    x = value.cast("double")
    usable = ~F.isnan(x) & (F.abs(x) != float("inf"))
    size = F.abs(F.when(usable, x))
    exponent = F.floor(F.log2(size))
    step = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * SUB_BINS)
    positive = (exponent * SUB_BINS + step + BIN_OFFSET).cast("long")
    end = F.lit(4 * BIN_OFFSET).cast("long")
    odd = F.when(F.isnan(x), end + 1).when(x > 0, end).otherwise(-end)
    return F.when(x.isNotNull() & ~usable, odd).when(x == 0, F.lit(0).cast("long")).when(x > 0, positive).otherwise(-positive)


def fine_bin(value: Column) -> Column:
    """Monotone integer inside a ``value_bin``: 1,048,576 steps of the value's distance from the bin's lower end.

    Values with a large offset and a small spread fall into few bins; these steps tell them apart. Like the bin it
    depends on the value alone.
    """
    x = value.cast("double")
    usable = ~F.isnan(x) & (F.abs(x) != float("inf")) & (x != 0)
    size = F.abs(F.when(usable, x))
    unit = F.pow(F.lit(2.0), F.floor(F.log2(size))) / SUB_BINS
    part = size / unit - F.floor(size / unit)
    step = F.floor(part * (1 << 20)).cast("long")
    return F.coalesce(F.when(x > 0, step).otherwise(-step), F.lit(0).cast("long"))


def order_bin(value: Column, kind: str) -> Column:
    """Monotone integer bin of a column of any sortable type; NULL has the last bin."""
    last = F.lit((1 << 62)).cast("long")
    if kind == "string":
        first = F.conv(F.rpad(F.hex(F.substring(F.encode(value, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
        return F.coalesce(first, last)
    if kind in ("date", "timestamp", "timestamp_ntz"):
        seconds = F.unix_date(value) * 86400 if kind == "date" else F.floor(F.unix_micros(value.cast("timestamp")) / 1_000_000)
        return F.coalesce(F.floor(seconds / 3600).cast("long"), last)
    return F.coalesce(value_bin(value), last)


def finite(value: Column) -> Column:
    """True for a usable number: not NULL, not NaN, not infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
