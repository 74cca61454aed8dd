"""Pentads, dekads, completed months, validity windows and source age."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ymd(year: Column, month: Column, day: Column) -> Column:
    return F.make_date(year.cast("int"), month.cast("int"), day.cast("int"))


def pentad_of(day: Column) -> Column:
    """1..6: five-day steps, the sixth runs to the end of the month."""
    return F.least(F.floor((F.dayofmonth(day) - 1) / 5) + 1, F.lit(6)).cast("int")


def pentad_ordinal(year: Column, month: Column, pentad: Column) -> Column:
    """Consecutive number, so trailing windows wrap over months and years."""
    return ((year * 12 + month - 1) * 6 + pentad).cast("long")


def pentad_start(year: Column, month: Column, pentad: Column) -> Column:
    return _ymd(year, month, (pentad - 1) * 5 + 1)


def pentad_end(year: Column, month: Column, pentad: Column) -> Column:
    """End as the availability probe has it: pentad 6 closes with the month."""
    return F.when(pentad == 6, F.last_day(_ymd(year, month, F.lit(1)))).otherwise(_ymd(year, month, pentad * 5))


def pentad_end_summary(year: Column, month: Column, pentad: Column) -> Column:
    """End as the accumulation summary has it: at most day 30, and 28 in February."""
    days = F.when(month == 2, 28).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return _ymd(year, month, F.least(pentad * 5, days))


def dekad_start(year: Column, month: Column, dekad: Column) -> Column:
    return _ymd(year, month, (dekad - 1) * 10 + 1)


def dekad_end(year: Column, month: Column, dekad: Column) -> Column:
    return F.when(dekad == 3, F.last_day(_ymd(year, month, F.lit(1)))).otherwise(_ymd(year, month, dekad * 10))


# Fixed value: period suffix of a provider code.
DEKAD_CODE = r"\.(\d{4})-(\d{2})-D([123])$"


def dekad_period(code: Column) -> Column:
    """struct(start, end) parsed from a code ``….YYYY-MM-D[123]``; NULL if it does not match."""
    year, month, dekad = (F.regexp_extract(code, DEKAD_CODE, i).try_cast("int") for i in (1, 2, 3))
    usable = code.rlike(DEKAD_CODE) & month.between(1, 12)
    return F.when(
        usable,
        F.struct(dekad_start(year, month, dekad).alias("start"), dekad_end(year, month, dekad).alias("end")),
    )


def completed_month(now: Column, latency_days: int = 5) -> Column:
    """First day of the latest month that is complete with the provider's publication margin."""
    back = F.when(F.dayofmonth(now) <= latency_days, -2).otherwise(-1)
    return F.add_months(F.trunc(now, "month"), back)


def rolling_window(now: Column, days: int, margin_days: int = 5) -> Column:
    """struct(start, end) of the completed window of ``days`` that ended ``margin_days`` ago."""
    end = F.date_sub(F.to_date(now), margin_days)
    return F.struct(F.date_sub(end, days).alias("start"), end.alias("end"))


def replay_validity(month: Column) -> Column:
    """Retrospective snapshot: valid for the source month itself."""
    start = F.trunc(month, "month")
    return F.struct(start.alias("valid_from"), F.date_sub(F.add_months(start, 1), 1).alias("valid_to"))


def preview_validity(month: Column) -> Column:
    """Calibration preview: from the next month; the end is 123 days later, back to the month end before."""
    start = F.add_months(F.trunc(month, "month"), 1)
    end = F.date_sub(F.trunc(F.date_add(start, 123), "month"), 1)
    return F.struct(start.alias("valid_from"), end.alias("valid_to"))


def age_days(observed: Column, as_of: Column) -> Column:
    """Whole days between two dates."""
    return F.datediff(F.to_date(as_of), F.to_date(observed))


def age_days_fractional(observed: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(observed)) / F.lit(86400e6)


def rate_to_depth(rate: Column, month: Column) -> Column:
    """Mean rate in m/s to a monthly depth in millimetres."""
    return rate * (F.dayofmonth(F.last_day(month)) * F.lit(86400e3))


def observation_window(start_fields: list[Column], end_fields: list[Column], fallback: Column) -> Column:
    """First present alternative for start and end, cut to the ISO date."""
    pick = lambda cols: F.substring(F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in cols], fallback.cast("string")), 1, 10)
    return F.struct(pick(start_fields).alias("start"), pick(end_fields).alias("end"))
