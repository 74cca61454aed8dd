"""Accumulation over arriving observations in calendar pentads, months or fixed windows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cellsight.functions.dates import pentad_of, pentad_ordinal


def with_pentad(df: DataFrame, event_time: str) -> DataFrame:
    """Calendar pentad number: pentads are not of equal length, so ``window()`` cannot make them."""
    day = F.col(event_time)
    return df.withColumn("pentad_ordinal", pentad_ordinal(F.year(day), F.month(day), pentad_of(day)))


def pentad_sums(df: DataFrame, keys: Sequence[str], event_time: str, value: str, delay: str | None = None) -> DataFrame:
    """Sum and count per calendar pentad; for batches and, with ``delay``, for streams.

    In a stream the day window carries the watermark: days close in order, and the days of a
    pentad are summed when they are read back (see ``pentads_of_days``).
    """
    if delay is None:
        grouped = with_pentad(df, event_time).groupBy(*keys, "pentad_ordinal")
        return grouped.agg(F.sum(value).alias("total"), F.count(value).alias("observations"))
    daily = df.withWatermark(event_time, delay).groupBy(*keys, F.window(event_time, "1 day").alias("day"))
    return daily.agg(F.sum(value).alias("total"), F.count(value).alias("observations")).select(*keys, F.col("day.start").alias("day"), "total", "observations")


def pentads_of_days(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Closed days to calendar pentads; ``closed_days`` tells from how many days a pentad was summed."""
    grouped = with_pentad(days, "day").groupBy(*keys, "pentad_ordinal")
    return grouped.agg(F.sum("total").alias("total"), F.sum("observations").alias("observations"), F.count(F.lit(1)).alias("closed_days"))


def pentad_end(day: Column) -> Column:
    """Midnight after the last day of the calendar pentad: pentads 1 to 5 have five days, the sixth goes to the end of the month."""
    first = F.trunc(day, "month")
    return F.when(pentad_of(day) < 6, F.date_add(first, 5 * pentad_of(day))).otherwise(F.add_months(first, 1)).cast("timestamp")


class _Pentad(StatefulProcessor):
    """Sums the closed days of one pentad and gives it out once, when the watermark has passed its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "total double, observations long, closed_days long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total, n, days = self.held.get() if self.held.exists() else (None, 0, 0)
        end = 0
        for batch in rows:
            known = batch["total"].dropna()
            total = total if known.empty else (total or 0.0) + float(known.sum())
            n, days = n + int(batch["observations"].sum()), days + len(batch)
            end = int(batch["pentad_end"].max().timestamp() * 1000)
        self.held.update((total, n, days))
        self.handle.registerTimer(end)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            total, n, days = self.held.get()
            self.held.clear()
            yield pd.DataFrame([(*key, total, n, days)])

    def close(self) -> None:
        pass


def whole_pentads(df: DataFrame, keys: Sequence[str], event_time: str, value: str, delay: str) -> DataFrame:
    """Stream to calendar pentads, each once and only when its last day has closed: ``*keys, pentad_ordinal, total, observations, closed_days``.

    Two stateful operators in a chain: day windows under the watermark, of which few rows come out, feed a state for each pentad with a timer
    at its end. ``closed_days`` counts the days with rows; values that are NULL count in no figure.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the operator needs it
    daily = df.withWatermark(event_time, delay).groupBy(*keys, F.window(event_time, "1 day").alias("_w"))
    days = daily.agg(F.sum(value).alias("total"), F.count(value).alias("observations")).select(*keys, F.window_time("_w").alias("_closing"), "_w.start", "total", "observations")
    placed = with_pentad(days, "start").withColumn("pentad_end", pentad_end(F.col("start").cast("date")))
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, pentad_ordinal {placed.schema['pentad_ordinal'].dataType.simpleString()}, total double, observations long, closed_days long"
    return placed.groupBy(*keys, "pentad_ordinal").transformWithStateInPandas(_Pentad(), schema, "Append", "eventTime")


def tumbling_sums(df: DataFrame, keys: Sequence[str], event_time: str, value: str, width: str = "5 days", delay: str | None = None) -> DataFrame:
    """Fixed-width windows, for cadences that are not tied to the calendar."""
    source = df.withWatermark(event_time, delay) if delay else df
    grouped = source.groupBy(*keys, F.window(event_time, width).alias("w"))
    return grouped.agg(F.sum(value).alias("total"), F.count(value).alias("observations")).select(*keys, F.col("w.start").alias("window_start"), "total", "observations")
