"""Alerts on a change of state only, and on silence past the stale date."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cellsight.operators.runs import previous_value

OUTPUT = "source_key string, state string, at long, observation_end long"
BUCKETS = 4_096
HELD = "source_key array<string>, state array<string>, seen array<long>, stale_after array<long>, waiting_source array<int>, waiting array<long>, waiting_until array<long>"


def state_changes(checks: DataFrame, keys: Sequence[str], order: Sequence[str], state: str, bucket: Column) -> DataFrame:
    """Batch twin: checks whose state differs from the one before (the first one counts)."""
    known = previous_value(checks, keys, order, state, bucket, "previous_state")
    return known.where(F.col("previous_state").isNull() | (F.col("previous_state") != F.col(state)))


def _judged(held: tuple, waiting: list[tuple[int, int]], now: int) -> tuple[list[tuple], tuple, list[tuple[int, int]], int | None]:
    """Alerts of one source up to the watermark ``now``, what is held and waits after them, and the millisecond at which it is due again.

    ``held`` is the state, the last observation and its stale date; all times are microseconds. Observations wait until the watermark has passed
    them and are then judged in the order of their times, so alerts depend on the observations alone, not on how they are dealt over files and batches.
    """
    state, seen, stale_after = held
    out, later = [], []
    for at, until in sorted(set(waiting)):
        if at > now:
            later.append((at, until))
            continue
        if seen is not None and at <= seen:
            continue
        if state == "current" and at > stale_after:
            out.append(("stale", stale_after, seen))
            state = "stale"
        if state != "current":
            out.append(("current", at, at))
        state, seen, stale_after = "current", at, until
    if state == "current" and stale_after <= now:
        out.append(("stale", stale_after, seen))
        state = "stale"
    due = [later[0][0]] if later else []
    due += [stale_after] if state == "current" else []
    return out, (state, seen, stale_after), later, -(-min(due) // 1000) if due else None


def _rows(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["source_key", "state", "at", "observation_end"])


def _alerts(key: tuple, rows: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    """The sources of one bucket: what is held comes and goes with the rows; one timeout stands for what is due next."""
    names, states, seen, stale_after, *late = held.get if held.exists else ([],) * 7
    known = dict(zip(names, zip(states, seen, stale_after)))
    waiting = {name: [] for name in names}
    for k, at, until in zip(*late):
        waiting[names[k]].append((at, until))
    for batch in () if held.hasTimedOut else rows:
        for name, at, until in zip(batch["source_key"].tolist(), batch["at"].tolist(), batch["stale_after"].tolist()):
            waiting.setdefault(name, []).append((at, until))
    now = max(held.getCurrentWatermarkMs(), 0) * 1000
    alerts, kept, later, next_due = [], [], [], []
    for k, (name, observed) in enumerate(waiting.items()):
        out, one, left, due = _judged(known.get(name, (None, None, None)), observed, now)
        alerts += [(name, *o) for o in out]
        kept.append((name, *one))
        later += [(k, *w) for w in left]
        next_due += [due] if due is not None else []
    columns = lambda values, n: [list(c) for c in zip(*values)] if values else [[] for _ in range(n)]
    held.update((*columns(kept, 4), *columns(later, 3)))
    if next_due:
        held.setTimeoutTimestamp(max(min(next_due) - 1, 1))  # it fires when the watermark is beyond this millisecond
    if alerts:
        yield _rows(alerts)


class _Alerts(StatefulProcessor):
    """One source with a state to begin with: every step is a call to the state store; one timer stands for what is due next."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "state string, seen long, stale_after long, timer long")
        self.waiting = handle.getListState("waiting", "at long, stale_after long")

    def _due(self, key: tuple, fresh: list[tuple[int, int]], timerValues) -> Iterator[pd.DataFrame]:
        *known, timer = self.held.get() if self.held.exists() else (None, None, None, None)
        waiting = [*(tuple(r) for r in self.waiting.get()), *fresh] if self.waiting.exists() else fresh
        out, known, later, after = _judged(tuple(known), waiting, max(timerValues.getCurrentWatermarkInMs(), 0) * 1000)
        self.waiting.put(later) if later else self.waiting.clear()
        if after != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if after is not None:
                self.handle.registerTimer(after)
        if known[0] is None and not later:
            return
        self.held.update((*known, after))
        if out:
            yield _rows([(key[0], *o) for o in out])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [w for batch in rows for w in zip(batch["at"].tolist(), batch["stale_after"].tolist())]
        yield from self._due(key, fresh, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._due(key, [], timerValues)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        last = initialState.sort_values("at").iloc[-1]
        seen, until = int(last["at"]), int(last["stale_after"])
        due = max(-(-until // 1000), timerValues.getCurrentWatermarkInMs() + 1)
        if last["state"] == "current":
            self.handle.registerTimer(due)
        self.held.update((last["state"], seen, until, due if last["state"] == "current" else None))

    def close(self) -> None:
        pass


def alert_stream(observations: DataFrame, stale_after_days: Column, delay: str = "1 day", known: DataFrame | None = None) -> DataFrame:
    """(source_key, observation_end) stream to change-only alerts: ``source_key, state, at, observation_end``.

    A source is 'current' from an observation on and 'stale' from ``stale_after_days`` after its last one, if none came in between by event time; each change is
    reported once, when the watermark (``delay``) has passed it. Observations later than the watermark are dropped. ``known``
    (source_key, state, observation_end, stale_after) gives states to begin with.

    Sources are dealt into ``BUCKETS`` buckets by their hash, whose state moves as a whole with the rows of a batch: a batch costs no more calls of
    Python than that, however many sources there are. States to begin with need a processor for each source, which calls the state store several times.
    """
    spark = observations.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the operator needs it
    until = F.timestamp_millis((F.unix_millis("observation_end") + stale_after_days * 86_400_000).cast("long"))
    dated = observations.where("observation_end IS NOT NULL").withColumn("stale_after", F.unix_micros(until)).withWatermark("observation_end", delay)
    rows = dated.select("source_key", "observation_end", F.unix_micros("observation_end").alias("at"), "stale_after")
    if known is None:
        dealt = rows.withColumns({"source_key": F.col("source_key").cast("string"), "bucket": F.pmod(F.xxhash64("source_key"), F.lit(BUCKETS))})
        out = dealt.groupBy("bucket").applyInPandasWithState(_alerts, OUTPUT, HELD, "append", GroupStateTimeout.EventTimeTimeout)
    else:
        begin = known.select("source_key", "state", *[F.unix_micros(c).alias(a) for c, a in (("observation_end", "at"), ("stale_after", "stale_after"))]).groupBy("source_key")
        out = rows.groupBy("source_key").transformWithStateInPandas(_Alerts(), OUTPUT, "Append", "eventTime", initialState=begin)
    return out.withColumns({c: F.timestamp_micros(c) for c in ("at", "observation_end")})
