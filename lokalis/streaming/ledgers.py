"""Request ledgers as streams: rolling counts, windows that begin with their first event, failure streaks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rolling_counts(events: DataFrame, by: str, ts: str = "ts", width: str = "24 hours", slide: str = "1 hour", late: str = "3 days") -> DataFrame:
    """(by, start, end, n): events in sliding windows; events later than `late` behind the newest are left out."""
    return events.withWatermark(ts, late).groupBy(by, F.window(ts, width, slide).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(rows: DataFrame, keys: list[str], ts: str, late: str = "3 days") -> DataFrame:
    """Each key once, within the time that the watermark remembers."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def activation_windows(events: DataFrame, by: str, ts: str = "ts", width_s: float = 3600.0) -> DataFrame:
    """(by, started, events) updates of the window that is open: it begins with the first event after the last has run out.

    The state is two numbers for each key. Events of one batch are taken in the order of their times.
    """
    kind = events.schema[by].dataType.simpleString()

    def step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        times = pd.concat([p["_t"] for p in parts]).sort_values()
        for t in times:
            if start is None or t - start >= width_s:
                start, n = float(t), 0
            n += 1
        state.update((start, n))
        yield pd.DataFrame({by: [key[0]], "started": [start], "events": [n]})

    rows = events.select(by, F.col(ts).cast("timestamp").cast("double").alias("_t")).where("_t is not null")
    return rows.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, started double, events long", "start double, n long", "update", GroupStateTimeout.NoTimeout)


def failure_streaks(events: DataFrame, by: str, failed: str, ts: str = "ts", limit: int = 3, forget_s: float = 21600.0) -> DataFrame:
    """(by, streak, tripped) updates: failures since the last success; a streak older than `forget_s` is forgotten."""
    kind = events.schema[by].dataType.simpleString()

    def step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, None)
        for t, bad in pd.concat(list(parts)).sort_values("_t")[["_t", "_bad"]].itertuples(index=False):
            if last is not None and t - last > forget_s:
                n = 0
            n, last = (n + 1 if bad else 0), float(t)
        state.update((int(n), last))
        yield pd.DataFrame({by: [key[0]], "streak": [int(n)], "tripped": [n >= limit]})

    rows = events.select(by, F.col(ts).cast("timestamp").cast("double").alias("_t"), F.col(failed).cast("boolean").alias("_bad")).where("_t is not null")
    return rows.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, streak long, tripped boolean", "n long, last double", "update", GroupStateTimeout.NoTimeout)
