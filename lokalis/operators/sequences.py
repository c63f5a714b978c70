"""Operators along an order: carrying values forward, running positions, streaks, rolling and activation windows."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lokalis.functions.geo import M_PER_DEG_LAT, M_PER_DEG_LNG


SLICE_ROWS = 1_000_000


def sliced(df: DataFrame, by: list[str], first: Column, nulls_last: bool = False, slice_rows: int = SLICE_ROWS) -> tuple[DataFrame, bool]:
    """`df` with `_slice`, and whether any key was cut.

    `_slice` is 0 for most keys; a key of more than `slice_rows` rows is cut along its order into slices of about that size.
    Window functions then run within (key, slice) and what earlier slices hold is added from one row for each slice, so no
    task has to take a whole hot key. Rows that are equal in the first order column stay together.
    """
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > slice_rows)
    most = sizes.agg(F.max("_n")).first()[0]
    if most is None:
        return df.withColumn("_slice", F.lit(0)), False
    k = min(2_000, -(-most // slice_rows))
    # One row for each hot key: no more than rows / slice_rows.
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    cuts = df.withColumn("_first", first).groupBy(*keys).agg(F.count("*").alias("_n"), F.array_distinct(F.percentile_approx("_first", [i / k for i in range(1, k)], 10 * k)).alias("_cuts")).where(F.col("_n") > slice_rows)
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & df[c].eqNullSafe(F.col(f"_k{i}"))
    j = df.join(F.broadcast(cuts), on, "left")
    at = F.when(first.isNull(), F.size("_cuts") if nulls_last else F.lit(0)).otherwise(F.size(F.filter("_cuts", lambda c: c < first)))
    return j.select(*(df[c] for c in df.columns), F.when(F.col("_cuts").isNull(), 0).otherwise(at).alias("_slice")), True


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, nulls_last: bool = False, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """`df` with running sums and last known values up to and with each row; keys of any size."""
    sums, lasts = sums or {}, lasts or {}
    names = [*sums, *lasts]
    rows, cut = sliced(df, by, F.col(order[0]), nulls_last, slice_rows)
    sort = [F.col(order[0]).asc_nulls_last() if nulls_last else F.col(order[0]), *(F.col(o) for o in order[1:])]
    w = Window.partitionBy(*by, "_slice").orderBy(*sort)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumns({n: F.sum(e).over(upto) for n, e in sums.items()} | {n: F.last(e, ignorenulls=True).over(upto) for n, e in lasts.items()} | {"_r": F.row_number().over(w)})
    if not cut:
        return here.drop("_slice", "_r")
    # What a slice ends with, one row for each key and slice, and what the slices before it hold.
    each = here.groupBy(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col("_slice").alias("_ks")).agg(*(F.max_by(n, "_r").alias(f"_b_{n}") for n in names))
    before = Window.partitionBy(*(f"_k{i}" for i in range(len(by)))).orderBy("_ks").rowsBetween(Window.unboundedPreceding, -1)
    carry = each.withColumns({f"_c_{n}": F.sum(f"_b_{n}").over(before) for n in sums} | {f"_c_{n}": F.last(f"_b_{n}", ignorenulls=True).over(before) for n in lasts}).where("_ks > 0")
    on = here["_slice"] == carry["_ks"]
    for i, c in enumerate(by):
        on = on & here[c].eqNullSafe(carry[f"_k{i}"])
    j = here.join(carry, on, "left")
    out = [(F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n) for n in sums] + [F.coalesce(F.col(n), F.col(f"_c_{n}")).alias(n) for n in lasts]
    return j.select(*(here[c] for c in df.columns), *out)


def carried_forward(df: DataFrame, value: str, order: list[str], by: list[str] | None = None, name: str = "carried", nulls_last: bool = True, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The last known value up to each row; NULL before the first one. Rows without an order come last."""
    return running(df, by or [], order, lasts={name: F.col(value)}, nulls_last=nulls_last, slice_rows=slice_rows)


def camera_track(pans: DataFrame, lat0: float, lng0: float, m_per_px: Column, by: list[str] | None = None, order: str = "seq", dx: str = "dx", dy: str = "dy", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Where the camera is after each pan. The map moves against the gesture; a step in longitude uses the latitude before it."""
    by, step = by or [], F.col(dy) * m_per_px / M_PER_DEG_LAT
    lat = running(pans, by, [order], sums={"_lat": step}, slice_rows=slice_rows).withColumn("cam_lat", F.lit(lat0) + F.col("_lat"))
    before = F.col("cam_lat") - step
    east = lat.withColumn("_step", -F.col(dx) * m_per_px / (M_PER_DEG_LNG * F.cos(F.radians(before))))
    return running(east, by, [order], sums={"_lng": F.col("_step")}, slice_rows=slice_rows).withColumn("cam_lng", F.lit(lng0) + F.col("_lng")).drop("_step", "_lat", "_lng")


def running_ratio(df: DataFrame, measured: str, asked: str, order: str, by: list[str] | None = None, least: float = 60, low: float = 0.8, high: float = 1.4, name: str = "ratio", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Sum of measured over sum of asked movements of at least `least` before each row, clamped; 1 where there is none."""
    use = F.col(measured).isNotNull() & (F.abs(asked) >= least)
    m, a = F.when(use, F.abs(measured).cast("double")).otherwise(0.0), F.when(use, F.abs(asked).cast("double")).otherwise(0.0)
    run = running(df, by or [], [order], sums={"_m": m, "_a": a}, slice_rows=slice_rows)
    ratio = F.try_divide(F.col("_m") - m, F.col("_a") - a)
    # greatest and least pass over NULL, so what has no ratio is told apart first.
    return run.withColumn("_q", ratio).withColumn(name, F.when(F.col("_q").isNull(), 1.0).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), F.col("_q"))))).drop("_m", "_a", "_q")


def streaks(df: DataFrame, bad: Column, order: list[str], by: list[str] | None = None, name: str = "streak", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Length of the unbroken run of `bad` rows that ends at each row; 0 on a good row."""
    by = by or []
    counted = running(df.withColumn("_good", ~F.coalesce(bad, F.lit(False))), by, order, sums={"_at": F.lit(1)}, slice_rows=slice_rows)
    last = running(counted, by, order, lasts={"_from": F.when(F.col("_good"), F.col("_at"))}, slice_rows=slice_rows)
    return last.withColumn(name, F.col("_at") - F.coalesce("_from", F.lit(0))).drop("_good", "_at", "_from")


def rolling_count(df: DataFrame, seconds_col: Column, width: int, by: list[str] | None = None, name: str = "recent", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Rows within the last `width` seconds up to each row, both ends included.

    In a key that is cut into slices, each slice also sees the counts by second of the `width` seconds before it.
    """
    by = by or []
    rows = df.withColumn("_s", seconds_col)
    # Rows of one second have the same answer: the count by second is what the window runs over.
    per = rows.groupBy(*by, "_s").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by, F.expr("_part")).orderBy("_s").rangeBetween(-width, 0)
    size = F.lit(max(width, 1))
    block = F.floor(F.col("_s") / size)
    both = per.withColumn("_part", block).withColumn("_own", F.lit(True)).unionByName(per.withColumn("_part", block + 1).withColumn("_own", F.lit(False)))
    counts = both.withColumn(name, F.sum("_n").over(w)).where("_own").select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col("_s").alias("_ks"), name)
    on = rows["_s"].eqNullSafe(counts["_ks"])
    for i, c in enumerate(by):
        on = on & rows[c].eqNullSafe(counts[f"_k{i}"])
    return rows.join(counts, on).select(*(rows[c] for c in df.columns), counts[name])


def activation_windows(df: DataFrame, by: str, seconds: str, width: float = 3600.0) -> DataFrame:
    """(by, started, events): windows that begin with the first event after the one before has run out; `seconds` is a number.

    Not aligned to the clock, so `window()` can't say it; each key's times are scanned in order. The times of a key stream in
    sorted batches, so a hot key needs no more memory than a batch.
    """
    from collections.abc import Iterator

    kind = df.schema[by].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, n = None, None, 0
        for p in parts:
            out = []
            for k, t in zip(p["k"], p["t"]):
                if start is None or k != key or t - start >= width:
                    if start is not None:
                        out.append((key, start, n))
                    key, start, n = k, t, 0
                n += 1
            yield pd.DataFrame(out, columns=[by, "started", "events"])
        if start is not None:
            yield pd.DataFrame([(key, start, n)], columns=[by, "started", "events"])

    rows = df.where(F.col(by).isNotNull() & F.col(seconds).isNotNull()).select(F.col(by).alias("k"), F.col(seconds).cast("double").alias("t"))
    return rows.repartition("k").sortWithinPartitions("k", "t").mapInPandas(run, f"{by} {kind}, started double, events long")


def live_entries(df: DataFrame, fetched: Column, now: Column, ttl_s: float, forever: Column | None = None) -> Column:
    """Whether a cache entry may still be used: younger than its time to live, or of a source that does not expire."""
    fresh = F.coalesce((now - fetched) < ttl_s, F.lit(False))
    return (F.coalesce(forever, F.lit(False)) | fresh) if forever is not None else fresh
