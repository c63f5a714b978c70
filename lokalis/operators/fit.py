"""Fits of positions: axis-wise lines, least-squares similarity, consensus with gates, and the correction of drifting cells."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lokalis.functions.geo import from_local, to_local
from lokalis.operators.aggregates import agreed_offsets
from lokalis.operators.sequences import carried_forward
from lokalis.runtime import ship, spread

MIN_MATCHES, AGREE_M = 4, 60.0
OUTLIER_TIMES, OUTLIER_FLOOR = 3.0, 60.0
MAX_MEDIAN_M, MAX_ROTATION, SCALES = 75.0, 3.0, (0.25, 4.0)
MAX_PAIRS = 2_000  # matched points up to which one task tries all pairs


def axis_lines(df: DataFrame, by: list[str], x: str = "x", y: str = "y", lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Two independent lines, x to lng and y to lat; NULL with fewer than two points or no spread."""
    return df.groupBy(*by).agg(
        F.regr_slope(lng, x).alias("lng_per_x"), F.regr_intercept(lng, x).alias("lng_at_zero"),
        F.regr_slope(lat, y).alias("lat_per_y"), F.regr_intercept(lat, y).alias("lat_at_zero"),
    )


def similarity(df: DataFrame, by: list[str], sx: str, sy: str, dx: str, dy: str) -> DataFrame:
    """z -> a z + b by least squares in closed form: (by, n, a_re, a_im, b_re, b_im); NULL where all sources coincide.

    Two aggregations that combine in each task: means, then centred sums.
    """
    mean = df.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"_m{i}") for i, c in enumerate((sx, sy, dx, dy))))
    j = df.join(mean, by) if by else df.crossJoin(F.broadcast(mean))  # a single row
    a, b, u, v = (F.col(c) - F.col(f"_m{i}") for i, c in enumerate((sx, sy, dx, dy)))
    s = j.groupBy(*by, "n", "_m0", "_m1", "_m2", "_m3").agg(F.sum(a * a + b * b).alias("_d"), F.sum(u * a + v * b).alias("_p"), F.sum(v * a - u * b).alias("_q"))
    ok = F.col("_d") > 1e-9
    re, im = F.when(ok, F.col("_p") / F.col("_d")), F.when(ok, F.col("_q") / F.col("_d"))
    return s.select(*by, "n", re.alias("a_re"), im.alias("a_im"), (F.col("_m2") - re * F.col("_m0") + im * F.col("_m1")).alias("b_re"), (F.col("_m3") - im * F.col("_m0") - re * F.col("_m1")).alias("b_im"))


def best_pair(src: np.ndarray, dst: np.ndarray, firsts: np.ndarray, agree: float = AGREE_M) -> tuple[int, float, float, float, int, int]:
    """(points explained, their error, re and im of the factor, first, second) of the best similarity through a point of `firsts` and a later one."""
    n, best = len(src), (0, 0.0, 1.0, 0.0, -1, -1)
    rows = max(1, 1_000_000 // max(n, 1))  # pairs scored at once
    for i in firsts.tolist():
        later = i + 1 + np.nonzero(np.abs(src[i + 1 :] - src[i]) > 1e-9)[0]
        for at in range(0, len(later), rows):
            j = later[at : at + rows]
            a = (dst[j] - dst[i]) / (src[j] - src[i])
            err = np.abs(a[:, None] * src[None, :] + (dst[i] - a * src[i])[:, None] - dst[None, :])
            near = err <= agree
            count, total = near.sum(1), np.where(near, err, 0).sum(1)
            k = np.lexsort((total, -count))[0]
            if (count[k], -total[k]) > (best[0], -best[1]):
                best = (int(count[k]), float(total[k]), float(a[k].real), float(a[k].imag), i, int(j[k]))
    return best


def explained(src: np.ndarray, dst: np.ndarray, best: tuple, agree: float = AGREE_M) -> np.ndarray:
    """Mask of the points that the similarity of `best_pair` explains; all where there was no pair."""
    if best[4] < 0:
        return np.ones(len(src), bool)
    a, i = complex(best[2], best[3]), best[4]
    return np.abs(a * src + (dst[i] - a * src[i]) - dst) <= agree


def consensus(src: np.ndarray, dst: np.ndarray, agree: float = AGREE_M) -> np.ndarray:
    """Mask of the largest set of points that one similarity through two of them explains; ties go to the smaller error."""
    return explained(src, dst, best_pair(src, dst, np.arange(len(src)), agree), agree)


def robust_similarity(src: np.ndarray, dst: np.ndarray, agreed: np.ndarray | None = None) -> dict[str, Any]:
    """Consensus (or the one found before), least squares, removal of the worst point while it is far off, and the gates; `problem` is '' for a good fit."""
    if len(src) < MIN_MATCHES:
        return {"problem": f"{len(src)} matches"}
    keep = np.nonzero(consensus(src, dst) if agreed is None else agreed)[0]
    if len(keep) < MIN_MATCHES:
        return {"problem": f"{len(keep)} matches agree"}
    while True:
        s, d = src[keep], dst[keep]
        sc, dc = s - s.mean(), d - d.mean()
        den = float((np.abs(sc) ** 2).sum())
        if den <= 1e-9:
            return {"problem": "all matches at one place"}
        a = (dc * sc.conj()).sum() / den
        b = d.mean() - a * s.mean()
        res = np.abs(a * s + b - d)
        w = int(res.argmax())
        if len(keep) <= MIN_MATCHES or res[w] <= max(OUTLIER_TIMES * float(np.median(res)), OUTLIER_FLOOR):
            break
        keep = np.delete(keep, w)
    rotation, median = math.degrees(math.atan2(a.imag, a.real)), float(np.median(res))
    bad = [t for t, x in ((f"median error {median:.0f} m", median > MAX_MEDIAN_M), (f"rotation {rotation:.1f} degrees", abs(rotation) > MAX_ROTATION), (f"scale {abs(a):.2f}", not SCALES[0] <= abs(a) <= SCALES[1])) if x]
    return {"a_re": a.real, "a_im": a.imag, "b_re": b.real, "b_im": b.imag, "inliers": len(keep), "median_m": median, "problem": ", ".join(bad)}


FIT = "a_re double, a_im double, b_re double, b_im double, inliers long, median_m double, problem string"


def robust_fits(pairs: DataFrame, by: str, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """One robust similarity for each group of matched points (sx, sy) -> (dx, dy) in metres.

    The pairs of a group of more than `max_pairs` points are tried in blocks by their first point, each in its own task with the
    group's points (32 bytes each) beside it; the best of all blocks is the group's. All pairs are tried against all points, so
    the time grows with the third power of a group's points.
    """
    kind = pairs.schema[by].dataType.simpleString()
    points = pairs.select(by, "sx", "sy", "dx", "dy")

    def ends(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        p = p.sort_values(["sx", "sy", "dx", "dy"])  # the same order in every block
        return p.sx.to_numpy() + 1j * p.sy.to_numpy(), p.dx.to_numpy() + 1j * p.dy.to_numpy()

    def row(key: Any, got: dict[str, Any]) -> pd.DataFrame:
        return pd.DataFrame([{by: key, **{c.split()[0]: got.get(c.split()[0]) for c in FIT.split(", ")}}])

    def run(key: tuple[Any, ...], p: pd.DataFrame) -> pd.DataFrame:
        return row(key[0], robust_similarity(p.sx.to_numpy() + 1j * p.sy.to_numpy(), p.dx.to_numpy() + 1j * p.dy.to_numpy()))

    # Few, as each holds more than `max_pairs` rows.
    large = [(r[by], -(-r["count"] * r["count"] // (max_pairs * max_pairs))) for r in points.groupBy(by).count().where(F.col("count") > max_pairs).collect()]
    if not large:
        return points.groupBy(by).applyInPandas(run, f"{by} {kind}, {FIT}")
    sizes = F.broadcast(points.sparkSession.createDataFrame(large, f"_g {kind}, _blocks long"))
    on = points[by].eqNullSafe(sizes["_g"])
    small, hot = points.join(sizes, on, "left_anti"), points.join(sizes, on).drop("_g")
    PAIR = "_count long, _error double, _re double, _im double, _i long, _j long"

    def search(key: tuple[Any, ...], p: pd.DataFrame) -> pd.DataFrame:
        src, dst = ends(p)
        best = best_pair(src, dst, np.arange(int(key[1]), len(src), int(p["_blocks"].iloc[0])))
        return pd.DataFrame([[key[0], *best]], columns=[by, *(c.split()[0] for c in PAIR.split(", "))])

    def finish(key: tuple[Any, ...], p: pd.DataFrame) -> pd.DataFrame:
        src, dst = ends(p)
        best = tuple(p[c.split()[0]].iloc[0] for c in PAIR.split(", "))
        return row(key[0], robust_similarity(src, dst, explained(src, dst, best)))

    blocks = spread(hot.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))), by, "_block")
    found = blocks.groupBy(by, "_block").applyInPandas(search, f"{by} {kind}, {PAIR}")
    order = F.struct(-F.col("_count"), "_error", "_i", "_j")
    best = found.groupBy(F.col(by).alias("_g")).agg(F.min_by(F.struct(*(c.split()[0] for c in PAIR.split(", "))), order).alias("_best"))
    whole = hot.join(best, hot[by].eqNullSafe(best["_g"])).select(by, "sx", "sy", "dx", "dy", "_best.*")
    return small.groupBy(by).applyInPandas(run, f"{by} {kind}, {FIT}").unionByName(whole.groupBy(by).applyInPandas(finish, f"{by} {kind}, {FIT}"))


def anchored_cells(swept: DataFrame, matched: DataFrame, lat0: Column, lng0: Column, by: list[str] | None = None) -> DataFrame:
    """Swept rows moved by their cell's measured shift, or by the last one measured before it; `anchor` says which.

    swept: by, cell, lat, lng; matched: by, cell, lat, lng, known_lat, known_lng. Cells go in order, rows without a cell last;
    before the first measurement nothing moves.
    """
    by = by or []
    p, q = to_local(F.col("lat"), F.col("lng"), lat0, lng0), to_local(F.col("known_lat"), F.col("known_lng"), lat0, lng0)
    off = matched.select(*by, "cell", (q["e"] - p["e"]).alias("de"), (q["n"] - p["n"]).alias("dn")).withColumn("_g", F.struct(*by, "cell"))
    shift = agreed_offsets(off, "_g", "de", "dn").select("_g.*", F.when(F.col("e").isNotNull(), F.struct("e", "n")).alias("shift"))
    cells = swept.select(*by, "cell").distinct()
    on = cells["cell"].eqNullSafe(shift["cell"])
    for c in by:
        on = on & cells[c].eqNullSafe(shift[c])
    measured = carried_forward(cells.join(shift, on, "left").select(*(cells[c] for c in by), cells["cell"], "shift"), "shift", ["cell"], by)
    state = F.when(F.col("shift").isNotNull(), "anchored").when(F.col("carried").isNotNull(), "carried").otherwise("unmeasured")
    track = measured.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("cell").alias("_cell"), F.col("carried").alias("_s"), state.alias("anchor"))
    on = swept["cell"].eqNullSafe(track["_cell"])
    for c in by:
        on = on & swept[c].eqNullSafe(track[f"_{c}"])
    j = swept.join(track, on)
    at = to_local(F.col("lat"), F.col("lng"), lat0, lng0)
    moved = from_local(at["e"] + F.col("_s.e"), at["n"] + F.col("_s.n"), lat0, lng0)
    j = j.withColumn("_p", F.when(F.col("_s").isNotNull() & F.col("lat").isNotNull(), moved))
    return j.withColumn("lat", F.coalesce("_p.lat", "lat")).withColumn("lng", F.coalesce("_p.lng", "lng")).drop("_p", "_s", "_cell", *(f"_{c}" for c in by))


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Indices of the corners of the convex hull, one row for each corner (monotone chain)."""
    order = np.lexsort((y, x))
    keep = np.ones(len(order), bool)
    keep[1:] = (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)
    order = order[keep]
    if len(order) < 3:
        return order
    at = list(zip(order.tolist(), x[order].tolist(), y[order].tolist()))

    def half(points: list[tuple]) -> list[int]:
        out: list[tuple] = []
        for p in points:
            while len(out) > 1 and (out[-1][1] - out[-2][1]) * (p[2] - out[-2][2]) - (out[-1][2] - out[-2][2]) * (p[1] - out[-2][1]) < 0:
                out.pop()
            out.append(p)
        return [i for i, _, _ in out]

    return np.unique(half(at) + half(at[::-1]))


def rim(x: np.ndarray, y: np.ndarray, e: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indices of the rows that can be an end of the farthest pair: corners of the hull, of a corner's rows those that span their metres."""
    corners = hull(x, y)
    place = pd.Series(np.arange(len(x))).groupby([x, y]).indices if len(corners) < len(x) else {}
    out = []
    for i in corners.tolist():
        same = place.get((x[i], y[i]), np.array([i]))
        out.append(same if len(same) < 3 else same[hull(e[same], n[same])])
    return np.concatenate(out) if out else np.empty(0, int)


def widest_scale(points: DataFrame, by: list[str], x: str = "x", y: str = "y", e: str = "e", n: str = "n") -> DataFrame:
    """(by, m_per_px): metres over pixels of the pair of known points farthest apart on the screen; of pairs equally far the most metres.

    The farthest pair are corners of the convex hull, so each batch of rows is cut to the hulls of its groups before the shuffle,
    and the corners of a group are paired, some at a time.
    """
    ship(points.sparkSession)
    cols = [F.col(c).cast("double").alias(k) for c, k in ((x, "_x"), (y, "_y"), (e, "_e"), (n, "_n"))]
    rows = points.select(*by, *cols).where("_x is not null and _y is not null and _e is not null and _n is not null")
    four = lambda t: [t.column(c).to_numpy(zero_copy_only=False) for c in ("_x", "_y", "_e", "_n")]

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = four(b)
            groups = pa.Table.from_batches([b]).select(by).append_column("_row", pa.array(np.arange(b.num_rows))).group_by(by).aggregate([("_row", "list")])
            at = [np.asarray(g) for g in groups.column("_row_list").to_pylist()]
            yield b.take(pa.array(np.concatenate([g[rim(*(c[g] for c in v))] for g in at] or [np.empty(0, int)]).astype(np.int64)))

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)

    def widest(key: tuple[Any, ...], p: pd.DataFrame) -> pd.DataFrame:
        a, b, u, v = (p[c].to_numpy() for c in ("_x", "_y", "_e", "_n"))
        a, b, u, v = (c[k] for k in [rim(a, b, u, v)] for c in (a, b, u, v))
        best = (0.0, 0.0)
        step = max(1, 1_000_000 // len(a))
        for i in range(0, len(a), step):
            px = np.hypot(a[i : i + step, None] - a, b[i : i + step, None] - b)
            m = np.hypot(u[i : i + step, None] - u, v[i : i + step, None] - v)
            best = max(best, (float(px.max()), float(m[px == px.max()].max())))
        return pd.DataFrame([[*key, best[1] / best[0] if best[0] >= 1 else None]], columns=[*by, "m_per_px"])

    found = rows.mapInArrow(corners, rows.schema).groupBy(*by).applyInPandas(widest, f"{kinds}, m_per_px double")
    groups, on = points.select(*by).distinct(), F.lit(True)
    for c in by:
        on = on & groups[c].eqNullSafe(found[c])
    return groups.join(found, on, "left").select(*(groups[c] for c in by), "m_per_px")
