"""Points near points or inside regions: Z-order cell codes, discs and boxes covered by code ranges, a range join on
sorted codes, exact refinement.

A disc or box is covered by at most 3 x 3 cells of the level that fits it; each cell is one range of codes. Points meet the ranges
of a level in the cell of that level they lie in. Cells go to buckets by hash, so a bucket holds about the same number of rows
however dense a town is; inside a bucket both sides are sorted by code and joined by binary search, and candidates are refined
with the exact distance. Nothing about cells is held by the driver but the levels in use. A cell with more than twice
`BUCKET_ROWS` points has its points split over salts, each point in one of them, and its ranges repeated in each; what is in one
cell of a disc's level is nearly all within its reach, so the repeated ranges are few beside the pairs that come out.

A pair is looked for from the point of the smaller code only. Rows of one group at one place are one point until the pairs are
found, as they make none among themselves.

Rows without a usable point (NULL, NaN, (0, 0), |lat| > 90, |lng| > 180) take no part. Extra columns are ignored; ids may be
repeated and are then treated as separate rows, which make no pair with each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lokalis.runtime import cut, parallelism, sent, ship

EARTH_M = 6_371_008.8
BITS = 26  # cells of about 0.8 m; a code has 52 bits
BUCKET_ROWS = 40_000


def usable_point(lat, lng):
    """A coordinate pair that is a place: known, in range and not the (0, 0) placeholder."""
    return (
        lat.isNotNull() & lng.isNotNull() & ~F.isnan(lat) & ~F.isnan(lng)
        & (F.abs(lat) <= 90) & (F.abs(lng) <= 180) & ~((lat == 0) & (lng == 0))
    )


def great_circle_m(lat1, lng1, lat2, lng2, radius_m: float = EARTH_M):
    """Haversine distance as a column expression."""
    h = (
        F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    )
    return F.lit(2 * radius_m) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def great_circle_np(lat1, lng1, lat2, lng2, radius_m: float = EARTH_M):
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lng2 - lng1) / 2) ** 2
    return 2 * radius_m * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def _spread(v: np.ndarray) -> np.ndarray:
    """Put a zero bit between the bits of `v`."""
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


def interleave(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (_spread(x) | (_spread(y) << np.uint64(1))).astype(np.int64)


def grid(lat: np.ndarray, lng: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << BITS
    x = np.floor((np.asarray(lng, float) + 180) / 360 * n).astype(np.int64) % n
    y = np.clip(np.floor((np.asarray(lat, float) + 90) / 180 * n).astype(np.int64), 0, n - 1)
    return x, y


def cell_codes(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    """Z-order code of each point's finest cell."""
    return interleave(*grid(lat, lng))


def cover_cells(south, north, west, east) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells that cover boxes: for each box those of the largest level at which it spans at most 3 x 3 of them.

    West may exceed east (the box crosses the antimeridian). Returns (row number, level, cell); a cell of level l holds the codes
    from cell << 2l up to the next cell.
    """
    n = 1 << BITS
    x0, y0 = grid(south, west)
    x1, y1 = grid(north, east)
    full = np.asarray(east, float) - np.asarray(west, float) >= 360
    x0, x1 = np.where(full, 0, x0), np.where(full, n - 1, x1)
    wide = (x1 - x0) % n
    span = np.maximum(np.maximum(wide, y1 - y0), 1)
    level = np.clip(np.ceil(np.log2(span / 2.0)).astype(np.int64), 0, BITS)  # side of 2**level finest cells
    rows, cells = [], []
    side = n >> level  # cells of a side of the world at that level
    cx0, cy0, cy1 = x0 >> level, y0 >> level, y1 >> level
    nx = np.minimum(((x0 & ((1 << level) - 1)) + wide >> level) + 1, side)
    ny = cy1 - cy0 + 1
    for dx in range(int(nx.max(initial=0))):
        for dy in range(int(ny.max(initial=0))):
            use = np.nonzero((dx < nx) & (dy < ny))[0]
            if len(use):
                rows.append(use), cells.append(interleave((cx0[use] + dx) % side[use], cy0[use] + dy))
    if not rows:
        return (np.empty(0, np.int64),) * 3
    row, cell = np.concatenate(rows), np.concatenate(cells)
    return row, level[row], cell


def cover_boxes(south, north, west, east) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code ranges [lo, hi) that cover boxes (row number, lo, hi); cells of a box that follow each other come as one range."""
    row, level, cell = cover_cells(south, north, west, east)
    if not len(row):
        return (np.empty(0, np.int64),) * 3
    lo, hi = cell << (2 * level), (cell + 1) << (2 * level)
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (lo[1:] != hi[:-1])
    last = np.append(first[1:], True)
    return row[first], lo[first], hi[last]


def disc_boxes(lat, lng, radius_m):
    """South, north, west, east of the discs; a disc that holds a pole spans all longitudes."""
    lat, lng, r = np.asarray(lat, float), np.asarray(lng, float), np.asarray(radius_m, float) * (1 + 1e-9) / EARTH_M
    d = np.degrees(r)
    south, north = lat - d, lat + d
    ratio = np.sin(np.minimum(r, np.pi / 2)) / np.maximum(np.cos(np.radians(lat)), 1e-12)
    polar = (north >= 90) | (south <= -90) | (ratio >= 1)
    w = np.where(polar, 180.0, np.degrees(np.arcsin(np.minimum(ratio, 1))))
    west, east = np.where(polar, -180.0, (lng - w + 180) % 360 - 180), np.where(polar, 180.0, (lng + w + 180) % 360 - 180)
    return np.maximum(south, -90), np.minimum(north, 90), west, np.where(polar, 180.0 + 1e-9, east)


PLACE = "id long, grp string, south double, west double, north double, east double"  # a point has its place in south and west
CODED = PLACE + ", code long, level int"
MET = "side int, level int, cell long, code long, " + PLACE


def _usable(points: DataFrame, id_col: str, lat: str, lng: str, group: str | None = None) -> DataFrame:
    """(id, grp, lat, lng) of the usable points."""
    return points.where(usable_point(F.col(lat), F.col(lng))).select(
        F.col(id_col).cast("long").alias("id"), (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("grp"),
        F.col(lat).cast("double").alias("lat"), F.col(lng).cast("double").alias("lng"),
    )


def _coded(points: DataFrame, radius_m: float | None = None) -> DataFrame:
    """Points with their codes and, with a radius, the level that their disc is covered at."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            level = np.full(len(p), -1)
            if radius_m is not None:
                row, lv, _ = cover_cells(*disc_boxes(p.south, p.west, np.full(len(p), float(radius_m))))
                level[row] = lv
            yield p.assign(code=cell_codes(p.south.to_numpy(), p.west.to_numpy()), level=level)

    none = F.lit(None).cast("double")
    return points.select("id", "grp", F.col("lat").alias("south"), F.col("lng").alias("west"), none.alias("north"), none.alias("east")).mapInPandas(run, CODED)


def _side(p: pd.DataFrame, side: int, row: np.ndarray, level: np.ndarray, cell: np.ndarray, code: np.ndarray) -> pd.DataFrame:
    out = p[["id", "grp", "south", "west", "north", "east"]].iloc[row].reset_index(drop=True)
    for n, (name, v) in enumerate((("side", side), ("level", level), ("cell", cell), ("code", code))):
        out.insert(n, name, v)
    return out


def _points_at(p: pd.DataFrame, levels: list[int]) -> Iterator[pd.DataFrame]:
    """The points in their cells of the levels in use."""
    code, row = p.code.to_numpy(), np.arange(len(p))
    for lv in levels:
        yield _side(p, 0, row, np.full(len(p), lv), code >> (2 * lv), code)


def _chunks(a: np.ndarray, b: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(range row, point row) pairs in chunks of bounded size, however many there are."""
    n = b - a
    for i in range(len(a)):
        if n[i] > most:  # one range over very many points
            for s in range(a[i], b[i], most):
                pt = np.arange(s, min(s + most, b[i]))
                yield np.full(len(pt), i), pt
            n[i] = 0
    ends = np.cumsum(n)
    start, done = 0, 0
    while start < len(a):
        stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        k = n[start:stop]
        total = int(k.sum())
        if total:
            rows = np.repeat(np.arange(start, stop), k)
            offs = np.arange(total) - np.repeat(np.cumsum(k) - k, k)
            yield rows, np.repeat(a[start:stop], k) + offs
        done, start = int(ends[stop - 1]), stop


def _meet(both: DataFrame, counts: DataFrame, n_rows: int, rows_each: int, match, schema: str) -> DataFrame:
    """Rows of `MET` in buckets of cells; `counts`: (level, cell, n) of the cells with more than twice `rows_each` points."""
    few = counts.select("level", "cell", F.ceil(F.col("n") / rows_each).cast("int").alias("salts"))
    placed = both.join(sent(few), ["level", "cell"], "left").na.fill(1, ["salts"])
    every = F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda k: k.cast("int"))
    placed = placed.withColumn("salt", F.explode(F.when(F.col("side") == 0, F.array(F.pmod(F.xxhash64("id", "code"), F.col("salts")).cast("int"))).otherwise(every)))
    buckets = max(parallelism(both.sparkSession), n_rows // rows_each + 1)
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("level", "cell", "salt"), F.lit(buckets))).drop("cell", "salts")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple[Any, ...], parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pd.concat(list(parts))
        for (level, _), g in p.groupby(["level", "salt"]):
            pts, rng = g[g.side == 0].sort_values("code", kind="stable"), g[g.side == 1]
            if not len(pts) or not len(rng):
                continue
            width = np.int64(1) << (2 * int(level))
            lo, at = rng.code.to_numpy(), pts.code.to_numpy()
            a, b = np.searchsorted(at, lo, "left"), np.searchsorted(at, (lo // width + 1) * width, "left")
            yield from (x[names] for x in match(a, b, pts, rng))

    return placed.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(run, schema)


def pairs_within(points: DataFrame, radius_m: float, id_col: str = "id", lat: str = "lat", lng: str = "lng", group: str | None = None, rows_each: int = BUCKET_ROWS) -> DataFrame:
    """All pairs (id_a < id_b, metres) of rows at most `radius_m` apart; with `group`, only rows of different groups.

    A NULL group never equals another.
    """
    spark = points.sparkSession
    ship(spark)
    src = _usable(points, id_col, lat, lng, group)
    if group:
        same = ["grp", "lat", "lng"]
        alone = F.when(F.col("grp").isNull(), F.col("id")).alias("alone")
        spots = src.groupBy(*same, alone).agg(F.min("id").alias("id"), F.count("*").alias("n"))
        spots = cut(spots)
        found = _pairs(spots.select("id", *same), radius_m, group, rows_each)
        if not spots.where("n > 1").limit(1).count():
            return found
        # Only spots of several rows are expanded; the others stand for themselves.
        shared = spots.where("n > 1 and alone is null").selectExpr("grp as g", "lat as la", "lng as lo", "id as spot")
        of = src.join(shared, (F.col("grp") == F.col("g")) & (F.col("lat") == F.col("la")) & (F.col("lng") == F.col("lo"))).select("spot", F.col("id").alias("row"))
        one, two = of.select(F.col("spot").alias("id_a"), F.col("row").alias("row_a")), of.select(F.col("spot").alias("id_b"), F.col("row").alias("row_b"))
        out = found.join(one, "id_a", "left").join(two, "id_b", "left").select(F.coalesce("row_a", "id_a").alias("a"), F.coalesce("row_b", "id_b").alias("b"), "metres")
        return out.where("a <> b").select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "metres")
    return _pairs(src, radius_m, group, rows_each)


def _pairs(src: DataFrame, radius_m: float, group: str | None, rows_each: int) -> DataFrame:
    pts = cut(_coded(src, radius_m))
    levels = sorted(r["level"] for r in pts.select("level").distinct().collect())  # at most BITS + 1
    n = pts.count()
    at = pts.select("code", F.explode(F.array(*(F.lit(v).cast("int") for v in levels)) if levels else F.array().cast("array<int>")).alias("level"))
    counts = at.groupBy("level", F.expr("shiftright(code, 2 * level)").alias("cell")).agg(F.count("*").alias("n")).where(F.col("n") > 2 * rows_each)

    def both(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p = p.reset_index(drop=True)
            yield from _points_at(p, levels)
            row, level, cell = cover_cells(*disc_boxes(p.south, p.west, np.full(len(p), float(radius_m))))
            own = p.code.to_numpy()[row]
            use = (cell + 1) << (2 * level) > own  # codes below its own are another point's to find
            row, level, cell, own = row[use], level[use], cell[use], own[use]
            yield _side(p, 1, row, level, cell, np.maximum(cell << (2 * level), own))

    def match(a: np.ndarray, b: np.ndarray, q: pd.DataFrame, rng: pd.DataFrame) -> Iterator[pd.DataFrame]:
        qi, qa, qo, qc = q.id.to_numpy(), q.south.to_numpy(), q.west.to_numpy(), q.code.to_numpy()
        ri, ra, ro = rng.id.to_numpy(), rng.south.to_numpy(), rng.west.to_numpy()
        rc = cell_codes(ra, ro)
        known = pd.factorize(pd.concat([q.grp, rng.grp]))[0]  # -1: no group
        qg, rg = known[: len(q)], known[len(q) :]
        for r, k in _chunks(a, b):
            keep = (qc[k] > rc[r]) | (qi[k] > ri[r])  # of two points of one code the smaller id looks
            keep &= qi[k] != ri[r]
            if group:
                keep &= (rg[r] < 0) | (rg[r] != qg[k])
            r, k = r[keep], k[keep]
            m = great_circle_np(ra[r], ro[r], qa[k], qo[k])
            near = m <= radius_m
            one, two = ri[r][near], qi[k][near]
            yield pd.DataFrame({"id_a": np.minimum(one, two), "id_b": np.maximum(one, two), "metres": m[near]})

    return _meet(pts.mapInPandas(both, MET), counts, n * max(1, len(levels)), rows_each, match, "id_a long, id_b long, metres double")


def points_in_boxes(points: DataFrame, boxes: DataFrame, id_col: str = "id", lat: str = "lat", lng: str = "lng", box_id: str = "box_id", rows_each: int = BUCKET_ROWS) -> DataFrame:
    """(id, box_id) for each point inside a box south <= lat <= north, west <= lng <= east (borders count).

    `boxes` has box_id, south, north, west, east; west > east crosses the antimeridian; a box with a NULL bound or
    south > north holds nothing.
    """
    ship(points.sparkSession)
    pts = cut(_coded(_usable(points, id_col, lat, lng)))
    src = boxes.where(F.col("south") <= F.col("north")).where(F.col("west").isNotNull() & F.col("east").isNotNull()).select(
        F.col(box_id).cast("long").alias("id"), F.lit(None).cast("string").alias("grp"), *(F.col(c).cast("double").alias(c) for c in ("south", "west", "north", "east")),
    )

    def covers(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p = p.reset_index(drop=True)
            row, level, cell = cover_cells(p.south, p.north, p.west, p.east)
            yield _side(p, 1, row, level, cell, cell << (2 * level))

    ranges = cut(src.mapInPandas(covers, MET))
    levels = sorted(r["level"] for r in ranges.select("level").distinct().collect())  # at most BITS + 1
    n = pts.count()
    at = pts.select("code", F.explode(F.array(*(F.lit(v).cast("int") for v in levels)) if levels else F.array().cast("array<int>")).alias("level"))
    counts = at.groupBy("level", F.expr("shiftright(code, 2 * level)").alias("cell")).agg(F.count("*").alias("n")).where(F.col("n") > 2 * rows_each)

    def placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield from _points_at(p.reset_index(drop=True), levels)

    def match(a: np.ndarray, b: np.ndarray, q: pd.DataFrame, rng: pd.DataFrame) -> Iterator[pd.DataFrame]:
        qi, qa, qo, ri = q.id.to_numpy(), q.south.to_numpy(), q.west.to_numpy(), rng.id.to_numpy()
        s, w, n_, e = (rng[c].to_numpy() for c in ("south", "west", "north", "east"))
        for r, k in _chunks(a, b):
            x = qo[k]
            inside = (qa[k] >= s[r]) & (qa[k] <= n_[r]) & np.where(w[r] <= e[r], (x >= w[r]) & (x <= e[r]), (x >= w[r]) | (x <= e[r]))
            yield pd.DataFrame({"id": qi[k][inside], "box_id": ri[r][inside]})

    return _meet(pts.mapInPandas(placed, MET).unionByName(ranges), counts, n * max(1, len(levels)), rows_each, match, "id long, box_id long")
