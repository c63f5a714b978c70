"""Summaries of a stage's rows, choices among candidates, and notes as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lokalis.functions.geo import MAP_CENTRE, degrees_lat, degrees_lng
from lokalis.operators.sets import top_rows


def split_summary(rows: DataFrame, keep: str, reason: str, flag: str) -> DataFrame:
    """(level, keep, reason, flag, n): counts of kept and excluded rows, by reason, and flags, in one pass over grouping sets."""
    sets = rows.groupingSets([[F.col(keep)], [F.col(keep), F.col(reason)], [F.col(keep), F.col(flag)]], F.col(keep), F.col(reason), F.col(flag))
    got = sets.agg(F.count("*").alias("n"), F.grouping(reason).alias("_r"), F.grouping(flag).alias("_f"))
    level = F.when((F.col("_r") == 1) & (F.col("_f") == 1), "all").when(F.col("_f") == 1, "reason").otherwise("flag")
    return got.select(level.alias("level"), F.col(keep).alias("keep"), F.col(reason).alias("reason"), F.col(flag).alias("flag"), "n")


def export_summary(rows: DataFrame, derived: list[str]) -> DataFrame:
    """(placemarks, unplaced, credit): rows with and without a point, and whether a point comes from a source that wants credit."""
    placed = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    return rows.agg(F.count_if(placed).alias("placemarks"), F.count_if(~placed).alias("unplaced"), F.coalesce(F.bool_or(placed & F.col("geo_source").isin(derived)), F.lit(False)).alias("credit"))


def tally(rows: DataFrame, status: str, blank: str = "unchecked", by: list[str] | None = None) -> DataFrame:
    """(by, status, n): rows by status, '' and NULL as `blank`."""
    s = F.coalesce(F.nullif(F.col(status), F.lit("")), F.lit(blank))
    return rows.groupBy(*(by or []), s.alias(status)).agg(F.count("*").alias("n"))


def progress(journal: DataFrame, totals: DataFrame, by: str, status: str = "status", ok: str = "ok") -> DataFrame:
    """(by, total, ok, failed, done): a stage is done when as many entries are ok as there are rows, and there are some."""
    n = journal.groupBy(by).agg(F.count_if(F.col(status) == ok).alias("ok"), F.count_if(~F.coalesce(F.col(status) == ok, F.lit(False))).alias("failed"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return totals.join(n, by, "left").select(by, "total", z("ok").alias("ok"), z("failed").alias("failed"), ((F.col("total") > 0) & (z("ok") >= F.col("total"))).alias("done"))


def next_stage(stages: DataFrame, by: list[str], stage: str = "stage", position: str = "pos", done: str = "done") -> DataFrame:
    """(by, stage): the first stage that is not done; no row where all are."""
    return stages.where(~F.coalesce(F.col(done), F.lit(False))).groupBy(*by).agg(F.min_by(stage, position).alias(stage))


def known_centre(points: DataFrame, by: list[str], m_per_px: Column, x: str = "x", y: str = "y", lat: str = "lat", lng: str = "lng") -> DataFrame:
    """(by, centre_lat, centre_lng) of a screen with points of known places: the mean latitude first, then the mean longitude at it."""
    at_lat = points.groupBy(*by).agg(F.avg(F.col(lat) + degrees_lat(F.col(y) - MAP_CENTRE[1], m_per_px)).alias("centre_lat"))
    j = points.join(at_lat, by)
    return j.groupBy(*by, "centre_lat").agg(F.avg(F.col(lng) - degrees_lng(F.col(x) - MAP_CENTRE[0], m_per_px, F.col("centre_lat"))).alias("centre_lng"))


def worst_offenders(rows: DataFrame, km: Column, key: str, n: int = 5) -> DataFrame:
    """(key, km) of the `n` farthest rows, the distance rounded to whole kilometres; `n` is the feature."""
    return rows.where(km.isNotNull()).select(key, km.alias("km")).orderBy(F.desc("km"), key).limit(n).select(key, F.round("km", 0).alias("km"))


def prominent_names(rows: DataFrame, name: str, order: list[str], limit: int = 60) -> DataFrame:
    """The first `limit` distinct names in an order, case ignored; `limit` is the feature."""
    first = rows.where(F.trim(name) != "").groupBy(F.lower(name).alias("_k")).agg(F.min_by(name, F.struct(*order)).alias(name), F.min(F.struct(*order)).alias("_o"))
    return first.orderBy("_o", "_k").limit(limit).select(name)


def clear_origin(pins: DataFrame, by: list[str], dx: int, dy: int, bounds: tuple[int, int, int, int], step: int = 50) -> DataFrame:
    """(by, x, y): where a gesture (dx, dy) begins farthest from all pins; the first grid place of the best.

    bounds: left, top, right, bottom, which begin and end of the gesture keep to. The grid is a fixed list of places, so each pin
    meets them as an array, and minima are taken before the shuffle.
    """
    left, top, right, bottom = bounds
    inside = lambda x, y: left <= x <= right and top <= y <= bottom
    grid = [(x, y) for y in range(top, bottom + 1, step) for x in range(left, right + 1, step) if inside(x + dx, y + dy)]
    if not grid:
        raise ValueError("the gesture does not fit into the bounds")
    places = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(x).alias("gx"), F.lit(y).alias("gy")) for n, (x, y) in enumerate(grid)))
    d2 = F.min(F.pow(F.col("x") - F.col("g.gx"), 2) + F.pow(F.col("y") - F.col("g.gy"), 2)).alias("d2")
    near = pins.select(*by, "x", "y", F.explode(places).alias("g")).groupBy(*by, "g").agg(d2)
    return near.groupBy(*by).agg(F.max_by("g", F.struct("d2", -F.col("g.n"))).alias("g")).select(*by, F.col("g.gx").alias("x"), F.col("g.gy").alias("y"))


def accounted(pans: DataFrame, measured: str, asked: str, ratio: str = "ratio") -> Column:
    """What a pan is taken to have moved: what was measured, else what was asked for times the ratio so far."""
    return F.coalesce(F.col(measured).cast("double"), F.col(asked) * F.col(ratio))


def gated(moved: DataFrame, least: int = 6) -> DataFrame:
    """Displacements (dx, dy, shared) that fewer than `least` names share are unknown."""
    ok = F.col("shared") >= least
    return moved.withColumns({"dx": F.when(ok, F.col("dx")), "dy": F.when(ok, F.col("dy"))})


def note_line(total: Column, uniques: Column, monthly: Column, rank: Column | None = None, as_of: Column | None = None, label: str = "") -> Column:
    """`label #rank | N check-ins | N unique | N/month | as of D`: what is known of it, '' without any count."""
    n = lambda c, s: F.when(c.isNotNull(), F.concat(F.format_number(c, 0), F.lit(s)))
    none = F.lit(None).cast("string")
    head = F.nullif(F.concat_ws(" ", F.nullif(F.lit(label), F.lit("")), F.when(rank.isNotNull(), F.concat(F.lit("#"), rank.cast("string"))) if rank is not None else none), F.lit(""))
    line = F.concat_ws(" | ", head, n(total, " check-ins"), n(uniques, " unique"), n(monthly, "/month"), F.concat(F.lit("as of "), as_of.cast("string")) if as_of is not None else none)
    return F.when(F.coalesce(total, uniques, monthly).isNull(), F.lit("")).otherwise(line)


def ranked(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group with their `rank`."""
    return top_rows(rows, by, order, most, "rank")


def as_venues(swept: DataFrame) -> DataFrame:
    """Swept rows (name, lat, lng) as venues: what a map does not tell is unknown."""
    none = {c: F.lit(None).cast(t) for t, cs in (("string", ("category", "address", "city")), ("bigint", ("total", "unique", "monthly", "you"))) for c in cs}
    placed = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    return swept.withColumns({"venue_id": F.lit(""), **none, "lat": F.when(placed, F.col("lat")), "lng": F.when(placed, F.col("lng")), "geo_source": F.when(placed, "app").otherwise("none"), "business_status": F.lit("")})
