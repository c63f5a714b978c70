"""Joins that decide: unambiguous keys, ranked name candidates verified by distance, shared shifts, surviving pins, resume filters."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lokalis.functions.geo import haversine_m, planar_offset
from lokalis.functions.text import calibration_keys, join_name, name_forms
from lokalis.runtime import cut, sent, ship, spread

NAME_MIN, MATCH_M, TRIES = 0.85, 1000.0, 2
BLOCK = 3_000  # names or refs of a group that one task compares at a time
LETTERS = 256  # columns of numbered letters
SHIFT_BAND = 0.12  # degrees; more than the farthest neighbour
SHIFT_NEED, SHIFT_AGREE_M, SHIFT_NEAR_M, SHIFT_MAX_M = 2, 100.0, 10_000.0, 5_000.0


def unambiguous(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_keys: Column, right_keys: Column) -> DataFrame:
    """(left_id, right_id) where the union of a left row's key hits is exactly one right row.

    One-sided: several left rows may have the same right row. The distinct hits are counted by their least and greatest id, so
    a key that many rows share is aggregated in each task before it is shuffled.
    """
    a = left.select(left_id, F.explode(left_keys).alias("_k")).distinct()
    b = right.select(right_id, F.explode(right_keys).alias("_k")).distinct()
    # Keys of several right rows stay as their least and greatest id: more than that is not needed to see ambiguity.
    span = b.groupBy("_k").agg(F.min(right_id).alias("_lo"), F.max(right_id).alias("_hi"))
    hits = a.join(span, "_k").groupBy(left_id).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    return hits.where("_lo = _hi").select(left_id, F.col("_lo").alias(right_id))


def match_known(swept: DataFrame, known: DataFrame, swept_id: str, known_id: str) -> DataFrame:
    """`unambiguous` on calibration keys, for swept rows with a point."""
    placed = swept.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    return unambiguous(placed, known, swept_id, known_id, calibration_keys(F.col("name")), calibration_keys(F.col("name")))


def _letters(forms: list[str], known: dict[tuple[str, int], int]) -> np.ndarray:
    """A row for each form with its letters, numbered among equal ones, in `LETTERS` columns; `known` gives them their columns."""
    at = [(n, known.setdefault((ch, k), len(known)) % LETTERS) for n, form in enumerate(forms) for ch, count in Counter(form).items() for k in range(count)]
    out = np.zeros((len(forms), LETTERS), np.float32)
    np.add.at(out, tuple(np.array(at, dtype=np.int64).reshape(-1, 2).T), 1)
    return out


def _common(a: str, places: dict[str, int], length: int) -> int:
    """Length of the longest common subsequence of `a` and a text of that length, given as the bits of each letter's places."""
    full = left = (1 << length) - 1
    for ch in a:
        met = left & places.get(ch, 0)
        left = (left + met | left - met) & full
    return length - left.bit_count()


def close_forms(a: list[str], b: list[str], least: float) -> Iterator[tuple[int, int, float]]:
    """(number in a, number in b, matching-blocks ratio) of all pairs of a form of each list whose ratio is at least `least`.

    The matched letters are shared ones and a common subsequence. Shared letters are counted for all pairs of lengths that can reach
    the ratio, as a product of matrices (letters that meet in one column only raise the bound); what they let through has its longest
    common subsequence measured, and only what is left is aligned.
    """
    x, y = sorted(range(len(a)), key=lambda i: len(a[i])), sorted(range(len(b)), key=lambda j: len(b[j]))
    known: dict[tuple[str, int], int] = {}
    la, lb = np.array([len(a[i]) for i in x]), np.array([len(b[j]) for j in y])
    u, v = _letters([a[i] for i in x], known), _letters([b[j] for j in y], known)
    places: dict[int, dict[str, int]] = {}
    for n in np.unique(la).tolist():
        s, e = np.searchsorted(lb, [math.ceil(n * least / (2 - least) - 1e-9), n * (2 - least) / max(least, 1e-9) + 1e-9], "left")
        first, last = np.searchsorted(la, [n, n + 1], "left")
        for k in range(first, last, 256):
            shared = u[k : min(k + 256, last)] @ v[s:e].T
            for i, j in np.argwhere(2 * shared + 1e-3 >= least * (n + lb[s:e])).tolist():
                i, j = x[k + i], y[s + j]
                p, q = a[i], b[j]
                if p == q and len(q) < 200:  # difflib takes frequent letters of longer texts for noise
                    yield i, j, 1.0
                    continue
                if j not in places:
                    places[j] = {}
                    for bit, ch in enumerate(q):
                        places[j][ch] = places[j].get(ch, 0) | 1 << bit
                if 2 * _common(p, places[j], len(q)) + 1e-9 >= least * (n + len(q)) and (r := SequenceMatcher(None, p, q).ratio()) >= least:
                    yield i, j, r


def place_rank(city: Column, ref_city: Column, ref_address: Column) -> Column:
    """2 for a candidate in the city, 1 where that is unknown, 0 elsewhere; by containment of the folded names."""
    want, line = join_name(city), join_name(F.concat_ws(" ", ref_city, ref_address))
    first = join_name(F.split_part(F.coalesce(ref_city, F.lit("")), F.lit(","), F.lit(1)))
    inside = F.contains(line, want) | ((first != "") & F.contains(want, first))
    return F.when((F.coalesce(want, F.lit("")) == "") | (F.coalesce(line, F.lit("")) == ""), 1).when(inside, 2).otherwise(0)


def ranked_candidates(names: DataFrame, refs: DataFrame, by: list[str], city: str | None = None, least: float = NAME_MIN, also: list[str] | None = None, rows_each: int = BLOCK) -> DataFrame:
    """Candidates of each name among the refs of the same group, best first (`rank` from 1), with the columns `also` of the ref.

    names: `by`, name_id, name; refs: `by`, ref_id, name, city, address. Groups are compared whole (`close_forms`), each name and
    ref shuffled once; those of more than `rows_each` names or refs go in blocks, of which each pair is one task's.
    """
    ship(names.sparkSession)
    also, by_all = also or [], by or ["_all"]
    held = lambda df: (df if by else df.withColumn("_all", F.lit(0))).dropna(subset=by_all).withColumn("_f", name_forms(F.col("name")))
    a, b = held(names).select(*by_all, "name_id", "_f").where(F.size("_f") > 0), held(refs).where(F.size("_f") > 0)
    b = b.select(*by_all, "ref_id", "_f", (place_rank(F.lit(city), F.col("city"), F.col("address")) if city else F.lit(1)).alias("place_rank"), *also)
    blocks = lambda df, to: sent(df.groupBy(*by_all).agg(F.ceil(F.count("*") / rows_each).cast("int").alias(to)).where(F.col(to) > 1))
    na, nb = blocks(names if by else names.withColumn("_all", F.lit(0)), "_na"), blocks(refs if by else refs.withColumn("_all", F.lit(0)), "_nb")
    dealt = lambda df: df.join(na, by_all, "left").join(nb, by_all, "left").na.fill(1, ["_na", "_nb"])
    every, own = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)), lambda k, n: F.pmod(F.xxhash64(k), F.col(n)).cast("int")
    a, b = dealt(a).withColumns({"_p": own("name_id", "_na"), "_q": every("_nb")}), dealt(b).withColumns({"_q": own("ref_id", "_nb"), "_p": every("_na")})
    a, b = (spread(df.drop("_na", "_nb"), *by_all, "_p", "_q").groupBy(*by_all, "_p", "_q") for df in (a, b))
    schema = StructType([*(names.schema[k] for k in by), names.schema["name_id"], *(refs.schema[k] for k in ("ref_id", *also)), StructField("place_rank", IntegerType()), StructField("score", DoubleType())])

    def match(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        at: tuple[dict[str, list[int]], dict[str, list[int]]] = {}, {}
        for of, rows in zip(at, (x, y)):
            for n, forms in enumerate(rows["_f"]):
                for f in forms:
                    of.setdefault(f, []).append(n)
        one, two = (list(of.values()) for of in at)
        found = [(np.repeat(one[i], len(two[j])), np.tile(two[j], len(one[i])), np.full(len(one[i]) * len(two[j]), r)) for i, j, r in close_forms(list(at[0]), list(at[1]), least)]
        i, j, score = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        order = np.lexsort((-score, j, i))  # of several forms of a pair the best counts
        order = order[np.append(True, (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0))[: len(order)]]
        left, right = x[[*by, "name_id"]].iloc[i[order]].reset_index(drop=True), y[["ref_id", *also, "place_rank"]].iloc[j[order]].reset_index(drop=True)
        return pd.concat([left, right], axis=1).assign(score=score[order])

    w = Window.partitionBy(*by, "name_id").orderBy(F.desc("place_rank"), F.desc("score"), "ref_id")
    return a.cogroup(b).applyInPandas(match, schema).withColumn("rank", F.row_number().over(w)).select(*by, "name_id", "ref_id", "score", "place_rank", "rank", *also)


def resolve_by_distance(names: DataFrame, candidates: DataFrame, pages: DataFrame, tries: int = TRIES, most_m: float = MATCH_M) -> DataFrame:
    """(name_id, status, page_id, metres): the first of the best `tries` candidates whose page lies near enough.

    names: name_id, lat, lng; candidates: name_id, page_id, rank; pages: page_id, lat, lng, one row each. A name without a
    point is `unlocated`, without a candidate `no_match`. Of candidates that fail, a later page without a point (`unverified`) or
    one that is missing (`fetch_failed`) replaces an earlier result, a farther `too_far` does not replace a nearer one.
    """
    c = candidates.where(F.col("rank") <= tries).join(pages.select("page_id", F.col("lat").alias("_plat"), F.col("lng").alias("_plng"), F.lit(True).alias("_there")), "page_id", "left")
    j = c.join(names.select("name_id", "lat", "lng"), "name_id").withColumn("metres", haversine_m(F.col("lat"), F.col("lng"), F.col("_plat"), F.col("_plng")))
    status = F.when(F.col("_there").isNull(), "fetch_failed").when(F.col("metres").isNull(), "unverified").when(F.col("metres") <= most_m, "resolved").otherwise("too_far")
    tried = j.withColumn("status", status).groupBy("name_id").agg(F.sort_array(F.collect_list(F.struct("rank", "status", "page_id", "metres"))).alias("t"))  # at most `tries` each
    empty = F.struct(F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("status"), F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("double").alias("metres"))
    keep = lambda last, x: F.when((last["status"] == "resolved") | ((x["status"] == "too_far") & (last["status"] == "too_far") & (last["metres"] <= x["metres"])), last).otherwise(x)
    best = tried.withColumn("r", F.aggregate("t", empty, lambda last, x: F.when(last["status"].isNull(), x).otherwise(keep(last, x))))
    out = names.select("name_id", "lat", "lng").join(best.select("name_id", "r"), "name_id", "left")
    located = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    return out.select(
        "name_id", F.when(~located, "unlocated").when(F.col("r").isNull(), "no_match").otherwise(F.col("r.status")).alias("status"),
        F.when(located, F.col("r.page_id")).alias("page_id"), F.when(located, F.col("r.metres")).alias("metres"),
    )


def later_duplicates(rows: DataFrame, key: str, resolved: Column, order: list[str]) -> DataFrame:
    """Rows with `duplicate`: a resolved row whose non-blank key an earlier resolved row has. Unresolved rows are never one."""
    use = resolved & (F.coalesce(key, F.lit("")) != "")
    first = rows.where(use).groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    j = rows.withColumn("_use", use).join(first, key, "left")
    return j.withColumn("duplicate", F.coalesce(F.col("_use") & (F.struct(*order) != F.col("_first")), F.lit(False))).drop("_use", "_first")


def shared_shifts(points: DataFrame, by: list[str] | None = None, key: str = "key") -> DataFrame:
    """(key, support): misses that enough neighbours share.

    points: key, status, pin_lat, pin_lng, page_lat, page_lng. A `too_far` row within the largest shift is supported by other
    resolved or too-far rows whose pin lies near and whose offset is the same within `SHIFT_AGREE_M`. Offsets and pins are put
    into squares of those sizes and met through their neighbouring squares; one pass, nothing follows from what was accepted.
    """
    by = by or []
    off = planar_offset(F.col("pin_lat"), F.col("pin_lng"), F.col("page_lat"), F.col("page_lng"))
    known = points.where(F.col("status").isin("resolved", "too_far") & F.col("pin_lat").isNotNull() & F.col("page_lat").isNotNull()).withColumn("o", off)
    base = known.select(*by, key, "status", "pin_lat", "pin_lng", F.col("o.east").alias("e"), F.col("o.north").alias("n"))
    # Pins: bands of latitude no narrower than the distance, cut into stretches of longitude that are no shorter at the band's
    # farther edge from the equator, the neighbouring bands included; a band knows its own stretches only.
    band = F.floor(F.col("pin_lat") / SHIFT_BAND)
    base = base.withColumn("oe", F.floor(F.col("e") / SHIFT_AGREE_M)).withColumn("on", F.floor(F.col("n") / SHIFT_AGREE_M)).withColumn("py", band)
    near = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    edge = F.radians(F.least(F.lit(89.0), F.greatest(F.abs(F.col("py") * SHIFT_BAND), F.abs((F.col("py") + 1) * SHIFT_BAND))))
    width = F.lit(SHIFT_BAND) / F.greatest(F.cos(edge), F.lit(0.017))
    count = F.ceil(360 / width)
    column = F.floor((F.col("pin_lng") + 180) / width)
    miss = base.where((F.col("status") == "too_far") & (F.hypot("e", "n") <= SHIFT_MAX_M))
    a = miss.withColumn("oe", near("oe")).withColumn("on", near("on")).withColumn("py", near("py"))
    a = a.withColumn("px", F.explode(F.array_distinct(F.transform(F.sequence(column - 1, column + 1), lambda k: F.pmod(k, count))))).alias("a")
    b = base.withColumn("px", F.pmod(column, count)).alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("oe", "on", "py", "px", *by)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    pairs = a.join(b, cond & (F.col(f"a.{key}") != F.col(f"b.{key}"))).where(
        (F.hypot(F.col("a.e") - F.col("b.e"), F.col("a.n") - F.col("b.n")) <= SHIFT_AGREE_M)
        & (haversine_m(F.col("a.pin_lat"), F.col("a.pin_lng"), F.col("b.pin_lat"), F.col("b.pin_lng")) <= SHIFT_NEAR_M)
    )
    return pairs.groupBy(*(F.col(f"a.{c}").alias(c) for c in by), F.col(f"a.{key}").alias(key)).agg(F.count("*").alias("support")).where(F.col("support") >= SHIFT_NEED)


def surviving_displacement(before: DataFrame, after: DataFrame, by: list[str], name: str = "name") -> DataFrame:
    """(by, dx, dy, shared): median movement of the names that stand exactly once in both."""
    once = lambda df: df.groupBy(*by, name).agg(F.count("*").alias("_n"), F.first("x").alias("x"), F.first("y").alias("y")).where("_n = 1").drop("_n")
    j = once(before).join(once(after).withColumnsRenamed({"x": "_x", "y": "_y"}), [*by, name])
    return j.groupBy(*by).agg(F.percentile(F.col("_x") - F.col("x"), 0.5).alias("dx"), F.percentile(F.col("_y") - F.col("y"), 0.5).alias("dy"), F.count("*").alias("shared"))


def still_to_do(rows: DataFrame, journal: DataFrame, key: str, order: list[str], limit: int | None = None) -> DataFrame:
    """Rows whose journal says nothing or something else than `ok`, in order, at most `limit`."""
    todo = rows.join(journal.where("status = 'ok'").select(key).distinct(), key, "left_anti")
    return todo.orderBy(*order).limit(limit) if limit is not None else todo


def filled_in(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows with the cache's point where they have none; `geo_source` then says `cache`. One cache row for each key."""
    c = cache.select(F.col(key), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    j = rows.join(c, key, "left")
    use = (F.col("lat").isNull() | F.col("lng").isNull()) & F.col("_lat").isNotNull() & F.col("_lng").isNotNull()
    return j.withColumn("geo_source", F.when(use, F.lit("cache")).otherwise(F.col("geo_source"))).withColumn("_use", use).withColumn("lat", F.when(F.col("_use"), F.col("_lat")).otherwise(F.col("lat"))).withColumn("lng", F.when(F.col("_use"), F.col("_lng")).otherwise(F.col("lng"))).drop("_lat", "_lng", "_use")


def second_search(candidates: DataFrame, more: DataFrame, by: list[str]) -> DataFrame:
    """Candidates (by, name_id, ref_id, score, place_rank), those of names without one in their city (`place_rank` 2) joined by the unseen ones of `more`, ranked anew."""
    base = candidates.drop("rank")
    there = base.where("place_rank = 2").select(*by, "name_id").distinct()
    unseen = more.drop("rank").join(there, [*by, "name_id"], "left_anti").join(base.select(*by, "name_id", "ref_id"), [*by, "name_id", "ref_id"], "left_anti")
    w = Window.partitionBy(*by, "name_id").orderBy(F.desc("place_rank"), F.desc("score"), "ref_id")
    return base.unionByName(unseen.select(*base.columns)).withColumn("rank", F.row_number().over(w))


def by_known_id(rows: DataFrame, pages: DataFrame, key: str, page_id: str, south: float, north: float, west: float, east: float) -> DataFrame:
    """(key, status) of rows that name their page: `resolved`, `outside` of the bounds, or `fetch_failed`; a page without a point is resolved."""
    p = pages.select(page_id, F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), F.lit(True).alias("_there"))
    inside = F.col("_lat").between(south, north) & F.col("_lng").between(west, east)
    status = F.when(F.col("_there").isNull(), "fetch_failed").when(F.coalesce(inside, F.lit(True)), "resolved").otherwise("outside")
    return rows.join(p, page_id, "left").select(key, status.alias("status"))


def with_closures(rows: DataFrame, answers: DataFrame, key: str, status: str = "business_status", unmatched: str = "unmatched") -> DataFrame:
    """Rows with the status of their answer: an answer without a place or a status says `unmatched`, an error or no answer leaves the row as it was.

    answers: key, place_id, business_status, error; of several the first by id counts.
    """
    a = answers.groupBy(key).agg(F.min_by(F.struct("place_id", F.col("business_status").alias("_s"), "error"), F.coalesce("place_id", F.lit(""))).alias("_a"))
    said = F.when(F.col("_a.error").isNull(), F.when(F.coalesce(F.col("_a.place_id"), F.lit("")) == "", unmatched).otherwise(F.coalesce(F.nullif(F.col("_a._s"), F.lit("")), F.lit(unmatched))))
    return rows.join(a, key, "left").withColumn(status, F.coalesce(F.when(F.col("_a").isNotNull(), said), F.col(status))).drop("_a")


def legacy_lookup(rows: DataFrame, journal: DataFrame, key: str, old_key: str, status: str = "status") -> DataFrame:
    """Rows with the status that a journal has under their key, or under the key of an older form."""
    entry = lambda as_, to: journal.groupBy("key").agg(F.min(status).alias(to)).withColumnRenamed("key", as_)
    return rows.join(entry(key, "_new"), key, "left").join(entry(old_key, "_old"), old_key, "left").withColumn(status, F.coalesce("_new", "_old")).drop("_new", "_old")


def enriched(names: DataFrame, refs: DataFrame, pages: DataFrame, by: list[str], city: str | None = None) -> DataFrame:
    """The outcome of every swept name: (by, name_id, status, page_id, metres, support, duplicate).

    names: by, name_id, name, lat, lng; refs: by, ref_id, name, city, address, page_id; pages: page_id, lat, lng, one row each.
    Candidates are ranked by place and name, verified by distance, near misses that enough neighbours share are accepted, and a
    page that an earlier name of the group has makes the later one a duplicate. Names without a result keep their row.
    """
    # Names written alike in a group have the same candidates, and of a page's refs written alike the first is enough.
    said = names.where("name is not null").dropna(subset=by)
    first = said.groupBy(*by, "name").agg(F.min("name_id").alias("_as"))
    known = refs.where("page_id is not null").groupBy(*by, "name", "page_id", *(["city", "address"] if city else [])).agg(F.min("ref_id").alias("ref_id"))
    c = ranked_candidates(first.withColumnRenamed("_as", "name_id"), known, by, city, also=["page_id"])
    best = c.groupBy(*by, "name_id", "page_id").agg(F.min("rank").alias("rank"))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "name_id").orderBy("rank", "page_id"))).where(F.col("rank") <= TRIES)
    best = said.join(first, [*by, "name"]).select("name_id", "_as").join(best.select(F.col("name_id").alias("_as"), "page_id", "rank"), "_as").drop("_as")
    out = resolve_by_distance(names, best, pages).join(names.select(*by, "name_id", F.col("lat").alias("pin_lat"), F.col("lng").alias("pin_lng")), "name_id")
    out = out.join(pages.select("page_id", F.col("lat").alias("page_lat"), F.col("lng").alias("page_lng")), "page_id", "left")
    out = cut(out)  # read several times below
    out = out.join(shared_shifts(out, by, "name_id"), [*by, "name_id"], "left")
    out = out.withColumn("status", F.when(F.col("support").isNotNull(), "resolved").otherwise(F.col("status"))).withColumn("_page", F.when(F.col("status") == "resolved", F.concat_ws("/", *by, "page_id")))
    return later_duplicates(out, "_page", F.col("status") == "resolved", ["name_id"]).select(*by, "name_id", "status", "page_id", "metres", "support", "duplicate")
