"""Matching pages and map elements that share no key, with a confidence for each match.

Method: candidates are pairs that lie near each other and have variant names (the index of `name_variants`, spread over
cells of the map). Rows of one page, pages of one venue and elements of one place are first put together. Every candidate
pair of groups has a weight from name, distance, house number and kind of house; a pair whose names alone do not suffice is a
candidate too if other evidence may make up for it. One-to-one factors on both sides make the pairs compete. Loopy belief
propagation exchanges messages through joins until they converge; the marginal probability of a pair is its confidence. Pairs
without a competitor have their fixed point in closed form and take no part in the exchange.

Repeated records (all that counts is equal) are matched once. Cells with more than half of `GROUP_ROWS` records are cut into
smaller ones; a place with more than `GROUP_ROWS` records is spread by its index keys over as many tasks as it needs. What a
record's name means does not depend on this: the words of towns come from the place lines of the cell it lies in.

Defined results: rows with NULL, (0, 0) or out-of-range points, NULL or blank names, or without an id, are never matched; repeated page rows
and repeated elements all appear; an empty side gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import Any
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lokalis.llm import addresses
from lokalis.llm.name_variants import ACCENTED, UNACCENTED, WordIndex, all_keys, branch_words, extra_keys, found_words, needed, sound_keys
from lokalis.llm.names import parse, same_name
from lokalis.operators.spatial import EARTH_M, great_circle_np, usable_point
from lokalis.runtime import cut, drop_cut, sent, ship, spread

REACH = 900.0  # metres within which a page and an element may be one place if one of them is placed coarsely
FINE = 350.0  # and if none is
COARSE = {"nominatim"}  # sources whose points may lie hundreds of metres off
CELL, SMALL_CELL = 1 / 10, 1 / 60  # degrees of latitude
TOWN_SHARE = 0.02  # a word in so large a share of a cell's place lines, and in three, is part of a town's name
GROUP_ROWS = 12_000
KEYS = 60
CLOSE = 1e-3
ACCEPT = 0.5
# Kinds of map elements and the words of page categories that go with them.
KIND_WORDS = {"pub": {"pub", "gastropub", "tavern", "alehouse"}, "bar": {"bar", "lounge"}, "brewery": {"brewery", "brewpub", "taproom"}, "biergarten": {"garden", "biergarten"}, "alcohol": {"store", "shop", "bottle", "liquor"}}
SAME_KIND, OTHER_KIND = 0.4, -0.4  # log odds
SIDES = "side int, id long, name string, lat double, lng double, coarse boolean, address string, kind string, towns string"
PLACED = "y long, x long, sub string, home boolean, " + SIDES
EDGE = "link string, a long, b long, theta double"


def records(venues: DataFrame, elements: DataFrame) -> DataFrame:
    """(side, id, name, lat, lng, coarse, address, place, kind): a page by its smallest usable row, and every usable element."""
    pages = usable_pages(venues).groupBy("page").agg(F.min_by(F.struct("venue_key", "name", "lat", "lng", "geo_source", "address", "city", "category"), "venue_key").alias("r"))
    a = pages.select(F.lit(0).alias("side"), F.col("r.venue_key").alias("id"), "r.name", "r.lat", "r.lng", F.coalesce(F.col("r.geo_source").isin(sorted(COARSE)), F.lit(False)).alias("coarse"), "r.address", F.col("r.city").alias("place"), F.col("r.category").alias("kind"))
    tag = lambda k: F.col("tags").getItem(k)
    street = F.when(tag("addr:street").isNotNull() & tag("addr:housenumber").isNotNull(), F.concat_ws(" ", tag("addr:housenumber"), tag("addr:street")))
    b = elements.where(usable() & F.col("osm_id").isNotNull()).select(F.lit(1).alias("side"), F.col("osm_id").alias("id"), "name", "lat", "lng", F.lit(False).alias("coarse"), street.alias("address"), F.lit(None).cast("string").alias("place"), "kind")
    return a.unionByName(b)


def usable():
    """A row with a place and a name."""
    return usable_point(F.col("lat"), F.col("lng")) & (F.trim(F.coalesce("name", F.lit(""))) != "")


def usable_pages(venues: DataFrame) -> DataFrame:
    """The usable rows with the page they belong to."""
    return venues.where(usable() & F.col("venue_key").isNotNull()).withColumn("page", F.coalesce("venue_id", F.concat(F.lit("row "), F.col("venue_key").cast("string"))))


def home_cell():
    """Columns (y, x) of the cell of `CELL` degrees that a record lies in; the rule of `_grid`."""
    y = F.floor(F.col("lat") / CELL)
    step = F.lit(CELL) / F.greatest(F.cos(F.radians(F.least(F.lit(89.0), F.greatest(F.abs(y * CELL), F.abs((y + 1) * CELL))))), F.lit(0.02))
    return y.cast("long").alias("y"), F.pmod(F.floor((F.col("lng") + 180) / step), F.ceil(360 / step)).cast("long").alias("x")


def _grid(lat: float, lng: float, size: float, reach: float) -> Iterator[tuple[tuple[int, int], bool]]:
    """Cells of `size` degrees within `reach` metres of a point; True for the cell it lies in."""
    home, d = int(np.floor(lat / size)), np.degrees(reach / EARTH_M)
    w = d / max(np.cos(np.radians(min(89.9, abs(lat) + d))), 0.02)
    for y in range(int(np.floor((lat - d) / size)), int(np.floor((lat + d) / size)) + 1):
        step = size / max(np.cos(np.radians(min(89.0, max(abs(y * size), abs((y + 1) * size))))), 0.02)
        n = int(np.ceil(360 / step))
        at = int(np.floor((lng + 180) / step)) % n
        for x in range(int(np.floor((lng + 180 - w) / step)), int(np.floor((lng + 180 + w) / step)) + 1):
            yield (y, x % n), y == home and x % n == at


def evidence(name: float, metres: float, coarse: bool, a, b, kind: str | None = None, category: str | None = None) -> float:
    """Log odds of a candidate pair from name similarity, distance, house number and kind of house."""
    t = 6.0 * name - 1.5 - metres / (400.0 if coarse else 120.0)
    if a is not None and b is not None:
        t += 1.5 if addresses.same_place(a, b) else (-1.0 if a.number != b.number else -0.3)
    if kind in KIND_WORDS and category:
        said = set(addresses.TOKEN.findall(category.lower()))
        if any(said & words for words in KIND_WORDS.values()):
            t += SAME_KIND if said & KIND_WORDS[kind] else OTHER_KIND
    return t


def squares(size: float, lat: np.ndarray, lng: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squares of the map that are nowhere narrower than `size` metres: what is within `size` lies in the same or a neighbouring one."""
    lng = np.where(lng < 0, lng + 360, lng) if len(lng) and lng.max() - lng.min() > 180 else lng
    m = np.radians(1) * EARTH_M
    low = np.cos(np.radians(min(89.99, float(np.abs(lat).max(initial=0)))))
    return np.floor(lat * m / size).astype(np.int64), np.floor(lng * m * low / size).astype(np.int64)


PAIRS = 2_000_000  # pairs of records that are looked at together


class Near:
    """Which pairs of records may be one: the first at home, near enough by their squares, each pair from one side if both are at home."""

    def __init__(self, lat: np.ndarray, lng: np.ndarray, coarse: np.ndarray, home: np.ndarray, rank: np.ndarray):
        self.fine, self.rough = squares(FINE, lat, lng), squares(REACH, lat, lng)
        self.coarse, self.home, self.rank = coarse, home, rank

    def pairs(self, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
        """Numbers (first * n + second) of the pairs of a and b that are near, in pieces of bounded size."""
        a, n = a[self.home[a]], len(self.home)
        step = max(1, PAIRS // max(1, len(b)))
        for k in range(0, len(a), step):
            i = a[k : k + step, None]
            at = lambda grid: (np.abs(grid[0][i] - grid[0][b]) <= 1) & (np.abs(grid[1][i] - grid[1][b]) <= 1)  # noqa: B023, E731
            ok = at(self.fine)
            if self.coarse[i].any() or self.coarse[b].any():
                ok |= (self.coarse[i] | self.coarse[b]) & at(self.rough)
            ok &= (self.rank[b] > self.rank[i]) | ~self.home[b] & (i != b)
            x, y = np.nonzero(ok)
            if len(x):
                yield i[x, 0] * n + b[y]


def candidate_pairs(words: list[list[str]], whole: list[set[str]], need: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of near records that share enough near words, or a key of the whole name."""
    n = len(words)
    of: dict[str, list[int]] = defaultdict(list)
    for j, ws in enumerate(words):
        for w in dict.fromkeys(ws):
            of[w].append(j)
    at = {w: np.array(js) for w, js in of.items()}
    index = WordIndex(of)
    met = []
    for w, a in at.items():
        if near.home[a].any():
            around = [at[v] for v in index.near(w)]
            met += near.pairs(a, np.unique(np.concatenate(around)) if len(around) > 1 else around[0])
    pair, hits = np.unique(np.concatenate(met), return_counts=True) if met else (np.empty(0, np.int64), np.empty(0, np.int64))
    pair = pair[(hits >= need[pair // n]) | (hits >= need[pair % n])]
    keys: dict[str, list[int]] = defaultdict(list)
    for j, ks in enumerate(whole):
        for k in ks:
            keys[k].append(j)
    more = [pair]
    for js in {tuple(js) for js in keys.values() if len(js) > 1}:  # records of one name share many keys, and are taken once
        a = np.array(js)
        more += near.pairs(a, a)
    pair = np.unique(np.concatenate(more))
    return pair // n, pair % n


def near_pairs(right: list[tuple], home: list[bool], branches: frozenset) -> Iterator[tuple]:
    """(link, a, b, log odds) among records (side, id, name, lat, lng, coarse, address, kind, towns): page and element, or two of one side.

    At least one of a pair is at home in this cell; a pair that two cells see comes twice.

    Pairs of well-placed records are looked for within `FINE` metres, pairs with a coarse one within `REACH`, by squares of fitting
    size; words and keys are looked up once for all records that have them.
    """
    towns = {t: frozenset(t.split()) for t in {r[8] for r in right}}
    names = [parse(r[2], branches, towns[r[8]]) for r in right]
    native = any(n.native for n in names)
    whole = [extra_keys(n) | (sound_keys(n) if native else set()) for n in names]
    lat, lng, coarse, at_home = np.array([r[3] for r in right]), np.array([r[4] for r in right]), np.array([r[5] for r in right]), np.array(home)
    rank = np.empty(len(right), np.int64)
    rank[sorted(range(len(right)), key=lambda j: right[j][:2])] = np.arange(len(right))
    near = Near(lat, lng, coarse, at_home, rank)
    i, j = candidate_pairs([found_words(n) for n in names], whole, np.array([needed(n) for n in names]), near)
    metres = great_circle_np(lat[i], lng[i], lat[j], lng[j])
    some_coarse = coarse[i] | coarse[j]
    close = metres <= np.where(some_coarse, REACH, FINE)
    addr: dict[int, object] = {}

    def address(k: int):
        if k not in addr:
            addr[k] = addresses.parse(right[k][6], None, frozenset()) if right[k][6] else None
        return addr[k]

    for a, b, d, rough in zip(i[close].tolist(), j[close].tolist(), metres[close].tolist(), some_coarse[close].tolist()):
        if rank[a] > rank[b]:  # pages before elements, smaller ids first
            a, b = b, a
        r, o = right[a], right[b]
        across = r[0] != o[0]
        c = same_name(names[a], names[b], need_branch=not across, weak=across)  # the map often leaves a branch out
        if c:
            t = evidence(c, d, rough, address(a), address(b), *((o[7], r[7]) if across else ()))
            if across:
                if t > LEAST_ODDS:
                    yield "match", r[1], o[1], t
            elif t > 1.0:
                yield ("page" if r[0] == 0 else "place"), r[1], o[1], t


LEAST_ODDS = -3.0  # a pair below takes no part: alone it has a probability of 5 %, and it moves a rival by as much at most


def candidates(recs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(link, a, b, theta) among `recs` (`records`): candidate matches, and pairs of pages or of elements that are one."""
    ship(recs.sparkSession)
    known = frozenset(branch_words(recs.select("name")))
    recs = recs.select("*", *home_cell())
    place = F.lower(F.translate("place", ACCENTED, UNACCENTED))
    lines = recs.where("place is not null").select("y", "x", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.split(place, r"[^\p{L}]+")))).alias("w")).where("w = '' or length(w) > 3")
    n = lines.groupBy("y", "x", "w").agg(F.count("*").alias("n"))
    share = F.greatest(F.lit(3), TOWN_SHARE * F.max(F.when(F.col("w") == "", F.col("n"))).over(Window.partitionBy("y", "x")))
    towns = n.withColumn("share", share).where("w <> '' and n >= share").groupBy("y", "x").agg(F.concat_ws(" ", F.sort_array(F.collect_set("w"))).alias("towns"))  # at most 1 / TOWN_SHARE words for each word of a line
    recs = recs.join(sent(towns), ["y", "x"], "left").na.fill("", ["towns"]).drop("y", "x", "place")

    def wide(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p = p.reset_index(drop=True)
            cells = [list(_grid(a, o, CELL, REACH if c else FINE)) for a, o, c in zip(p.lat, p.lng, p.coarse)]
            out = p.loc[np.repeat(p.index.to_numpy(), [len(c) for c in cells])].reset_index(drop=True)
            out.insert(0, "y", [y for cs in cells for (y, _), _ in cs])
            out.insert(1, "x", [x for cs in cells for (_, x), _ in cs])
            out.insert(2, "sub", "")
            out.insert(3, "home", [h for cs in cells for _, h in cs])
            yield out

    def narrow(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p = p.reset_index(drop=True)
            cells = [list(_grid(a, o, SMALL_CELL, REACH if c else FINE)) for a, o, c in zip(p.lat, p.lng, p.coarse)]
            out = p.loc[np.repeat(p.index.to_numpy(), [len(c) for c in cells])].reset_index(drop=True)
            out["sub"] = [f"{y} {x}" for cs in cells for (y, x), _ in cs]
            out["home"] = out.home & [h for cs in cells for _, h in cs]
            yield out

    placed = cut(recs.mapInPandas(wide, PLACED))
    crowded = sent(placed.where("home").groupBy("y", "x").count().where(F.col("count") > group_rows // 2).select("y", "x"))
    fine = placed.join(crowded, ["y", "x"], "left_semi").select(placed.columns).mapInPandas(narrow, PLACED)
    placed = placed.join(crowded, ["y", "x"], "left_anti").select(placed.columns).unionByName(fine)
    # What is still too large lies at one place; its names are spread by their keys, of which each has about `KEYS`.
    full = placed.groupBy("y", "x", "sub").agg(F.count("*").alias("n"), F.count_if("home").alias("at_home")).where("at_home > 0").select("y", "x", "sub", F.when(F.col("n") > group_rows, F.ceil(F.col("n") * KEYS / group_rows)).otherwise(1).cast("int").alias("salts"))
    hot = sent(full.where("salts > 1"))

    def salted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p = p.reset_index(drop=True)
            at, salt = [], []
            for i, (c, n) in enumerate(zip(p.salts, p.name_)):
                s = {crc32(k.encode()) % c for k in all_keys(parse(n, known))}
                at += [i] * len(s)
                salt += sorted(s)
            out = p.iloc[at].reset_index(drop=True).drop(columns="salts")
            out.insert(0, "salt", salt)
            yield out

    rows = placed.withColumnRenamed("name", "name_")
    keys, columns = ["y", "x", "sub"], rows.columns
    renamed = PLACED.replace(" name ", " name_ ").replace(", name ", ", name_ ")
    rows = rows.join(hot, keys, "left_anti").select(F.lit(0).alias("salt"), *columns).unionByName(rows.join(hot, keys).select(*columns, "salts").mapInPandas(salted, "salt int, " + renamed))

    def match(key: tuple[Any, ...], p: pd.DataFrame) -> pd.DataFrame:
        text = lambda v: v if isinstance(v, str) else None
        got = []
        if p.home.any():
            all_ = [(int(s), int(i), n, a, o, bool(c), text(ad), text(k), t) for s, i, n, a, o, c, ad, k, t in zip(p.side, p.id, p.name_, p.lat, p.lng, p.coarse, p.address, p.kind, p.towns)]
            got = list(near_pairs(all_, [bool(h) for h in p.home], known))
        return pd.DataFrame(got, columns=["link", "a", "b", "theta"])

    got = spread(rows, *keys, "salt").groupBy(*keys, "salt").applyInPandas(match, EDGE)
    return got.groupBy("link", "a", "b").agg(F.max("theta").alias("theta"))


def grouped(pairs: DataFrame) -> DataFrame:
    """(id, grp): the smallest id that can be reached; ids without a partner do not appear.

    Every round takes the smallest label around and then the label of that label, so the rounds grow with the logarithm of the
    longest chain; they end when no label changes.
    """
    both = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("grp")))
    while True:
        told = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("grp").alias("new"))
        near = label.join(told, "id").select("id", "grp", F.least("grp", "new").alias("new"))
        far = label.select(F.col("id").alias("new"), F.col("grp").alias("beyond"))
        step = cut(near.join(far, "new", "left").select("id", "grp", F.least("new", F.coalesce("beyond", "new")).alias("new")))
        drop_cut(label)
        label = step.select("id", F.col("new").alias("grp"))
        if not step.where("new < grp").limit(1).count():
            return label


def propagate(edges: DataFrame, close: float = CLOSE) -> DataFrame:
    """(a, b, p): marginal probabilities of the edges (a, b, w) under one-to-one factors; w are odds.

    The message of a node along an edge is w / (1 + what its other edges send it); at the fixed point the odds of an edge are
    the product of its two messages over w. Messages are damped by half and exchanged in joins until the largest change is below
    `close`. A larger message in gives a smaller one out, so the messages close in on one fixed point from both sides whatever
    the graph, by a factor of about 1 - 1 / sqrt(w x degree) a round.
    """
    da, db = edges.groupBy("a").agg(F.count("*").alias("na")), edges.groupBy("b").agg(F.count("*").alias("nb"))
    deg = cut(edges.join(da, "a").join(db, "b"))
    alone = deg.where("na = 1 and nb = 1").select("a", "b", (F.col("w") / (1 + F.col("w"))).alias("p"))
    start = deg.where("na > 1 or nb > 1").select("a", "b", "w", F.col("w").alias("ab"), F.col("w").alias("ba"), F.lit(1.0).alias("change"))
    m = cut(start)
    while (m.agg(F.max("change")).first()[0] or 0.0) >= close:
        sa, sb = m.groupBy("a").agg(F.sum("ba").alias("sa")), m.groupBy("b").agg(F.sum("ab").alias("sb"))
        j = m.join(sa, "a").join(sb, "b")
        ab = 0.5 * F.col("ab") + 0.5 * F.col("w") / (1 + F.greatest(F.lit(0.0), F.col("sa") - F.col("ba")))
        ba = 0.5 * F.col("ba") + 0.5 * F.col("w") / (1 + F.greatest(F.lit(0.0), F.col("sb") - F.col("ab")))
        # Each round uses the messages three times, so its result is written: plans stay small.
        told = cut(j.select("a", "b", "w", ab.alias("ab"), ba.alias("ba"), F.greatest(F.abs(ab - F.col("ab")) / F.col("ab"), F.abs(ba - F.col("ba")) / F.col("ba")).alias("change")))
        drop_cut(m)
        m = told
    odds = F.col("ab") * F.col("ba") / F.col("w")
    return alone.unionByName(m.select("a", "b", (odds / (1 + odds)).alias("p")))


def match_places(venues: DataFrame, elements: DataFrame, accept: float = ACCEPT, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(venue_key, osm_id, confidence): rows of `venues` and `osm_venues` that describe the same place."""
    every = records(venues, elements)
    # Records that are equal in all that counts are one; the smallest id stands for them.
    equal = F.md5(F.to_json(F.struct("side", "name", "lat", "lng", "coarse", "address", "place", "kind"))).alias("equal")
    every = cut(every.select("*", equal))
    one = every.groupBy("equal").agg(F.min_by(F.struct(*[c for c in every.columns if c != "equal"]), "id").alias("r"))
    cand = cut(candidates(one.select("r.*"), group_rows))
    stands = every.select("side", "id", "equal").join(one.select("equal", F.col("r.id").alias("rep")), "equal").select("side", "id", "rep")
    pg, pl = grouped(cand.where("link = 'page'")), grouped(cand.where("link = 'place'"))
    edges = (
        cand.where("link = 'match'").join(pg.select(F.col("id").alias("a"), F.col("grp").alias("ga")), "a", "left").join(pl.select(F.col("id").alias("b"), F.col("grp").alias("gb")), "b", "left")
        .select(F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b"), "theta")
    )
    w = edges.groupBy("a", "b").agg(F.exp(F.max("theta")).alias("w"))
    sure = cut(propagate(w).where(F.col("p") >= accept))
    rows = usable_pages(venues).select("venue_key", "page")
    of = lambda side, grp, name, to: stands.where(F.col("side") == side).join(grp.select(F.col("id").alias("rep"), "grp"), "rep", "left").select(F.col("id").alias(name), F.coalesce("grp", "rep").alias(to))
    of_page = rows.join(rows.groupBy("page").agg(F.min("venue_key").alias("id")), "page").join(of(0, pg, "id", "a"), "id").select("venue_key", "a")
    return of_page.join(sure, "a").join(of(1, pl, "osm_id", "b"), "b").select("venue_key", "osm_id", F.col("p").alias("confidence"))
