"""Addresses of one place written differently.

Method: an address is taken apart into house number, street words with the kind of street among them, unit and postcode.
MinHash signatures of the street's word and letter-pair shingles are banded; streets of one group (a sweep) with the same house
number that share a band are candidates, verified by an affine-gap alignment of their words, kinds of street included, whose
substitution costs know abbreviations and typos; town and kind of street must not contradict each other.

Each distinct street of a group and number is hashed and aligned once, however many addresses have it. Work goes by group and
house number in buckets of about `BUCKET_ROWS` addresses; a number with more than `GROUP_ROWS` addresses in a group goes by its
band keys. Copies are collapsed before matching and expanded by joins.

Defined results: NULL, blank and number-less addresses, and rows without an id, match nothing; identical strings are no pair; a NULL group is a group; a
missing town contradicts none. Units, floors, shops and postcodes do not make another location; `12` and `12a` do. A number of
five digits or more is a house number where it begins an address that has no other number; elsewhere it is a postcode.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache
from typing import Any
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lokalis.llm.canonical_list import AROUND, SHORT, TWO
from lokalis.llm.edits import osa
from lokalis.llm.lookalikes import bare, fold
from lokalis.llm.names import near_word
from lokalis.runtime import cut, parallelism, sent, ship

GROUP_ROWS, BUCKET_ROWS = 20_000, 10_000
BANDS, BAND_ROWS = 64, 3
GAP_OPEN, GAP_MORE = 0.7, 0.3
KIND_GAP, KIND_SHORT = 0.1, 0.05  # a kind of street left out, or in another form
MAX_COST = 0.85
KIND = "~"  # marks the kind of street among the words of an address
# Kinds of street and their short forms.
STREETS = {
    "street": ["street", "str", "st", "strt", "stret"], "road": ["road", "rd"], "avenue": ["avenue", "ave", "av", "avn", "avenida", "avda", "avd", "aven"],
    "lane": ["lane", "ln", "la"], "square": ["square", "sq", "sqr", "squ"], "court": ["court", "ct", "crt", "cour"], "drive": ["drive", "dr"],
    "place": ["place", "pl", "plaza", "pza", "plz", "platz", "p", "plza"], "strasse": ["strasse", "straße", "str", "st"], "weg": ["weg", "wg"], "gasse": ["gasse", "g", "ga", "gas"],
    "rue": ["rue", "r"], "boulevard": ["boulevard", "bd", "blvd", "bld", "boul"], "calle": ["calle", "c", "cl", "cll"], "paseo": ["paseo", "ps", "po", "pso", "p"], "terrace": ["terrace", "ter", "tce"],
    "way": ["way", "wy"], "alley": ["alley", "aly", "allee"], "hill": ["hill", "hl"], "quay": ["quay", "qy", "quai"], "row": ["row"],
}
KINDS_OF: dict[str, frozenset] = {}
for _k, _ws in STREETS.items():
    for _w in _ws:
        KINDS_OF[_w] = KINDS_OF.get(_w, frozenset()) | {_k}
LONG_STREET = [w for w in KINDS_OF if len(w) >= 4]
ATTACHED = re.compile(r"^(.{3,}?)-?(strasse|strase|straße|str|gasse|gass|weg|platz|pl|wg|g)\.?$")
UNIT = re.compile(r"\(?\b(?:suite|ste|unit|floor|flr|fl|shop|arch|flat|apt|apartment|level|lvl|room|rm|stall|booth|no\.? of|bldg|building|block)\b\.?\s*#?(\d+[a-z]?\b|[a-z]\b)\s*\)?", re.I)
NUMBER = re.compile(r"^(\d{1,4})\s?-?([a-z]?)$")
MARK = {"no", "nr", "num", "n", "nº", "n°", "numero", "nro", "number", "hausnr", "hnr"}
SKIP = {"de", "la", "du", "des", "del", "le", "les", "der", "den", "am", "an", "the", "of", "d", "l"}
TOKEN = re.compile(r"[^\W_]+")


class Address:
    """`unsure`: the town's line has a short word that is no known town word, so a word of its name may be mistyped."""

    __slots__ = ("number", "words", "street", "kinds", "town", "unsure")

    def __init__(self, number: str, street: tuple[str, ...], kinds: frozenset, town: frozenset, unsure: bool = False):
        self.number, self.street, self.kinds, self.town, self.unsure = number, street, kinds, town, unsure
        self.words = tuple(w for w in street if w[0] != KIND)


@lru_cache(maxsize=20_000)
def street_kind(word: str) -> frozenset:
    """Kinds of street a word may stand for, one typo allowed in words of five letters and more."""
    if word in KINDS_OF:
        return KINDS_OF[word]
    if len(word) >= 4:
        for w in LONG_STREET:
            if w[0] == word[0] and osa(word, w, 1) <= 1:
                return KINDS_OF[w]
    return frozenset()


def town_of(words: list[str], towns: frozenset) -> list[str]:
    """For each word of three letters and more: the town word it is, or ''."""
    return [near_word(SHORT.get(w, w), towns) for w in words if len(SHORT.get(w, w)) >= 3 and not w.isdigit()]


@lru_cache(maxsize=20_000)
def town_key(line: str | None, towns: frozenset) -> tuple[frozenset, bool]:
    """The town's words that a line names, and whether a short word of it may be a mistyped one; empty with a short form of two meanings."""
    if not line or not towns:
        return frozenset(), False
    words = TOKEN.findall(bare(fold(line)))
    if any(w in TWO for w in words):
        return frozenset(), False
    got = town_of(words, towns)
    odd = any(not t and len(w) <= 5 and w not in AROUND for w, t in zip((w for w in words if len(SHORT.get(w, w)) >= 3 and not w.isdigit()), got)) or any(len(w) == 2 and w.isalpha() and w != "on" and w not in SHORT for w in words)
    return frozenset(w for w in got if w), odd


def towns_agree(x: Address, y: Address) -> bool:
    """Whether the towns do not contradict each other."""
    if not x.town or not y.town or x.town == y.town:
        return True
    return x.unsure and x.town < y.town or y.unsure and y.town < x.town


def parse(address: str, city: str | None, towns: frozenset) -> Address | None:
    """Take an address apart; None without house number and street."""
    text = bare(fold(address)).replace("ß", "ss")
    text = UNIT.sub(" , ", text).replace("#", " ").replace("c/", "calle ")
    words: list[str] = []
    kinds: frozenset = frozenset()
    number, long_number, town = "", "", set()
    for n, part in enumerate(re.split(r"[,;()/]", text)):
        toks = TOKEN.findall(part.replace("'", ""))
        if not toks:
            continue
        in_town = town_of(toks, towns)
        if in_town and all(in_town) and any(len(t) > 4 for t in in_town):
            town.update(in_town)
            toks = [t for t in toks if t.isdigit() and len(t) < 5]
        for i, t in enumerate(toks):
            lane = t == "la" and i > 0 and toks[i - 1] not in SKIP and toks[i - 1] not in KINDS_OF and not toks[i - 1].isdigit()
            if t.isdigit() and len(t) >= 5 and not n and not i and len(toks) > 1:
                long_number = t
            if t.isdigit() and len(t) >= 5 or t in MARK or t in SKIP and not lane:
                continue
            m = NUMBER.match(t)
            if m:
                if not number:
                    number = m[1].lstrip("0") + m[2]
                    if not m[2] and i + 1 < len(toks) and len(toks[i + 1]) == 1 and toks[i + 1] in "abcdefgh" and (i + 2 == len(toks) or i == 0 and len(toks) > 3 and not street_kind(toks[i + 1])):
                        number += toks[i + 1]
                elif len(m[1]) < 4 or m[2]:
                    continue
                continue
            if len(t) == 1 and number.endswith(t):
                continue
            k = street_kind(t)
            if k and not (k & kinds and len(t) > 5):
                kinds = kinds | k if not kinds else (kinds & k or kinds)
                words.append(KIND + t)
                continue
            a = ATTACHED.match(t)
            if a and not kinds:
                kinds = KINDS_OF.get(a[2], frozenset({"strasse"})) & {"strasse", "gasse", "weg", "place"} or frozenset({"strasse"})
                words += [a[1], KIND + (a[2] if a[2] in KINDS_OF else "strasse")]
                continue
            words.append(t)
    if towns:  # a town written without a comma
        near = {w: got for w in words if w[0] != KIND and (got := near_word(w, towns))}
        if near and sum(w[0] != KIND for w in words) > sum(w in near for w in words):
            town.update(near.values())
            words = [w for w in words if w not in near]
    number = number or long_number
    if not number or all(w[0] == KIND for w in words):
        return None
    own, unsure = (frozenset(town), False) if town else town_key(city, towns)
    return Address(number, tuple(words), kinds, own, unsure)


def shingles(words: tuple[str, ...]) -> set[str]:
    """Words and letter pairs of a street."""
    out = set(words)
    s = "^" + "".join(words) + "$"
    out.update([s[i : i + 2] for i in range(len(s) - 1)])
    return out


_SEEDS = np.random.default_rng(7).integers(1, 2**31 - 1, (2, BANDS * BAND_ROWS)).astype(np.uint64)


@lru_cache(maxsize=20_000)
def hashes(shingle: str) -> np.ndarray:
    return (_SEEDS[0] * np.uint64(crc32(shingle.encode())) + _SEEDS[1]) % np.uint64(2_147_483_647)


@lru_cache(maxsize=10_000)
def bands(words: tuple[str, ...]) -> tuple[int, ...]:
    """Band keys of the MinHash signature."""
    low = np.minimum.reduce([hashes(s) for s in shingles(words)])
    return tuple(hash((i, *low[i * BAND_ROWS : (i + 1) * BAND_ROWS].tolist())) for i in range(BANDS))


@lru_cache(maxsize=100_000)
def word_cost(a: str, b: str) -> float:
    """Substitution cost: 0 the same, little for an abbreviation, a share for typos, 2 for different words."""
    if a == b:
        return 0.0
    if (a[0] == KIND) != (b[0] == KIND):
        return 2.0
    if a[0] == KIND:
        return KIND_SHORT if street_kind(a[1:]) & street_kind(b[1:]) else 2.0
    s, l = (a, b) if len(a) <= len(b) else (b, a)
    most = 0 if len(l) <= 3 else 1 if len(l) <= 5 else 2 if len(l) <= 9 else 3
    d = osa(a, b, most)
    if d <= most:
        return 0.25 * d
    return 0.3 if len(s) >= 3 and l.startswith(s) else 2.0


def align(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Global alignment cost of two word sequences with affine gaps (three states); a kind of street that is left out costs little and opens no gap."""
    inf = float("inf")
    start = [(0.0, inf, inf)]
    for v in b:
        m, _, y = start[-1]
        start.append((m + KIND_GAP, inf, y + KIND_GAP) if v[0] == KIND else (inf, inf, min(m + GAP_OPEN, y + GAP_MORE)))
    row = start
    for w in a:
        kind = w[0] == KIND
        out: list[tuple[float, float, float]] = []
        for j, (m, x, y) in enumerate(row):
            m2, x2, y2 = (m + KIND_GAP, x + KIND_GAP, y + KIND_GAP) if kind else (inf, min(min(m, y) + GAP_OPEN, x + GAP_MORE), inf)
            if j:
                v, (lm, lx, ly) = b[j - 1], out[-1]
                m2 = min(m2, min(row[j - 1]) + word_cost(w, v))
                if v[0] == KIND:
                    m2, x2, y2 = min(m2, lm + KIND_GAP), min(x2, lx + KIND_GAP), min(y2, ly + KIND_GAP)
                else:
                    y2 = min(y2, min(lm, lx) + GAP_OPEN, ly + GAP_MORE)
            out.append((m2, x2, y2))
        row = out
    return min(row[-1])


@lru_cache(maxsize=50_000)
def street_cost(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Least alignment cost of two streets, in their order, sorted, or without blanks."""
    if a == b:
        return 0.0
    by_kind = lambda w: (w[0] == KIND, w)
    cost = align(a, b)
    if cost > 0 and len(a) + len(b) > 2:
        cost = min(cost, align(tuple(sorted(a, key=by_kind)), tuple(sorted(b, key=by_kind))))
    p, q = [w for w in a if w[0] != KIND], [w for w in b if w[0] != KIND]
    if cost > MAX_COST and len(p) != len(q):
        cost = min(cost, word_cost("".join(p), "".join(q)))
    return cost


def same_place(x: Address, y: Address) -> float:
    """Confidence in (0, 1] that two addresses are of one place; 0 if not."""
    if x.number != y.number or not towns_agree(x, y) or x.kinds and y.kinds and not x.kinds & y.kinds:
        return 0.0
    cost = street_cost(*sorted((x.street, y.street)))
    return max(0.05, 1 - cost) if cost <= MAX_COST else 0.0


def match_parsed(rows: list[tuple[int, str, Address]]) -> list[tuple]:
    """(id_a, id_b, confidence) among rows (id, address, parsed) of one group and house number."""
    of: dict[tuple, list[int]] = defaultdict(list)
    for k, (_, _, p) in enumerate(rows):
        of[p.street].append(k)
    index: dict[int, list[tuple]] = defaultdict(list)
    for street in of:
        for b in bands(tuple(w for w in street if w[0] != KIND)):
            index[b].append(street)
    seen: set[tuple] = {(s, s) for s in of}
    for streets in index.values():
        for n, s in enumerate(streets):
            seen.update((s, t) if s <= t else (t, s) for t in streets[n + 1 :])
    out = []
    for s, t in seen:
        cost = street_cost(s, t)
        if cost > MAX_COST:
            continue
        c = max(0.05, 1 - cost)
        for n, k in enumerate(of[s]):
            for j in of[s][n + 1 :] if s == t else of[t]:
                x, y = rows[k][2], rows[j][2]
                if rows[k][1] != rows[j][1] and not (x.kinds and y.kinds and not x.kinds & y.kinds) and towns_agree(x, y):
                    out.append((rows[k][0], rows[j][0], c))
    return out


def match_addresses(rows: list[tuple], towns: frozenset) -> list[tuple]:
    """(id_a, id_b, confidence) among rows (id, address, city) of one group."""
    groups: dict[str, list] = defaultdict(list)
    for i, a, c in rows:
        if p := parse(a, c, towns):
            groups[p.number].append((i, a, p))
    return [x for g in groups.values() for x in match_parsed(g)]


PARSED = "number string, street string, kinds string, town string, unsure boolean"


def link_addresses(rows: DataFrame, towns: frozenset, group_rows: int = GROUP_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id_a, id_b, confidence) for rows (id, grp, address, city) with distinct (address, city) in a group; `towns`: words of the town list."""
    spark = rows.sparkSession
    ship(spark)
    kind = rows.schema["grp"].dataType.simpleString()
    base = f"id long, grp {kind}, address string, "

    def take_apart(parts):
        for p in parts:
            out = []
            for i, g, a, c in zip(p.id, p.grp, p.address, p.city):
                if x := parse(a, c if isinstance(c, str) else None, towns):
                    out.append((i, None if pd.isna(g) else g, a, x.number, " ".join(x.street), " ".join(sorted(x.kinds)), " ".join(sorted(x.town)), x.unsure))
            got = pd.DataFrame(out, columns=["id", "grp", "address", "number", "street", "kinds", "town", "unsure"])
            yield got.astype({"grp": "Int64"}) if kind in ("bigint", "int") else got

    parsed = cut(rows.select("id", "grp", "address", "city").mapInPandas(take_apart, base + PARSED))
    buckets = max(parallelism(spark), parsed.count() // bucket_rows + 1)
    crowded = parsed.groupBy(F.col("grp").alias("g"), F.col("number").alias("no")).agg(F.count("*").alias("n")).where(F.col("n") > group_rows)
    crowded = cut(crowded.select("g", "no", F.ceil(F.col("n") * BANDS / group_rows).cast("int").alias("salts")))
    hot = crowded.count() > 0

    def salted(parts):
        for p in parts:
            p = p.reset_index(drop=True)
            at, salt = [], []
            for i, (s, n) in enumerate(zip(p.street, p.salts)):
                got = {1 + crc32(str(b).encode()) % int(n) for b in bands(tuple(w for w in s.split(" ") if w[0] != KIND))}
                at += [i] * len(got)
                salt += sorted(got)
            out = p.iloc[at].reset_index(drop=True).drop(columns=["salts", "salt"])
            out.insert(0, "salt", salt)
            yield out

    plain = parsed.withColumn("salt", F.lit(0))
    if hot:
        met = parsed["grp"].eqNullSafe(crowded["g"]) & (parsed["number"] == crowded["no"])
        few = sent(crowded)
        plain = parsed.join(few, met, "left").drop("g", "no").withColumn("salt", F.lit(0))
        crowd = plain.where("salts is not null").select("salt", *parsed.columns, "salts").mapInPandas(salted, "salt int, " + base + PARSED)
        plain = plain.where("salts is null").drop("salts").select("salt", *parsed.columns).unionByName(crowd)
    placed = plain.withColumn("bucket", F.pmod(F.xxhash64("grp", "number", "salt"), F.lit(buckets)))

    def match(key: tuple[Any, ...], p: pd.DataFrame) -> pd.DataFrame:
        groups: dict[tuple, list] = defaultdict(list)
        words = lambda v: frozenset(v.split())
        for i, g, a, no, s, k, t, u, salt in zip(p.id, p.grp, p.address, p.number, p.street, p.kinds, p.town, p.unsure, p.salt):
            groups[None if pd.isna(g) else g, no, salt].append((int(i), a, Address(no, tuple(s.split(" ")), words(k), words(t), bool(u))))
        got = [x for rows in groups.values() for x in match_parsed(rows)]
        return pd.DataFrame(got, columns=["id_a", "id_b", "confidence"])

    got = placed.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(match, "id_a long, id_b long, confidence double")
    return got.dropDuplicates(["id_a", "id_b"]) if hot else got


def address_pairs(refs: DataFrame, cities: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(ref_id_a, ref_id_b, confidence), smaller id first: rows of one sweep whose differently written addresses are one place.

    The words of `cities`, a fixed list that every task holds, tell the towns of every sweep apart, however rare a town is in it.
    """
    src = refs.where(F.col("address").rlike(r"\p{Nd}") & F.col("ref_id").isNotNull()).select("ref_id", F.col("sweep_no").alias("grp"), "address", "city")
    recs = cut(src.groupBy("grp", "address", "city").agg(F.min("ref_id").alias("id")))
    town = F.explode(F.split(F.lower(F.translate("city_name", "áàâäãåéèêëíìîïóòôöõøúùûüñç", "aaaaaaeeeeiiiioooooouuuunc")), r"[^\p{L}]+")).alias("word")
    towns = frozenset(r["word"] for r in cities.select(town).where(F.length("word") >= 3).distinct().collect())
    links = link_addresses(recs.select("id", "grp", "address", "city"), towns, group_rows)
    few = recs.selectExpr("id", "grp as g", "address as said", "city as town")
    of = src.join(few, F.col("grp").eqNullSafe(F.col("g")) & (F.col("address") == F.col("said")) & F.col("city").eqNullSafe(F.col("town"))).select("ref_id", "id")
    a, b = of.select(F.col("ref_id").alias("a"), F.col("id").alias("id_a")), of.select(F.col("ref_id").alias("b"), F.col("id").alias("id_b"))
    return links.join(a, "id_a").join(b, "id_b").select(F.least("a", "b").alias("ref_id_a"), F.greatest("a", "b").alias("ref_id_b"), "confidence")
