"""Variant spellings of names typed by people, linked within a group (a sweep).

Method: the words of every name are looked up in a symmetric-delete neighbourhood index (all strings left after up to two
deletions); names that meet in all their distinctive words are compared by optimal assignment of words, which allows typos,
initials, short forms of given names, cut words, changed order, words written together, and a name in another script by
its sound. A branch ("- Station") must agree: branches of one house are different venues.

Every group is matched by one task, except one of more than `LEFT_ROWS` or `RIGHT_ROWS` names: its names are cut into blocks by
hash, and the blocks of both sides are matched through the index, so no task holds an unbounded group and no pair is lost.
Names that occur in many rows are matched once and expanded by a join.

Defined results: NULL and blank names match nothing; identical strings are no variants of each other; a NULL group is a group.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lokalis.llm.edits import deletes
from lokalis.llm.names import MOST_COST, NICK, Name, near_nick, neighbourhood, parse, same_name, soft, sounds, word_cost
from lokalis.runtime import sent, ship, spread

LEFT_ROWS, RIGHT_ROWS = 60_000, 10_000  # names of a group that one task takes
BRANCH_SHARE = 0.002  # a word that ends so large a share of the names with a branch names branches
ACCENTED, UNACCENTED = "áàâäãåéèêëíìîïóòôöõøúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕØÚÙÛÜÑÇ", "aaaaaaeeeeiiiioooooouuuuncAAAAAAEEEEIIIIOOOOOOUUUUNC"
SHARED_PLACES = 0.01  # a word in so large a share of a group's place lines is part of a town's name


def branch_words(*names: DataFrame) -> list[str]:
    """Words that end at least `BRANCH_SHARE` of the names that have a dash or @ before their last word; so no more than 1 / `BRANCH_SHARE`."""
    all_names = names[0]
    for n in names[1:]:
        all_names = all_names.unionByName(n)
    word = F.lower(F.translate(F.regexp_extract("name", r"\s[-–—@]\s*(\p{L}{4,})$", 1), ACCENTED, UNACCENTED))
    ends = all_names.select(word.alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    got = ends.crossJoin(ends.agg(F.sum("n").alias("all"))).where(F.col("n") >= F.greatest(F.lit(2), BRANCH_SHARE * F.col("all"))).select("w").collect()
    return sorted(r["w"] for r in got)


def index_keys(n: Name) -> list[frozenset]:
    """For each word that must be found: its neighbourhood."""
    return [neighbourhood(w) for w in n.core if len(w) > 1]


def extra_keys(n: Name) -> set[str]:
    """Keys that alone bring two names together: all words without blanks."""
    return {"#" + n.whole, *deletes(n.squashed, 1)}


def sound_keys(n: Name) -> set[str]:
    """Keys that bring a name in another script together with one in Latin letters."""
    s = n.sound or sounds(n.squashed)
    return {"~" + k for k in deletes(s, 1)} if len(s) >= 3 else set()


def all_keys(n: Name) -> set[str]:
    return extra_keys(n).union(sound_keys(n), *index_keys(n))


def needed(n: Name) -> int:
    """How many different words of a name have to be found."""
    return max(1, sum(1 for w in set(n.core) if len(w) > 1 and not w.isdigit() and not soft(w)))


class WordIndex:
    """Symmetric-delete index of distinct words: which of them are near a word, found once for each word."""

    def __init__(self, words: Iterable[str]):
        self.index: dict[str, list[str]] = defaultdict(list)
        self.begins: dict[str, list[str]] = defaultdict(list)
        self.known: dict[str, tuple[str, ...]] = {}
        self.words = dict.fromkeys(words)
        for w in self.words:
            for k in neighbourhood(w):
                self.index[k].append(w)
            for k in range(3, len(w) - 1):
                self.begins[w[:k]].append(w)

    def near(self, word: str) -> tuple[str, ...]:
        got = self.known.get(word)
        if got is None:
            seen: set[str] = set()
            for k in self.index.keys() & neighbourhood(word):
                seen.update(self.index[k])
            seen.update(self.begins.get(word, ()))  # a cut form on this side, or on the other
            seen.update(word[:k] for k in range(3, len(word) - 1) if word[:k] in self.words)
            for k in near_nick(word):  # a short form of a given name, mistyped
                if NICK[k] != word and NICK[k] in self.words:
                    seen.add(NICK[k])
            got = self.known[word] = tuple(w for w in seen if w == word or word_cost(word, w) <= MOST_COST)
        return got


def found_words(n: Name) -> list[str]:
    """The words by which a name is looked up."""
    return [] if n.native else [w for w in n.core if len(w) > 1]


def match_names(left: list[str], right: list[str], branches: frozenset, places: frozenset) -> list[tuple[str, str, float]]:
    """(left, right, confidence) of the variants."""
    names = [parse(r, branches, places) for r in right]
    mine = [parse(a, branches, places) for a in left]
    native_right = [j for j, n in enumerate(names) if n.native]
    native_left = any(n.native for n in mine)
    words: dict[str, list[int]] = defaultdict(list)
    whole: dict[str, list[int]] = defaultdict(list)
    for j, n in enumerate(names):
        for w in found_words(n):
            words[w].append(j)
        for k in extra_keys(n):
            whole[k].append(j)
    for j in range(len(names)) if native_left else native_right:
        for k in sound_keys(names[j]):
            whole[k].append(j)
    index = WordIndex(words)
    need = [needed(n) for n in names]
    out = []
    for a, n in zip(left, mine):
        if not n.core:
            continue
        least = needed(n)
        hits: dict[int, int] = defaultdict(int)
        for x in found_words(n):
            found: set[int] = set()
            for w in index.near(x):
                found.update(words[w])
            for j in found:
                hits[j] += 1
        cand = {j for j, h in hits.items() if h >= least or h >= need[j]}
        for k in whole.keys() & extra_keys(n):
            cand.update(whole[k])
        if n.native or native_right:
            for k in whole.keys() & sound_keys(n):
                cand.update(whole[k])
        for j in cand:
            if a != right[j] and (c := same_name(n, names[j])):
                out.append((a, right[j], c))
    return out


def link_names(left: DataFrame, right: DataFrame, places: DataFrame, left_rows: int = LEFT_ROWS, right_rows: int = RIGHT_ROWS) -> DataFrame:
    """(grp, left, right, confidence): variants among the distinct names of each group.

    left, right: (grp, name), repeated rows allowed; places: (grp, word), words of the towns around.
    """
    spark = left.sparkSession
    ship(spark)
    known = frozenset(branch_words(left, right))
    a = left.where(F.trim("name") != "").select("grp", "name").distinct().withColumn("side", F.lit(0))
    b = right.where(F.trim("name") != "").select("grp", "name").distinct().withColumn("side", F.lit(1))
    both = a.unionByName(b)
    # The names of a group beyond the bounds are cut into blocks by hash; every block of left names meets every block of right names
    # through the index, not pair by pair.
    words = places.select("grp", F.col("word").alias("name"), F.lit(2).alias("side"))
    blocks = lambda side, most: F.ceil(F.count_if(F.col("side") == side) / most).cast("int")
    large = both.groupBy("grp").agg(F.greatest(F.lit(1), blocks(0, left_rows)).alias("l"), F.greatest(F.lit(1), blocks(1, right_rows)).alias("r")).where("l > 1 or r > 1").withColumnRenamed("grp", "g")
    rows = both.unionByName(words)
    rows = rows.join(sent(large), rows["grp"].eqNullSafe(F.col("g")), "left").na.fill(1, ["l", "r"])
    h = F.pmod(F.xxhash64("name"), F.when(F.col("side") == 0, F.col("l")).otherwise(F.col("r"))).cast("int")
    range_ = lambda n: F.sequence(F.lit(0), n - 1)
    at = F.when(F.col("side") == 0, F.transform(range_(F.col("r")), lambda k: h * F.col("r") + k)).when(F.col("side") == 1, F.transform(range_(F.col("l")), lambda k: k * F.col("r") + h)).otherwise(range_(F.col("l") * F.col("r")))
    rows = rows.select("grp", "name", "side", F.explode(at).alias("salt"))

    def match(key: tuple[Any, ...], p: pd.DataFrame) -> pd.DataFrame:
        side = p.side.to_numpy()
        name = p.name_.to_numpy(object)
        l, r = list(name[side == 0]), list(name[side == 1])
        got = match_names(l, r, known, frozenset(name[side == 2])) if l and r else []
        out = pd.DataFrame(got, columns=["left", "right", "confidence"])
        out.insert(0, "grp", pd.Series([key[0]] * len(out), dtype="object"))
        return out

    kind = both.schema["grp"].dataType.simpleString()
    return spread(rows.withColumnRenamed("name", "name_"), "grp", "salt").groupBy("grp", "salt").applyInPandas(match, f"grp {kind}, left string, right string, confidence double")


def town_words(refs: DataFrame, group: str, line: str) -> DataFrame:
    """(grp, word): words in at least `SHARED_PLACES` of a group's place lines (so at most some hundred for each group)."""
    word = F.explode(F.array_distinct(F.split(F.lower(F.translate(line, ACCENTED, UNACCENTED)), r"[^\p{L}]+")))
    n = refs.where(F.col(line) != "").groupBy(F.col(group).alias("grp")).agg(F.count("*").alias("all"))
    each = refs.where(F.col(line) != "").select(F.col(group).alias("grp"), word.alias("word")).where(F.length("word") >= 3).groupBy("grp", "word").count()
    n = n.withColumnRenamed("grp", "g")
    return each.join(n, each["grp"].eqNullSafe(n["g"])).where((F.col("count") >= 3) & (F.col("count") >= SHARED_PLACES * F.col("all"))).select("grp", "word")


def variant_pairs(refs: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(ref_id, res_id, confidence): search results and swept names of one sweep that are variants of one name."""
    a = refs.select(F.col("sweep_no").alias("grp"), "name")
    b = resolutions.select(F.col("sweep_no").alias("grp"), "name")
    links = link_names(a, b, town_words(refs, "sweep_no", "city"))
    l = refs.select("ref_id", F.col("sweep_no").alias("grp"), F.col("name").alias("left"))
    r = resolutions.select("res_id", F.col("sweep_no").alias("grp_r"), F.col("name").alias("right_r"))
    met = links.join(r, links["grp"].eqNullSafe(r["grp_r"]) & (links["right"] == r["right_r"])).select(links["grp"].alias("grp_l"), links["left"].alias("left_l"), "res_id", "confidence")
    return l.join(met, l["grp"].eqNullSafe(met["grp_l"]) & (l["left"] == met["left_l"])).select("ref_id", "res_id", "confidence")
