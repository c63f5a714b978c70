"""Free-entered values mapped to the closest entry of a reference list.

Method: set-similarity join with prefix filter. A value's readings (the whole line, its parts, neighbouring parts together)
and the entries are sets of word-wise letter pairs, word borders included. Pairs are ordered by their rarity in the list; two sets with Jaccard
similarity of at least `MIN_JACCARD` share a token within their first |x| - ceil(t |x|) + 1 tokens, so only those are joined,
under the length filter and the positional filter. Candidates are verified by exact Jaccard and, behind that, by edit distance;
the best entry of each value is kept. Values without an entry come out with `NO_ENTRY`.

Defined results: NULL and '' are not mapped (no row); blank or punctuation-only values map to NO_ENTRY. An entry whose name
occurs twice is decided by a country named in the line, then by the region most common among the rows of the same group
(a sweep), then by the smaller id. An empty list maps everything to NO_ENTRY.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lokalis.llm.edits import Lexicon, osa
from lokalis.llm.lookalikes import bare, fold
from lokalis.runtime import cut, ship, spread

MIN_JACCARD = 0.3
NO_ENTRY = -1
LIST_BOUND = 20_000
# Short forms in place names.
SHORT = {"st": "saint", "st.": "saint", "ste": "saint", "ste.": "saint", "mt": "mount", "mt.": "mount", "pt": "port", "pt.": "port", "nth": "north", "upr": "upper", "up": "upper", "up.": "upper", "jct": "junction", "jn": "junction", "jctn": "junction", "hth": "heath", "o/sea": "on sea", "nr": "near", "gt": "greater"}
# Words around a place name that do not belong to it.
AROUND = {"near", "greater", "city", "of", "town", "centre", "center", "area", "region", "municipality", "metro", "in", "the", "at", "by", "outskirts", "downtown", "central", "stadt", "surroundings", "and", "ville", "docks", "mitte", "quarter"}
# Short forms with two meanings.
TWO = {"n.": ("north", "new"), "n": ("north", "new"), "s.": ("saint", "south"), "s": ("saint", "south")}
PART = re.compile(r"\s*(?:[,;/|()\[\]@•·]|\s-\s|\s–\s|\s>\s)\s*")
SHOWN_WORD = re.compile(r"[^\W\d_]+")


def words_of(part: str) -> list[str]:
    out: list[str] = []
    for w in part.replace("o/sea", "on sea").split():
        w = SHORT.get(w.strip(",;"), w)
        out += SHOWN_WORD.findall(w)
    return out


class Countries:
    """Names of countries, found by their last word with up to two typos."""

    def __init__(self, names: list[str]):
        self.by_last: dict[str, list[list[str]]] = {}
        for n in sorted({n for n in names if n}):
            self.by_last.setdefault(n.split()[-1], []).append(n.split())
        self.last = Lexicon(self.by_last, 2)

    def without(self, words: list[str]) -> tuple[list[str], str]:
        """`words` without a country's name (few typos in each word) at their end, and the country."""
        for last in self.last.near(words[-1]) if len(words) > 1 else ():
            for c in self.by_last[last]:
                n = len(c)
                if len(words) > n and all(osa(x, y, 2) <= (2 if len(y) > 6 else 1) for x, y in zip(words[-n:], c)):
                    return words[:-n], " ".join(c)
        return words, ""


def readings(line: str, countries: Countries) -> tuple[list[str], list[str]]:
    """Word strings that may be the name, and the parts as written (for country names)."""
    said: list[str] = []
    line = fold(line).replace("o/sea", "on-sea")
    parts = [p for p in PART.split(line) if p and p.strip()]
    clean = []
    for p in parts:
        w = words_of(bare(p))
        two = TWO.get(bare(p).split(" ")[0])
        if two and len(w) > 1:
            clean.append([two[1], *w[1:]])
            w = [two[0], *w[1:]]
        w, country = countries.without(w)
        if country:
            said.append(country)
        core = [x for x in w if x not in AROUND] or w
        if core:
            clean.append(core)
    out: dict[str, None] = {}
    for c in clean:
        out[" ".join(c)] = None
    for a, b in zip(clean, clean[1:]):
        out[" ".join(a + b)] = None
        if len(a) + len(b) <= 4:
            out[" ".join(b + a)] = None
    return list(out), [re.sub(r"[\d\s]+$|^[\d\s]+", "", bare(p)) for p in parts] + said


def pairs_of(text: str) -> set[str]:
    """Letter pairs of each word, with borders."""
    out = set()
    for w in text.split():
        w = f"<{w}>"
        out.update(w[i : i + 2] for i in range(len(w) - 1))
    return out


def prefix(tokens: set[str], rarity: dict[str, int]) -> list[str]:
    """The rare head of the ordered token set; tokens in no entry come first, as they are the rarest."""
    order = sorted(tokens, key=lambda t: (rarity.get(t, 0), t))
    return order[: len(order) - math.ceil(MIN_JACCARD * len(order)) + 1]


def _tokenised(df: DataFrame, rarity: dict[str, int], columns: str) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            sets = [pairs_of(t) for t in p.text]
            yield p.assign(tokens=[sorted(s) for s in sets], head=[prefix(s, rarity) for s in sets])

    return df.mapInPandas(run, columns + ", tokens array<string>, head array<string>")


def _edits(a, b):
    """Fewest edits of the two texts without blanks, in the order of words or sorted."""

    @F.pandas_udf("int")
    def count(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([min(osa(x.replace(" ", ""), y.replace(" ", ""), 4), osa("".join(sorted(x.split())), "".join(sorted(y.split())), 4)) for x, y in zip(a, b)], dtype="int32")

    return count(a, b)


def _heads(df: DataFrame) -> DataFrame:
    return df.select("*", F.posexplode("head").alias("pos", "token")).drop("head")


def entries_of(entries: DataFrame) -> DataFrame:
    """(city_id, country, region, text): one row for each spelling of each entry."""
    src = entries.select(F.col("city_id").cast("long").alias("city_id"), "city_name", "native_name", "country", F.concat_ws("/", F.col("metro_lat").cast("string"), F.col("metro_lng").cast("string")).alias("region"))
    names = src.select("city_id", "country", "region", F.explode(F.array("city_name", "native_name")).alias("text")).where("text is not null")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p = p.assign(text=[" ".join(words_of(bare(fold(t)))) for t in p.text], country=[bare(fold(c)) for c in p.country])
            yield p[p.text != ""]

    return names.mapInPandas(run, "city_id long, country string, region string, text string").distinct()


def map_lines(refs: DataFrame, entries: DataFrame, line: str = "city", group: str = "sweep_no") -> DataFrame:
    """(line, group, city_id, confidence) for each distinct line of each group."""
    spark = refs.sparkSession
    ship(spark)
    named = entries_of(entries)
    # The letter pairs of the list, as `pairs_of` makes them: at most alphabet squared, whatever the number of rows.
    framed = F.transform(F.split("text", " "), lambda w: F.concat(F.lit("<"), w, F.lit(">")))
    tokens = F.array_distinct(F.flatten(F.transform(framed, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2))))))
    rarity: dict[str, int] = {r["t"]: r["count"] for r in named.select(F.explode(tokens).alias("t")).groupBy("t").count().collect()}
    names = cut(_tokenised(named, rarity, "city_id long, country string, region string, text string"))
    lines = refs.select(F.col(line).cast("string").alias("line"), F.col(group).alias("grp")).where("line is not null and line <> ''").groupBy("line", "grp").agg(F.count("*").alias("n"))

    countries = Countries([bare(fold(r[0])) for r in entries.select("country").distinct().collect()])  # of the list, no more than it has entries

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for v in p.line:
                texts, written = readings(v, countries)
                rows += [(v, t, written) for t in texts]
            yield pd.DataFrame(rows, columns=["line", "text", "written"])

    read = lines.select("line").distinct().mapInPandas(parse, "line string, text string, written array<string>")
    # A reading is looked up once, however many lines have it.
    read = cut(read)
    texts = spread(_tokenised(read.select("text").distinct(), rarity, "text string"), "text")
    # A list of up to LIST_BOUND spellings goes to every task, a longer one is shuffled by token.
    sent = F.broadcast if names.count() <= LIST_BOUND else lambda df: df
    a, b = _heads(texts).alias("a"), sent(_heads(names)).alias("b")
    na, nb = F.size("a.tokens"), F.size("b.tokens")
    t = F.lit(MIN_JACCARD)
    need = F.ceil(t / (t + 1) * (na + nb))
    left = 1 + F.least(F.size("a.tokens") - F.col("a.pos") - 1, F.size("b.tokens") - F.col("b.pos") - 1) + F.least("a.pos", "b.pos")
    met = (
        a.join(b, (F.col("a.token") == F.col("b.token")) & (na >= t * nb) & (nb >= t * na) & (left >= need))
        .select(F.col("a.text").alias("text"), "city_id", "country", "region", F.col("b.text").alias("entry"), F.col("a.tokens").alias("x"), F.col("b.tokens").alias("y"))
        .dropDuplicates(["text", "city_id", "entry"])
    )
    both = F.size(F.array_intersect("x", "y"))
    flat = lambda c: F.regexp_replace(c, " ", "")
    ordered = lambda c: F.array_join(F.array_sort(F.split(c, " ")), "")
    size = F.length(flat("entry"))
    allowed = F.when(size >= 16, 3).when(size >= 7, 2).otherwise(1)
    met = (
        met.withColumn("jaccard", both / (F.size("x") + F.size("y") - both)).where(F.col("jaccard") >= t)
        # Swapped letters count as two edits here, so this only spares the exact count below.
        .where(F.least(F.levenshtein(flat("text"), flat("entry")), F.levenshtein(ordered("text"), ordered("entry"))) <= allowed * 2)
        .withColumn("edits", _edits(F.col("text"), F.col("entry"))).where(F.col("edits") <= allowed)
        .select("text", "city_id", "country", "region", "jaccard", "edits", size.alias("size"))
    )
    met = cut(met)
    # The place in a line is what is closest; of two exact readings the longer one (district and city, "Upper" behind a comma).
    score = F.struct((-F.col("edits")).alias("e"), F.col("size"), F.col("jaccard"))
    cand = read.join(met, "text").withColumn("score", score)
    named_country = F.exists("written", lambda w: (w == F.col("country")) | ((F.length(w) >= 3) & (F.regexp_replace(w, r"\.$", "") == F.substring("country", 1, 3)))).alias("said")
    best = cand.groupBy("line").agg(F.max("score").alias("score"))
    top = cand.join(best, ["line", "score"]).select("line", "score", "city_id", "region", named_country).groupBy("line", "city_id", "region").agg(F.max("said").alias("said"), F.first("score.jaccard").alias("jaccard"))
    top = cut(top)
    w = Window.partitionBy("line")
    sure = top.withColumn("k", F.count("*").over(w)).where("k = 1")
    spots = lines.join(sure.select("line", "region"), "line").groupBy("grp", "region").agg(F.sum("n").alias("n"))
    home = spots.groupBy("grp").agg(F.max_by("region", F.struct("n", "region")).alias("home"))
    choice = lines.select("line", "grp").join(home, "grp", "left").join(top, "line", "left")
    rank = F.struct(F.coalesce("said", F.lit(False)), F.coalesce(F.col("region") == F.col("home"), F.lit(False)), -F.col("city_id"))
    return choice.groupBy("line", "grp").agg(F.max_by(F.struct("city_id", "jaccard"), rank).alias("b")).select("line", F.col("grp").alias(group), F.coalesce("b.city_id", F.lit(NO_ENTRY).cast("long")).alias("city_id"), F.col("b.jaccard").alias("confidence"))


def map_values(refs: DataFrame, entries: DataFrame, id_col: str = "ref_id", line: str = "city", group: str = "sweep_no") -> DataFrame:
    """(ref_id, city_id) for the rows whose value is neither NULL, '' nor exactly an entry's name."""
    exact = entries.select(F.col("city_name").alias(line)).distinct()
    rest = refs.select(id_col, line, group).where(F.col(line).isNotNull() & (F.col(line) != "")).join(exact, line, "left_anti")
    # Lines that are exactly an entry still tell where their sweep is.
    mapped = map_lines(refs, entries, line, group).withColumnRenamed("line", line)
    return rest.join(mapped, (rest[line] == mapped[line]) & rest[group].eqNullSafe(mapped[group])).select(rest[id_col], mapped["city_id"])
