"""Visually identical text with different characters, brought to one form.

Method: words with unusual characters are run through tries of the vocabulary (the words that stand in plain characters in
the same columns) by a weighted edit automaton: an equal character, a look-alike and an ignorable cost nothing, a second
reading of a look-alike costs `SECOND_COST`, anything else is not allowed. Of the spellings reached within `MAX_COST` the
cheapest, then the most frequent is the canonical one. Words that reach none are normalised by the table; a word properly
written in another script stays as it is.

Defined results: NULL stays NULL and is no case; '' stays ''; a value in plain characters is its own canonical form. Repeated
rows get one result each. The vocabulary is spread over tasks by first letters, length and last letter of the words, which their
look-alikes share, and is never gathered in one place.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lokalis.llm.lookalikes import PLAIN, SECOND, SECOND_COST, WORD, foreign_word, kind, script, shown
from lokalis.runtime import parallelism, ship

MAX_COST = 0.5
PREFIX = 3
END = ""
SPLIT = re.compile("(" + WORD.pattern + ")")


def build_trie(words: dict[str, int]) -> dict:
    """Nested dicts by character; END holds the word's count."""
    root: dict = {}
    for w, n in words.items():
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[END] = max(n, node.get(END, 0))
    return root


def _steps(word: str, i: int) -> list[tuple[int, str, float, int]]:
    """What the automaton may read at `i`: (characters used, text, cost, stand-ins)."""
    c = word[i]
    k = kind(c)
    if k == "unseen":
        return [(1, "", 0.0, 1)]
    j = i + 1
    while j < len(word) and kind(word[j]) == "mark":
        j += 1
    if j > i + 1:
        one = unicodedata.normalize("NFC", "".join(shown(x) for x in word[i:j]))
        return [(j - i, one, 0.0, 1)]
    out = [(1, c, 0.0, 0)]
    if (s := shown(c)) != c:
        out.append((1, s, 0.0, 1))
    if c in SECOND:
        out.append((1, SECOND[c], SECOND_COST, 1))
    return out


def walk(trie: dict, word: str, max_cost: float = MAX_COST) -> tuple[str, int] | None:
    """Canonical spelling and number of stand-ins of `word`, or None if no vocabulary word looks like it."""
    states = {(0, ""): (0.0, 0, trie)}
    best: tuple[float, int, str, int] | None = None
    while states:
        nxt: dict = {}
        for (i, text), (cost, subs, node) in states.items():
            if i == len(word):
                if END in node and (best is None or (cost, -node[END], text) < best[:3]):
                    best = (cost, -node[END], text, subs)
                continue
            for used, s, c, n in _steps(word, i):
                at, total = node, cost + c
                if total > max_cost:
                    continue
                for ch in s:
                    at = at.get(ch)
                    if at is None:
                        break
                if at is not None:
                    key = (i + used, text + s)
                    if key not in nxt or total < nxt[key][0]:
                        nxt[key] = (total, subs + n, at)
        states = nxt
    return (best[2], best[3]) if best else None


def by_table(word: str) -> tuple[str, int]:
    """Normal form of a word outside the vocabulary, and its stand-ins."""
    letters = {script(c) for c in word} - {""}
    if foreign_word(word):  # its own look-alikes are proper letters; Latin ones inside stay
        keep = {c for c in word if kind(c) == "look"}
    elif "LATIN" not in letters:  # only look-alikes, in no vocabulary: a short word of another script
        keep = {c for c in word if kind(c) == "look"}
    else:
        keep = set()
    out = unicodedata.normalize("NFC", "".join(c if c in keep else shown(c) for c in word))
    n = sum(1 for c in word if c not in keep and kind(c) in ("unseen", "look", "compat", "blank"))
    if not n and unicodedata.normalize("NFC", word) != word:
        n = 1
    return out, n


SECOND_SEEN = str.maketrans({c: t for c, t in SECOND.items() if kind(c) != "look"})
ONE_LOOK = str.maketrans("lu", "iv")


def look_key(word: str) -> str:
    """First letters, length and last letter as they look: what the words that one trie must hold have in common."""
    t = unicodedata.normalize("NFC", "".join(shown(c) for c in word)).translate(SECOND_SEEN).lower()
    return f"{t[:PREFIX]}{len(t)}{t[-1:]}".translate(ONE_LOOK)


def cut_value(value: str) -> tuple[list[str], list[str], int]:
    """(text before each odd word and after the last, odd words, stand-ins outside of words)."""
    seps, words = [""], []
    composed = unicodedata.normalize("NFC", value)
    n, value = int(composed != value), composed
    for i, part in enumerate(SPLIT.split(value)):
        if i % 2 and not part.isascii() and any(kind(c) != "other" and kind(c) != "plain" for c in part):
            words.append(part)
            seps.append("")
        elif i % 2:
            seps[-1] += part
        else:
            n += sum(1 for c in part if kind(c) in ("unseen", "blank", "compat") or kind(c) == "mark")
            seps[-1] += unicodedata.normalize("NFC", "".join(shown(c) for c in part))
    return seps, words, n


def canonical_values(df: DataFrame, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    """(id, field, value, canonical, stand_ins): one row for each non-NULL value of `fields`."""
    odd, plain = _odd_values(df, id_col, fields)
    return plain.select("id", "field", "value", F.col("value").alias("canonical"), F.lit(0).cast("long").alias("stand_ins")).unionByName(_solved(odd, plain))


def unusual_values(df: DataFrame, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    """The rows of `canonical_values` with at least one stand-in."""
    odd, plain = _odd_values(df, id_col, fields)
    return _solved(odd, plain).where("stand_ins > 0")


def _odd_values(df: DataFrame, id_col: str, fields: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    ship(df.sparkSession)
    long = df.select(F.col(id_col).alias("id"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("v")).select("id", "v.*").where(F.col("value").isNotNull())
    return long.where(F.col("value").rlike(PLAIN)), long.where(~F.col("value").rlike(PLAIN))


def _solved(odd: DataFrame, plain: DataFrame) -> DataFrame:
    spark = odd.sparkSession
    buckets = parallelism(spark) * 2

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = [cut_value(v) for v in p.value]
            yield p.assign(seps=[g[0] for g in got], words=[g[1] for g in got], outside=[g[2] for g in got])

    pieces = odd.mapInPandas(cut, "id long, field string, value string, seps array<string>, words array<string>, outside long")
    each = pieces.select("id", "field", "value", "seps", "outside", F.posexplode_outer("words").alias("at", "word"))

    def keyed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(key=[look_key(w) for w in p.word])

    words = each.where("word is not null").select("word").distinct().mapInPandas(keyed, "word string, key string")
    # Plain words have their key in Spark's own expressions; the two ways agree on plain characters.
    vocabulary = (
        plain.select(F.explode(F.split("value", r"[^\p{L}]+")).alias("word")).where(F.length("word") > 1)
        .groupBy("word").agg(F.count("*").alias("n"))
        .withColumn("key", F.translate(F.concat(F.lower(F.substring("word", 1, PREFIX)), F.length(F.lower("word")), F.lower(F.substring("word", -1, 1))), "lu", "iv"))
    )
    vocabulary = vocabulary.join(words.select("key").distinct(), "key", "left_semi")
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")

    def solve(dirty: pd.DataFrame, vocab: pd.DataFrame) -> pd.DataFrame:
        by_key = {k: dict(zip(g.word, g.n)) for k, g in vocab.groupby("key")}
        tries: dict[str, dict] = {}
        rows = []
        for w, k in zip(dirty.word, dirty.key):
            if k not in tries:
                tries[k] = build_trie(by_key.get(k, {}))
            got = None if foreign_word(w) else walk(tries[k], w)
            rows.append((w, *(got or by_table(w))))
        return pd.DataFrame(rows, columns=["word", "canon", "subs"])

    table = words.select("word", "key", bucket).groupBy("bucket").cogroup(vocabulary.select("word", "n", "key", bucket).groupBy("bucket")).applyInPandas(solve, "word string, canon string, subs long")
    joined = each.join(table, "word", "left").groupBy("id", "field").agg(
        F.first("value").alias("value"), F.first("seps").alias("seps"), F.first("outside").alias("outside"),
        F.sort_array(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("at", "canon")))).alias("got"), F.coalesce(F.sum("subs"), F.lit(0)).alias("subs"),
    )
    text = F.array_join(F.zip_with("seps", F.transform("got", lambda g: g["canon"]), lambda s, w: F.concat(s, F.coalesce(w, F.lit("")))), "")
    return joined.select("id", "field", "value", text.alias("canonical"), (F.col("outside") + F.col("subs")).alias("stand_ins"))
