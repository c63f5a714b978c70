"""Evaluation passages inside a corpus, verbatim or with other values put in.

Method: texts become words without case, markup, punctuation and quote marks. A template puts typed placeholders where a word's
form or place says that it is a value: a number; a unit, the word behind a number; a name, a capitalised word that is no
function word. Each text has two templates, one with names and one without, as a text in capitals shows no names. Windows of
`WINDOW` template words of the items are hashed and the windows of every document are joined to them by hash; a window with
fewer than `PLAIN` ordinary words says too little and keeps its words instead of placeholders. Joined windows lie on diagonals
(item, shift), and the slots of each diagonal are compared:

- `words`: longest run of at least `LEAST` successive item words, at most one in ten changed. Such a run has a window whose
  slots all agree, as 15 to 29 words with up to two changed leave six in a row, and longer ones more.
- `template_words`: longest run of at least `LEAST` words in which all ordinary words agree and every slot holds a value of its
  type, the same new value wherever the item repeats the old one; `replaced` counts the slots with a new value. These are the
  re-parameterised questions.

The items are a query set held against all documents in blocks of at most `BLOCK_WORDS` words, so what a task holds of them is
bounded whatever their number. Documents are read whole, each in one piece.

Defined results: NULL and empty documents or items, and those without an id, leak nothing; an item shorter than `LEAST` words cannot leak; repeated
documents are reported once for each doc_id, with their longest runs.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lokalis.llm.junk_pages import ROLE_OF
from lokalis.llm.lookalikes import UNSEEN
from lokalis.runtime import ship

WINDOW = 6
PLAIN = 3  # ordinary words that a template window must have
LEAST = 15
BLOCK_WORDS = 2_000_000  # about 120 MB of windows
MARKUP = re.compile(r"<[A-Za-z/!?][^<>]*>")
HIDDEN = re.compile("[­​-‏⁠-⁤﻿" + UNSEEN + "]")
MARKS = re.compile("[ -©«-´¶-¹»-¿×÷ -‗“-⁯←-⯿　-〿]")
QUOTES = re.compile("[’‘ʼ＇´]")
BREAKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
OTHER, NUMBER, NAME, FUNCTION = range(4)  # form of a word, in the low bits of its id
FORM = np.uint64(3)
NUMBER_SLOT, UNIT_SLOT, NAME_SLOT = (np.uint64(n) for n in (4, 8, 12))  # no word has such an id
BASE = np.uint64(0x9E3779B97F4A7C15)
KNOWN_WORDS = 1_000_000


def pieces(text: str) -> list[bytes]:
    """Words of a text as they are written, without markup, punctuation and quote marks."""
    if "<" in text:
        text = MARKUP.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = MARKS.sub(" ", QUOTES.sub("", HIDDEN.sub("", text)))
    return text.encode("utf-8", "replace").translate(BREAKS, b"'`").split()


def words_of(text: str) -> list[bytes]:
    """Words without case, markup, punctuation and quote marks."""
    return [w.decode().lower().encode() for w in pieces(text)]


class Ids(dict):
    """Ids of words met: a hash of the word without case, and its form in the low bits."""

    def __missing__(self, piece: bytes) -> int:
        word = piece.decode()
        low = word.lower()
        form = NUMBER if low.isdigit() else FUNCTION if low in ROLE_OF else NAME if word[0] != low[0] else OTHER
        got = self[piece] = int.from_bytes(blake2b(low.encode(), digest_size=8).digest(), "little") & ~15 | 16 | form
        return got

    def of(self, text: str) -> np.ndarray:
        if len(self) > KNOWN_WORDS:
            self.clear()
        ps = pieces(text)
        return np.fromiter(map(self.__getitem__, ps), np.uint64, len(ps))


class Words:
    """Words of a text: `same` (ids without form), `form`, `unit` (place behind a number), hashes of the exact windows and of the template windows.

    A window without a name has one template only; `at` is the place of each template.
    """

    __slots__ = ("same", "form", "unit", "exact", "template", "at")

    def __init__(self, ids: np.ndarray):
        self.form = (ids & FORM).astype(np.int8)
        self.same = ids & ~FORM
        behind = np.zeros(len(ids), bool)
        behind[1:] = self.form[:-1] == NUMBER
        self.unit = behind & ((self.form == OTHER) | (self.form == NAME))
        first = np.where(self.form == NUMBER, NUMBER_SLOT, self.same)  # what is in front of a window does not alter it
        bare = np.where(self.unit, UNIT_SLOT, first)
        named = np.where((self.form == NAME) & ~self.unit, NAME_SLOT, bare)
        first_named = np.where(self.form == NAME, NAME_SLOT, first)
        self.exact = window_hash(self.same, self.same)
        bare_hash = _templates(first, bare, self.exact, np.uint64(1))
        names = np.concatenate([[0], np.cumsum((self.form == NAME))])
        at = np.nonzero(names[WINDOW:] > names[: len(bare_hash)])[0]
        self.template = np.concatenate([bare_hash, _templates(first_named, named, self.exact, np.uint64(2))[at]])
        self.at = np.concatenate([np.arange(len(bare_hash)), at])


def window_hash(first: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Hash of each `WINDOW` successive ids, the first of them taken from `first`."""
    n = len(rest) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = first[:n].copy()
    for k in range(1, WINDOW):
        h = h * BASE + (rest[k : k + n] ^ (rest[k : k + n] >> np.uint64(31)))
    return h ^ (h >> np.uint64(29))


def _templates(first: np.ndarray, rest: np.ndarray, exact: np.ndarray, salt: np.uint64) -> np.ndarray:
    n = len(exact)
    if not n:
        return exact
    plain = np.concatenate([[0], np.cumsum(rest >= 16)])
    enough = plain[WINDOW:] - plain[1 : n + 1] + (first[:n] >= 16) >= PLAIN
    return np.where(enough, window_hash(first, rest), exact) * BASE + salt


class Items:
    """A block of items: their words and their template windows sorted by hash."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        split = [(i, Words(w)) for i, w in items if len(w) >= LEAST]
        self.ids = np.array([i for i, _ in split], np.int64)
        self.start = np.concatenate([[0], np.cumsum([len(w.same) for _, w in split])]).astype(np.int64)
        join = lambda name, kind: np.concatenate([getattr(w, name) for _, w in split]) if split else np.empty(0, kind)
        self.same, self.form, self.unit = join("same", np.uint64), join("form", np.int8), join("unit", bool)
        hashes, exact = join("template", np.uint64), np.concatenate([w.exact[w.at] for _, w in split]) if split else np.empty(0, np.uint64)
        pos = np.concatenate([s + w.at for s, (_, w) in zip(self.start, split)]) if split else np.empty(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hash, self.pos, self.exact = hashes[order], pos[order], exact[order]


def longest_run(same: np.ndarray) -> int:
    """Length of the longest stretch that begins and ends with an unchanged word and has at most a tenth changed."""
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -9))])  # sum >= 0 over a stretch: changed * 10 <= length
    best = 0
    low = np.minimum.accumulate(score)
    for e in range(len(score) - 1, 0, -1):
        if e <= best:
            break
        if same[e - 1]:
            s = int(np.searchsorted(-low, -score[e], "left"))
            while s < e and (not same[s] or score[s] > score[e]):
                s += 1
            best = max(best, e - s)
    return best


def clean_run(ok: np.ndarray) -> tuple[int, int]:
    """Begin and end of the longest stretch without a False."""
    wrong = np.nonzero(~ok)[0]
    if not len(wrong):
        return 0, len(ok)
    edge = np.empty(len(wrong) + 2, np.int64)
    edge[0], edge[1:-1], edge[-1] = -1, wrong, len(ok)
    k = int((edge[1:] - edge[:-1]).argmax())
    return int(edge[k]) + 1, int(edge[k + 1])


def consistent_run(same: np.ndarray, slot: np.ndarray, fits: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[int, int]:
    """(words, replaced) of the longest run whose ordinary words agree and whose slots hold new values of their type, one new value for each old one."""
    ok = same | (slot & fits)
    while True:
        a, b = clean_run(ok)
        if b - a < LEAST or not (at := np.nonzero(slot[a:b] & ~same[a:b])[0] + a).size:
            return 0, 0
        taken: dict[int, int] = {}
        bad = [k for k in (np.nonzero(slot[a:b])[0] + a).tolist() if taken.setdefault(int(old[k]), int(new[k])) != int(new[k])]
        if not bad:
            return (b - a, len(at)) if 2 * np.count_nonzero(~slot[a:b]) >= b - a else (0, 0)
        ok = ok.copy()
        ok[bad] = False


def leaks_in(words: Words, items: Items) -> dict[int, tuple[int, int, int]]:
    """{item number: (words, template_words, replaced)} of one document."""
    n = len(words.same)
    if n < LEAST or not len(items.hash):
        return {}
    a = np.searchsorted(items.hash, words.template, "left")
    met = np.nonzero(items.hash[np.minimum(a, len(items.hash) - 1)] == words.template)[0]
    if not len(met):
        return {}
    a = a[met]
    k = np.searchsorted(items.hash, words.template[met], "right") - a
    d = np.repeat(words.at[met], k)
    at = np.repeat(a - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(int(k.sum()))
    p = items.pos[at]
    agree = words.exact[d] == items.exact[at]
    item = np.searchsorted(items.start, p, "right") - 1
    line, back, hits = np.unique((item << 32) + (p - d - items.start[item]) + (1 << 31), return_inverse=True, return_counts=True)
    exact = np.bincount(back, agree, len(line)) > 0
    out: dict[int, tuple[int, int, int]] = {}
    # A clean template run of `LEAST` words has that many windows, in at least one of the two templates; a few may keep their words.
    worth = exact | (hits >= LEAST - WINDOW - 3)
    for key, is_exact in zip(line[worth].tolist(), exact[worth].tolist()):
        i = key >> 32
        s, e = int(items.start[i]), int(items.start[i + 1])
        shift = (key & 0xFFFFFFFF) - (1 << 31) + s
        lo, hi = max(s, shift), min(e, n + shift)
        if hi - lo < LEAST:
            continue
        it, doc = slice(lo, hi), slice(lo - shift, hi - shift)
        same = items.same[it] == words.same[doc]
        run = longest_run(same) if is_exact and 10 * np.count_nonzero(same) >= 9 * LEAST else 0
        form, unit = items.form[it], items.unit[it]
        slot = (form == NUMBER) | unit | (form == NAME)
        fits = np.where(form == NUMBER, words.form[doc] == NUMBER, np.where(unit, words.unit[doc], (words.form[doc] == NAME) | (words.form[doc] == OTHER)))
        long, replaced = consistent_run(same, slot, fits, items.same[it], words.same[doc]) if not same.all() else (0, 0)
        if run >= LEAST or long:
            was = out.get(i, (0, 0, 0))
            out[i] = max(was[0], run if run >= LEAST else 0), *max(was[1:], (long, replaced))
    return out


def leaked(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, words, template_words, replaced): documents and the items they hold; a run that is too short counts 0."""
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(doc_id, "text").where(F.col("text").isNotNull() & F.col(doc_id).isNotNull())
    schema = f"{doc_id} long, {item_id} long, words int, template_words int, replaced int"
    out = None
    for block in _blocks(items.select(item_id, "text").where(F.col("text").isNotNull() & F.col(item_id).isNotNull()), block_words):
        held = spark.sparkContext.broadcast(Items(block))

        def run(parts: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            at, ids = held.value, Ids()
            for p in parts:
                rows = []
                for d, t in zip(p[doc_id], p.text):
                    rows += [(d, int(at.ids[i]), *n) for i, n in leaks_in(Words(ids.of(t)), at).items()]
                yield pd.DataFrame(rows, columns=[doc_id, item_id, "words", "template_words", "replaced"])

        got = docs.mapInPandas(run, schema)
        out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.groupBy(doc_id, item_id).agg(F.max("words").alias("words"), F.max(F.struct("template_words", "replaced")).alias("t")).select(doc_id, item_id, "words", "t.template_words", "t.replaced")


def _blocks(items: DataFrame, size: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The items in blocks of bounded size; no more than one block and one partition of items is held at a time."""
    block: list[tuple[int, np.ndarray]] = []
    held, ids = 0, Ids()
    for r in items.toLocalIterator():
        w = ids.of(r[1])
        if block and held + len(w) > size:
            yield block
            block, held = [], 0
        block.append((r[0], w))
        held += len(w)
    if block:
        yield block


def verbatim(found: DataFrame) -> DataFrame:
    """The rows of `leaked` that hold a passage as it is."""
    return found.where(F.col("words") >= LEAST)


def reparameterised(found: DataFrame) -> DataFrame:
    """The rows of `leaked` that hold a passage with other values in its slots."""
    return found.where((F.col("template_words") >= LEAST) & (F.col("replaced") > 0))
