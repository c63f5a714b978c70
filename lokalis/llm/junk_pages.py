"""Keyword-stuffed and link-list pages.

Method: every text becomes a sequence of function-word roles and word classes (capitalised and plain content words, numbers, what
is no word: links, tags, disguised words; marks). A trigram model of the classes is trained for each language on the corpus's
sentences, that is on all that begins with a capital behind an end mark, ends in one and is of a sentence's length, whatever
classes are in it; the language of a text is the one with most of its function words. Beside it a cache model codes
the content words themselves: a word not met in the last `MEMORY` words of the page is dear, one met is cheap, one met behind the
same word cheaper still. Both give each stretch of a page a perplexity: lists of links, tags and products are abnormally
perplexing to the first, repeated keywords abnormally predictable to the second. The deviations of a stretch from the usual
(median and median deviation over all stretches of the language), upwards in the first and downwards in the second, add up; a
stretch with `FAR` of them is abnormal, except records (tap lists, opening hours: capitalised names with numbers, no running
words). Where an abnormal stretch meets a usual one the border is put at the place within the two that parts their words best
(least squares), as stretches straddle it. A page is junk if more than half of its words stand in abnormal passages.

Counts and thresholds come from all documents; what is gathered are counts by class triple and two histograms, whose sizes do
not depend on the corpus. Texts are read once; later steps work on their class bytes.

Defined results: NULL, empty and texts of fewer than `LEAST_WORDS` words are no junk; a corpus without sentences flags nothing;
repeated documents are judged each; words and links that stand together without blanks are classified one by one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lokalis.runtime import cut, ship

LEAST_WORDS = 25
STRETCH = 40  # classes in a stretch
FAR = 7.5  # median deviations from the median that make a stretch abnormal
LEAST_SPREAD = 0.15, 0.6  # bits; a corpus of very few sentences spreads less
MEMORY = 60  # words of a page that the cache model keeps in mind
WORD_BITS = np.array([0.0, 10.0, 4.0, 1.0])  # code length: no content word; new to the page's last words; met; met behind the same word
MOST = 0.5  # share of a page's words
RECORD_NUMBERS, RECORD_NAMES, RECORD_RUNNING = 0.08, 0.12, 0.15
# Function words of English, German, French and Spanish by role.
ROLES = {
    "d": "the a an this that these those its my our his her their every some no each der die das den dem des ein eine einen einem einer eines kein keine unser mein le la les un une des ce cette ces son sa ses mon notre el los las una unos unas este esta su sus mi nuestro lo",
    "p": "of in on at to from with by for about into over after before between under without through until since as than during behind beside à de du au aux en dans sur pour par avec sans chez vers depuis entre selon après avant von aus mit bei nach zu zum zur vom im am an auf für über unter durch gegen ohne seit laut vor um del al con sin por para según desde hasta sobre tras",
    "c": "and or but so yet while if because though although when where which who whose what why how und oder aber denn weil wenn dass ob wie wo was als et ou mais donc car que qui quand comme où si y o pero porque cuando donde como",
    "r": "i you he she it we they me us them him one nobody everyone someone something nothing anything ich du er sie es wir ihr sich man niemand je tu il elle on nous vous ils elles se me te yo él ella nosotros usted uno nadie alguien le",
    "v": "is are was were be been being has have had do does did can could will would shall should may might must not ist sind war waren wird werden hat haben hatte kann muss nicht sein est sont était a ont avait peut faut ne pas n'est es son era ha han hay había puede no está",
    "a": "there here then only also too very more most less just still even never always again out up down off all both half few many much same other another once noch nur auch schon sehr mehr immer nie wieder hier dort so alle viele plus très aussi encore toujours jamais bien peu tout tous y muy más menos también siempre nunca ya todo todos solo sólo",
}
# Function words that tell the language.
LANGUAGES = ("the of and is was that it for with", "der das und ist nicht den mit von im ein", "le les des et est une du dans pour il", "el los las y es una con por del se")
LANGUAGE_OF = {w: n for n, ws in enumerate(LANGUAGES, 1) for w in ws.split()}  # 0: none of them
SPEECHES = len(LANGUAGES) + 1
ROLE_OF = {w: r for r, ws in ROLES.items() for w in ws.split()}
CLASSES = "dpcrvaCLNO.,;("  # plus 0 for the border of a text; O: a link, a tag, a disguised word
ID = {c: i + 1 for i, c in enumerate(CLASSES)}
SIZE = len(CLASSES) + 1
WORDLIKE = np.zeros(SIZE, bool)
WORDLIKE[[ID[c] for c in "dpcrvaCLNO"]] = True
CONTENT = np.zeros(SIZE, bool)
CONTENT[[ID[c] for c in "CLO"]] = True
STATE, CAPITAL = 16, 64  # a byte holds a class, in units of this what the cache model knows of the word, and whether it has a capital
LINK = re.compile(r"https?:|www\.|^[\w-]{2,}(?:\.[\w-]{2,})+(?:/\S*)?$|<a\b|href=|</a>", re.I)
PARTS = re.compile(r"[#@]?\w(?:[\w'’@€$&!.-]*\w)?|[^\w\s]")
DISGUISED = re.compile(r"[^\W\d_][\d@€$!]|[\d@€$!][^\W\d_]|^(?:\w\.){2,}\w?$|^(?:\.?\w\.)+\w?$")


LINK_BEGINS = r"(?<=[^\s=\"'(<\[:])(?=https?:)|(?<=[\w,;|>)])(?=www\.)|(?<=[^/:]/)(?=www\.)"
LINKS = re.compile(rf"(?<=[,|])(?=[^,|;])|{LINK_BEGINS}", re.I)
WORDS = re.compile(r"(?<=[,;|/+\\])(?=[^\W_]|[#@])")
CHAIN, CHAINED = re.compile(r"\w{2,}(?:[-._&]\w{2,}){4,}"), re.compile(r"(?<=[-._&])(?=\w)")


def pieces(token: str) -> list[str]:
    """The words and links that stand in text without a blank, each with the marks after it."""
    out = []
    for p in LINKS.split(token):
        if LINK.search(p):
            out.append(p)
        else:
            for x in WORDS.split(p):
                out += CHAINED.split(x) if CHAIN.match(x) else [x]
    return out


def piece_classes(token: str) -> bytes:
    """Classes of one word or link."""
    if LINK.search(token):
        return bytes([ID["O"]])
    if DISGUISED.match(token.strip(",;:!?")) and not token[0].isdigit():
        return bytes([ID["O"]])
    out = []
    for p in PARTS.findall(token):
        c = p[0]
        if c == "#" and len(p) > 1:
            out.append("O")
        elif c.isalnum() or c in "@_":
            low = p.lower()
            if low in ROLE_OF:
                out.append(ROLE_OF[low])
            elif DISGUISED.search(p) and not c.isdigit():
                out.append("O")
            elif c.isdigit():
                out.append("O" if sum(x.isalpha() for x in p) > 2 and DISGUISED.search(p) and "-" not in p else "N")
            elif c.isupper():
                out.append("C")
            else:
                head = low.split("'")[0].split("’")[0]
                out.append(ROLE_OF.get(low if "'" not in low and "’" not in low else "", "L") if head == low else "L")
        elif c in ".!?…":
            out.append(".")
        elif c in ",;:–—":
            out.append("," if c == "," else ";")
        elif c in "()[]{}":
            out.append("(")
        elif c in "\"'’‘“”`«»":
            continue
        else:
            out.append(";")
    return bytes([ID[c] for c in out])


class Known(dict):
    """Classes of blank-separated pieces already met; `joined` has the words of those that hold several, `same` a word's identity."""

    def __init__(self) -> None:
        self.joined: dict[str, list[str]] = {}
        self.same: dict[str, int] = {}
        self.mark: dict[str, int] = {}  # language and whether it has a capital

    def __missing__(self, token: str) -> bytes:
        found = pieces(token)
        if len(found) > 1:
            self.joined[token] = found
        for p in found:
            w = p.strip(".,;:!?\"'()/|><«»*-¿¡“”„‘’")
            self.same[p] = hash(w.lower())  # of one process and one page; it is stored nowhere
            self.mark[p] = LANGUAGE_OF.get(w.lower(), 0) + (CAPITAL if w[:1].isupper() else 0)
        got = self[token] = b"".join(map(piece_classes, found))
        return got

    def trim(self) -> None:
        """Empty it when it grew too large."""
        if len(self) > 400_000:
            self.clear()
            self.joined.clear()
            self.same.clear()
            self.mark.clear()


def behind(h: np.ndarray) -> np.ndarray:
    """How far before each place the same value stood."""
    order = np.argsort(h, kind="stable")
    out = np.full(len(h), np.iinfo(np.int64).max)
    again = h[order[1:]] == h[order[:-1]]
    out[order[1:][again]] = (order[1:] - order[:-1])[again]
    return out


def encoded(text: str, known: Known) -> bytes:
    """The language of a text and its classes, each with the state of its word in the cache model."""
    known.trim()
    tokens = text.split()
    classes = [known[t] for t in tokens]
    if not known.joined.keys().isdisjoint(tokens):
        tokens = [p for t in tokens for p in known.joined.get(t, (t,))]
        classes = [known[t] for t in tokens]
    c = np.frombuffer(b"".join(classes), np.uint8)
    size = np.fromiter(map(len, classes), np.int64, len(classes))
    at = (np.cumsum(size) - size)[size > 0]
    if not len(at):
        return b""
    mark = np.fromiter(map(known.mark.__getitem__, tokens), np.uint8, len(tokens))[size > 0]
    speech = np.bincount(mark % CAPITAL, minlength=SPEECHES)
    speech[0] = 0
    word = np.fromiter(map(known.same.__getitem__, tokens), np.int64, len(tokens))[size > 0]
    pair = word * np.int64(1_000_003)
    pair[1:] += word[:-1]
    state = np.where(behind(pair) <= MEMORY, 3, np.where(behind(word) <= MEMORY, 2, 1))
    out = c.copy()
    out[at] += (np.where(CONTENT[c[at]], STATE * state, 0) + mark // CAPITAL * CAPITAL).astype(np.uint8)
    return bytes([int(speech.argmax())]) + out.tobytes()


def decoded(b: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Language, classes, states, and where a word has a capital."""
    v = np.frombuffer(b, np.uint8)
    return int(v[0]) if len(v) else 0, v[1:] % STATE, v[1:] % CAPITAL // STATE, v[1:] >= CAPITAL


def trigrams(c: np.ndarray) -> np.ndarray:
    """Code of the class triple that ends at each place."""
    p = np.concatenate([[0, 0], c]).astype(np.int64)
    return (p[:-2] * SIZE + p[1:-1]) * SIZE + p[2:]


def sentence_places(c: np.ndarray, capital: np.ndarray) -> np.ndarray:
    """Places between two end marks that begin with a capital and are of a sentence's length."""
    good = np.zeros(len(c), bool)
    start = 0
    for e in np.nonzero(c == ID["."])[0].tolist():
        if 6 <= e - start + 1 <= 60 and capital[start]:
            good[start : e + 1] = True
        start = e + 1
    return good


def surprisal_table(counts: np.ndarray) -> np.ndarray:
    """-log2 P(class | two classes before), interpolated with the lower orders."""
    c3 = counts.reshape(SIZE, SIZE, SIZE).astype(float)
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + 0.05) / (c1 + 0.05).sum()
    p2 = (c2 + 5 * p1[None, :]) / (c2.sum(1, keepdims=True) + 5)
    p3 = (c3 + 5 * p2[None, :, :]) / (c3.sum(2, keepdims=True) + 5)
    return -np.log2(p3).reshape(-1)


class Stretches:
    """Successive stretches of one text: borders, words, mean bits of the two models, and which are records."""

    __slots__ = ("edge", "words", "bits", "record")

    def __init__(self, c: np.ndarray, state: np.ndarray, surprisal: np.ndarray):
        k = max(1, round(len(c) / STRETCH))
        self.edge = np.linspace(0, len(c), k + 1).astype(int)
        add = lambda v: np.add.reduceat(v.astype(float), self.edge[:-1])
        self.words = add(WORDLIKE[c])
        base = np.maximum(self.words, 1)
        content = add(state > 0)
        self.bits = add(surprisal) / np.maximum(np.diff(self.edge), 1), np.where(content > 0, add(WORD_BITS[state]) / np.maximum(content, 1), np.nan)
        running = add((c == ID["L"]) | (c == ID["O"])) / base
        self.record = (add(c == ID["N"]) / base >= RECORD_NUMBERS) & (add(c == ID["C"]) / base >= RECORD_NAMES) & (running <= RECORD_RUNNING)


def abnormal_words(speech: int, c: np.ndarray, state: np.ndarray, tables: list[np.ndarray], usual: list[list[tuple[float, float]]]) -> tuple[float, float]:
    """Words of a text, and those in its abnormal passages with their borders located; `usual`: middle and spread of the two models' bits in each language."""
    if not len(c):
        return 0.0, 0.0
    grams = trigrams(c)
    s = tables[speech][grams]
    t = Stretches(c, state, s)
    (m1, d1), (m2, d2) = usual[speech]
    low = np.maximum(m2 - np.nan_to_num(t.bits[1], nan=m2), 0) / d2
    odd = (np.maximum((t.bits[0] - m1) / d1, 0) + low > FAR) & ~t.record
    if odd.any():
        # A stretch may be in another language than most of its text: the language that fits it best counts.
        size = np.maximum(np.diff(t.edge), 1)
        high = np.minimum.reduce([(np.add.reduceat(table[grams], t.edge[:-1]) / size - m) / d for table, ((m, d), _) in zip(tables, usual)])
        odd &= np.maximum(high, 0) + low > FAR
    if odd.all() or not odd.any():
        return float(t.words.sum()), float(t.words[odd].sum())
    s = s / d1 + np.where(state > 0, m2 - WORD_BITS[state], 0) / d2
    edge, at = t.edge, t.edge.copy()
    for j in (np.nonzero(odd[1:] != odd[:-1])[0] + 1).tolist():
        run = np.cumsum(s[edge[j - 1] : edge[j + 1]])
        n = np.arange(1, len(run))
        at[j] = edge[j - 1] + 1 + int(((run[:-1] - n * run[-1] / len(run)) ** 2 / (n * (len(run) - n))).argmax())
    before = np.concatenate([[0], np.cumsum(WORDLIKE[c])])
    at = np.maximum.accumulate(at)  # a lone stretch whose borders come the wrong way round holds no words
    return float(before[-1]), float(np.diff(before[at])[odd].sum())


BINS, TOP = 2000, 20.0


def junk_scores(documents: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, words, share): words of each text and the share of them in abnormal stretches."""
    spark = documents.sparkSession
    ship(spark)

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Known()
        for p in parts:
            yield pd.DataFrame({doc_id: p[doc_id], "classes": [encoded(t, known) for t in p.text]})

    coded = cut(documents.select(doc_id, "text").where("text is not null and text <> ''").mapInPandas(encode, f"{doc_id} long, classes binary"))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((SPEECHES, SIZE**3), np.int64)
        for p in parts:
            for b in p.classes:
                speech, c, _, capital = decoded(b)
                if len(c) and (good := sentence_places(c, capital)).any():
                    total[speech] += np.bincount(trigrams(c)[good], minlength=SIZE**3)
        speech, at = np.nonzero(total)
        yield pd.DataFrame({"speech": speech, "gram": at, "n": total[speech, at]})

    # At most SPEECHES * SIZE ** 3 rows come to the driver.
    counts = np.zeros((SPEECHES, SIZE**3), np.int64)
    for r in coded.mapInPandas(count, "speech int, gram long, n long").groupBy("speech", "gram").agg(F.sum("n").alias("n")).collect():
        counts[r["speech"], r["gram"]] = r["n"]
    if not counts.sum():
        return coded.select(doc_id, F.lit(0).cast("long").alias("words"), F.lit(0.0).alias("share"))
    counts[0] = counts.sum(0)  # a text of no language is held against all
    tables = [surprisal_table(k) for k in counts]

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((SPEECHES, 2, BINS), np.int64)
        for p in parts:
            for b in p.classes:
                speech, c, state, _ = decoded(b)
                if len(c):
                    t = Stretches(c, state, tables[speech][trigrams(c)])
                    for k, bits in enumerate(t.bits):
                        known = ~np.isnan(bits)
                        total[speech, k] += np.bincount(np.minimum((bits[known] / TOP * BINS).astype(int), BINS - 1), t.words[known], BINS).astype(np.int64)
        speech, model, at = np.nonzero(total)
        yield pd.DataFrame({"speech": speech, "model": model, "bin": at, "n": total[speech, model, at]})

    hist = np.zeros((SPEECHES, 2, BINS), np.int64)
    for r in coded.mapInPandas(score, "speech int, model int, bin int, n long").groupBy("speech", "model", "bin").agg(F.sum("n").alias("n")).collect():
        hist[r["speech"], r["model"], r["bin"]] = r["n"]
    hist[0] = hist.sum(0)
    usual = [[middle_and_spread(h, least) for h, least in zip(two, LEAST_SPREAD)] for two in hist]

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            words, share = [], []
            for b in p.classes:
                speech, c, state, _ = decoded(b)
                n, odd = abnormal_words(speech, c, state, tables, usual)
                words.append(int(n))
                share.append(odd / n if n else 0.0)
            yield pd.DataFrame({doc_id: p[doc_id], "words": words, "share": share})

    return coded.mapInPandas(judge, f"{doc_id} long, words long, share double")


def quantile(hist: np.ndarray, q: float) -> float:
    """Value below which a share `q` of the histogram lies."""
    run = np.cumsum(hist)
    return (int(np.searchsorted(run, q * run[-1])) + 0.5) / BINS * TOP if run[-1] else math.nan


def middle_and_spread(hist: np.ndarray, least: float) -> tuple[float, float]:
    """Median and median deviation of a histogram, the latter no less than `least`."""
    if not hist.any():
        return 0.0, least
    middle = quantile(hist, 0.5)
    away = np.zeros(BINS, np.int64)
    np.add.at(away, np.abs(np.arange(BINS) - int(middle / TOP * BINS)), hist)
    return middle, max(quantile(away, 0.5), least)


def junk_pages(documents: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, share) of the junk pages."""
    return junk_scores(documents, doc_id).where((F.col("words") >= LEAST_WORDS) & (F.col("share") > MOST)).select(doc_id, "share")
