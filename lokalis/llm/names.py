"""Names of venues taken apart: distinctive words, kind of house, branch; similarity by optimal assignment of words."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

from lokalis.llm.edits import Lexicon, deletes, osa
from lokalis.llm.lookalikes import bare, fold, script

# Number words.
NUMBERS = {"one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12", "thirteen": "13", "twenty": "20"}
# Short forms of given names.
NICK = {
    "rob": "robert", "bob": "robert", "bert": "robert", "rick": "richard", "dick": "richard", "rich": "richard", "will": "william", "bill": "william",
    "alex": "alexander", "sandy": "alexander", "ted": "theodore", "theo": "theodore", "tony": "anthony", "kate": "katherine", "kathy": "katherine",
    "kat": "katherine", "josie": "josephine", "jo": "josephine", "nell": "eleanor", "ellie": "eleanor", "nora": "eleanor", "fred": "frederick",
    "freddie": "frederick", "meg": "margaret", "peggy": "margaret", "maggie": "margaret", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth",
    "jim": "james", "tom": "thomas", "sam": "samuel", "dan": "daniel", "mike": "michael", "joe": "joseph", "ed": "edward", "ned": "edward",
    "eddie": "edward", "chris": "christopher", "max": "maximilian", "ben": "benjamin", "nick": "nicholas", "harry": "henry", "hank": "henry",
    "jack": "john", "charlie": "charles", "chuck": "charles", "george": "george", "sue": "susan", "jenny": "jennifer", "mandy": "amanda",
    "abby": "abigail", "becky": "rebecca", "vicky": "victoria", "lexi": "alexandra", "matt": "matthew", "dave": "david", "steve": "stephen", "andy": "andrew", "dot": "dorothy", "dolly": "dorothy", "dottie": "dorothy", "kitty": "katherine", "fritz": "frederick", "bess": "elizabeth", "gus": "augustus", "al": "albert", "lou": "louise", "pat": "patricia", "ron": "ronald", "walt": "walter", "frank": "francis", "millie": "mildred", "winnie": "winifred",
}
# Words that say what kind of house it is, by kind.
KINDS = {
    "brewery": ["brewery", "breweries", "brewing", "brew", "brewers", "brewpub", "company", "comp", "co", "craft", "beer", "bier", "brewhouse", "brau", "brauerei", "brauhaus", "cerveceria", "brasserie", "birrificio"],
    "house": ["house", "public", "pub", "ph", "alehouse", "ale", "beerhouse", "bh"],
    "garden": ["garden", "gardens", "biergarten", "beergarden", "gard", "bg"],
    "shop": ["shop", "bottle", "store", "bottleshop", "bottleshoppe", "bs"],
    "tap": ["taproom", "tap", "room", "taphouse"],
    "kitchen": ["kitchen", "kitch"],
    "bar": ["bar", "bodega", "cafe", "tavern", "tav", "inn"],
    "gasthaus": ["gasthaus", "gasth", "gh", "zum", "gasthof"],
}
KIND_OF = {w: k for k, ws in KINDS.items() for w in ws}
LONG_KINDS = Lexicon((w for w in KIND_OF if len(w) >= 5), 1)
END_KIND = ["bar", "inn", "pub", "tap", "shop", "room", "beer", "house"]
# Words for such houses in other scripts.
ELSEWHERE = ["μπυραρια", "ταβερνα", "μπαρ", "καφε", "пивная", "пивоварня", "таверна", "бар", "паб", "кафе", "ресторан", "פאב", "בר", "מבשלה", "ビール", "バー", "パブ", "居酒屋"]
ELSEWHERE_NEAR = Lexicon(ELSEWHERE, 1), Lexicon([w for w in ELSEWHERE if len(w) >= 6], 2)
IGNORED = {"the", "and", "n", "of", "s", "at", "und", "et", "y"}
# Short forms that begin some names.
OPENERS = {"st": "saint", "mt": "mount", "mnt": "mount", "ste": "saint", "sant": "saint"}
# Letters of other scripts by their usual Latin letter.
LATIN = {
    **dict(zip("αβγδεζηθικλμνξοπρσςτυφχψωάέίόύήώ", "abgdezhtiklmnxoprsstufhyvaeiouho")),
    **dict(zip("абвгдежзийклмнопрстуфхцчшщыьэюя", "abvgdezziiklmnoprstufhkhhhi eua")),
    **dict(zip("אבגדהוזחטיכלמנסעפצקרשתםןךףץ", "abgdhozhtiklmnsapzkrstmnkfz")),
    **dict(zip("アイウエオカクスズトドンハフブプビピムリルワヴヤジグ", "aiueokksztdnhfbpbpmrlvvijg")),
}
PIECE = re.compile(r"[^\W_]+(?:['`’][^\W_]+)*")
LAST_PART = re.compile(r"\s[-–—@]\s*([^\W\d_]{4,})$")
BRANCH = re.compile(r"\s+[-–—@]\s*|\s*[-–—@]\s+|\s*[,(]\s*|\)\s*")


@lru_cache(maxsize=20_000)
def latin(word: str) -> str:
    """Latin spelling of a word in another script."""
    return "".join(LATIN.get(c, c) for c in word).replace(" ", "")


def sounds(word: str) -> str:
    """Letters of one sound together, so that a spelling survives a change of script."""
    w = word.translate(SAME).replace("x", "ks").replace("e", "")
    return re.sub(r"(.)\1+", r"\1", w)


SAME = str.maketrans("cqjyw", "kkiiv")


@lru_cache(maxsize=20_000)
def skeleton(word: str) -> str:
    """The kind word that a word without vowels is short for (its letters in order, the first and the last one, but for a final vowel, the same), or ''."""
    if 2 <= len(word) <= 7 and not set(word[:-1]) & set("aeiou"):
        for k in SKELETON_OF:
            if k[0] == word[0] and word[-1] in (k[-1], k.rstrip("aeiou")[-1]) and len(k) > len(word) + 1 and 4 * len(word) >= len(k):
                rest = iter(k)
                if all(c in rest for c in word):
                    return k
    return ""


SKELETON_OF = [w for w in KIND_OF if len(w) >= 4 and w.isascii()]


@lru_cache(maxsize=20_000)
def near_article(word: str, article: str) -> bool:
    """Whether a word of up to four letters is an article or "and" mistyped."""
    return 2 <= len(word) <= 4 and word not in KIND_OF and word not in NICK and osa(word, article, 1) <= 1


@lru_cache(maxsize=50_000)
def kind_of(word: str, last: bool) -> str:
    """Kind of house a word stands for, one typo allowed in a longer word; '' if none."""
    if word in KIND_OF:
        return KIND_OF[word]
    if len(word) >= 4 and (got := LONG_KINDS.near(word)):
        return KIND_OF[got[0]]
    if short := skeleton(word):
        return KIND_OF[short]
    if last and 2 <= len(word) <= 6:
        for w in END_KIND:
            if w[0] == word[0] and osa(word, w, 1) <= 1:
                return KIND_OF[w]
    return ""


FRONT = frozenset({*NUMBERS, "the", "and", "cafe", "brau"})
FULL = frozenset(NICK.values())
GLUED = frozenset(w for w in KIND_OF if w.isascii() and (len(w) >= 4 and w not in ("comp", "brew", "room", "public", "craft") or w in ("bar", "inn")))
GLUED_SIZES = sorted({len(w) for w in GLUED}, reverse=True)


@lru_cache(maxsize=50_000)
def unglue(word: str) -> tuple[str, ...]:
    """A word with a kind, a number or an article written onto it."""
    m = re.match(r"^(\d+)([^\W\d_]{3,})$", word)
    if m:
        return (m[1], *unglue(m[2]))
    if word in KIND_OF:
        return (word,)
    if word in NICK or word in FULL:
        return (word,)
    for size in (3, 4, 5, 6, 8):
        if len(word) >= size + 4 and word[:size] in FRONT:
            return (word[:size], *unglue(word[size:]))
    for size in GLUED_SIZES:
        if len(word) >= size + (4 if size >= 4 else 5) and word[-size:] in GLUED:
            return (*unglue(word[:-size]), word[-size:])
        if size >= 6 and len(word) >= size + 5 and word[:size] in GLUED:
            return (word[:size], *unglue(word[size:]))
    return (word,)


AROUND = {"on", "sea", "magna", "junction"}


class Name:
    """core: distinctive words; kinds: kinds of house; branch: branch of the house; native: core is in another script."""

    __slots__ = ("core", "kinds", "branch", "native", "flat", "sound", "squashed", "whole", "words")

    def __init__(self, core, kinds, branch, native, words):
        self.words = words
        self.whole = "".join(w for w in words if w not in IGNORED)
        self.squashed = "".join(core)
        self.core, self.kinds, self.branch, self.native = core, kinds, branch, native
        self.flat = "".join(sorted(core))
        self.sound = sounds("".join(core)) if native else ""


@lru_cache(maxsize=20_000)
def near_word(word: str, words: frozenset) -> str:
    """The word of a lexicon that `word` is, one typo allowed."""
    if word in words:
        return word
    if len(word) >= 5:
        for w in lexicon(words).near(word):
            if len(w) >= 5:
                return w
    return ""


@lru_cache(maxsize=64)
def lexicon(words: frozenset) -> Lexicon:
    return Lexicon(words, 1)


def parse(name: str, branches: frozenset = frozenset(), places: frozenset = frozenset()) -> Name:
    """Take a name apart. `branches`: words known to name branches; `places`: words of the towns around."""
    text = bare(fold(name)).replace("’", "'")
    text = re.sub(r"\b(?:[a-z]\.){2,}", lambda m: m[0].replace(".", "") + " ", text)
    said = LAST_PART.search(text)
    if said and kind_of(said[1], False):
        said = None
    parts = [p for p in BRANCH.split(text[: said.start()] if said else text) if p]
    words: list[str] = []
    for p in parts:
        for w in PIECE.findall(p):
            w = re.sub(r"['`’]s?$|['`’]", "", w) if w.endswith(("'s", "`s", "'")) else w.replace("'s", " ").replace("'", "").replace("`", "")
            for x in w.split():
                words += unglue(x) if x.isascii() else (x,)
    core: list[str] = []
    kinds: set[str] = set()
    branch, native, foreign = (near_word(said[1], branches) or said[1]) if said else "", False, []
    for i, w in enumerate(words):
        last = i == len(words) - 1
        if w in IGNORED or len(words) > 2 and (i == 0 and near_article(w, "the") or 0 < i < len(words) - 1 and near_article(w, "and")):
            continue
        w = OPENERS.get(w, w)
        if not w.isascii() and script(w[0]) not in ("LATIN", ""):
            if ELSEWHERE_NEAR[0].near(w) if len(w) < 6 else ELSEWHERE_NEAR[1].near(w):
                kinds.add("any")
            else:
                foreign.append(latin(w))
            continue
        w = NUMBERS.get(w, w)
        if i and (b := near_word(w, branches)):
            branch = b
            continue
        k = kind_of(w, last and len(core) > 0)
        if k:
            kinds.add(k)
            continue
        core.append(NICK.get(w, w))
    if len(core) > 1 and places:
        rest = [w for w in core[:1]] + [w for w in core[1:] if w not in AROUND and not near_word(w, places)]
        core = rest or core
    if not core and foreign:
        core, native = foreign, True
    if not core:
        core = [w for w in words if w not in IGNORED]
    return Name(tuple(core), frozenset(kinds), branch, native, [NUMBERS.get(w, w) for w in words])


@lru_cache(maxsize=10_000)
def neighbourhood(word: str) -> frozenset:
    """Symmetric-delete keys: two words share one if they are within two edits (one in words of up to four letters)."""
    if len(word) <= 2 or word.isdigit():
        return frozenset({word})
    return frozenset(deletes(word, 2 if len(word) >= 5 else 1))


NICKS = Lexicon((k for k in NICK if len(k) >= 3), 1)


@lru_cache(maxsize=20_000)
def near_nick(word: str) -> tuple[str, ...]:
    return tuple(NICKS.near(word)) if len(word) <= 8 else ()


@lru_cache(maxsize=100_000)
def word_cost(a: str, b: str) -> float:
    """0 for the same word, up to 1 for typos, an initial or a cut form; 9 for different words."""
    if a == b:
        return 0.0
    if a.isdigit() or b.isdigit():
        if a.isdigit() and b.isdigit():
            return 9.0
        w, n = (b, a) if a.isdigit() else (a, b)
        return 0.6 if len(w) >= 3 and any(v == n and osa(w, k, 1) <= 1 for k, v in NUMBERS.items()) else 9.0
    s, l = (a, b) if len(a) <= len(b) else (b, a)
    if len(s) == 1:
        return 0.6 if l.startswith(s) and len(l) > 2 else 9.0
    most = 0 if len(l) <= 2 else 1 if len(l) <= 4 else 2 if len(l) <= 9 else 3
    d = osa(a, b, most)
    if d <= most:
        return 0.35 * d
    if len(s) >= 3 and l.startswith(s) and len(l) - len(s) >= 2 and len(l) <= 2.6 * len(s):
        return 0.9
    if any(osa(l, NICK[k], 1) <= 1 for k in near_nick(s)):
        return 0.8
    return 9.0


MOST_COST = 2.2  # of an assignment that counts


@lru_cache(maxsize=50_000)
def soft(word: str) -> bool:
    """A word that may be missing: an article, "and", a kind of house, with typos."""
    if len(word) <= 4 and any(w in ("the", "and") or w[0] == word[0] for w in SOFT_SHORT.near(word)):
        return True
    if len(word) >= 2 and any(w.startswith(word) for w in ("craft", "brewing", "company", "brasserie", "garden", "bodega", "tavern", "public")):
        return True
    return len(word) >= 4 and bool(SOFT_LONG.near(word))


SOFT_SHORT = Lexicon(["the", "and", *(w for w in KIND_OF if 3 <= len(w) <= 5)], 1)
SOFT_LONG = Lexicon([w for w in KIND_OF if len(w) >= 5 and w.isascii()] + ["beer", "craft", "brewingcompany", "beercompany", "beergarden", "beerhouse", "bottleshop", "craftbrewery", "publichouse", "beerco", "bottlestore", "brewco"], 2)


def assign(a: tuple[str, ...], b: tuple[str, ...], most: float = MOST_COST) -> float:
    """Least total cost of giving each word of the shorter name a word of its own in the longer one; words left over must be soft. 9 if it is over `most`.

    Equal words of the longer name are one kind of which several may be used, so repeated words do not multiply the states.
    """
    if len(a) > len(b):
        a, b = b, a
    types = list(Counter(b).items())
    shift, at = [], 0
    for _, n in types:
        shift.append(at)
        at += n.bit_length()
    full = [n for _, n in types]
    if len(b) > 12:  # a long name: words without a partner within the bound are known beforehand
        here = set(b)
        if sum(1 for w in a if w not in here) * 0.3 > most and sum(n for w, n in types if w not in set(a)) * 0.3 > most:
            return 9.0
    states = {0: 0.0}
    for w in sorted(a):
        cost = [(j, c) for j, (x, _) in enumerate(types) if (c := word_cost(w, x)) <= most]
        may_lack = soft(w)
        nxt: dict[int, float] = {}
        for used, c in states.items():
            for j, k in cost:
                if (used >> shift[j] & (1 << full[j].bit_length()) - 1) < full[j] and c + k <= most and c + k < nxt.get(t := used + (1 << shift[j]), 9.0):
                    nxt[t] = c + k
            if may_lack and c + 0.5 <= most and c + 0.5 < nxt.get(used, 9.0):
                nxt[used] = c + 0.5
        states = nxt
        if not states:
            return 9.0
    best = 9.0
    for used, c in states.items():
        if used:
            over = [(x, n - (used >> shift[j] & (1 << n.bit_length()) - 1)) for j, (x, n) in enumerate(types)]
            total = c + 0.3 * sum(n for _, n in over)
            if total <= most and total < best and all(not n or soft(x) for x, n in over):
                best = total
    return best


WEAK = 0.05  # similarity of names that other evidence must make up for


def same_name(x: Name, y: Name, need_branch: bool = True, weak: bool = False) -> float:
    """Confidence in (0, 1] that two names are of one venue; 0 if not. Without `need_branch`, one of them may lack its branch.

    With `weak`, an assignment above the bound for the names' length still gives `WEAK`.
    """
    if x.branch != y.branch and not (x.branch and y.branch and osa(x.branch, y.branch, 1) <= 1):
        if need_branch or x.branch and y.branch:
            return 0.0
        return 0.85 * same_name(Name(x.core, x.kinds, "", x.native, x.words), Name(y.core, y.kinds, "", y.native, y.words), weak=weak)
    if x.kinds and y.kinds and not x.kinds & y.kinds and "any" not in x.kinds | y.kinds:
        return 0.0
    if x.native != y.native:
        a, b = (x.sound or sounds("".join(x.core))), (y.sound or sounds("".join(y.core)))
        return 0.8 if len(a) >= 3 and osa(a, b, 1) <= (1 if len(a) >= 5 else 0) else 0.0
    cost = assign(x.core, y.core)
    if cost < 9:
        size = len(x.flat) + len(y.flat)
        if cost <= 0.7 or size >= 16 and cost <= 1.5 or size >= 24:
            return max(0.05, 1 - cost / (1 + len(x.core)))
        return WEAK if weak else 0.0
    # Words written together or apart: compared without blanks.
    a, b = x.squashed, y.squashed
    most = 3 if min(len(a), len(b)) >= 14 else 2 if min(len(a), len(b)) >= 9 else 1
    if min(len(a), len(b)) >= 5 and set(re.findall(r"\d+", a)) == set(re.findall(r"\d+", b)) and len(x.core) != len(y.core) and osa(a, b, most) <= most:
        return 0.5
    a, b = x.whole, y.whole
    most = 3 if min(len(a), len(b)) >= 14 else 2 if min(len(a), len(b)) >= 10 else 1
    if min(len(a), len(b)) >= 7 and osa(a, b, most) <= most and len(x.core) != len(y.core):
        return 0.5
    return 0.0
