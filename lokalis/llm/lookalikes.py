"""Characters that look like others: the table, tests on single characters, and the plain folding used as a first step."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Letters of other scripts and the Latin letter of the same look.
LOOK = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S",
    "Т": "T", "Х": "X", "У": "Y", "Ѵ": "V", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ӏ": "I",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v",
    "ԝ": "w", "х": "x", "у": "y", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "γ": "y", "χ": "x", "ε": "e", "ω": "w",
    "ɡ": "g", "ɑ": "a", "ı": "i", "ȷ": "j", "ʏ": "Y", "ꞵ": "ß",
    "Օ": "O", "օ": "o", "Տ": "S", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q",
}
# Letters that may also stand for a second letter, at a small cost.
SECOND = {"І": "l", "Ι": "l", "Ӏ": "l", "ν": "u", "η": "n", "к": "k", "т": "t", "м": "m", "в": "b", "н": "h", "п": "n", "г": "r"}
SECOND_COST = 0.25
# Invisible characters that are not format characters by category.
UNSEEN = "͏ᅟᅠ឴឵᠋᠌᠍᠎ㅤﾠ⠀"
PLAIN = "[^ -~À-ÖØ-öø-ÿ‘’“”–—]"  # a value without such a character has one form only (Java and Python syntax)


@lru_cache(maxsize=100_000)
def kind(ch: str) -> str:
    """plain, blank (shows only a blank), unseen (shows nothing), compat (another form of an ordinary one), look, mark or other."""
    if " " <= ch <= "~":
        return "plain"
    cat = unicodedata.category(ch)
    if cat in ("Cf", "Cc") and ch not in "\t\n\r\v\f\x85" or ch in UNSEEN or "︀" <= ch <= "️":
        return "unseen"
    if ch.isspace() or cat in ("Zs", "Zl", "Zp"):
        return "blank"
    if cat == "Mn":
        return "mark"
    if ch in LOOK:
        return "look"
    k = unicodedata.normalize("NFKC", ch)
    return "compat" if k != ch and unicodedata.normalize("NFC", ch) != k and ch not in "…" else "other"


@lru_cache(maxsize=100_000)
def shown(ch: str) -> str:
    """What an ordinary writer would have typed for this one character."""
    k = kind(ch)
    if k == "unseen":
        return ""
    if k == "blank":
        return " "
    if k == "look":
        return LOOK[ch]
    return unicodedata.normalize("NFKC", ch) if k == "compat" else ch


@lru_cache(maxsize=100_000)
def script(ch: str) -> str:
    """Script of a letter by its Unicode name; '' for what is no letter."""
    if not ch.isalpha():
        return ""
    k = unicodedata.normalize("NFKC", ch)
    return unicodedata.name(k[0], "?").split(" ")[0]


def foreign_word(word: str) -> bool:
    """A word properly written in another script: most of its letters have no Latin look-alike."""
    letters = [c for c in word if c.isalpha()]
    own = sum(1 for c in letters if kind(c) != "look" and script(c) not in ("LATIN", ""))
    latin = sum(1 for c in letters if script(c) == "LATIN")
    return own > latin and own > 0 or (own > 0 and latin == 0)


WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ­​-‏⁠-⁤﻿]+[^\W\d_]+)*[̀-ͯ]*")


def fold(text: str | None) -> str:
    """Plain table folding: composed letters, look-alikes of words in Latin letters, ordinary blanks, lower case, single spaces."""
    if not text:
        return ""
    if text.isascii():
        return " ".join(text.lower().split())
    t = unicodedata.normalize("NFC", "".join(c if kind(c) == "look" else shown(c) for c in text))
    if not t.isascii():
        t = WORD.sub(lambda m: m[0] if m[0].isascii() or foreign_word(m[0]) else "".join(shown(c) for c in m[0]), t)
        t = t.translate({0x2018: "'", 0x2019: "'", 0x201C: '"', 0x201D: '"', 0x2013: "-", 0x2014: "-"})
    return " ".join(t.lower().split())


def bare(text: str) -> str:
    """Without accents."""
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
