"""Text normalisers and parsers as columns.

The normalisers differ on purpose (spaces kept or not, ASCII only or every script, which part of a name counts); mixing them
changes what joins. Only Unicode normalisation itself leaves the JVM, as one Arrow function each for NFKC with case folding and
for the ASCII fold; all else is built from Spark's own expressions.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_KEY = 4
SECONDARY = r"\s*(?:\(.*|\s[-–]\s.*)$"
KEY_SPLIT = r"[\(\)\[\]|/–—-]"
CITY_MARKS = "[-‐-―/·・'’]+"


def nfkc_casefold(c: Column) -> Column:
    """NFKC and full case folding (Spark's `lower` keeps ß)."""

    @F.pandas_udf("string")
    def fold(v: pd.Series) -> pd.Series:
        return v.map(lambda t: unicodedata.normalize("NFKC", t).casefold() if t is not None else None)

    return fold(c)


def ascii_fold(c: Column) -> Column:
    """NFKD without anything beyond ASCII, lower case; text of other scripts becomes ''."""

    @F.pandas_udf("string")
    def fold(v: pd.Series) -> pd.Series:
        return v.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower() if t is not None else None)

    return fold(c)


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def clean(c: Column) -> Column:
    """`squeeze`, with '' as NULL."""
    return F.nullif(squeeze(c), F.lit(""))


def parse_count(c: Column) -> Column:
    """First number of a text: thousands separators removed, k or m as a suffix unless a letter follows; half-even; else NULL."""
    pattern = r"(\d[\d,.]*)\s*([kKmM](?![A-Za-z]))?"
    raw = F.regexp_replace(F.regexp_extract(c, pattern, 1), ",", "")
    unit = F.lower(F.regexp_extract(c, pattern, 2))
    value = F.when(raw.rlike(r"^\d+\.?\d*$"), F.regexp_replace(raw, r"\.$", "").cast("double"))
    return F.bround(value * F.when(unit == "k", 1e3).when(unit == "m", 1e6).otherwise(1.0)).cast("bigint")


def strict_count(c: Column) -> Column:
    """Digits with thousands separators as a number; '' and anything else is unknown, never 0."""
    digits = F.regexp_replace(F.trim(c), ",", "")
    return F.when(digits.rlike("^[0-9]+$"), digits.cast("bigint"))


def number_or_null(c: Column) -> Column:
    """Text as a finite DOUBLE, else NULL."""
    t = F.trim(c)
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.cast("double"))


def slug_of_url(url: Column) -> Column:
    """Second-last path segment where the last one is a number."""
    parts = F.filter(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), lambda p: p != "")
    return F.when((F.size(parts) >= 2) & F.element_at(parts, -1).rlike("^[0-9]+$"), F.element_at(parts, -2)).otherwise(F.lit(""))


def page_url(base: str, slug: Column, page_id: Column) -> Column:
    """A page's address; '' unless both slug and id are known."""
    known = (F.coalesce(slug, F.lit("")) != "") & (F.coalesce(page_id, F.lit("")) != "")
    return F.when(known, F.concat(F.lit(base.rstrip("/") + "/v/"), slug, F.lit("/"), page_id)).otherwise(F.lit(""))


def category_parts(c: Column) -> Column:
    """Comma-separated parts, folded, in order; blank parts are dropped before folding, so a part of another script stays as ''."""
    marked = F.array_join(F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda p: F.trim(p) != ""), ",")
    return F.when(marked == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(ascii_fold(marked), ","), squeeze))


def join_name(c: Column) -> Column:
    """For comparing names: NFKC and case folded, letters and digits of every script, single blanks."""
    return F.trim(F.regexp_replace(nfkc_casefold(c), r"[^\p{L}\p{N}]+", " "))


def base_name(c: Column) -> Column:
    """A name without what follows a bracket or a spaced dash; the name itself if nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(c, SECONDARY, "")), F.lit("")), F.trim(c))


def name_forms(c: Column) -> Column:
    """The comparable forms of a name: whole and base."""
    return F.filter(F.array_distinct(F.array(join_name(c), join_name(base_name(c)))), lambda x: x != "")


def calibration_keys(c: Column) -> Column:
    """Keys of a name and of its parts between brackets, bars, slashes and dashes: letters and digits only, `MIN_KEY` at least."""
    whole = nfkc_casefold(c)
    key = lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}]", "")
    parts = F.concat(F.split(whole, KEY_SPLIT), F.array(whole))
    return F.filter(F.array_distinct(F.transform(parts, key)), lambda k: F.length(k) >= MIN_KEY)


def locality(c: Column) -> Column:
    """A place name for comparison: folded, text before the first comma, dashes and quotes as blanks."""
    return squeeze(F.regexp_replace(F.split_part(nfkc_casefold(c), F.lit(","), F.lit(1)), CITY_MARKS, " "))


def locality_words(c: Column) -> Column:
    """All words of a place line."""
    words = F.split(squeeze(F.regexp_replace(F.regexp_replace(nfkc_casefold(c), ",", " "), CITY_MARKS, " ")), " ")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def overlap_words(c: Column) -> Column:
    """Words for overlap tests: lower case, letters and digits."""
    words = F.transform(F.split(F.lower(c), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def names_agree(want: Column, got: Column, share: float = 0.5) -> Column:
    """Whether at least `share` of the wanted words are there; nothing wanted agrees with anything."""
    w = overlap_words(want)
    return (F.size(w) == 0) | (F.size(F.array_intersect(w, overlap_words(got))) >= share * F.size(w))


def list_key(c: Column) -> Column:
    """A list's name without a count behind it, case folded."""
    return F.trim(nfkc_casefold(F.regexp_replace(F.trim(c), r"(?i)\s*(?:\(\d+\)|·?\s*\d+\s+places?)$", "")))


def split_names(c: Column) -> Column:
    """Names joined by commas or ` & `."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\s*,\s*|\s+&\s+"), F.trim), lambda n: n != "")


def scope_slug(c: Column) -> Column:
    """ASCII letters and digits joined by dashes; `unnamed` if none is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(ascii_fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("unnamed"))


def city_slug(c: Column) -> Column:
    """`scope_slug`, or the name in its own script where no ASCII is left."""
    own = F.regexp_replace(F.regexp_replace(nfkc_casefold(c), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    slug = scope_slug(c)
    return F.when((slug == "unnamed") & (own != ""), own).otherwise(slug)


def query_text(*parts: Column) -> Column:
    """Non-empty parts joined by commas: what a place is asked for with."""
    return F.concat_ws(", ", *(F.nullif(F.trim(p), F.lit("")) for p in parts))


def with_region(text: Column, region: Column) -> Column:
    """`text` with the region behind it, unless it is named already."""
    named = F.coalesce(F.contains(F.lower(text), F.lower(region)), F.lit(True))
    return F.when(named, text).otherwise(F.concat_ws(", ", text, region))


def row_key(name: Column, address: Column) -> Column:
    """`name | address`, or the name alone."""
    return F.concat_ws(" | ", name, F.nullif(F.trim(address), F.lit("")))


def radius_km(c: Column) -> Column:
    """`5`, `5 km`, `3 mi`, `800 m` as kilometres; anything else, or 0 and less, raises an error."""
    t = F.lower(F.trim(c))
    n, unit = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)\s*(km|mi|m)?$", 1), F.regexp_extract(t, r"^(\d+(?:\.\d+)?)\s*(km|mi|m)?$", 2)
    km = F.when(n != "", n.cast("double") * F.when(unit == "mi", 1.609344).when(unit == "m", 0.001).otherwise(1.0))
    return F.when(km > 0, km).otherwise(F.raise_error(F.concat(F.lit("not a radius: "), F.coalesce(c, F.lit("NULL")))).cast("double"))


def retry_after_seconds(header: Column, now: Column, fallback: float) -> Column:
    """Seconds or an HTTP date as seconds from `now`; the fallback for anything else."""
    h = F.trim(header)
    at = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(F.regexp_replace(h, "^[A-Za-z]+, *", ""), " GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss")))
    return F.coalesce(F.when(h.rlike("^[0-9]+$"), h.cast("double")), F.when(at.isNotNull(), F.greatest(F.lit(0.0), (at - now).cast("double"))), F.lit(float(fallback)))


def or_na(c: Column) -> Column:
    """A count as text, unknown as `n/a`."""
    return F.coalesce(c.cast("string"), F.lit("n/a"))


def stats_line(total: Column, uniques: Column, monthly: Column, category: Column) -> Column:
    """One line of counts; only what is known, but the total is always named."""
    n = lambda c, s: F.when(c.isNotNull(), F.concat(F.format_number(c, 0), F.lit(s)))
    return F.concat_ws(" | ", F.coalesce(n(total, " check-ins"), F.lit("check-ins n/a")), n(uniques, " unique"), n(monthly, "/month"), F.nullif(category, F.lit("")))


def first_phrase(text: Column, phrases: list[str]) -> Column:
    """The first of `phrases` that a text contains, case ignored."""
    hits = F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.lower(text), p))
    return F.when(F.size(hits) > 0, F.element_at(hits, 1))


def request_key(url: Column, params: Column, length: int = 64) -> Column:
    """Fingerprint of a request: SHA-256 of its address and its parameters (a map) in the order of their names."""
    query = F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), F.url_encode(e["value"]))), "&")
    return F.substring(F.sha2(F.concat(url, F.when(F.size(params) > 0, F.concat(F.lit("?"), query)).otherwise(F.lit(""))), 256), 1, length)


def search_url(base: str, query: Column) -> Column:
    """Address of a search, the query encoded as in a form: blanks as plus signs."""
    return F.concat(F.lit(base.rstrip("/") + "/search?q="), F.url_encode(query))
