"""Vocabulary rules over category lines and simple shape tests over counts, as columns.

The vocabularies are parameters; the defaults below are data, not logic. Every decision carries its reason, and unknown counts
decide nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lokalis.functions.text import ascii_fold, category_parts

# Phrases searched in the whole folded line, in this order.
KIND_PHRASES = {
    "brewery": ["brewery", "brewpub", "brew pub", "taproom", "tap room", "cidery", "meadery", "microbrewery"],
    "bottle_shop": ["bottle shop", "bottleshop", "liquor store", "beer store", "off licence", "off-licence", "off license"],
    "craft_beer_bar": ["craft beer", "beer bar", "beer garden", "beer hall", "bottle share"],
    "non_beer": ["cafe", "coffee", "tea house", "bakery", "juice", "convenience store", "grocery", "supermarket"],
}
# Whole category parts that keep a row, by kind, in this order.
KEEP_PARTS = {
    "brewery": ["brewery", "brewpub", "brew pub", "microbrewery", "taproom", "tap room", "cidery", "meadery"],
    "bottle_shop": ["bottle shop", "bottleshop", "beer store", "liquor store", "off licence", "off-licence", "off license"],
    "beer_bar": ["beer bar", "craft beer bar", "craft beer", "beer garden", "biergarten", "beer hall"],
}


def possible_home(uniques: Column, total: Column, most: int = 3, least: int = 20) -> Column:
    """Many visits by very few people."""
    return F.coalesce((uniques <= most) & (total >= least), F.lit(False))


def possibly_gone(monthly: Column, total: Column, most: int = 0, least: int = 50) -> Column:
    """A long history and no activity."""
    return F.coalesce((monthly <= most) & (total >= least), F.lit(False))


def phrase_kind(category: Column, phrases: dict[str, list[str]] | None = None, otherwise: str = "unsettled") -> Column:
    """Kind of the first group with a phrase anywhere in the folded line."""
    line = ascii_fold(F.coalesce(category, F.lit("")))
    out = F.lit(otherwise)
    for kind, ps in reversed((phrases or KIND_PHRASES).items()):
        hit = F.lit(False)
        for p in ps:
            hit = hit | F.contains(line, F.lit(p))
        out = F.when(hit, kind).otherwise(out)
    return out


def part_kind(category: Column, vocabulary: dict[str, list[str]] | None = None) -> Column:
    """(kind, part) of the first group that has a whole part of the line, the first such part; kind NULL if none."""
    parts = category_parts(category)
    out = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("part"))
    for kind, ps in reversed((vocabulary or KEEP_PARTS).items()):
        hits = F.filter(parts, lambda p: p.isin(ps))  # noqa: B023 - evaluated at once
        out = F.when(F.size(hits) > 0, F.struct(F.lit(kind).alias("kind"), F.element_at(hits, 1).alias("part"))).otherwise(out)
    return out


def closure_flag(status: Column, monthly: Column, total: Column) -> Column:
    """`closed` for the two statuses that say so, `possibly_closed` by activity, else ''."""
    return F.when(status.isin("CLOSED_PERMANENTLY", "CLOSED_TEMPORARILY"), "closed").when(possibly_gone(monthly, total), "possibly_closed").otherwise("")


def osm_kind(tags: Column) -> Column:
    """First non-empty of the tags amenity, craft and shop; `unknown` if none."""
    return F.coalesce(*(F.nullif(tags.getItem(k), F.lit("")) for k in ("amenity", "craft", "shop")), F.lit("unknown"))


def drinking_element(tags: Column) -> Column:
    """Whether an element is one of the kinds that are asked for."""
    t = lambda k: F.coalesce(tags.getItem(k), F.lit(""))
    return t("amenity").isin("bar", "pub", "biergarten") | t("craft").isin("brewery", "distillery") | (t("microbrewery") == "yes") | (t("shop") == "alcohol")


def full_counts(total: Column, uniques: Column, monthly: Column) -> Column:
    """Whether all three public counts are known."""
    return total.isNotNull() & uniques.isNotNull() & monthly.isNotNull()


def said_closed(status: Column) -> Column:
    """Whether a status says that a place is closed; no other status does."""
    return F.coalesce(status.isin("CLOSED_PERMANENTLY", "CLOSED_TEMPORARILY"), F.lit(False))


def has_part(category: Column, vocabulary: list[str]) -> Column:
    """Whether a comma-separated part of a label is in a vocabulary of lower-case words; accents count."""
    return F.exists(F.split(F.coalesce(category, F.lit("")), ","), lambda p: F.lower(F.trim(p)).isin(vocabulary))


def cut_off(found: Column, full: int = 55) -> Column:
    """Whether an answer holds so many rows that it was cut off; no rows are a whole answer."""
    return F.coalesce(found >= full, F.lit(False))
