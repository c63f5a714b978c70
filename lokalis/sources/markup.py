"""Captured screens (XML) and pages (HTML) as tables. Parsing runs in Arrow batches; everything after it is column expressions.

Documents that can't be read, or are not what they should be, come out in the `error` column instead of as an empty answer.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lokalis.functions.text import parse_count, slug_of_url

BOUNDS = re.compile(r"\[(-?\d+),(-?\d+)\]\[(-?\d+),(-?\d+)\]")
# Patterns of coordinates in a page, tried in this order.
COORDINATES = [
    r"staticmap[^\"']*?center=(-?\d+\.\d+),(-?\d+\.\d+)",
    r"data-latitude=[\"'](-?\d+\.\d+)[\"'][^>]*?data-longitude=[\"'](-?\d+\.\d+)[\"']",
    r"maps[^\"']*?[?&](?:q|query|daddr|ll)=(-?\d+\.\d+),(-?\d+\.\d+)",
    r"[\"']lat(?:itude)?[\"']\s*:\s*(-?\d+\.\d+)\s*,\s*[\"']l(?:ng|on|ongitude)[\"']\s*:\s*(-?\d+\.\d+)",
    r"\bcenter\s*:\s*\{?\s*lat\s*:\s*(-?\d+\.\d+)\s*,\s*lng\s*:\s*(-?\d+\.\d+)",
]
# Labels of controls that are no pins.
CONTROLS = ["Filter", "Switch to list view", "Switch to map view", "Places", "Producers", "Google Map", "Reset location", "View Menu", "View", "Back to Discover", "Close", "Clear", "Back", "filters", "VENUES", "BREWERIES", "My Location", "Refresh search"]
NODE = "seq int, cls string, text string, label string, checked boolean, x1 int, y1 int, x2 int, y2 int, error string"


def screen_nodes(dumps: DataFrame, key: str = "dump_id", xml: str = "xml") -> DataFrame:
    """Every node of every screen dump in document order; an unreadable dump gives one row with its error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for k, text in zip(p[key], p[xml]):
                try:
                    nodes = list(ET.fromstring(text or "").iter())
                except ET.ParseError as e:
                    rows.append((k, 0, None, None, None, None, None, None, None, None, f"not XML: {e}"))
                    continue
                for n, node in enumerate(nodes):
                    m = BOUNDS.fullmatch(node.get("bounds") or "")
                    rows.append((k, n, node.get("class"), node.get("text"), node.get("content-desc"), node.get("checked") == "true", *(map(int, m.groups()) if m else (None,) * 4), None))
            out = pd.DataFrame(rows, columns=[key, *(c.split()[0] for c in NODE.split(", "))])
            yield out.astype({c: "Int32" for c in ("seq", "x1", "y1", "x2", "y2")})

    kind = dumps.schema[key].dataType.simpleString()
    return dumps.select(key, xml).mapInPandas(run, f"{key} {kind}, {NODE}")


def screen_errors(nodes: DataFrame, key: str = "dump_id", needed: tuple[str, ...] = ("Google Map", "Switch to list view")) -> DataFrame:
    """(key, error) of the dumps that are unreadable or lack one of the labels that mark the right screen."""
    has = [F.coalesce(F.bool_or((F.col("label") == n) | (F.col("text") == n)), F.lit(False)) for n in needed]
    ok = has[0]
    for h in has[1:]:
        ok = ok & h
    return nodes.groupBy(key).agg(F.max("error").alias("error"), ok.alias("_ok")).select(key, F.coalesce("error", F.when(~F.col("_ok"), F.lit("not the expected screen"))).alias("error")).where("error is not null")


def pins(nodes: DataFrame, key: str = "dump_id") -> DataFrame:
    """(key, name, x, y) of the pins of a map screen: the first of each name, at the tip of its marker."""
    name = F.trim(F.regexp_replace("label", r"\.+$", ""))
    rows = nodes.where(F.col("cls").endswith(".View") & (F.trim("label") != "") & ~F.trim("label").isin(CONTROLS) & F.col("x1").isNotNull())
    rows = rows.select(key, name.alias("name"), "seq", F.floor((F.col("x1") + F.col("x2")) / 2).cast("int").alias("x"), F.col("y2").alias("y")).where("name <> ''")
    return rows.groupBy(key, "name").agg(F.min_by(F.struct("x", "y", "seq"), "seq").alias("p")).select(key, "name", "p.x", "p.y", "p.seq")


def category_rows(nodes: DataFrame, key: str = "dump_id") -> DataFrame:
    """(key, name, count, checked) of the rows of a filter panel; the last of a name counts, a row without a number has count NULL."""
    rows = nodes.where(F.col("cls").endswith("CheckBox"))
    label = F.regexp_replace(F.trim(F.coalesce(F.nullif("label", F.lit("")), F.col("text"))), r",\s*$", "")
    n = F.regexp_extract(label, r"^(.+),\s*(\d+)$", 2)
    got = rows.select(key, "seq", F.when(n != "", F.regexp_extract(label, r"^(.+),\s*(\d+)$", 1)).otherwise(label).alias("name"), F.when(n != "", n.cast("bigint")).alias("count"), "checked")
    return got.where("name <> ''").groupBy(key, "name").agg(F.max_by(F.struct("count", "checked"), "seq").alias("r")).select(key, "name", "r.*")


def page_point(html: Column) -> Column:
    """(lat, lng) of a page: the first pattern whose first match is a place; NULL if none is."""
    out = F.lit(None).cast("struct<lat:double,lng:double>")
    for p in reversed(COORDINATES):
        lat, lng = F.nullif(F.regexp_extract(html, p, 1), F.lit("")).cast("double"), F.nullif(F.regexp_extract(html, p, 2), F.lit("")).cast("double")
        ok = lat.between(-90, 90) & lng.between(-180, 180) & ~((lat == 0) & (lng == 0))
        out = F.when(F.coalesce(ok, F.lit(False)), F.struct(lat.alias("lat"), lng.alias("lng"))).otherwise(out)
    return out


class _Tree(HTMLParser):
    """Texts of the elements asked for: a list of (tag, class, href, depth, text)."""

    VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}

    def __init__(self):
        super().__init__()
        self.stack: list[list] = []
        self.done: list[dict] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag not in self.VOID:
            self.stack.append([tag, a.get("class") or "", a.get("href") or "", [], len(self.done)])
            self.done.append({"tag": tag, "cls": (a.get("class") or "").split(), "href": a.get("href") or "", "text": "", "up": [e[4] for e in self.stack[:-1]]})

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        for e in self.stack:
            self.done[e[4]]["text"] += data + " "


def _elements(html: str) -> list[dict]:
    t = _Tree()
    t.feed(html or "")
    for e in t.done:
        e["text"] = " ".join(e["text"].split())
    return t.done


LABEL = re.compile(r"\b(TOTAL|UNIQUE|MONTHLY|YOU)\b", re.I)


def page_stats(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, total, unique, monthly, you, lat, lng, geo_source, error) of captured pages.

    The label of an item of the stats block says what it counts, never its place; of a label given twice the last counts. A page
    that asks for a login and one without a known label are errors, not zeros.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for k, text in zip(p[key], p[html]):
                got: dict = dict.fromkeys(("total", "unique", "monthly", "you"))
                els = _elements(text)
                blocks = {i for i, e in enumerate(els) if "stats" in e["cls"]}
                items = [e["text"] for e in els if e["tag"] == "li" and blocks & set(e["up"])]
                seen = False
                for t in items:
                    if m := LABEL.search(t):
                        seen = True
                        got[m[1].lower()] = LABEL.sub(" ", t)
                error = None
                if len(items) < 2:
                    seen, got = False, dict.fromkeys(got)  # one item is no stats block
                if not seen:
                    error = "login required" if re.search(r"log ?in to view", text or "", re.I) else "no stats block" if len(items) < 2 else "no known label"
                rows.append((k, *got.values(), error, text))
            yield pd.DataFrame(rows, columns=[key, "total", "unique", "monthly", "you", "error", html])

    kind = pages.schema[key].dataType.simpleString()
    raw = pages.select(key, html).mapInPandas(run, f"{key} {kind}, total string, unique string, monthly string, you string, error string, {html} string")
    at = page_point(F.col(html))
    return raw.withColumn("_p", at).select(key, *(parse_count(F.col(c)).alias(c) for c in ("total", "unique", "monthly", "you")), "_p.lat", "_p.lng", F.when(F.col("_p").isNotNull(), "embedded").otherwise("none").alias("geo_source"), "error")


def search_cards(pages: DataFrame, key: str = "page_id", html: str = "html", item: str = "beer-item") -> DataFrame:
    """(key, pos, venue_id, slug, name, category, address, city) of the result cards of captured pages.

    The last line of a card is its city if there are at least two and it has no digit; the address is the first line with one; the
    category the first line that is not the address.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for k, text in zip(p[key], p[html]):
                els = _elements(text)
                pos = 0
                for i, card in enumerate(els):
                    if item not in card["cls"]:
                        continue
                    inner = [e for e in els if i in e["up"]]
                    link = next((e for e in inner if e["tag"] == "a" and e["href"].startswith("/v/")), None)
                    if link:
                        rows.append((k, pos, link["href"], link["text"], [e["text"] for e in inner if e["tag"] == "p" and "style" in e["cls"] and e["text"]]))
                        pos += 1
            yield pd.DataFrame(rows, columns=[key, "pos", "href", "name", "lines"])

    kind = pages.schema[key].dataType.simpleString()
    raw = pages.select(key, html).mapInPandas(run, f"{key} {kind}, pos int, href string, name string, lines array<string>")
    last = F.when((F.size("lines") >= 2) & ~F.element_at("lines", -1).rlike(r"\d"), F.element_at("lines", -1))
    address = F.get(F.filter("lines", lambda x: x.rlike(r"\d")), 0)
    rest = F.when(last.isNotNull(), F.slice("lines", 1, F.size("lines") - 1)).otherwise(F.col("lines"))
    category = F.get(F.filter(rest, lambda x: ~x.eqNullSafe(address)), 0)
    return raw.select(key, "pos", F.regexp_extract("href", r"/(\d+)/?$", 1).alias("venue_id"), slug_of_url(F.col("href")).alias("slug"), "name", category.alias("category"), address.alias("address"), last.alias("city")).where("venue_id <> ''")


def result_total(text: Column) -> Column:
    """The total that a result page reports, or NULL."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, r"([\d,]+)\s+venue results", 1), ",", ""), F.lit("")).cast("bigint")
