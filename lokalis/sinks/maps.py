"""KML, GPX and GeoJSON files, and CSV tables with a byte-order mark.

Features are made in the executors as text, one row each; only the framing is added by the writer. A map file is one file by
its nature, so rows reach it through an iterator that holds one partition at a time.
"""

from __future__ import annotations

import csv
import json
import os
from collections.abc import Callable
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lokalis.functions.text import or_na, stats_line

MAX_PLACEMARKS = 2000
DERIVED = ["app", "nominatim", "osm", "overpass"]
EXTRA = ["category", "address", "city", "total", "unique", "monthly", "you", "url"]


def located(df: DataFrame) -> DataFrame:
    return df.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())


def needs_credit(df: DataFrame) -> bool:
    """Whether a placed row's point comes from open map data."""
    return bool(located(df).where(F.col("geo_source").isin(DERIVED)).limit(1).count())


def _xml(c: Column | str) -> Column:
    t = F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    return F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def placemark(link_text: str = "View page") -> Column:
    """A KML placemark: counts that are unknown read n/a, coordinates are lng,lat with six decimals."""
    line = lambda k, c: F.concat(F.lit(k + ": "), c, F.lit("<br/>"))
    body = F.concat(
        F.lit("<b>"), _xml("category"), F.lit("</b><br/>"), _xml("address"), F.lit("<br/>"), _xml("city"), F.lit("<br/><br/>"),
        line("Total check-ins", or_na(F.col("total"))), line("Unique", or_na(F.col("unique"))), line("Monthly", or_na(F.col("monthly"))), line("You", F.coalesce(F.col("you").cast("string"), F.lit("-"))),
        F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit('<a href="'), F.col("url"), F.lit(f'">{link_text}</a>'))).otherwise(F.lit("")),
    )
    data = F.concat(*(F.concat(F.lit(f'<Data name="{c}"><value>'), _xml(c), F.lit("</value></Data>")) for c in EXTRA))
    return F.concat(F.lit("<Placemark><name>"), _xml("name"), F.lit("</name><description>"), _xml(body), F.lit("</description><ExtendedData>"), data, F.lit("</ExtendedData><Point><coordinates>"), F.format_string("%.6f,%.6f,0", "lng", "lat"), F.lit("</coordinates></Point></Placemark>"))


def waypoint() -> Column:
    """A GPX waypoint; the link only where there is a page."""
    link = F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit('<link href="'), F.replace(_xml("url"), F.lit('"'), F.lit("&quot;")), F.lit('"/>'))).otherwise(F.lit(""))
    return F.concat(F.format_string('<wpt lat="%.6f" lon="%.6f"><name>', "lat", "lng"), _xml("name"), F.lit("</name><desc>"), _xml(stats_line(F.col("total"), F.col("unique"), F.col("monthly"), F.col("category"))), F.lit("</desc>"), link, F.lit("</wpt>"))


def feature() -> Column:
    """A GeoJSON feature: [lng, lat] as they are, unknown counts as null."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    props = F.struct("name", stats_line(F.col("total"), F.col("unique"), F.col("monthly"), F.col("category")).alias("description"), text("category"), text("address"), text("city"), text("url"), "total", "unique", "monthly", "you")
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates")).alias("geometry"), props.alias("properties")), {"ignoreNullFields": "false"})


def _write(df: DataFrame, row: Column, order: list[str], path: str, head: str, tail: str, between: str = "\n") -> str:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    part = path + ".part"
    with open(part, "w", encoding="utf-8") as f:
        f.write(head)
        for n, r in enumerate(df.orderBy(*order).select(row.alias("t")).toLocalIterator()):
            f.write((between if n else "") + r["t"])
        f.write(tail)
    os.replace(part, path)
    return path


def write_kml(df: DataFrame, path: str, title: str, order: list[str], credit: str | None = None, most: int = MAX_PLACEMARKS) -> str:
    """Placed rows as KML; more than `most` raise, as readers would cut them off without a word."""
    rows = located(df)
    n = rows.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} placemarks; split into several files")
    about = f"<description>{escape('Coordinates: ' + credit)}</description>" if credit else ""
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>{escape(title)}</name>{about}\n'
    return _write(rows, placemark(), order, path, head, "\n</Document></kml>\n")


def write_gpx(df: DataFrame, path: str, title: str, order: list[str], credit: str | None = None, creator: str = "lokalis") -> str:
    """Placed rows as GPX 1.1; metadata in the order name, desc, copyright."""
    about = f'<desc>{escape("Coordinates: " + credit)}</desc><copyright author="OpenStreetMap contributors"><license>https://opendatacommons.org/licenses/odbl/</license></copyright>' if credit else ""
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<gpx xmlns="http://www.topografix.com/GPX/1/1" version="1.1" creator={quoteattr(creator)}><metadata><name>{escape(title)}</name>{about}</metadata>\n'
    return _write(located(df), waypoint(), order, path, head, "\n</gpx>\n")


def write_geojson(df: DataFrame, path: str, order: list[str], credit: str | None = None) -> str:
    """Placed rows as a GeoJSON feature collection."""
    tail = "\n]" + (f', "attribution": {json.dumps(credit, ensure_ascii=False)}' if credit else "") + "}\n"
    return _write(located(df), feature(), order, path, '{"type": "FeatureCollection", "features": [\n', tail, ",\n")


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[str]) -> str:
    """One CSV file with a byte-order mark; NULL as '', points with six decimals; columns that are not named are left out."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    cell = lambda c: F.when(F.col(c).isNull(), "").otherwise(F.format_string("%.6f", c) if c in ("lat", "lng") else F.col(c).cast("string")).alias(c)
    with open(path + ".part", "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(columns)
        for r in df.orderBy(*order).select(*(cell(c) for c in columns)).toLocalIterator():
            w.writerow(list(r))
    os.replace(path + ".part", path)
    return path


def write_tables(df: DataFrame, path: str, by: list[str]) -> None:
    """A partitioned Parquet table; only the partitions that `df` has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


WRITERS: dict[str, Callable] = {"kml": write_kml, "gpx": write_gpx, "geojson": write_geojson}


def map_formats(text: str | None) -> list[str]:
    """Names of formats from a comma-separated list, once each; an unknown one raises."""
    names = list(dict.fromkeys(t.strip().lower() for t in (text or "").split(",") if t.strip()))
    if unknown := [n for n in names if n not in WRITERS]:
        raise ValueError(f"unknown formats: {unknown}")
    return names
