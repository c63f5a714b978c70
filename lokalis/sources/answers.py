"""Captured answers of services and saved state as tables: geocoders, place searches, boundaries, journals, baselines, caches.

A document that can't be read gives no rows, and an answer that says there was an error gives a row with `error`. Folders of
documents are read in parallel, one document a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lokalis.functions.text import request_key

VENUE = "struct<venue_id:string,name:string,category:string,address:string,city:string,total:bigint,unique:bigint,monthly:bigint,you:bigint,lat:double,lng:double,geo_source:string,business_status:string,url:string>"
JOURNAL = f"struct<complete:boolean,centre:array<double>,centre_source:string,warnings:array<string>,venues:array<{VENUE}>>"
ENRICHED = f"struct<source:string,done:map<string,struct<status:string,detail:string,venue:{VENUE}>>>"
PLACE = "struct<place_id:string,display_name:string,business_status:string,types:array<string>,fetched_at:double>"
SYSTEMIC = [401, 403, 429]


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, modified) of the text files of a folder."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of the bytes of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def parsed(text: Column, schema: str) -> Column:
    """A JSON document as a struct, NULL where it can't be read."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def journals(docs: DataFrame) -> DataFrame:
    """(path, modified, complete, centre, warnings, n_venues, venues) of sweep journals; an unreadable one is empty."""
    j = docs.withColumn("j", parsed(F.col("text"), JOURNAL))
    venues = F.coalesce("j.venues", F.array().cast(f"array<{VENUE}>"))
    return j.select("path", "modified", F.coalesce("j.complete", F.lit(False)).alias("complete"), "j.centre", "j.centre_source", F.coalesce("j.warnings", F.array().cast("array<string>")).alias("warnings"), F.size(venues).alias("n_venues"), venues.alias("venues"))


def journal_rows(journal: DataFrame) -> DataFrame:
    """The venues of journals, one a row, with their place in the journal."""
    return journal.select("path", F.posexplode("venues").alias("pos", "v")).select("path", "pos", "v.*")


def finished(journal: DataFrame, now: Column, most_h: float = 12.0) -> DataFrame:
    """Journals of a sweep that is complete, has a centre, and was written within `most_h` hours."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("modified")) / 3600
    return journal.where(F.col("complete") & (F.size("centre") == 2) & (age <= most_h)).withColumn("age_h", F.round(age, 1))


def enriched_rows(docs: DataFrame, source: Column) -> DataFrame:
    """(path, pos, status, detail, venue columns) of enrich journals whose source is the fingerprint of the present input."""
    j = docs.withColumn("j", parsed(F.col("text"), ENRICHED)).where(F.col("j.source") == source)
    return j.select("path", F.explode("j.done").alias("pos", "e")).select("path", F.col("pos").cast("int").alias("pos"), "e.status", "e.detail", "e.venue.*")


def baseline(docs: DataFrame, scoped: str, legacy: str) -> DataFrame:
    """(venue_id, row columns) of the map in the file named `scoped`, or in `legacy` where that is missing; else nothing."""
    name = F.element_at(F.split("path", "/"), -1)
    mine = docs.where(name.isin(scoped, legacy)).withColumn("_old", name == legacy).withColumn("m", parsed(F.col("text"), f"map<string,{VENUE}>"))
    first = mine.where("m is not null").groupBy().agg(F.min_by("m", "_old").alias("m"))  # two files at most
    return first.select(F.explode("m").alias("key", "r")).select("key", "r.*")


def place_cache(docs: DataFrame) -> DataFrame:
    """(query, place_id, display_name, business_status, types, fetched_at) of a places cache; missing keys have their defaults."""
    m = docs.select(F.explode(parsed(F.col("text"), f"map<string,{PLACE}>")).alias("query", "p")).where("p is not null")
    text = lambda c: F.coalesce(F.col(f"p.{c}"), F.lit("")).alias(c)
    return m.select("query", text("place_id"), text("display_name"), text("business_status"), F.coalesce("p.types", F.array().cast("array<string>")).alias("types"), "p.fetched_at")


def place_json() -> Column:
    """A place match (place_id, display_name, business_status, types, fetched_at) as JSON."""
    return F.to_json(F.struct("place_id", "display_name", "business_status", "types", "fetched_at"))


def answer_cache(docs: DataFrame) -> DataFrame:
    """(key, fetched_at, body) of a cache of raw answers."""
    m = parsed(F.col("text"), "map<string,struct<fetched_at:double,body:string>>")
    return docs.select(F.explode(m).alias("key", "e")).where("e is not null").select("key", "e.fetched_at", "e.body")


def answer_key(url: Column, query: Column) -> Column:
    """Key of a posted query: the first 32 digits of the SHA-256 of address and query, a line each."""
    return F.substring(F.sha2(F.concat(url, F.lit("\n"), query), 256), 1, 32)


def geocoded(answers: DataFrame, key: str = "query", text: str = "text") -> DataFrame:
    """(key, lat, lng, error) of one geocoder's answers: a status, and results with a location; nothing found is NULL, any other status an error."""
    a = answers.withColumn("a", parsed(F.col(text), "struct<status:string,results:array<struct<geometry:struct<location:struct<lat:double,lng:double>>>>>"))
    at = F.get("a.results", F.lit(0))["geometry"]["location"]
    ok = F.col("a.status") == "OK"
    return a.select(key, F.when(ok, at["lat"]).alias("lat"), F.when(ok, at["lng"]).alias("lng"), F.when(F.coalesce(F.col("a.status"), F.lit("unreadable")).isin("OK", "ZERO_RESULTS"), None).otherwise(F.coalesce("a.status", F.lit("unreadable"))).alias("error"))


def listed_points(answers: DataFrame, key: str = "query", text: str = "text") -> DataFrame:
    """(key, lat, lng) of the other geocoder's answers: a list of results with lat and lon as text; the first counts."""
    first = F.get(parsed(F.col(text), "array<struct<lat:string,lon:string>>"), F.lit(0))
    return answers.select(key, first["lat"].cast("double").alias("lat"), first["lon"].cast("double").alias("lng"))


PLACES = "struct<places:array<struct<id:string,displayName:struct<text:string>,types:array<string>,businessStatus:string>>>"


def found_places(answers: DataFrame, key: str = "query", text: str = "text", code: str = "code") -> DataFrame:
    """(key, place_id, display_name, business_status, types, error, systemic) of place searches: the top hit, all NULL without one."""
    top = F.get(parsed(F.col(text), PLACES)["places"], F.lit(0))
    bad = F.col(code) >= 400
    hit = lambda c, v: F.when(~bad, v).alias(c)
    status = F.when(top.isNotNull(), F.coalesce(F.nullif(top["businessStatus"], F.lit("")), F.lit("unmatched")))
    return answers.select(key, hit("place_id", top["id"]), hit("display_name", top["displayName"]["text"]), hit("business_status", status), hit("types", top["types"]), F.when(bad, F.concat(F.lit("HTTP "), F.col(code))).alias("error"), F.col(code).isin(SYSTEMIC).alias("systemic"))


def nearby_places(answers: DataFrame, most: int = 20, key: str = "type", text: str = "text", code: str = "code") -> DataFrame:
    """(key, pos, name) of the first `most` results of each page of a nearby search; pages with an error have none."""
    names = F.slice(F.transform(parsed(F.col(text), PLACES)["places"], lambda p: p["displayName"]["text"]), 1, most)
    return answers.where(F.col(code) < 400).select(key, F.posexplode(names).alias("pos", "name")).where("name is not null")


BOUNDS = "array<struct<display_name:string,boundingbox:array<string>,geojson:struct<type:string,coordinates:string>>>"


def boundaries(answers: DataFrame, key: str = "city", text: str = "text", most: int = 5) -> DataFrame:
    """(key, display_name, kind, south, north, west, east, polygon): of the first `most` hits the first with an area; none gives no row."""
    areas = F.filter(F.slice(parsed(F.col(text), BOUNDS), 1, most), lambda h: h["geojson"]["type"].isin("Polygon", "MultiPolygon"))
    hit = answers.select(key, F.get(areas, F.lit(0)).alias("h")).where("h is not null")
    side = lambda n: F.get("h.boundingbox", F.lit(n)).cast("double")
    return hit.select(key, "h.display_name", F.col("h.geojson.type").alias("kind"), side(0).alias("south"), side(1).alias("north"), side(2).alias("west"), side(3).alias("east"), F.col("h.geojson.coordinates").alias("polygon"))


def rings_of(bounds: DataFrame, key: str = "city") -> DataFrame:
    """(key, ring, lat, lng) of boundaries, for `harvest.in_polygons`: corners as arrays, holes as further rings."""
    one = F.from_json("polygon", "array<array<array<double>>>")
    many = F.from_json("polygon", "array<array<array<array<double>>>>")
    rings = F.when(F.col("kind") == "Polygon", one).otherwise(F.flatten(many))
    r = bounds.select(key, F.posexplode(rings).alias("ring", "c"))
    return r.select(key, "ring", F.transform("c", lambda p: F.get(p, F.lit(1))).alias("lat"), F.transform("c", lambda p: F.get(p, F.lit(0))).alias("lng"))


def cached_request_key(url: Column, params: Column) -> Column:
    """Key of a fetched page."""
    return request_key(url, params)
