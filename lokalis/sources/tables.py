"""Stage tables as CSV: read leniently as text, then typed. Missing columns are unknown, extra columns are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lokalis.functions.text import number_or_null, slug_of_url, strict_count
from lokalis.operators.summaries import note_line

COLUMNS = ["venue_id", "name", "category", "address", "city", "total", "unique", "monthly", "you", "lat", "lng", "geo_source", "business_status", "url"]
COUNTS, OPTIONAL = ["total", "unique", "monthly", "you"], ["category", "address", "city"]


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """All columns as text; a byte-order mark, doubled quotes and line breaks inside quotes are understood."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("encoding", encoding).option("nullValue", "").csv(path)


def with_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """`df` with the missing ones of `names` (case ignored) as NULL text."""
    there = {c.lower() for c in df.columns}
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n.lower() not in there})


def typed(rows: DataFrame) -> DataFrame:
    """Text rows as venues: trimmed, blank optional fields NULL, counts and coordinates NULL where they can't be read."""
    df = with_columns(rows, COLUMNS)
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    own = {"venue_id": text("venue_id"), "name": text("name"), "geo_source": F.coalesce(F.nullif(text("geo_source"), F.lit("")), F.lit("none")), "business_status": text("business_status"), "url": text("url")}
    own |= {c: F.nullif(text(c), F.lit("")) for c in OPTIONAL} | {c: strict_count(F.col(c)) for c in COUNTS} | {c: number_or_null(F.col(c)) for c in ("lat", "lng")}
    return df.withColumns(own).withColumn("slug", slug_of_url(F.col("url")))


def stage(spark: SparkSession, path: str) -> DataFrame:
    """A stage table; rows without a name are left out."""
    return typed(read_csv(spark, path).where(F.trim(F.coalesce("name", F.lit(""))) != ""))


def any_table(spark: SparkSession, path: str) -> DataFrame:
    """A foreign table: a blank id is the name, a missing source is `csv` for placed rows."""
    rows = with_columns(read_csv(spark, path), COLUMNS)
    df = typed(rows.where(F.trim(F.coalesce("name", F.lit(""))) != ""))
    return df.withColumn("venue_id", F.coalesce(F.nullif("venue_id", F.lit("")), F.col("name"))).withColumn("geo_source", F.when(F.col("geo_source") != "none", F.col("geo_source")).when(F.col("lat").isNotNull(), "csv").otherwise("none"))


def place_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(name, address) with the city behind the address unless it is named there; the city alone without an address."""
    df = with_columns(read_csv(spark, path), ["name", "address", "city"])
    some = lambda *cs: F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in cs))
    rows = df.select(some("name").alias("name"), some("address").alias("address"), some("city").alias("city")).where("name is not null")
    whole = F.when(F.contains(F.lower("address"), F.lower("city")), F.col("address")).otherwise(F.nullif(F.concat_ws(", ", "address", "city"), F.lit("")))
    return rows.select("name", whole.alias("address"))


def note_rows(spark: SparkSession, path: str, label: str = "") -> DataFrame:
    """(name, address, note) of the rows with at least one count; unlike `place_pairs` the city never stands for a missing address."""
    rows = stage(spark, path)
    rank = F.col("rank") if "rank" in rows.columns else None
    noted = rows.withColumn("note", note_line(F.col("total"), F.col("unique"), F.col("monthly"), rank, label=label)).where("note <> ''")
    line = F.when(F.contains(F.lower("address"), F.lower("city")), F.col("address")).otherwise(F.concat_ws(", ", "address", "city"))
    return noted.select("name", F.when(F.col("address").isNotNull(), line).alias("address"), "note")


def label_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A filled-in label sheet; UTF-8, or Windows-1252 where that can't be decoded. Raises if a stratum's size is missing or differs."""
    df = read_csv(spark, path)
    broken = df.where(F.concat_ws("", *df.columns).contains("�")).limit(1).count()
    if broken:
        df = read_csv(spark, path, "ISO-8859-1")  # the same but for the bytes 128 to 159
        codes = [b for b in range(128, 160) if bytes([b]).decode("cp1252", "ignore")]
        df = df.withColumns({c: F.translate(c, "".join(map(chr, codes)), bytes(codes).decode("cp1252")) for c in df.columns})
    sizes = df.groupBy("_stratum").agg(F.count_distinct("_stratum_size").alias("k"), F.count_if(~F.coalesce(F.col("_stratum_size").rlike("^[0-9]+$"), F.lit(False))).alias("bad"))
    wrong = [r["_stratum"] for r in sizes.where("k <> 1 or bad > 0").limit(20).collect()]
    if wrong:
        raise ValueError(f"strata without one size: {wrong}")
    return df


CACHE = T.MapType(T.StringType(), T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType()), T.StructField("source", T.StringType()), T.StructField("fetched_at", T.DoubleType())]))


def point_cache(spark: SparkSession, path: str) -> DataFrame:
    """(query, lat, lng, source, fetched_at) of a JSON map; a file that can't be read gives no rows."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", CACHE, {"mode": "PERMISSIVE"}).alias("m"))
    return raw.select(F.explode("m").alias("query", "e")).where("e is not null").select("query", "e.*")


def osm_elements(spark: SparkSession, path: str) -> DataFrame:
    """(osm_id, name, lat, lng, tags) of captured elements: named ones with a point of their own or of their centre."""
    point = "struct<lat:double,lon:double>"
    schema = f"array<struct<type:string,id:bigint,lat:double,lon:double,center:{point},tags:map<string,string>>>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("e"))
    own = F.col("e.lat").isNotNull() & F.col("e.lon").isNotNull()
    at = F.when(own, F.struct(F.col("e.lat").alias("lat"), F.col("e.lon").alias("lng"))).when(F.col("e.center.lat").isNotNull() & F.col("e.center.lon").isNotNull(), F.struct(F.col("e.center.lat").alias("lat"), F.col("e.center.lon").alias("lng")))
    df = raw.select(F.col("e.id").alias("osm_id"), F.trim(F.col("e.tags").getItem("name")).alias("name"), at.alias("at"), F.col("e.tags").alias("tags"))
    return df.where((F.coalesce("name", F.lit("")) != "") & F.col("at").isNotNull()).select("osm_id", "name", "at.lat", "at.lng", "tags")
