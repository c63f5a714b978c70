"""Queries of the spatial operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lokalis.operators import spatial
from lokalis.runtime import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    near = spatial.pairs_within(table(spark, d, "venues"), 50.0, "venue_key", group="venue_id")
    return near.select(F.col("id_a").alias("venue_key_a"), F.col("id_b").alias("venue_key_b"))


def p4_regions(spark: SparkSession, d: str) -> DataFrame:
    """Pages inside the box of 0.2 x 0.3 degrees around each metropolitan centre."""
    boxes = table(spark, d, "cities").selectExpr("city_id as box_id", "metro_lat - 0.1 as south", "metro_lat + 0.1 as north", "metro_lng - 0.15 as west", "metro_lng + 0.15 as east")
    return spatial.points_in_boxes(table(spark, d, "venues"), boxes, "venue_key").select(F.col("id").alias("venue_key"), F.col("box_id").alias("city_id"))


USABLE = "lat is not null and lng is not null and not (lat = 0 and lng = 0) and abs(lat) <= 90 and abs(lng) <= 180"

QUERIES = {"p4_found": p4_found, "p4_regions": p4_regions}
SQL = {
    "p4_found": f"""
        with v as (select venue_key k, venue_id i, lat, lng, cast(floor(lat / 0.001) as bigint) cy from venues where {USABLE}),
        w as (select v.*, cy + d as at from v, (values (-1), (0), (1)) t(d))
        select a.k as venue_key_a, b.k as venue_key_b from w a join v b on a.at = b.cy and a.k < b.k and a.i is distinct from b.i and abs(a.lng - b.lng) < 0.05
        where 2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))) <= 50.0""",
    "p4_regions": f"""
        select v.venue_key, c.city_id from (select * from venues where {USABLE}) v join cities c
        on v.lat between c.metro_lat - 0.1 and c.metro_lat + 0.1 and v.lng between c.metro_lng - 0.15 and c.metro_lng + 0.15""",
}
