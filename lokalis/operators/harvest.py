"""Adaptive harvest of a source that gives at most so many rows for a rectangle, and points inside polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lokalis.functions.geo import haversine_km, quarters
from lokalis.operators.sets import top_rows
from lokalis.operators.spatial import points_in_boxes
from lokalis.runtime import cut

CAP, FULL = 60, 55
SLICES = 256


def quadtree_harvest(points: DataFrame, cell: tuple[float, float, float, float], key: str = "id", popularity: str = "total", max_depth: int = 3, min_depth: int = 1, cap: int = CAP, full: int = FULL) -> tuple[DataFrame, DataFrame]:
    """(rows found, cells visited) of asking for a rectangle (left, right, bottom, top), and for its quarters where the answer is cut off.

    Each answer holds the `cap` most popular rows inside; one of at least `full` rows counts as cut off. Quarters overlap, so rows
    come more than once and are credited to the first cell in the order of visits. All cells of a depth are asked in one range join
    on cell codes; `key` is a number. Depths are cut from each other, so none computes the ones above it again.
    """
    spark = points.sparkSession
    schema = "path string, left double, right double, bottom double, top double"
    level = spark.createDataFrame([("0", *map(float, cell))], schema)
    points = cut(points)
    found, visited = [], []
    for depth in range(max_depth + 1):
        # A path has one digit a depth: as a number to the base 5 it names its cell.
        number = F.aggregate(F.split("path", r"\."), F.lit(0).cast("long"), lambda n, q: n * 5 + q.cast("long") + 1)
        boxes = cut(level.select("path", number.alias("box_id"), F.col("bottom").alias("south"), F.col("top").alias("north"), F.col("left").alias("west"), F.col("right").alias("east")))
        hits = points_in_boxes(points, boxes, key).join(boxes.select("box_id", "path"), "box_id").select(F.col("id").alias(key), "path")
        got = cut(points.join(hits, key).select(*points.columns, "path"))
        got = top_rows(got, ["path"], [F.desc_nulls_last(popularity), F.col(key)], cap)
        found.append(got.select(*points.columns, "path"))
        counts = got.groupBy("path").agg(F.count("*").alias("n"))
        asked = level.join(counts, "path", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("depth", F.lit(depth)).withColumn("cut_off", F.col("n") >= full)
        asked = cut(asked)
        visited.append(asked)
        split = asked.where(F.col("cut_off") | (F.lit(depth) < min_depth)).select("path", F.posexplode(quarters(F.struct("left", "right", "bottom", "top"))).alias("q", "c"))
        level = split.select(F.concat("path", F.lit("."), F.col("q").cast("string")).alias("path"), "c.*")
    rows, cells = found[0], visited[0]
    for r, c in zip(found[1:], visited[1:]):
        rows, cells = rows.unionByName(r), cells.unionByName(c)
    best = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), "path").alias("r"))
    return best.select("r.*"), cells


def in_polygons(points: DataFrame, rings: DataFrame, key: str = "id") -> DataFrame:
    """(key, polygon): points inside polygons by counting the ring edges east of them (holes are further rings).

    rings: polygon, ring, lat and lng as arrays of the ring's corners. Points meet only polygons whose bounding box
    holds them, found by the range join on cell codes; keys and polygons are numbers.
    """
    edges = rings.select("polygon", F.explode(F.arrays_zip("lat", "lng", F.concat(F.slice("lat", 2, F.size("lat")), F.slice("lat", 1, 1)).alias("lat2"), F.concat(F.slice("lng", 2, F.size("lng")), F.slice("lng", 1, 1)).alias("lng2"))).alias("e")).select("polygon", "e.*")
    box = rings.groupBy("polygon").agg(F.min(F.array_min("lat")).alias("south"), F.max(F.array_max("lat")).alias("north"), F.min(F.array_min("lng")).alias("west"), F.max(F.array_max("lng")).alias("east"))
    held = points_in_boxes(points, box, key, box_id="polygon").select(F.col("id").alias(key), F.col("box_id").alias("polygon"))
    # Edges lie in the slices of latitude that they cross, `SLICES` of each polygon, so a point meets only the edges at its height.
    band = box.select("polygon", "south", F.greatest((F.col("north") - F.col("south")) / SLICES, F.lit(1e-9)).alias("height"))
    slice_of = lambda c: F.floor((F.col(c) - F.col("south")) / F.col("height"))
    low, high = F.least("lat", "lat2"), F.greatest("lat", "lat2")
    cut_up = edges.join(band, "polygon").withColumn("lo", low).withColumn("hi", high).withColumn("slice", F.explode(F.sequence(slice_of("lo"), slice_of("hi"))))
    near = held.join(points.select(key, F.col("lat").alias("y"), F.col("lng").alias("x")), key).join(band, "polygon").withColumn("slice", slice_of("y")).drop("south", "height")
    crosses = ((F.col("lat") > F.col("y")) != (F.col("lat2") > F.col("y"))) & (F.col("x") < (F.col("lng2") - F.col("lng")) * (F.col("y") - F.col("lat")) / F.when(F.col("lat2") != F.col("lat"), F.col("lat2") - F.col("lat")) + F.col("lng"))
    return near.join(cut_up, ["polygon", "slice"]).groupBy(key, "polygon").agg(F.count_if(crosses).alias("k")).where("k % 2 = 1").select(key, "polygon")


def nearest_names(points: DataFrame, lat0: float, lng0: float, radius_km: float, limit: int = 60) -> DataFrame:
    """(name, km): the nearest distinct names around a point, case ignored; `limit` is the feature."""
    km = haversine_km(F.lit(lat0), F.lit(lng0), F.col("lat"), F.col("lng"))
    near = points.where(F.trim("name") != "").withColumn("km", km).where(F.col("km") <= radius_km)
    return near.groupBy(F.lower("name").alias("_k")).agg(F.min_by("name", F.struct("km", "name")).alias("name"), F.min("km").alias("km")).orderBy("km", "_k").limit(limit).select("name", "km")


def harvested(results: DataFrame, variant: str, key: str, order: list[str], in_place: Column, top: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(rows, stats) of searches by several spellings: the first `top` of each spelling, each key once, rows of other places left out.

    stats: variant, total, collected, other_place. A key that several spellings found is credited to the first spelling.
    """
    ranked = top_rows(results, [variant], [F.col(o) for o in order], top).withColumn("_in", F.coalesce(in_place, F.lit(False)))
    total = results.groupBy(variant).agg(F.count("*").alias("total"))
    counts = ranked.groupBy(variant).agg(F.count_if("_in").alias("collected"), F.count_if(~F.col("_in")).alias("other_place"))
    kept = ranked.where("_in").groupBy(key).agg(F.min_by(F.struct(*results.columns), F.struct(variant, "_pos")).alias("r")).select("r.*")
    return kept, total.join(counts, variant)


def counted_in_box(places: DataFrame, south: float, north: float, west: float, east: float, by: str) -> DataFrame:
    """(by, places) inside a box; the bounds reach the scan, so row groups outside are not read."""
    inside = F.col("lat").between(south, north) & F.col("lng").between(west, east)
    return places.where(inside).groupBy(by).agg(F.count("*").alias("places"))
