"""Merging batches without repetition, and what changed between two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lokalis.functions.text import row_key


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """For each key the row that comes first in `order`. Aggregates before the shuffle, so a hot key costs one row a task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return best.select(*keys, "_first.*").select(*df.columns)


def merge_unique(batches: list[DataFrame], order: list[str]) -> DataFrame:
    """All rows of the batches once by venue_id, or by name and address where it is blank; the first sight wins.

    `order` are the columns that order rows within a batch. Adds `duplicates`, the number of rows merged into the kept one.
    """
    rows = None
    for n, b in enumerate(batches):
        b = b.withColumn("_batch", F.lit(n))
        rows = b if rows is None else rows.unionByName(b, allowMissingColumns=True)
    cols = [c for c in rows.columns if c != "_batch"]
    key = F.coalesce(F.nullif("venue_id", F.lit("")), row_key(F.col("name"), F.col("address")))
    best = rows.withColumn("_key", key).groupBy("_key").agg(F.min_by(F.struct(*cols), F.struct("_batch", *order)).alias("r"), (F.count("*") - 1).alias("duplicates"))
    return best.select("r.*", "duplicates")


def run_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change, deltas): rows that are new, gone or changed, with the changed fields as MAP<STRING, STRUCT<before, after>>.

    Values are compared as text, unknown as ''. Repeated keys count once, by their largest values.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))

    def one(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(key).agg(F.max(F.struct(*(text(f).alias(f) for f in fields))).alias(side))

    j = one(before, "b").join(one(after, "a"), key, "full_outer")
    pairs = F.filter(F.array(*(F.struct(F.lit(f).alias("key"), F.struct(F.col(f"b.{f}").alias("before"), F.col(f"a.{f}").alias("after")).alias("value")) for f in fields)), lambda e: e["value"]["before"] != e["value"]["after"])
    change: Column = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "gone").when(F.size(pairs) > 0, "changed")
    return j.select(key, change.alias("change"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.map_from_entries(pairs)).alias("deltas")).where("change is not null")


def top_rows(df: DataFrame, by: list[str], order: list[Column], n: int, position: str = "_pos") -> DataFrame:
    """The first `n` rows of each group, with their position; each task keeps its own first rows before they are shuffled."""
    parts = df.withColumn("_part", F.spark_partition_id())
    mine = parts.withColumn(position, F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))).where(F.col(position) <= n)
    return mine.withColumn(position, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(position) <= n).drop("_part")
