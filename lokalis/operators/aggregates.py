"""Aggregations: quality gates, modal values, spelling variants, stratified samples, weighted rates, agreement of offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lokalis.operators.sets import top_rows


def quality_share(df: DataFrame, good: Column) -> DataFrame:
    """(rows, share): rows and the share of them that are good; the share of no rows is NULL."""
    return df.agg(F.count("*").alias("rows"), F.avg(F.coalesce(good, F.lit(False)).cast("int")).alias("share"))


def assert_quality(df: DataFrame, good: Column, least: float = 0.9) -> None:
    """Raise if the share of good rows is below `least`, or if there are no rows."""
    r = quality_share(df, good).first()
    if not r["rows"] or r["share"] < least:
        raise ValueError(f"only {r['share'] or 0:.1%} of {r['rows']} rows have full figures; {least:.0%} are needed")


def modal_value(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, count) of the most frequent non-blank value; of several, the one seen first."""
    seen = df.where(F.trim(value) != "").groupBy(value).agg(F.count("*").alias("count"), F.min(order).alias("_first"))
    return seen.orderBy(F.desc("count"), "_first").limit(1).drop("_first")


def spelling_variants(counts: DataFrame, key: str, n: str, share: float = 0.02, most: int = 10, cover: float = 0.005) -> DataFrame:
    """(query, places, share): spellings worth a search.

    A spelling counts for the shortest common spelling (at least `cover` of all) whose words are a strict subset of its own; of
    those the one with the most places, then the first by name. Kept are spellings with at least `share`, the `most` largest.
    The subset test joins on a word of the cover, so it is no join of all with all.
    """
    merged = counts.where(F.col(key) != "").groupBy(F.col(key).alias("k")).agg(F.sum(n).cast("bigint").alias("n"))
    total = merged.agg(F.sum("n").alias("total"))
    words = merged.withColumn("w", F.array_distinct(F.split("k", " ")))
    # One row of totals: a broadcast of a single number.
    covers = words.join(F.broadcast(total)).where(F.col("n") >= cover * F.col("total")).select(F.col("k").alias("c"), F.col("n").alias("cn"), F.col("w").alias("cw"))
    a = words.select("k", "n", "w", F.explode("w").alias("word"))
    b = covers.select("c", "cn", "cw", F.element_at("cw", 1).alias("word"))
    inside = a.join(b, "word").where((F.size("cw") < F.size("w")) & (F.size(F.array_except("cw", "w")) == 0))
    head = inside.groupBy("k").agg(F.min_by("c", F.struct(F.size("cw"), -F.col("cn"), F.col("c"))).alias("head"))
    folded = merged.join(head, "k", "left").groupBy(F.coalesce("head", "k").alias("query")).agg(F.sum("n").alias("places"))
    kept = folded.join(F.broadcast(total)).where(F.col("places") >= share * F.col("total"))
    return kept.select("query", "places", F.round(F.col("places") / F.col("total"), 4).alias("share")).orderBy(F.desc("places"), "query").limit(most)


def stratified_sample(df: DataFrame, stratum: str, key: str, quota: int, seed: int = 0) -> DataFrame:
    """At most `quota` rows of each stratum, in an order fixed by the seed, with the stratum's size as `_stratum_size`.

    The choice is made before the shuffle too: each task keeps its own best rows, so a stratum with most of the rows does not
    gather in one task.
    """
    rank = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_stratum_size"))
    best = top_rows(df.withColumn("_rank", rank), [stratum], [F.col("_rank"), F.col(key)], quota)
    return best.join(sizes, stratum).drop("_rank", "_pos")


def weighted_rate(rows: DataFrame, stratum: str, size: str, answered: Column, wrong: Column) -> DataFrame:
    """(rate, covered, thin): error rate weighted by inverse sampling probability.

    Within a stratum the rows that answered the question stand for the whole stratum; strata without an answer are left out of
    numerator and denominator; `thin` counts strata with fewer than five answers.
    """
    per = rows.groupBy(stratum).agg(
        F.max(size).cast("double").alias("size"), F.count_if(F.coalesce(answered, F.lit(False))).alias("usable"),
        F.count_if(F.coalesce(answered & wrong, F.lit(False))).alias("errors"),
    )
    some = F.when(F.col("usable") > 0, F.col("size"))
    return per.agg(F.try_divide(F.sum(some * F.col("errors") / F.col("usable")), F.sum(some)).alias("rate"), F.coalesce(F.sum(some), F.lit(0.0)).alias("covered"), F.count_if(F.col("usable") < 5).alias("thin"))


def agreed_offsets(df: DataFrame, by: str, e: str, n: str, least: int = 3, within: float = 250.0, share: float = 0.6) -> DataFrame:
    """(by, matches, e, n): component-wise median offset of each group, NULL unless enough offsets lie near it."""
    mid = df.groupBy(by).agg(F.percentile(e, 0.5).alias("_e"), F.percentile(n, 0.5).alias("_n"))
    near = (F.hypot(F.col(e) - F.col("_e"), F.col(n) - F.col("_n")) <= within).cast("int")
    got = df.join(mid, by).groupBy(by).agg(F.count("*").alias("matches"), F.avg(near).alias("_s"), F.first("_e").alias("_e"), F.first("_n").alias("_n"))
    ok = (F.col("matches") >= least) & (F.col("_s") >= share)
    return got.select(by, "matches", F.when(ok, F.col("_e")).alias("e"), F.when(ok, F.col("_n")).alias("n"))


def radius_from_extent(df: DataFrame, km: Column, margin: float = 1.0, low: float = 3.0, high: float = 8.0) -> DataFrame:
    """(radius_km): the farthest row and a margin, within limits; the lower limit where nothing is placed."""
    return df.agg(F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(F.max(km) + margin, F.lit(low)))).alias("radius_km"))
