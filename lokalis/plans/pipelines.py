"""Whole stages composed of the operators: filter, export, closures, enrich, label, score, search sweep, map sweep.

Vocabularies, bounds and thresholds are arguments; a stage returns tables and does not collect rows.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lokalis.operators import aggregates, harvest, matching, summaries
from lokalis.sinks import maps


def filter_stage(rows: DataFrame, kind: Column, wanted: list[str], flag: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with kind, keep, reason and flag; their summary). A row is kept for a wanted kind, the reason is its kind; a flag never removes."""
    decided = rows.withColumn("kind", kind).withColumn("flag", flag)
    decided = decided.withColumn("keep", F.coalesce(F.col("kind").isin(wanted), F.lit(False))).withColumn("reason", F.coalesce("kind", F.lit("unknown")))
    return decided, summaries.split_summary(decided, "keep", "reason", "flag")


def export_stage(rows: DataFrame, folder: str, title: str, formats: list[str], order: list[str], credit: str) -> tuple[dict[str, str], DataFrame]:
    """(files by format, summary): the placed rows as map files, with the credit that their points' sources want."""
    said = credit if maps.needs_credit(rows) else None
    writers: dict[str, Callable[[str], str]] = {
        "kml": lambda p: maps.write_kml(rows, p, title, order, said), "gpx": lambda p: maps.write_gpx(rows, p, title, order, said), "geojson": lambda p: maps.write_geojson(rows, p, order, said),
    }
    return {f: writers[f](os.path.join(folder, f"{title}.{f}")) for f in formats}, summaries.export_summary(rows, maps.DERIVED)


def closures_stage(rows: DataFrame, answers: DataFrame, key: str, status: str = "business_status") -> tuple[DataFrame, DataFrame]:
    """(rows with their answers' status, tally of the statuses)."""
    done = matching.with_closures(rows, answers, key, status)
    return done, summaries.tally(done, status)


def enrich_stage(names: DataFrame, refs: DataFrame, pages: DataFrame, by: list[str], city: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, report, counts): the outcome of every name, rows without duplicates, and the counts by status."""
    report = matching.enriched(names, refs, pages, by, city)
    status = F.when(F.col("duplicate"), "duplicate").otherwise(F.col("status"))
    return report.where(~F.col("duplicate")), report, report.withColumn("status", status).groupBy("status").agg(F.count("*").alias("n"))


def label_stage(rows: DataFrame, bucket: Column, key: str, quota: int, seed: int = 0, thin: int = 5) -> tuple[DataFrame, DataFrame]:
    """(sheet, summary): a stratified sample with `_stratum` and `_stratum_size`, and (rows, buckets, thin) of it."""
    sheet = aggregates.stratified_sample(rows.withColumn("_stratum", bucket), "_stratum", key, quota, seed)
    per = sheet.groupBy("_stratum").agg(F.count("*").alias("n"))
    return sheet, per.agg(F.sum("n").alias("rows"), F.count("*").alias("buckets"), F.count_if(F.col("n") < thin).alias("thin"))


def score_stage(sheet: DataFrame, questions: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(question, rate, covered, thin): weighted error rates of a filled-in sheet; a question is (answered, wrong)."""
    out = None
    for name, (answered, wrong) in questions.items():
        one = aggregates.weighted_rate(sheet, "_stratum", "_stratum_size", answered, wrong).select(F.lit(name).alias("question"), "*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no questions")
    return out


def search_sweep_stage(results: DataFrame, localities: DataFrame, variant: str, key: str, order: list[str], in_place: Column, top: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(rows, stats) of the searches by the spellings that are worth one. localities: (name, places)."""
    worth = aggregates.spelling_variants(localities, "name", "places").select(F.col("query").alias(variant))
    return harvest.harvested(results.join(worth, variant, "left_semi"), variant, key, order, in_place, top)


def map_sweep_stage(points: DataFrame, cell: tuple[float, float, float, float], key: str, popularity: str, max_depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """(venues, cells): what an adaptive harvest finds, as venues whose counts are unknown, and the cells that it visited."""
    rows, cells = harvest.quadtree_harvest(points, cell, key, popularity, max_depth)
    return summaries.as_venues(rows.select(key, "name", "lat", "lng")), cells
