"""Saved state: journals, baselines, caches, run diffs and the envelope of a command's result.

Tables are written by Spark, partitioned and in parallel; a small JSON file is written through one row and replaced at once.
"""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lokalis.operators.freshness import expired_content

SHEET = ["venue_id", "name", "category", "address", "city", "url"]


def replace_text(path: str, text: str) -> str:
    """Write a text file beside and put it in place at once."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path + ".part", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(path + ".part", path)
    return path


def append_journal(rows: DataFrame, path: str, by: list[str], stamp: Column) -> None:
    """Add a batch to a journal table; what was written stays, and the latest batch of a key counts (`latest`)."""
    rows.withColumn("_written", stamp).write.mode("append").partitionBy(*by).parquet(path)


def latest(journal: DataFrame, key: list[str]) -> DataFrame:
    """The state of a journal table: for each key its last entry."""
    cols = [c for c in journal.columns if c not in key]
    return journal.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct("_written", *cols)).alias("r")).select(*key, "r.*").drop("_written")


def mark_complete(path: str, centre: tuple[float, float], source: str) -> str:
    """Note that a journal is complete, with its centre."""
    return replace_text(os.path.join(path, "_complete.json"), json.dumps({"complete": True, "centre": list(centre), "centre_source": source}))


def completed(path: str) -> dict[str, Any]:
    """What `mark_complete` noted, {} where nothing or nothing readable is there."""
    try:
        with open(os.path.join(path, "_complete.json"), encoding="utf-8") as f:
            got = json.load(f)
        return got if isinstance(got, dict) else {}
    except (OSError, ValueError):
        return {}


def write_cache(entries: DataFrame, path: str, live: Column | None = None) -> None:
    """A cache table (one row a key), dead entries left out."""
    (entries.where(live) if live is not None else entries).write.mode("overwrite").parquet(path)


def write_place_cache(entries: DataFrame, path: str, now: Column, seconds: float = 30 * 86_400) -> None:
    """A places cache with its content expired."""
    expired_content(entries, "place_id", ["display_name", "business_status", "types", "fetched_at"], "fetched_at", now, seconds).write.mode("overwrite").parquet(path)


def write_baseline(rows: DataFrame, path: str, by: str) -> None:
    """Replace the baseline of the scopes in `rows`; other scopes stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_diff(diff: DataFrame, folder: str, stamp: str) -> dict[str, str]:
    """A run diff: all changes as JSON lines, new keys as CSV where there are any."""
    out = {"diff": os.path.join(folder, f"diff_{stamp}")}
    diff.write.mode("overwrite").json(out["diff"])
    new = diff.where("change = 'new'").drop("deltas", "change")
    if new.limit(1).count():
        out["new"] = os.path.join(folder, f"new_{stamp}")
        new.write.mode("overwrite").option("header", True).csv(out["new"])
    return out


def write_table_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A CSV table of many files: a header in each, NULL as '', points with six decimals; the rows stay where they are."""
    cell = lambda c: F.when(F.col(c).isNull(), F.lit("")).otherwise(F.format_string("%.6f", c) if c in ("lat", "lng") else F.col(c).cast("string")).alias(c)
    df.select(*map(cell, columns)).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def envelope(command: str, data: dict[str, Any], warnings: list[str] | None = None, next_actions: list[str] | None = None, hints: list[str] | None = None, error: str | None = None) -> str:
    """A command's result as one line of ASCII JSON; `ok` is false with an error."""
    body = {"command": command, "ok": error is None, "schema_version": 1, "data": data, "warnings": warnings or [], "next_actions": next_actions or [], "hints": hints or []}
    return json.dumps(body if error is None else {**body, "error": error}, ensure_ascii=True, default=str)
