"""Ages, times to live, expiry of cached content, and what is left of a rolling allowance; times are seconds as numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR, DAY = 3600, 86_400


def age_hours(then: Column, now: Column) -> Column:
    """Hours since `then`; NULL for an unknown time."""
    return (now - then) / HOUR


def fresh_within(then: Column, now: Column, seconds: float) -> Column:
    """Whether something is no older than `seconds`; what has no time is not fresh."""
    return F.coalesce(now - then <= seconds, F.lit(False))


def retained(files: DataFrame, modified: str, now: Column, older_than_h: float | None = None) -> DataFrame:
    """What is left after a discard: nothing, or with `older_than_h` what is younger."""
    return files.where(F.lit(False) if older_than_h is None else age_hours(F.col(modified), now) <= older_than_h)


def expired_content(entries: DataFrame, id_col: str, content: list[str], fetched_at: str, now: Column, seconds: float) -> DataFrame:
    """Cache entries whose content may be kept for `seconds` only: younger ones whole, older ones with their id alone, those without an id dropped."""
    fresh = F.coalesce(now - F.col(fetched_at) < seconds, F.lit(False))
    return entries.where(F.coalesce(F.col(id_col).cast("string"), F.lit("")) != "").withColumns({c: F.when(fresh, F.col(c)) for c in content})


def data_date(path: Column, modified: Column) -> Column:
    """The date in a file's name, or that of its last change."""
    name = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(F.try_to_date(F.nullif(name, F.lit(""))), F.to_date(modified))


def stale_outputs(outputs: DataFrame, inputs: DataFrame, name: str = "stage", modified: str = "modified") -> DataFrame:
    """(stage, modified, stale): an output older than its input is stale; without an input it is not."""
    src = inputs.groupBy(name).agg(F.max(modified).alias("_in"))
    return outputs.join(src, name, "left").select(name, modified, F.coalesce(F.col("_in") > F.col(modified), F.lit(False)).alias("stale"))


def kept_events(events: DataFrame, seconds: str, now: Column, width: float = DAY) -> DataFrame:
    """Events of the last `width` seconds."""
    return events.where(F.col(seconds) >= now - width)


def allowance(events: DataFrame, by: list[str], seconds: str, now: Column, most: int, blocked_until: DataFrame | None = None, width: float = DAY) -> DataFrame:
    """(by, used, remaining, wait_s, may_start): use within the last `width` seconds, and what a block still lasts.

    blocked_until: by, until. Keys that only have a block appear too.
    """
    used = events.groupBy(*by).agg(F.count_if(F.col(seconds) >= now - width).alias("used"))
    if blocked_until is not None:
        used = used.join(blocked_until.groupBy(*by).agg(F.max("until").alias("_until")), by, "full_outer")
    else:
        used = used.withColumn("_until", F.lit(None).cast("double"))
    wait = F.greatest(F.lit(0.0), F.coalesce(F.col("_until").cast("double") - now, F.lit(0.0)))
    n = F.coalesce("used", F.lit(0))
    return used.select(*by, n.alias("used"), F.greatest(F.lit(0), most - n).alias("remaining"), wait.alias("wait_s"), ((wait <= 0) & (n < most)).alias("may_start"))
