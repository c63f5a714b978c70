"""Session-level helpers: checkpoint folder, shipping the package, sizes checked before a broadcast."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a temporary one only where the session names none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lokalis-checkpoint-"))
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from there (survives the loss of executors)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_cut(df: DataFrame) -> None:
    """Delete what `cut` wrote for `df`, which nothing may read any more."""
    sc = df.sparkSession.sparkContext
    for part in _cut_files(df):
        path = sc._jvm.org.apache.hadoop.fs.Path(part)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _cut_files(df: DataFrame) -> list[str]:
    file = df._jdf.queryExecution().toRdd().getCheckpointFile()
    if file.isDefined():
        return [file.get()]
    at = df._jdf.queryExecution().analyzed()
    rdd = at.rdd() if at.nodeName() in ("LogicalRDD", "Scan ExistingRDD") else None
    got = rdd.getCheckpointFile() if rdd is not None else None
    return [got.get()] if got is not None and got.isDefined() else []


def ship(spark: SparkSession) -> None:
    """Make the package importable in every Python worker, whatever PYTHONPATH it starts with."""
    sc = spark.sparkContext
    if getattr(sc, "_lokalis_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lokalis-code-"), "lokalis.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._lokalis_shipped = True


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


SENT_ROWS = 50_000


def sent(df: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """A small side of a join: computed once and broadcast if it has at most `most` rows, else joined by shuffle like any other."""
    held = cut(df)
    return F.broadcast(held) if held.count() <= most else held


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key in as many tasks as the session has; adaptive execution would join small but slow groups into few tasks."""
    return df.repartition(parallelism(df.sparkSession), *keys)
