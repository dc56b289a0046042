"""Shared scratch space: where lineage is cut and where small tables are measured."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after it was written and counted, and only up to this many rows.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlens-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write the rows once as Parquet below the shared folder; readers then read the columns they need."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Delete a table that `stored` wrote and that nothing reads any more, as the state of a past round."""
    spark = table.sparkSession
    files = table.inputFiles()
    if files and files[0].rsplit("/", 2)[-2].startswith("table-"):
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Place groups on as many tasks as a shuffle has partitions.

    Adaptive execution merges partitions that are small in bytes, which would put groups that are small
    but costly to compute into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def join_measured(left: DataFrame, small: DataFrame, on, how: str = "left",
                  limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a per-group table whose size is measured first.

    The table is written once and counted. Up to `limit` rows it is broadcast, so the large side is
    not shuffled; beyond that Spark joins by shuffle, and adaptive execution splits hot keys.
    """
    kept = cut(small)
    if kept.count() <= limit:
        kept = F.broadcast(kept)
    return left.join(kept, on, how)
