"""Streams: new ledger rows as they arrive, running daily totals, scoring against published limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens import fixed_values as fv
from ledgerlens.config import DEFAULT, LedgerConfig
from ledgerlens.functions.calc import lookup
from ledgerlens.operators.cleaning import row_status, standardised
from ledgerlens.schema import AMOUNT, CATEGORY, DATE

LINEAGE = ["source_file", "source_sheet", "source_row"]


def new_rows(stream: DataFrame, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Arriving rows without exact copies: a lineage id seen within the delay is passed on once."""
    return (stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
            .dropDuplicatesWithinWatermark(LINEAGE))


def ingest(stream: DataFrame, path: str, checkpoint: str, time: str = "ts", delay: str = "1 day") -> StreamingQuery:
    """Append new rows to the ledger table by year and month; reads what is there and ends.

    Offsets and seen ids live in the checkpoint, so a restart goes on where it stopped.
    """
    rows = new_rows(stream, time, delay).withColumns({"year": F.year(time), "month": F.month(time)})
    return (rows.writeStream.format("parquet").partitionBy("year", "month").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def daily_totals(stream: DataFrame, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Total and row count per day and category, final once the watermark has passed the day."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return (rows.groupBy(F.window(time, "1 day"), CATEGORY)
            .agg(F.sum(AMOUNT).alias(AMOUNT), F.count(F.lit(1)).alias("n_records"))
            .select(F.to_date(F.col("window.start")).alias(DATE), CATEGORY, AMOUNT, "n_records"))


# A version is the generation of its checkpoint, and below it the number of the batch.
BATCH_BITS = 40


def _names(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers of the files or folders `prefix<number>` in a folder, if there is one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
    return [int(name.removeprefix(prefix)) for name in found if name.startswith(prefix)]


def _mark(spark: SparkSession, checkpoint: str, generation: int) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/generation-{generation}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True).close()
    return generation


def _generation(spark: SparkSession, path: str, checkpoint: str) -> int:
    """The generation of a checkpoint; a new checkpoint comes after all that is stored."""
    known = _names(spark, checkpoint, "generation-")
    if known:
        return max(known)
    return _mark(spark, checkpoint, max([v >> BATCH_BITS for v in _names(spark, path, "version=")], default=-1) + 1)


def maintain_totals(stream: DataFrame, path: str, checkpoint: str, time: str = "ts", delay: str = "1 day",
                    final: bool = False) -> StreamingQuery:
    """Keep the daily totals in a table.

    By default each batch writes the totals it changed as its own version and `current_totals` reads the
    newest per day; with `final` a day is appended once, when the watermark has passed it. A batch that is run again
    writes the same version again; the versions of a new checkpoint are newer than all that are there.
    """
    totals = daily_totals(stream, time, delay)
    if final:
        return (totals.writeStream.format("parquet").outputMode("append").option("path", path)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    first = _generation(stream.sparkSession, path, checkpoint) << BATCH_BITS

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={first + number}")

    return (totals.writeStream.outputMode("update").foreachBatch(keep)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current_totals(versions: DataFrame) -> DataFrame:
    """Newest version of each day and category."""
    newest = F.max_by(F.struct(AMOUNT, "n_records"), "version")
    return versions.groupBy(DATE, CATEGORY).agg(newest.alias("t")).select(DATE, CATEGORY, "t.*")


def compact_totals(spark: SparkSession, path: str, checkpoint: str) -> None:
    """Put the current totals in place of all versions; runs while no stream writes.

    The checkpoint's next generation is marked first, so that wherever this ends, later batches are newer than what is there.
    """
    generation = _generation(spark, path, checkpoint)
    old = _names(spark, path, "version=")
    _mark(spark, checkpoint, generation + 2)
    current_totals(spark.read.parquet(path)).write.mode("overwrite").parquet(f"{path}/version={generation + 1 << BATCH_BITS}")
    for version in old:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={version}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def score_arriving(stream: DataFrame, limits: DataFrame, medians: DataFrame,
                   cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """Row status and peer deviation against the last published category limits and medians.

    A stateless join with static tables; a copy is not known here, so DUPLICATE is left to the batch run.
    """
    rows = (standardised(stream).join(limits.select(CATEGORY, "high_limit"), CATEGORY, "left")
            .join(medians.select(CATEGORY, "category_median"), CATEGORY, "left"))
    status = row_status(F.col(AMOUNT), F.col("status_text"), F.col(DATE), F.lit(False),
                        F.col(AMOUNT) > F.col("high_limit"), cfg.known_statuses)
    return rows.withColumns({
        "data_status": status, "deviation_from_category_median": F.col(AMOUNT) - F.col("category_median"),
    }).withColumn("issue_code", lookup(F.col("data_status"), fv.ISSUE_CODES))
