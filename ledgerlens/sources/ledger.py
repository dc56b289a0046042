"""Choice and union of sources; table sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.monitoring import placeholder_forecast
from ledgerlens.schema import DATE, FORECAST, FORECAST_COLUMNS, LEDGER_COLUMNS, SourceMissingError
from ledgerlens.sources.vendor import read_csv_checked

MODES = ("hybrid", "sheets", "vendor")


def combine_sources(mode: str, sheets: DataFrame | None, vendor: DataFrame | None) -> DataFrame:
    """Ledger rows of the sources a mode asks for.

    The two single-source modes need their source; "hybrid" takes whichever exist.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    wanted = {"hybrid": [sheets, vendor], "sheets": [sheets], "vendor": [vendor]}[mode]
    found = [rows.select(*[c for c in LEDGER_COLUMNS if c in rows.columns]) for rows in wanted if rows is not None]
    if not found:
        raise SourceMissingError(f"no source available for mode {mode}")
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows, allowMissingColumns=True)
    return out


def read_forecasts(spark: SparkSession, path: str, fallback: DataFrame | None = None,
                   series_key: str = "ALL") -> DataFrame:
    """External forecasts in the contract, or the placeholder over `fallback` when there are none."""
    try:
        rows = read_csv_checked(spark, path, FORECAST_COLUMNS)
    except SourceMissingError:
        if fallback is None:
            raise
        return placeholder_forecast(fallback)
    typed = [F.try_to_date(F.substring(DATE, 1, 10)).alias(DATE) if f.name == DATE
             else F.col(f.name).try_cast(f.dataType).alias(f.name) for f in FORECAST.fields]
    return rows.select(F.lit(series_key).alias("series_key"), *typed)


def save_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet",
                partitions: Mapping[str, list[str]] | None = None) -> dict[str, str]:
    """Write one table per result below a folder; arrays become text in CSV."""
    written = {}
    for name, rows in tables.items():
        if fmt == "csv":
            rows = rows.select(*[F.to_json(c).alias(c) if t.startswith("array") else F.col(c)
                                 for c, t in rows.dtypes])
        writer = rows.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        columns = (partitions or {}).get(name)
        if columns:
            writer = writer.partitionBy(*columns)
        written[name] = f"{folder.rstrip('/')}/{name}"
        writer.save(written[name])
    return written


def save_ledger(cleaned: DataFrame, folder: str) -> str:
    """Cleaned ledger by year and month, so date filters skip whole folders.

    Rows of a month meet before the write; adaptive execution splits a month that is too large for one
    task and merges small ones.
    """
    path = f"{folder.rstrip('/')}/cleaned_ledger"
    cleaned.hint("rebalance", "year", "month").write.mode("overwrite").partitionBy("year", "month").parquet(path)
    return path
