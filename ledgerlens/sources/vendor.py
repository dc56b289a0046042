"""Vendor dispenser reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens import fixed_values as fv
from ledgerlens.functions.text import split_unit
from ledgerlens.schema import AMOUNT, CATEGORY, DATE, LEDGER, LEDGER_COLUMNS, UNIT, SourceMissingError, SourceSchemaError
from ledgerlens.scratch import join_measured, stored


def _named(columns: list[str], wanted: str, partly: bool = False) -> str | None:
    """The column of that name in any case, or the first that contains it."""
    for column in columns:
        shown = column.strip().lower()
        if shown == wanted or (partly and wanted in shown):
            return column
    return None


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows as stored, with _number 1..n: the place in the part they were written from after all earlier parts."""
    kept = stored(rows.withColumn("_at", F.monotonically_increasing_id()))
    kept = kept.withColumn("_part", F.shiftright("_at", 33))
    # One row per part, whatever the number of rows.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_held"))
               .select("_part", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_offset")))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (join_measured(kept, offsets, "_part", "inner")
            .withColumn("_number", F.col("_offset") + place + 1).drop("_at", "_part", "_offset"))


def vendor_ledger(report: DataFrame, source_label: str = "vendor_report",
                  prefixes: Mapping[str, str] = fv.UNIT_PREFIXES) -> DataFrame:
    """Raw report (Date, Unit, Volume, Status, ...) as ledger rows with VALID or INVALID marks.

    The report's own running number is the lineage row; without one the rows are stored and numbered from 1 in
    the order of their parts.
    """
    found = {name: _named(report.columns, name, name == "volume") for name in ("no", "date", "unit", "volume", "status")}
    missing = [name for name in ("date", "unit", "volume") if found[name] is None]
    if missing:
        raise SourceSchemaError(f"report lacks columns: {missing}")

    def raw(name: str) -> Column:
        return F.col(f"`{found[name]}`")

    if found["no"] is None:
        if report.isStreaming:
            raise SourceSchemaError("a stream of reports needs its own running number (no)")
        report = _numbered(report.select(*[raw(name) for name in found if found[name]]))

    category, unit = split_unit(raw("unit"), prefixes)
    amount = F.replace(raw("volume").cast("string"), F.lit(","), F.lit("")).try_cast("double")
    number = raw("no").try_cast("long") if found["no"] else F.col("_number")
    rows = report.select(
        F.try_to_date(raw("date").cast("string")).alias(DATE), category.alias(CATEGORY), unit.alias(UNIT),
        amount.alias(AMOUNT), (raw("status") if found["status"] else F.lit("")).alias("status_text"),
        F.lit("N/A").alias("source_sheet"), F.lit(source_label).alias("source_file"),
        number.alias("source_row"))
    return rows.withColumns({
        "year": F.year(DATE), "month": F.month(DATE),
        "data_status": F.when(F.col(AMOUNT).isNotNull(), "VALID").otherwise("INVALID"),
        "issue_code": F.when(F.col(AMOUNT).isNotNull(), "").otherwise("MISSING_VOLUME"),
    }).select(*LEDGER_COLUMNS, "data_status", "issue_code")


def read_csv_checked(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """CSV with a header, all columns as text; an error when it is missing, empty or lacks columns."""
    try:
        rows = spark.read.option("header", True).csv(path)
    except AnalysisException as error:
        raise SourceMissingError(f"no input at {path}") from error
    lacking = [name for name in required if name not in rows.columns]
    if lacking:
        raise SourceSchemaError(f"{path} lacks columns {lacking}")
    if rows.isEmpty():
        raise SourceMissingError(f"{path} holds no rows")
    return rows


def read_vendor_csv(spark: SparkSession, path: str) -> DataFrame:
    """Transformed vendor report as ledger rows; unreadable dates become missing."""
    rows = read_csv_checked(spark, path, LEDGER_COLUMNS)
    typed = [F.try_to_date(F.substring(F.col(f.name), 1, 10)).alias(f.name) if f.name == DATE
             else F.col(f.name).try_cast(f.dataType).alias(f.name) for f in LEDGER.fields]
    return rows.select(*typed)
