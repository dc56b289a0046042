"""Column names and declared schemas of the ledger tables."""

from __future__ import annotations

from pyspark.sql import types as T

DATE = "date"
CATEGORY = "equipment_category"
UNIT = "equipment_id"
AMOUNT = "fuel_liter"
UNIT_KEY = [CATEGORY, UNIT]

# The ledger holds at most one analysed row per unit and day (copies are marked DUPLICATE and set
# aside), so this order is total for every per-unit window.
ROW_ORDER = [DATE, "source_file", "source_row"]

LEDGER = T.StructType([
    T.StructField(DATE, T.DateType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField(CATEGORY, T.StringType()),
    T.StructField(UNIT, T.StringType()),
    T.StructField(AMOUNT, T.DoubleType()),
    T.StructField("status_text", T.StringType()),
    T.StructField("source_sheet", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("source_row", T.LongType()),
])
LEDGER_COLUMNS = LEDGER.fieldNames()

CONTROL_TOTALS = T.StructType([
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("day", T.IntegerType()),
    T.StructField("category_label", T.StringType()),
    T.StructField("workbook_value", T.DoubleType()),
    T.StructField("source_file", T.StringType()),
    T.StructField(DATE, T.DateType()),
])

CELLS = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("sheet", T.StringType()),
    T.StructField("row", T.IntegerType()),
    T.StructField("col", T.IntegerType()),
    T.StructField("text", T.StringType()),
])

FORECAST = T.StructType([
    T.StructField(DATE, T.DateType()),
    T.StructField("actual_fuel", T.DoubleType()),
    T.StructField("forecast_fuel", T.DoubleType()),
    T.StructField("lower_interval", T.DoubleType()),
    T.StructField("upper_interval", T.DoubleType()),
    T.StructField("model_name", T.StringType()),
])
FORECAST_COLUMNS = FORECAST.fieldNames()


class SourceMissingError(FileNotFoundError):
    """The requested input does not exist or holds no rows."""


class SourceSchemaError(ValueError):
    """The input lacks required columns or structure."""
