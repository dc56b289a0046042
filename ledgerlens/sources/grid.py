"""Sheet grids: a table of cells (file, sheet, row, col, text) becomes the ledger and control totals.

All files and sheets are read in one job. Sections are few per sheet, so they are found first and the
cells are joined to them; no sheet is gathered in one task.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens import fixed_values as fv
from ledgerlens.functions.text import cell_value, date_from, number_in, one_spaced, sheet_month, sheet_year
from ledgerlens.schema import AMOUNT, CATEGORY, CELLS, DATE, LEDGER_COLUMNS, UNIT, SourceMissingError
from ledgerlens.scratch import stored

SHEET = ["file", "sheet"]
SECTION = [*SHEET, "title_row"]


class Grid(NamedTuple):
    """What the sheets hold, all lazy."""
    ledger: DataFrame
    totals: DataFrame
    header_anomalies: DataFrame
    skipped_sheets: DataFrame


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cell table stored as CSV (file,sheet,row,col,text)."""
    try:
        return spark.read.schema(CELLS).option("header", True).csv(path)
    except Exception as error:
        raise SourceMissingError(path) from error


def section_label(text: Column) -> Column:
    """Category of a section title in column 0, missing for other texts."""
    def named(shown: Column) -> Column:
        label = F.lit(None).cast("string")
        for words, name in reversed(fv.SECTION_TITLES):
            label = F.when(F.contains(shown, F.lit(words)), name).otherwise(label)
        return label

    # The text is put in shape once, not once for each title.
    return F.get(F.transform(F.array(F.upper(one_spaced(text))), named), F.lit(0))


def sheet_calendar(cells: DataFrame) -> DataFrame:
    """Every sheet with the month and year its name gives, and its number of rows.

    Sheets are written before their names are read: a filter on what names give would move below the grouping, to all cells.
    """
    sheets = stored(cells.groupBy(*SHEET).agg((F.max("row") + 1).alias("n_rows")))
    return (sheets.withColumns({"month": sheet_month(F.col("sheet")), "year": sheet_year(F.col("sheet"))})
            .withColumn("is_monthly", F.col("month").isNotNull() & F.col("year").isNotNull()))


def find_sections(cells: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """Titled sections of monthly sheets: title row, label, the row where the next one starts.

    `sheets` takes the calendar of the cells' sheets where it is known.
    """
    titles = (cells.where("col = 0").withColumn("label", section_label(F.col("text")))
              .where("label IS NOT NULL").select(*SHEET, F.col("row").alias("title_row"), "label"))
    following = F.lead("title_row").over(Window.partitionBy(*SHEET).orderBy("title_row"))
    months = (sheet_calendar(cells) if sheets is None else sheets).where("is_monthly")
    return (titles.join(months, SHEET).withColumn("end_row", F.coalesce(following, F.col("n_rows")))
            .where("title_row + 1 < end_row").select(*SECTION, "label", "end_row", "year", "month"))


def placed(cells: DataFrame, sections: DataFrame) -> DataFrame:
    """Cells with the section whose rows hold them, from its title to the row before `end_row`.

    The sections of a sheet are one short list of intervals that a cell is looked up in, so no cell meets all of them.
    """
    own = F.struct(*[c for c in sections.columns if c not in SHEET])
    lists = sections.groupBy(*SHEET).agg(F.collect_list(own).alias("_sections"))
    holds = F.filter("_sections", lambda s: (s["title_row"] <= F.col("row")) & (F.col("row") < s["end_row"]))
    return cells.join(lists, SHEET).withColumn("_section", F.get(holds, F.lit(0))).where("_section IS NOT NULL").select(
        *cells.columns, "_section.*")


def section_intervals(cells: DataFrame, sections: DataFrame) -> DataFrame:
    """Every section as an interval of rows, with its filled cells."""
    return placed(cells, sections).groupBy(*SECTION, "label", "end_row", "year", "month").agg(
        F.count("text").alias("n_cells"))


def _in_section(cells: DataFrame, sections: DataFrame) -> DataFrame:
    """Cells below the header of a section."""
    return placed(cells, sections).where("row > title_row + 1")


def header_days(cells: DataFrame, sections: DataFrame) -> DataFrame:
    """Header cells that name a day 1..31, numbered per day from the left (nth = 1 is used)."""
    heads = sections.withColumn("row", F.col("title_row") + 1)
    # Written before its texts are read, as reading would move below the join, to all cells.
    header = stored(cells.where("col >= 1").join(heads, [*SHEET, "row"]).select(*SECTION, "row", "col", "text"))
    day = number_in(F.trim("text"))
    days = (header.withColumn("_number", day).where("_number = floor(_number) AND _number BETWEEN 1 AND 31")
            .withColumn("day", F.col("_number").cast("int")))
    nth = F.row_number().over(Window.partitionBy(*SECTION, "day").orderBy("col"))
    return days.withColumn("nth", nth).select(*SECTION, "row", "col", "day", "nth")


def unit_rows(cells: DataFrame, sections: DataFrame) -> DataFrame:
    """Rows that belong to a unit, with its category.

    A block ends at its first TOTAL row; a stacked section holds one block per label.
    """
    first = _in_section(cells.where("col = 0 AND text IS NOT NULL"),
                        sections.where(F.col("label") != fv.TOTALS_SECTION))
    word = F.upper(F.trim("text"))
    ends = (first.where(word == "TOTAL")
            .withColumn("nth", F.row_number().over(Window.partitionBy(*SECTION).orderBy("row")))
            .where(F.col("nth") <= len(fv.STACKED_LABELS)).groupBy(*SECTION)
            .agg(*[F.max(F.when(F.col("nth") == i + 1, F.col("row"))).alias(f"end_{i}")
                   for i in range(len(fv.STACKED_LABELS))]))
    rows = first.where(~word.isin("TOTAL", "UNIT")).join(ends, SECTION, "left")
    no_end = F.lit(2 ** 31 - 1)
    stacked = F.col("label") == fv.STACKED_SECTION
    category = F.when(F.col("row") < F.coalesce("end_0", no_end),
                      F.when(stacked, fv.STACKED_LABELS[0]).otherwise(F.col("label")))
    category = category.when(stacked & (F.col("row") < F.coalesce("end_1", no_end)), fv.STACKED_LABELS[1])
    return (rows.withColumn(CATEGORY, category).where(F.col(CATEGORY).isNotNull())
            .select(*SECTION, "row", "year", "month", CATEGORY, F.trim("text").alias(UNIT)))


def read_units(cells: DataFrame, sections: DataFrame, days: DataFrame) -> DataFrame:
    """One ledger row per filled cell of a unit and day."""
    values = cells.where("col >= 1").join(unit_rows(cells, sections), [*SHEET, "row"])
    values = values.join(days.where("nth = 1").select(*SECTION, "col", "day"), [*SECTION, "col"])
    amount, status = cell_value(F.col("text"))
    return (values.withColumns({AMOUNT: amount, "status_text": status})
            .where(F.col(AMOUNT).isNotNull() | F.col("status_text").isNotNull())
            .withColumns({DATE: date_from(F.col("year"), F.col("month"), F.col("day")),
                          "source_sheet": F.col("sheet"), "source_file": F.col("file"),
                          "source_row": F.col("row").cast("long")})
            .select(*LEDGER_COLUMNS))


def read_totals(cells: DataFrame, sections: DataFrame, days: DataFrame) -> DataFrame:
    """Reported control totals per label and day; only numeric cells count."""
    totals = sections.where(F.col("label") == fv.TOTALS_SECTION)
    name = F.upper(F.trim("text"))
    labels = (_in_section(cells.where("col = 0"), totals).where(F.trim("text") != "")
              .select(*SECTION, "row", "year", "month",
                      F.when(name == "TOTAL", fv.GRAND_TOTAL).otherwise(name).alias("category_label")))
    values = cells.where("col >= 1").join(labels, [*SHEET, "row"])
    values = values.join(days.where("nth = 1").select(*SECTION, "col", "day"), [*SECTION, "col"])
    return (values.withColumn("workbook_value", number_in(F.trim("text"))).where("workbook_value IS NOT NULL")
            .select("year", "month", "day", "category_label", "workbook_value", F.col("file").alias("source_file"),
                    date_from(F.col("year"), F.col("month"), F.col("day")).alias(DATE)))


def read_grid(cells: DataFrame) -> Grid:
    """Ledger, control totals, repeated header days and skipped sheets of all cells.

    `cells` is read several times and should be a stored table. Sections and header days, a few rows per
    sheet, are written once, as Parquet, so that Spark knows how small they are before it moves cells.
    """
    sheets = sheet_calendar(cells)
    sections = stored(find_sections(cells, sheets))
    days = stored(header_days(cells, sections))
    repeated = days.where("nth > 1").select(
        "file", F.col("sheet").alias("source_sheet"), F.col("row").alias("header_row"), "day",
        F.col("col").alias("dropped_col"))
    used = sections.select(*SHEET).distinct()
    skipped = (sheets.join(used, SHEET, "left_anti")
               .select(*SHEET, F.when(F.col("is_monthly"), "no section").otherwise("no month").alias("reason")))
    return Grid(read_units(cells, sections, days), read_totals(cells, sections, days), repeated, skipped)
