"""The given tables seen as ledgers, control totals, vendor reports and sheet grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens import fixed_values as fv
from ledgerlens.functions.calc import lookup
from ledgerlens.functions.text import cell_value
from ledgerlens.schema import AMOUNT, CATEGORY, DATE, LEDGER_COLUMNS, UNIT
from ledgerlens.scratch import cut, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ledger(rows: DataFrame, date: Column, category: Column, unit: Column, amount: Column, file: str,
            row: Column, status: Column | None = None) -> DataFrame:
    return rows.select(
        date.alias(DATE), F.year(date).alias("year"), F.month(date).alias("month"), category.alias(CATEGORY),
        unit.alias(UNIT), amount.alias(AMOUNT),
        (F.lit(None).cast("string") if status is None else status).alias("status_text"),
        F.date_format(date, "yyyy-MM").alias("source_sheet"), F.lit(file).alias("source_file"),
        row.cast("long").alias("source_row")).select(*LEDGER_COLUMNS)


def lines_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: quantity per supplier within return flag, by ship date."""
    rows = table(spark, sf_dir, "lineitem")
    return _ledger(rows, F.to_date("l_shipdate"), F.col("l_returnflag"), F.col("l_suppkey").cast("string"),
                   F.col("l_quantity"), "lineitem", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


def suppliers_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with the supplier as category and the return flag as unit: three units per category."""
    rows = table(spark, sf_dir, "lineitem")
    return _ledger(rows, F.to_date("l_shipdate"), F.col("l_suppkey").cast("string"), F.col("l_returnflag"),
                   F.col("l_quantity"), "lineitem", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


def events_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: value per user within event type."""
    rows = table(spark, sf_dir, "events")
    return _ledger(rows, F.to_date("ts"), F.col("event_type"), F.col("user_id").cast("string"), F.col("value"),
                   "events", F.col("event_id"))


def spiked_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines_ledger with forty times the quantity in the first lines of one order in 101."""
    spike = (F.floor(F.col("source_row") / 10) % 101 == 0) & (F.col("source_row") % 10 == 1)
    return lines_ledger(spark, sf_dir).withColumn(AMOUNT, F.col(AMOUNT) * F.when(spike, 40).otherwise(1))


def planted_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: monthly quantity per supplier, ten times as much from a month on that depends on the supplier."""
    month = F.trunc(F.to_date("l_shipdate"), "MM")
    rows = table(spark, sf_dir, "lineitem").groupBy(month.alias("month"), "l_suppkey").agg(F.sum("l_quantity").alias("used"))
    number = F.year("month") * 12 + F.month("month") - 1995 * 12
    late = number >= 20 + F.col("l_suppkey") % 40
    return _ledger(rows, F.col("month"), (F.col("l_suppkey") % 3).cast("string"), F.col("l_suppkey").cast("string"),
                   F.col("used") * F.when(late, 10).otherwise(1), "planted", F.col("l_suppkey") * 1000 + number)


def raw_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as hand-written cells: the number in props decides how a cell is filled and an id is spelt.

    Written once, as cells are an input that several steps read.
    """
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k, value, user = F.col("k"), F.col("value").cast("string"), F.col("user_id").cast("string")
    text = (F.when(k < 8, "").when(k < 16, " full").when(k < 20, "in  shop").when(k < 40, F.replace(value, F.lit("."), F.lit(",")))
            .when(k < 45, F.concat(F.lit("-"), value)).otherwise(value))
    unit = (F.when(k < 30, F.concat(F.lit("U "), user)).when(k < 60, F.concat(F.lit(" U  "), user, F.lit(" / old 1")))
            .when(k < 90, F.concat(F.lit("u-"), user)).otherwise(F.concat(F.lit("U"), user)))
    date = F.when(k < 97, F.to_date("ts"))
    return cut(rows.select("event_id", date.alias(DATE), F.col("event_type").alias(CATEGORY), unit.alias(UNIT),
                           text.alias("text")))


def mixed_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hand-written cells read into a ledger; rows of every status occur."""
    cells = raw_cells(spark, sf_dir)
    amount, status = cell_value(F.col("text"))
    return _ledger(cells, F.col(DATE), F.col(CATEGORY), F.col(UNIT), amount, "cells", F.col("event_id"), status)


def vendor_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a vendor report: all columns text, volumes with thousands commas."""
    rows = table(spark, sf_dir, "events")
    return rows.select(
        (F.col("event_id") + 1).cast("string").alias("No"), F.lit("S1").alias("Site"),
        F.date_format("ts", "yyyy-MM-dd").alias(" Date"), vendor_unit().alias("Unit"),
        F.lit("online").alias("Status"), F.format_number(F.col("value") * 1000, 2).alias("Volume (L)"))


def vendor_unit() -> Column:
    """Unit strings of the vendor kind from event type and user."""
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    return (F.when(kind == "click", F.concat(F.lit("HT "), user)).when(kind == "view", F.concat(F.lit("bus"), user))
            .when(kind == "error", user).otherwise(F.concat(F.lit(" "), kind, F.lit("  "), user)))


def sales_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem joined to orders and customers: price per supplier within market segment, by order date."""
    rows = (table(spark, sf_dir, "lineitem")
            .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")))
    return _ledger(rows, F.to_date("o_orderdate"), F.col("c_mktsegment"), F.col("l_suppkey").cast("string"),
                   F.col("l_extendedprice"), "lineitem", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


# Market segments and the labels under which their totals are reported; HOUSEHOLD is not reported.
SEGMENT_LABELS = {
    "AUTOMOBILE": ["AUTOMOBILE"], "BUILDING": ["BUILDING"], "FURNITURE": ["FURNITURE URGENT", "FURNITURE OTHER"],
    "HOUSEHOLD": ["HOUSEHOLD"], "MACHINERY": ["MACHINERY"],
}


def sales_totals(spark: SparkSession, sf_dir: str, sales: DataFrame | None = None) -> DataFrame:
    """Reported totals: order prices per day and segment, furniture under two labels, machinery as sold.

    `sales` is the sales ledger, if it was already written.
    """
    orders = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    kind = F.col("c_mktsegment")
    label = (F.when(kind == "FURNITURE", F.when(F.col("o_orderpriority") == "1-URGENT", "FURNITURE URGENT")
                    .otherwise("FURNITURE OTHER"))
             .when(kind == "HOUSEHOLD", "UNLISTED").otherwise(kind))
    date = F.to_date("o_orderdate").alias(DATE)
    by_label = (orders.where(kind != "MACHINERY").groupBy(date, label.alias("category_label"))
                .agg(F.sum("o_totalprice").alias("workbook_value")))
    sales = sales_ledger(spark, sf_dir) if sales is None else sales
    sold = (sales.where(F.col(CATEGORY) == "MACHINERY")
            .groupBy(DATE, F.col(CATEGORY).alias("category_label")).agg(F.sum(AMOUNT).alias("workbook_value")))
    grand = orders.groupBy(date, F.lit(fv.GRAND_TOTAL).alias("category_label")).agg(
        F.sum("o_totalprice").alias("workbook_value"))
    rows = by_label.unionByName(sold).unionByName(grand)
    return rows.select(F.year(DATE).alias("year"), F.month(DATE).alias("month"), F.dayofmonth(DATE).alias("day"),
                       "category_label", "workbook_value", F.lit("orders").alias("source_file"), DATE)


LINE_LABELS = {"A": ["A"], "N": ["N"], "R": ["R"]}


def line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported totals beside the lines ledger: quantities less tax by flag, less discount over all."""
    rows = table(spark, sf_dir, "lineitem")
    date = F.to_date("l_shipdate").alias(DATE)
    flags = rows.groupBy(date, F.col("l_returnflag").alias("category_label")).agg(
        F.sum(F.col("l_quantity") * (1 - F.col("l_tax"))).alias("workbook_value"))
    grand = rows.groupBy(date, F.lit(fv.GRAND_TOTAL).alias("category_label")).agg(
        F.sum(F.col("l_quantity") * (1 - F.col("l_discount"))).alias("workbook_value"))
    both = flags.unionByName(grand)
    return both.select(F.year(DATE).alias("year"), F.month(DATE).alias("month"), F.dayofmonth(DATE).alias("day"),
                       "category_label", "workbook_value", F.lit("lineitem").alias("source_file"), DATE)


def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem written as monthly sheets: one row per supplier, one column per day, totals below.

    Flag A fills one section, N a second, R a stacked one whose two groups split the suppliers by nation.
    """
    used = (table(spark, sf_dir, "lineitem")
            .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy(F.to_date("l_shipdate").alias(DATE), "l_returnflag", "l_suppkey", "s_nationkey")
            .agg(F.sum("l_quantity").alias("used")))
    # Sums per day and the places of rows are read by several parts of the sheets, so both are written once.
    group = (F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2)
             .when(F.col("s_nationkey") < 13, 3).otherwise(4))
    months = {at: name for name, at in reversed(fv.SHEET_MONTHS.items())}
    used = used.withColumns({
        "grp": group, "day": F.dayofmonth(DATE),
        "sheet": F.concat_ws(" ", lookup(F.month(DATE), months), F.year(DATE).cast("string")),
        "file": F.concat(F.lit("report_"), F.year(DATE).cast("string"))})
    used = stored(used)
    sheets = used.select("file", "sheet").distinct()
    units = used.select("file", "sheet", "grp", F.col("l_suppkey").alias("at")).distinct().withColumn(
        "text", F.concat(F.lit("S "), F.col("at").cast("string"))).withColumn("kind", F.lit("unit"))

    def fixed(grp: int, at: int, kind: str, text: str) -> Column:
        return F.struct(F.lit(grp).alias("grp"), F.lit(at).cast("long").alias("at"), F.lit(kind).alias("kind"),
                        F.lit(text).alias("text"))

    end = 2 ** 40
    frame = [
        fixed(1, -2, "title", "PEMAKAIAN SOLAR RTGC"), fixed(1, -1, "header", "UNIT"), fixed(1, end, "sum", "TOTAL"),
        fixed(1, end + 1, "note", "after the total"),
        fixed(2, -2, "title", " Pemakaian  Solar HeadTruck"), fixed(2, -1, "header", "UNIT"), fixed(2, end, "sum", "Total"),
        fixed(3, -2, "title", "PEMAKAIAN SOLAR KENDARAAN BUS DAN ELF"), fixed(3, -1, "header", "UNIT"),
        fixed(3, end, "sum", "TOTAL"), fixed(4, -1, "note", "UNIT"), fixed(4, end, "sum", "TOTAL"),
        fixed(5, -2, "title", "TOTALISATOR"), fixed(5, -1, "header", "UNIT"), fixed(5, 1, "label", "RTGC"),
        fixed(5, 2, "label", "head truck"), fixed(5, 3, "label", "BUS"), fixed(5, 4, "label", "ELF"),
        fixed(5, 5, "label", "TOTAL"),
    ]
    rows = sheets.select("file", "sheet", F.inline(F.array(*frame))).unionByName(units)
    order = Window.partitionBy("file", "sheet").orderBy("grp", "at")
    rows = stored(rows.withColumn("row", F.row_number().over(order) - 1))
    first = rows.select("file", "sheet", "row", F.lit(0).alias("col"), "text")
    marks = [F.struct(F.lit(d).alias("col"), F.lit(str(d)).alias("text")) for d in range(1, 32)]
    marks += [F.struct(F.lit(32).alias("col"), F.lit("WEEKS").alias("text")),
              F.struct(F.lit(33).alias("col"), F.lit("21").alias("text"))]
    header = rows.where("kind = 'header'").select("file", "sheet", "row", F.inline(F.array(*marks)))
    shown = F.when(F.col("grp") == 2, F.replace(F.col("used").cast("string"), F.lit("."), F.lit(","))).otherwise(
        F.col("used").cast("string"))
    values = (used.withColumn("at", F.col("l_suppkey"))
              .join(rows.where("kind = 'unit'").drop("text"), ["file", "sheet", "grp", "at"])
              .select("file", "sheet", "row", F.col("day").alias("col"), shown.alias("text")))
    sums = used.select("file", "sheet", "day", "used", F.explode(F.array(F.col("grp"), F.lit(5))).alias("label"))
    sums = sums.groupBy("file", "sheet", "day", "label").agg(F.sum("used").alias("used"))
    totals = (sums.join(rows.where("kind = 'label'").withColumn("label", F.col("at").cast("int")).drop("text"),
                        ["file", "sheet", "label"])
              .select("file", "sheet", "row", F.col("day").alias("col"), F.col("used").cast("string").alias("text")))
    notes = sheets.select("file", F.lit("CATATAN").alias("sheet"), F.lit(0).alias("row"), F.lit(0).alias("col"),
                          F.lit("free text").alias("text")).distinct()
    return first.unionByName(header).unionByName(values).unionByName(totals).unionByName(notes)
