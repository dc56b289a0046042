"""Recomputed totals against reported control totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import fixed_values as fv
from ledgerlens.config import DEFAULT, LedgerConfig
from ledgerlens.functions.calc import lookup, share
from ledgerlens.operators.cleaning import dated
from ledgerlens.schema import AMOUNT, CATEGORY


def difference_state(pct: Column, cfg: LedgerConfig = DEFAULT) -> Column:
    """State of a percent difference; a missing one needs review."""
    size = F.abs(pct)
    return (F.when(size < cfg.match_pct, "MATCH").when(size < cfg.minor_pct, "MINOR DIFFERENCE")
            .when(size < cfg.major_pct, "MAJOR DIFFERENCE").otherwise("REQUIRES REVIEW"))


def month_label(year: Column, month: Column) -> Column:
    return F.concat_ws(" ", lookup(month, fv.MONTH_NAMES), year.cast("string"))


def _compared(table: DataFrame) -> DataFrame:
    difference = F.col("recalculated_total") - F.col("workbook_reported_total")
    return (table.withColumn("month_name", month_label(F.col("year"), F.col("month")))
            .withColumn("difference_liter", difference)
            .withColumn("difference_percentage",
                        F.bround(share("difference_liter", "workbook_reported_total"), 2)))


def monthly_reconciliation(cleaned: DataFrame, totals: DataFrame, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """Per month: recomputed total, reported grand total, difference and its state."""
    recomputed = dated(cleaned).where("year IS NOT NULL AND month IS NOT NULL").groupBy("year", "month").agg(
        F.sum(AMOUNT).alias("recalculated_total"))
    reported = totals.where(F.col("category_label") == fv.GRAND_TOTAL).groupBy("year", "month").agg(
        F.sum("workbook_value").alias("workbook_reported_total"))
    table = _compared(recomputed.join(reported, ["year", "month"], "full"))
    return (table.withColumn("validation_status", difference_state(F.col("difference_percentage"), cfg))
            .select("year", "month", "month_name", "workbook_reported_total", "recalculated_total",
                    "difference_liter", "difference_percentage", "validation_status"))


def category_reconciliation(cleaned: DataFrame, totals: DataFrame, cfg: LedgerConfig = DEFAULT,
                            labels: Mapping[str, Sequence[str]] = fv.CATEGORY_LABELS) -> DataFrame:
    """The same per month and category; several reported labels may make up one category."""
    by_label = {label: category for category, names in labels.items() for label in names}
    recomputed = (dated(cleaned).where(f"year IS NOT NULL AND month IS NOT NULL AND {CATEGORY} IS NOT NULL")
                  .groupBy("year", "month", CATEGORY).agg(F.sum(AMOUNT).alias("recalculated_total")))
    reported = (totals.withColumn(CATEGORY, lookup(F.col("category_label"), by_label))
                .where(F.col(CATEGORY).isNotNull()).groupBy("year", "month", CATEGORY)
                .agg(F.sum("workbook_value").alias("workbook_reported_total")))
    table = _compared(recomputed.join(reported, ["year", "month", CATEGORY], "left"))
    nothing = (F.col("difference_liter").isNull()
               | ((F.col("workbook_reported_total") == 0) & (F.col("difference_liter") == 0)))
    state = F.when(nothing, "NO_WORKBOOK_VALUE").otherwise(
        difference_state(F.col("difference_percentage"), cfg))
    return table.withColumn("validation_status", state).select(
        "year", "month", "month_name", CATEGORY, "workbook_reported_total", "recalculated_total",
        "difference_liter", "difference_percentage", "validation_status")


def reconciliation_summary(monthly: DataFrame, by_category: DataFrame) -> DataFrame:
    """One row: number and names of problem months, problem category-months, largest difference."""
    problem = F.col("validation_status").isin(*fv.PROBLEM_STATES)
    month = F.when(problem, F.struct("year", "month", "month_name"))
    named = F.transform(F.array_sort(F.collect_list(month)), lambda m: m["month_name"])
    n_category = by_category.agg(F.count_if(problem)).scalar()
    return monthly.agg(
        F.count_if(problem).alias("n_months_with_major_difference"),
        named.alias("months_with_major_difference"),
        F.max(F.abs("difference_percentage")).alias("max_abs_difference_percentage"),
    ).withColumn("n_category_months_with_major_difference", n_category)


def by_severity(reconciliation: DataFrame) -> DataFrame:
    """Rows ordered from the worst state to the best."""
    rank = (F.when(F.col("validation_status") == "REQUIRES REVIEW", 0)
            .when(F.col("validation_status") == "MAJOR DIFFERENCE", 1)
            .when(F.col("validation_status") == "MINOR DIFFERENCE", 2)
            .when(F.col("validation_status") == "MATCH", 3).otherwise(4))
    return reconciliation.withColumn("severity_rank", rank).orderBy("severity_rank", "year", "month")

