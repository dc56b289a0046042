"""Completeness of the ledger: missing days, gaps per unit, key figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens import fixed_values as fv
from ledgerlens.config import DEFAULT, LedgerConfig
from ledgerlens.operators.cleaning import dated
from ledgerlens.schema import CATEGORY, DATE, UNIT, UNIT_KEY


def missing_runs(cleaned: DataFrame) -> DataFrame:
    """Runs of calendar days on which no row at all was recorded, from each recorded day and the next one.

    One row per run, however long it is, so a date that is far off costs nothing; recorded days are bounded by the calendar.
    """
    following = F.lead(DATE).over(Window.orderBy(DATE))
    days = dated(cleaned).select(DATE).distinct().withColumn("following", following)
    return days.where(F.datediff("following", DATE) > 1).select(
        F.date_add(DATE, 1).alias("first_day"), F.date_sub("following", 1).alias("last_day"),
        (F.datediff("following", DATE) - 1).alias("n_days"))


def missing_days(cleaned: DataFrame) -> DataFrame:
    """Calendar days between the first and last day on which no row at all was recorded."""
    days = F.explode(F.sequence("first_day", "last_day")).alias(DATE)
    return missing_runs(cleaned).select(days).withColumn("issue", F.lit(fv.MISSING_DAY))


def longest_gaps(cleaned: DataFrame, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """Longest run of days without a row inside each unit's active range, where long enough.

    Works on distinct days, so a unit has at most as many rows as the calendar; of equal gaps the
    earliest is given.
    """
    days = dated(cleaned).select(*UNIT_KEY, DATE).distinct()
    before = F.lag(DATE).over(Window.partitionBy(*UNIT_KEY).orderBy(DATE))
    steps = days.withColumn("_before", before).withColumn("_gap", F.datediff(DATE, "_before") - 1)
    found = steps.groupBy(*UNIT_KEY).agg(
        F.min(DATE).alias("active_range_start"), F.max(DATE).alias("active_range_end"),
        F.max(F.when(F.col("_gap") > 0, F.struct(
            F.col("_gap").alias("days"), (-F.datediff(DATE, F.lit("1970-01-01"))).alias("early"),
            F.date_add("_before", 1).alias("start"), F.date_sub(DATE, 1).alias("end")))).alias("_longest"))
    return found.where(F.col("_longest.days") >= cfg.gap_days).select(
        *UNIT_KEY, F.col("_longest.start").alias("longest_gap_start"),
        F.col("_longest.end").alias("longest_gap_end"), F.col("_longest.days").alias("longest_gap_days"),
        "active_range_start", "active_range_end")


def quality_kpis(cleaned: DataFrame, monthly: DataFrame, gaps: DataFrame,
                 cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """One row of key figures and the overall state PASS, REVIEW or FAILED."""
    status = F.col("data_status")
    n_units = dated(cleaned).select(*UNIT_KEY).distinct().agg(F.count(F.lit(1))).scalar()
    n_gaps = gaps.agg(F.count(F.lit(1))).scalar()
    state = F.col("validation_status")
    months = monthly.agg(
        F.round(F.max(F.abs("difference_liter")), 1).alias("difference"),
        F.count_if(state.isin(*fv.PROBLEM_STATES)).alias("n_major"),
        F.count_if(state == "REQUIRES REVIEW").alias("n_review"))
    figures = cleaned.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(status.isin("VALID", "STATUS_ONLY")).alias("n_good"),
        F.count_if(status == "DUPLICATE").alias("duplicate_count"),
        F.count_if(F.trim(F.col(UNIT)) == "").alias("missing_equipment_count"),
        F.count_if(status.isin("NEGATIVE_VALUE", "UNKNOWN_STATUS")).alias("invalid_value_count"),
        F.count_if(status == "UNUSUALLY_HIGH").alias("unusually_high_count"),
        F.count_if(status == "INVALID_DATE").alias("invalid_date_count"),
    ).select(
        "*",
        F.coalesce(F.try_divide(F.col("n_good"), F.col("n")) * 100, F.lit(0.0)).alias("valid"),
        F.coalesce((1 - F.try_divide(n_gaps, n_units)) * 100, F.lit(0.0)).alias("complete"),
        months.select("difference").scalar().alias("difference"),
        months.select("n_major").scalar().alias("n_major"),
        months.select("n_review").scalar().alias("n_review"),
    ).withColumn("reconciliation_status", F.when(F.col("n_review") > 0, "FAILED")
                 .when(F.col("n_major") > cfg.major_months_allowed, "REVIEW").otherwise("PASS"))
    valid, complete, reconciled = F.col("valid"), F.col("complete"), F.col("reconciliation_status")
    overall = (F.when((valid >= cfg.valid_pct_pass) & (complete >= cfg.completeness_pass)
                      & (reconciled == "PASS"), "PASS")
               .when((valid >= cfg.valid_pct_review) & (complete >= cfg.completeness_review)
                     & (reconciled != "FAILED"), "REVIEW").otherwise("FAILED"))
    return figures.select(
        F.round("complete", 2).alias("data_completeness_percentage"),
        F.round("valid", 2).alias("valid_transaction_percentage"),
        "duplicate_count", "missing_equipment_count", "invalid_value_count", "unusually_high_count",
        "invalid_date_count", F.col("difference").alias("monthly_difference_liter_max"),
        F.col("n_major").alias("n_months_major_reconciliation_issue"), "reconciliation_status",
        overall.alias("overall_status"))


def top_gaps(gaps: DataFrame, n: int = 20) -> DataFrame:
    """The longest gaps of the fleet."""
    return gaps.orderBy(F.desc("longest_gap_days"), CATEGORY, UNIT).limit(n)
