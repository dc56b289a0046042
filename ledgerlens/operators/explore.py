"""Drill-down queries over the cleaned ledger and the derived tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.calc import share, total
from ledgerlens.functions.ranks import group_quantiles
from ledgerlens.schema import AMOUNT, CATEGORY, DATE, UNIT, UNIT_KEY


def scope(rows: DataFrame, categories: Sequence[str] = (), units: Sequence[str] = (), start=None,
          end=None) -> DataFrame:
    """Rows of the given categories, units and days (both ends included); empty means all."""
    if categories:
        rows = rows.where(F.col(CATEGORY).isin(*categories))
    if units:
        rows = rows.where(F.col(UNIT).isin(*units))
    if start is not None:
        rows = rows.where(F.col(DATE) >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col(DATE) <= F.lit(end).cast("date"))
    return rows


def scope_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(total(AMOUNT).alias("total_liter"), F.count_distinct(UNIT).alias("n_equipment"),
                    F.count(F.lit(1)).alias("n_transaksi"), F.avg(AMOUNT).alias("avg_per_transaksi"))


def period_totals(rows: DataFrame, period: str = "month", keys: Sequence[str] = ()) -> DataFrame:
    """Totals per month (label yyyy-MM) or per day, overall or by keys."""
    bucket = {"month": F.date_format(DATE, "yyyy-MM").alias("period_label"), "day": F.col(DATE)}[period]
    return rows.groupBy(bucket, *keys).agg(total(AMOUNT).alias(AMOUNT))


def category_stats(rows: DataFrame) -> DataFrame:
    """Total, units, transactions, share of the grand total and mean per unit for each category."""
    stats = rows.groupBy(CATEGORY).agg(
        total(AMOUNT).alias("total_liter"), F.count_distinct(UNIT).alias("n_equipment"),
        F.count(AMOUNT).alias("n_transaksi"))
    everything = rows.agg(total(AMOUNT)).scalar()
    return stats.withColumns({
        "share_pct": F.bround(share(F.col("total_liter"), everything), 1),
        "rata_rata_per_equipment": F.bround(F.col("total_liter") / F.col("n_equipment"), 1),
    }).orderBy(F.desc("total_liter"), CATEGORY)


def month_category_pivot(rows: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Month x category totals with 0 for none; TOTAL is the month over all categories, listed or not."""
    parts = [F.bround(F.coalesce(F.sum(F.when(F.col(CATEGORY) == c, F.col(AMOUNT))), F.lit(0.0)), 0).alias(c)
             for c in categories]
    whole = F.bround(F.coalesce(F.sum(AMOUNT), F.lit(0.0)), 0).alias("TOTAL")
    return rows.groupBy(F.date_format(DATE, "yyyy-MM").alias("period_label")).agg(*parts, whole)


def combined_share(stats: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Share of the grand total that the given categories hold together."""
    return stats.where(F.col(CATEGORY).isin(*categories)).agg(
        F.coalesce(F.sum("share_pct"), F.lit(0.0)).alias("combined_share_pct"))


def top_units(rows: DataFrame, n: int = 10) -> DataFrame:
    return (rows.groupBy(*UNIT_KEY).agg(total(AMOUNT).alias(AMOUNT))
            .withColumn("label", F.concat_ws(" - ", CATEGORY, UNIT))
            .orderBy(F.desc(AMOUNT), CATEGORY, UNIT).limit(n))


def trailing_sum(series: DataFrame, days: int) -> DataFrame:
    """Sum of the last `days` days of each daily series."""
    last = series.groupBy("series_key").agg(F.max(DATE).alias("last_date"), F.min(DATE).alias("first_date"))
    enough = F.datediff("last_date", "first_date") + 1 >= days
    recent = series.join(last, "series_key").where(F.col(DATE) > F.date_sub("last_date", days))
    return recent.where(enough).groupBy("series_key").agg(total("y").alias(f"trailing_{days}"))


def overview_kpis(report: DataFrame, health: DataFrame) -> DataFrame:
    """Anomalies of at least medium severity, and units with critical ones."""
    critical = health.where("critical_anomaly_count > 0").agg(F.count_distinct(UNIT)).scalar()
    return report.agg(F.count_if(F.col("severity").isin("MEDIUM", "HIGH", "CRITICAL")).alias("n_anomaly")
                      ).withColumn("n_critical_units", critical)


def anomaly_filter(report: DataFrame, severities: Sequence[str] = ("MEDIUM", "HIGH", "CRITICAL"),
                   categories: Sequence[str] = (), units: Sequence[str] = (), start=None, end=None) -> DataFrame:
    rows = scope(report.where(F.col("severity") != "INSUFFICIENT_DATA"), categories, units, start, end)
    return rows.where(F.col("severity").isin(*severities)) if severities else rows


def anomaly_counters(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n_anomaly"), F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"),
                    F.count_if(F.col("severity") == "HIGH").alias("n_high"),
                    F.count_distinct(UNIT).alias("n_equipment"))


def contribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy(CATEGORY).agg(F.count(F.lit(1)).alias("n_anomaly")).orderBy(F.desc("n_anomaly"), CATEGORY)


def unit_timeline(report: DataFrame, unit: str) -> DataFrame:
    """One unit's scored rows in time, with the anomalous ones marked."""
    return (report.where((F.col(UNIT) == unit) & (F.col("severity") != "INSUFFICIENT_DATA"))
            .select(DATE, CATEGORY, AMOUNT, "severity", (F.col("severity") != "NORMAL").alias("is_anomaly"))
            .orderBy(DATE, CATEGORY))


def health_counters(health: DataFrame) -> DataFrame:
    status = F.col("health_status")
    return health.agg(
        F.avg(F.when(status != "INSUFFICIENT_DATA", F.col("health_score"))).alias("mean_score"),
        F.count_if(status == "CRITICAL").alias("n_critical"), F.count_if(status == "REVIEW").alias("n_review"),
        F.count_if(status == "INSUFFICIENT_DATA").alias("n_insufficient"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def five_numbers(health: DataFrame) -> DataFrame:
    """Minimum, quartiles and maximum of the score per category."""
    scored = health.where(F.col("health_status") != "INSUFFICIENT_DATA")
    return group_quantiles(scored, [CATEGORY], "health_score",
                           {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0})


def unit_search(health: DataFrame, pattern: str | None = None, statuses: Sequence[str] = (),
                categories: Sequence[str] = ()) -> DataFrame:
    """Units whose id matches a pattern in any case, within the given states and categories."""
    rows = scope(health, categories)
    if statuses:
        rows = rows.where(F.col("health_status").isin(*statuses))
    if pattern:
        rows = rows.where(F.col(UNIT).rlike(f"(?i){pattern}"))
    return rows


def advice_counters(advice: DataFrame) -> DataFrame:
    return advice.agg(F.count(F.lit(1)).alias("n_recommendations"),
                      F.count_if(F.col("priority") == "HIGH").alias("n_high"),
                      F.count_distinct(UNIT).alias("n_equipment"))


def advice_filter(advice: DataFrame, priorities: Sequence[str] = (), roles: Sequence[str] = (),
                  statuses: Sequence[str] = ()) -> DataFrame:
    for column, wanted in (("priority", priorities), ("responsible_role", roles), ("status", statuses)):
        if wanted:
            advice = advice.where(F.col(column).isin(*wanted))
    return advice
