"""Health score per unit from eight penalties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import fixed_values as fv
from ledgerlens.config import DEFAULT, LedgerConfig
from ledgerlens.functions.calc import clip, lookup, share
from ledgerlens.functions.ranks import percent_ranks
from ledgerlens.operators.changepoint import unit_series
from ledgerlens.schema import AMOUNT, CATEGORY, UNIT, UNIT_KEY
from ledgerlens.scratch import cut, join_measured

PENALTIES = list(fv.HEALTH_WEIGHTS)


def base_stats(cleaned: DataFrame) -> DataFrame:
    """Mean, median, relative spread and trend (second half against first half) per unit."""
    half = F.floor(F.col("n_observations") / 2)
    stats = unit_series(cleaned).groupBy(*UNIT_KEY).agg(
        F.avg(AMOUNT).alias("average_daily_fuel"), F.median(AMOUNT).alias("median_daily_fuel"),
        F.count(AMOUNT).alias("n_observations"), F.stddev_samp(AMOUNT).alias("_std"),
        F.avg(F.when(F.col("position") < half, F.col(AMOUNT))).alias("_early"),
        F.avg(F.when(F.col("position") >= half, F.col(AMOUNT))).alias("_late"))
    trend = F.when(F.col("n_observations") >= 6, share(F.col("_late") - F.col("_early"), "_early"))
    return stats.select(*UNIT_KEY, "average_daily_fuel", "median_daily_fuel", "n_observations",
                        F.try_divide("_std", "average_daily_fuel").alias("fuel_volatility"),
                        trend.alias("trend_percentage"))


def anomaly_component(report: DataFrame, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """Severity-weighted share of anomalies and repeated critical ones."""
    weights = {name: float(rank) for rank, name in enumerate(fv.SEVERITIES)}
    severity, weight = F.col("severity"), lookup(F.col("severity"), weights)
    counts = report.groupBy(*UNIT_KEY).agg(
        F.count_if(weight > 0).alias("anomaly_count"),
        F.count_if(severity == "CRITICAL").alias("critical_anomaly_count"),
        F.avg(weight).alias("_weight")).where("_weight IS NOT NULL")
    repeated = F.least(F.col("critical_anomaly_count") / cfg.repeated_critical, F.lit(1.0)) * 100
    return counts.select(*UNIT_KEY, "anomaly_count", "critical_anomaly_count",
                         clip(F.col("_weight") / max(weights.values()) * 100).alias("anomaly_penalty"),
                         repeated.alias("repeated_critical_penalty"))


def volatility_component(stats: DataFrame) -> DataFrame:
    """Percentile rank of the relative spread among the units of the category."""
    ranks = percent_ranks(stats, [CATEGORY], "fuel_volatility", "_rank")
    return stats.select(*UNIT_KEY, "fuel_volatility").join(ranks, [CATEGORY, "fuel_volatility"], "left").select(
        *UNIT_KEY, F.coalesce(F.col("_rank") * 100, F.lit(0.0)).alias("volatility_penalty"))


def trend_penalty(trend: Column, cfg: LedgerConfig = DEFAULT) -> Column:
    """Only a rising trend counts, up to a cap."""
    return clip(F.coalesce(F.greatest(trend, F.lit(0.0)), F.lit(0.0)) / cfg.trend_cap_pct * 100)


def change_component(changes: DataFrame) -> DataFrame:
    """Sum of direction x confidence weights, at most 100, and the last change."""
    weight = (lookup(F.col("change_direction"), fv.DIRECTION_WEIGHTS, 0.2)
              * lookup(F.col("confidence"), fv.CONFIDENCE_WEIGHTS, 0.3) * 100)
    return changes.groupBy(*UNIT_KEY).agg(
        F.least(F.sum(weight), F.lit(100.0)).alias("change_point_penalty"),
        F.max("change_date").alias("last_change_point"))


def gap_penalty(days: Column, cfg: LedgerConfig = DEFAULT) -> Column:
    return clip(F.coalesce(days, F.lit(0)) / (cfg.gap_days * 3) * 100)


def reconciliation_component(by_category: DataFrame) -> DataFrame:
    """Mean penalty of a category's reconciled months."""
    return by_category.groupBy(CATEGORY).agg(
        F.avg(lookup(F.col("validation_status"), fv.RECONCILIATION_PENALTIES, 0.0))
        .alias("reconciliation_penalty"))


def health_status(score: Column, n: Column, cfg: LedgerConfig = DEFAULT) -> Column:
    """Band of a score; scores between two bands are REVIEW."""
    state = F.when(n < cfg.health_min_observations, "INSUFFICIENT_DATA")
    for name, (low, high) in fv.HEALTH_BANDS.items():
        state = state.when(score.between(low, high), name)
    return state.otherwise("REVIEW")


def recommended_action(cfg: LedgerConfig = DEFAULT) -> Column:
    """Most urgent action that applies."""
    return (F.when(F.col("health_status") == "INSUFFICIENT_DATA", fv.ACTION_COLLECT)
            .when(F.col("reconciliation_penalty") >= 60, fv.ACTION_RECONCILE)
            .when(F.col("critical_anomaly_count") >= cfg.repeated_critical, fv.ACTION_INSPECT)
            .when(F.col("change_point_penalty") >= 50, fv.ACTION_COMPARE)
            .when(F.col("anomaly_count") >= 5, fv.ACTION_LOGS)
            .when(F.col("missing_data_penalty") >= 50, fv.ACTION_GAPS)
            .when(F.col("health_status") == "MONITOR", fv.ACTION_WATCH)
            .otherwise(fv.ACTION_NONE))


def forecast_penalty(wape, cfg: LedgerConfig = DEFAULT) -> Column:
    """Fleet forecast error relative to the retraining limit; `wape` is a number, a column or None."""
    if wape is None:
        return F.lit(0.0)
    value = wape if isinstance(wape, Column) else F.lit(float(wape))
    return F.coalesce(F.least(value / cfg.wape_monitor * 100, F.lit(100.0)), F.lit(0.0))


def weighted_score(cfg: LedgerConfig = DEFAULT) -> Column:
    lost = F.lit(0.0)
    for name, weight in cfg.health_weights.items():
        lost = lost + F.col(name) * weight
    return F.bround(clip(100 - lost), 1)


def health_scores(cleaned: DataFrame, report: DataFrame, changes: DataFrame, gaps: DataFrame,
                  by_category: DataFrame, wape=None, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """Health table: base figures, penalties, score, status and action for every analysed unit."""
    stats = cut(base_stats(cleaned))
    joined = stats
    for part in (anomaly_component(report, cfg), volatility_component(stats), change_component(changes),
                 gaps.select(*UNIT_KEY, "longest_gap_days")):
        joined = joined.join(part, UNIT_KEY, "left")
    joined = join_measured(joined, reconciliation_component(by_category), CATEGORY)
    joined = joined.withColumns({
        "trend_penalty": trend_penalty(F.col("trend_percentage"), cfg),
        "missing_data_penalty": gap_penalty(F.col("longest_gap_days"), cfg),
        "forecast_error_penalty": forecast_penalty(wape, cfg),
        "anomaly_count": F.coalesce("anomaly_count", F.lit(0)),
        "critical_anomaly_count": F.coalesce("critical_anomaly_count", F.lit(0)),
    }).fillna(0.0, PENALTIES)
    joined = joined.withColumn("data_completeness", F.bround(100 - F.col("missing_data_penalty"), 1))
    joined = joined.withColumn("health_score", weighted_score(cfg))
    joined = joined.withColumn("health_status",
                               health_status(F.col("health_score"), F.col("n_observations"), cfg))
    return joined.withColumn("recommended_action", recommended_action(cfg)).select(
        UNIT, CATEGORY, "average_daily_fuel", "median_daily_fuel", "fuel_volatility", "trend_percentage",
        "anomaly_count", "critical_anomaly_count", "last_change_point", "data_completeness",
        "n_observations", *PENALTIES, "health_score", "health_status", "recommended_action")
