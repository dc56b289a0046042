"""Anomaly severity, type and reason per transaction; peers; summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import fixed_values as fv
from ledgerlens.config import DEFAULT, LedgerConfig
from ledgerlens.functions.calc import share, total
from ledgerlens.operators.cleaning import dated
from ledgerlens.operators.features import unit_features
from ledgerlens.operators.isolation import isolation_scores
from ledgerlens.schema import AMOUNT, CATEGORY, DATE, UNIT, UNIT_KEY
from ledgerlens.scratch import join_measured


def robust_z(cfg: LedgerConfig = DEFAULT) -> Column:
    """Distance from the trailing median in MADs; the MAD is at least a share of the trailing mean."""
    floor = F.abs(F.col("rolling_mean_7") * cfg.mad_floor)
    spread = F.when(F.col("rolling_mad_7") > floor, F.col("rolling_mad_7")).otherwise(floor)
    return fv.MAD_SCALE * F.try_divide(F.col(AMOUNT) - F.col("rolling_median_7"), spread)


def severity(z: Column, isolation: Column, cfg: LedgerConfig = DEFAULT) -> Column:
    """Severity of a robust z, one step higher when the forest agrees."""
    size = F.abs(z)
    level = (F.when(size >= cfg.z_critical, 4).when(size >= cfg.z_high, 3)
             .when(size >= cfg.z_medium, 2).when(size >= cfg.z_low, 1).otherwise(0))
    raised = F.when((level > 0) & (isolation < 0), F.least(level + 1, F.lit(4))).otherwise(level)
    return F.get(F.array(*map(F.lit, fv.SEVERITIES)), raised)


def _signs() -> list[tuple[Column, str]]:
    z, median = F.col("robust_z_score"), F.col("category_median")
    return [
        (F.col(AMOUNT) == 0, "UNUSUAL_ZERO_FILL"),
        (z > 0, "HIGH_VS_OWN_PATTERN"),
        (z < 0, "LOW_VS_OWN_PATTERN"),
        (F.abs("percentage_change") >= 100, "SPIKE_VS_PREVIOUS"),
        ((median > 0) & (F.abs("deviation_from_category_median") >= median), "EXTREME_VS_CATEGORY_PEERS"),
        (F.col("isolation_score") < -0.05, "MULTIVARIATE_OUTLIER"),
    ]


def _joined(separator: str, text, cfg: LedgerConfig) -> Column:
    found = F.concat_ws(separator, *[F.when(sign, F.lit(text(name))) for sign, name in _signs()])
    return (F.when(F.col("severity") == "NORMAL", text("NORMAL"))
            .when(found == "", text("STATISTICAL_DEVIATION")).otherwise(found))


def anomaly_report(cleaned: DataFrame, cfg: LedgerConfig = DEFAULT, use_forest: bool = True,
                   medians: DataFrame | None = None) -> DataFrame:
    """Every analysed row with its expected value, deviation, scores, severity, type and reason."""
    rows = unit_features(cleaned, cfg, medians)
    if use_forest:
        rows = isolation_scores(rows, cfg)
    else:
        rows = rows.withColumn("isolation_score", F.lit(None).cast("double"))
    enough = F.col("sufficient")
    rows = rows.withColumns({
        "robust_z_score": F.when(enough, robust_z(cfg)),
        "expected_fuel": F.coalesce("rolling_median_7", "equipment_mean"),
    })
    rows = rows.withColumns({
        "deviation_liter": F.col(AMOUNT) - F.col("expected_fuel"),
        "deviation_percentage": share(F.col(AMOUNT) - F.col("expected_fuel"), "expected_fuel"),
        "severity": F.when(enough, severity(F.col("robust_z_score"), F.col("isolation_score"), cfg))
        .otherwise("INSUFFICIENT_DATA"),
    })
    few = F.format_string(fv.TOO_FEW_TEXT, F.col("n_observations"), F.lit(cfg.min_observations))
    return rows.select(
        DATE, UNIT, CATEGORY, AMOUNT, "expected_fuel", "deviation_liter", "deviation_percentage",
        "robust_z_score", "isolation_score",
        F.when(enough, _joined("|", lambda name: name, cfg)).otherwise("INSUFFICIENT_DATA").alias("anomaly_type"),
        "severity",
        F.when(enough, _joined(" ", fv.ANOMALY_TEXTS.get, cfg)).otherwise(few).alias("anomaly_reason"))


def anomaly_summary(report: DataFrame) -> DataFrame:
    return report.groupBy(CATEGORY, "severity").agg(F.count(F.lit(1)).alias("n_records"))


def peer_comparison(cleaned: DataFrame, start=None, end=None) -> DataFrame:
    """Unit totals of a period against mean and spread of all units of the category.

    Units without a row in the period count with 0; a category whose period total is 0 is left out.
    """
    rows = dated(cleaned)
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col(DATE) >= F.lit(start).cast("date"))
    if end is not None:
        inside = inside & (F.col(DATE) <= F.lit(end).cast("date"))
    units = rows.groupBy(*UNIT_KEY).agg(total(F.when(inside, F.col(AMOUNT))).alias(AMOUNT))
    peers = units.groupBy(CATEGORY).agg(
        F.avg(AMOUNT).alias("peer_mean"), F.coalesce(F.stddev_samp(AMOUNT), F.lit(0.0)).alias("peer_std"),
        F.sum(AMOUNT).alias("_total"))
    value = F.col(AMOUNT)
    out = join_measured(units, peers.where("_total <> 0"), CATEGORY, "inner").withColumns({
        "upper_flag": F.col("peer_mean") + 2 * F.col("peer_std"),
        "lower_flag": F.greatest(F.lit(0.0), F.col("peer_mean") - 2 * F.col("peer_std")),
    })
    status = (F.when(value > F.col("upper_flag"), fv.PEER_HIGH)
              .when((value < F.col("lower_flag")) & (value > 0), fv.PEER_LOW)
              .when(value == 0, fv.PEER_NONE).otherwise(fv.PEER_NORMAL))
    return out.select(*UNIT_KEY, AMOUNT, "peer_mean", "peer_std", "upper_flag", "lower_flag",
                      status.alias("status"))
