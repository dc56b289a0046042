"""Forecast quality over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens import fixed_values as fv
from ledgerlens.config import DEFAULT, LedgerConfig
from ledgerlens.functions.calc import share
from ledgerlens.operators.forecast import KEY
from ledgerlens.schema import DATE


def placeholder_forecast(series: DataFrame) -> DataFrame:
    """Seasonal-naive stand-in: the value a week before, with the 10-90 % residual band."""
    week_before = F.lag("y", 7).over(Window.partitionBy(KEY).orderBy(DATE))
    rows = series.withColumn("forecast_fuel", week_before)
    residual = F.col("y") - F.col("forecast_fuel")
    band = rows.groupBy(KEY).agg(F.percentile(residual, 0.1).alias("_low"), F.percentile(residual, 0.9).alias("_high"))
    return rows.where(F.col("forecast_fuel").isNotNull()).join(band, KEY).select(
        KEY, DATE, F.col("y").alias("actual_fuel"), "forecast_fuel",
        (F.col("forecast_fuel") + F.col("_low")).alias("lower_interval"),
        (F.col("forecast_fuel") + F.col("_high")).alias("upper_interval"),
        F.lit(fv.PLACEHOLDER_MODEL).alias("model_name"))


def forecast_errors(forecasts: DataFrame) -> DataFrame:
    """Residual, absolute and percent error, and whether the actual value lies in the interval."""
    actual, residual = F.col("actual_fuel"), F.col("actual_fuel") - F.col("forecast_fuel")
    inside = (actual >= F.col("lower_interval")) & (actual <= F.col("upper_interval"))
    return forecasts.withColumns({
        "residual": residual, "abs_error": F.abs(residual), "pct_error": share(residual, actual),
        "within_interval": F.coalesce(inside, F.lit(False))})


def model_health(wape: Column, cfg: LedgerConfig = DEFAULT) -> Column:
    return (F.when(wape.isNull(), "INSUFFICIENT_DATA").when(wape <= cfg.wape_healthy, "HEALTHY")
            .when(wape <= cfg.wape_monitor, "MONITOR").otherwise("RETRAIN"))


def overall_metrics(errors: DataFrame, strict: bool = True, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """MAE, RMSE, WAPE, bias and coverage per series and model.

    With `strict` a missing actual or forecast makes the error figures missing; else it is skipped.
    """
    whole = F.lit(True) if not strict else F.count(F.lit(1)) == F.count("residual")
    sums = errors.groupBy(KEY, "model_name").agg(
        F.count(F.lit(1)).alias("n_days_evaluated"), F.when(whole, F.avg("abs_error")).alias("_mae"),
        F.when(whole, F.sqrt(F.avg(F.col("residual") * F.col("residual")))).alias("_rmse"),
        F.when(whole, F.try_divide(F.sum("abs_error"), F.sum(F.abs("actual_fuel"))) * 100).alias("_wape"),
        F.when(whole, F.avg("residual")).alias("_bias"),
        (F.avg(F.col("within_interval").cast("double")) * 100).alias("_coverage"))
    return sums.select(
        KEY, "model_name", "n_days_evaluated", F.bround("_mae", 1).alias("mae"), F.bround("_rmse", 1).alias("rmse"),
        F.bround("_wape", 2).alias("wape"), F.bround("_bias", 1).alias("bias"),
        F.bround("_coverage", 1).alias("interval_coverage_pct"),
        model_health(F.col("_wape"), cfg).alias("model_health_status"))


def rolling_performance(errors: DataFrame, cfg: LedgerConfig = DEFAULT,
                        windows: Sequence[int] | None = None) -> DataFrame:
    """MAE and WAPE over the last 7, 14 and 30 rows of each series."""
    order = Window.partitionBy(KEY).orderBy(DATE)
    entries = []
    for days in windows or cfg.rolling_windows:
        frame = order.rowsBetween(1 - days, 0)
        least = max(2, days // 2)
        enough = F.count("abs_error").over(frame) >= least
        wape = F.try_divide(F.sum("abs_error").over(frame), F.sum(F.abs("actual_fuel")).over(frame)) * 100
        known = enough & (F.count("actual_fuel").over(frame) >= least)
        entries.append(F.struct(F.lit(days).alias("window_days"),
                                F.when(enough, F.avg("abs_error").over(frame)).alias("rolling_mae"),
                                F.when(known, wape).alias("rolling_wape")))
    rows = errors.select(KEY, DATE, F.array(*entries).alias("_windows"))
    return (rows.select(KEY, DATE, F.inline("_windows")).where(F.col("rolling_mae").isNotNull())
            .withColumn("model_health_status", model_health(F.col("rolling_wape"), cfg)))


def drift_warnings(performance: DataFrame, window_days: int = 30, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """Series whose latest rolling WAPE is above the healthy limit and 20 % above the one before."""
    late = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(DATE)))
    last_two = performance.where(F.col("window_days") == window_days).withColumn("_late", late).where("_late <= 2")
    pair = last_two.groupBy(KEY).agg(F.max(F.when(F.col("_late") == 1, F.col("rolling_wape"))).alias("latest_wape"),
                                     F.max(F.when(F.col("_late") == 2, F.col("rolling_wape"))).alias("previous_wape"))
    worse = ((F.col("latest_wape") > F.col("previous_wape") * 1.2)
             & (F.col("latest_wape") > cfg.wape_healthy))
    return pair.withColumn("drift", F.coalesce(worse, F.lit(False)))


def latest_performance(performance: DataFrame) -> DataFrame:
    """The newest row per series and window."""
    newest = F.max_by(F.struct(DATE, "rolling_mae", "rolling_wape", "model_health_status"), DATE)
    return performance.groupBy(KEY, "window_days").agg(newest.alias("r")).select(
        KEY, "window_days", "r.*")
