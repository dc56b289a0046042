"""Daily series and their forecasts, for many series at once.

A series is (series_key, date, y) with one row per calendar day and y missing on days without amounts,
so every per-series window or group is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens import fixed_values as fv
from ledgerlens.config import DEFAULT, LedgerConfig
from ledgerlens.functions.calc import share
from ledgerlens.operators.cleaning import dated
from ledgerlens.schema import AMOUNT, DATE

KEY = "series_key"
LAGS = (1, 2, 3, 7, 14, 30)
MEANS = (3, 7, 14, 30)
SPREADS = (7, 30)
CALENDAR = ["day_of_week", "day_of_month", "week_of_year", "month", "is_weekend"]
FEATURES = (CALENDAR + [f"lag_{n}" for n in LAGS] + [f"rolling_mean_{n}" for n in MEANS]
            + [f"rolling_std_{n}" for n in SPREADS])
TAIL = 30
BASELINES = ("naive", "seasonal_naive_7", "moving_average_7", "moving_average_30")


def daily_series(cleaned: DataFrame, key: Column | None = None) -> DataFrame:
    """Daily totals per series, complete from its first to its last day."""
    key = F.lit("ALL") if key is None else key
    totals = dated(cleaned).groupBy(key.cast("string").alias(KEY), DATE).agg(F.sum(AMOUNT).alias("y"))
    spans = totals.groupBy(KEY).agg(F.min(DATE).alias("low"), F.max(DATE).alias("high"))
    days = spans.select(KEY, F.explode(F.sequence("low", "high")).alias(DATE))
    return days.join(totals, [KEY, DATE], "left")


def training_part(series: DataFrame, cutoff: str = DEFAULT.training_cutoff) -> DataFrame:
    return series.where(F.col(DATE) <= F.lit(cutoff).cast("date"))


def available_years(series: DataFrame) -> DataFrame:
    return series.select(F.year(DATE).alias("year")).distinct().orderBy("year")


def _order():
    return Window.partitionBy(KEY).orderBy(DATE)


def calendar_columns(day: Column) -> dict[str, Column]:
    return {
        "day_of_week": F.weekday(day), "day_of_month": F.dayofmonth(day), "week_of_year": F.weekofyear(day),
        "month": F.month(day), "is_weekend": (F.weekday(day) >= 5).cast("int"),
    }


def feature_matrix(series: DataFrame, full_windows: bool = True) -> DataFrame:
    """Calendar, lag and trailing columns from prior days only.

    For training a trailing value needs a full window; for prediction missing days are skipped.
    """
    def trailing(value: Column, n: int) -> Column:
        prior = _order().rowsBetween(-n, -1)
        return F.when(F.count("y").over(prior) == n, value.over(prior)) if full_windows else value.over(prior)

    columns = calendar_columns(F.col(DATE))
    columns.update({f"lag_{n}": F.lag("y", n).over(_order()) for n in LAGS})
    columns.update({f"rolling_mean_{n}": trailing(F.avg("y"), n) for n in MEANS})
    columns.update({f"rolling_std_{n}": trailing(F.stddev_samp("y"), n) for n in SPREADS})
    return series.withColumns(columns)


def tails(series: DataFrame, n: int = TAIL) -> DataFrame:
    """The last n values of each series in time order (missing ones kept), with its last day."""
    recent = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(DATE)))
    last = series.withColumn("_recent", recent).where(F.col("_recent") <= n)
    packed = last.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(DATE, "y"))).alias("_rows"),
                                   F.max(DATE).alias("last_date"))
    return packed.select(KEY, "last_date", F.transform("_rows", lambda r: r["y"]).alias("tail"))


def _mean_of(values: Column) -> Column:
    present = F.filter(values, lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(present, F.lit(0.0), lambda a, v: a + v), F.size(present))


def baseline_path(series: DataFrame, horizon: int, model: str) -> DataFrame:
    """Day-by-day forecasts after the end of each series; later days build on earlier forecasts."""
    ends = tails(series)
    size = F.size("tail")
    steps = F.sequence(F.lit(1), F.lit(horizon))
    if model == "naive":
        path = F.transform(steps, lambda i: F.element_at("tail", -1))
    elif model == "seasonal_naive_7":
        path = F.transform(steps, lambda i: F.get(F.col("tail"), size - 7 + (i - 1) % 7))
    elif model in ("moving_average_7", "moving_average_30"):
        width = int(model.rsplit("_", 1)[1])

        def grow(known: Column, _: Column) -> Column:
            first = F.greatest(F.size(known) - width + 1, F.lit(1))
            return F.concat(known, F.array(_mean_of(F.slice(known, first, width))))

        grown = F.aggregate(steps, F.col("tail"), grow)
        path = F.slice(grown, size + 1, horizon)
    else:
        raise ValueError(f"unknown baseline: {model}")
    rows = ends.select(KEY, "last_date", F.posexplode(path).alias("at", "forecast"))
    return rows.select(KEY, F.date_add("last_date", F.col("at") + 1).alias(DATE), "forecast",
                       (F.col("at") + 1).alias("step"))


def forecast_path(series: DataFrame, horizon: int, model: str, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """Recursive forecast by model name."""
    if model in BASELINES:
        return baseline_path(series, horizon, model)
    from ledgerlens.operators import smoothing, trees

    models: dict[str, Callable] = {
        "holt_winters": smoothing.holt_winters_path,
        "random_forest": trees.path,
        "hist_gradient_boosting": trees.path,
    }
    if model not in models:
        raise ValueError(f"unknown model: {model}; known: {list(fv.FORECAST_MODELS)}")
    return models[model](series, horizon, model, cfg)


def backtest_rows(series: DataFrame, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """Series rows with `evaluated`: the last days that a walk-forward test predicts one by one."""
    n, position = F.count(F.lit(1)).over(Window.partitionBy(KEY)), F.row_number().over(_order())
    days = F.when(n < cfg.backtest_days + 40, F.greatest(F.lit(10), n - 40)).otherwise(cfg.backtest_days)
    return series.withColumn("position", position).withColumn("evaluated", F.col("position") > n - days)


def one_step_forecasts(series: DataFrame, model: str, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """(series_key, date, actual_fuel, forecast_fuel) of the walk-forward test, each day from prior days."""
    rows = backtest_rows(series, cfg)
    if model in BASELINES:
        def mean(n: int) -> Column:
            return F.avg("y").over(_order().rowsBetween(-n, -1))

        step = {"naive": F.lag("y", 1).over(_order()), "seasonal_naive_7": F.lag("y", 7).over(_order()),
                "moving_average_7": mean(7), "moving_average_30": mean(30)}[model]
        tested = rows.withColumn("forecast_fuel", step).where("evaluated")
    else:
        from ledgerlens.operators import smoothing, trees

        walk = smoothing.walk_forward if model == "holt_winters" else trees.walk_forward
        tested = walk(rows, model, cfg)
    return tested.select(KEY, DATE, F.col("y").alias("actual_fuel"), "forecast_fuel")


def residual_quantiles(tested: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Quantiles of actual - forecast per series; one missing residual makes both missing."""
    residual = F.col("actual_fuel") - F.col("forecast_fuel")
    whole = F.count(F.lit(1)) == F.count(residual)
    return tested.groupBy(KEY).agg(F.when(whole, F.percentile(residual, low)).alias("low_residual"),
                                   F.when(whole, F.percentile(residual, high)).alias("high_residual"))


def backtest(series: DataFrame, model: str, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """Walk-forward test in the forecast contract, with an interval from the residuals."""
    tested = one_step_forecasts(series, model, cfg)
    return tested.join(residual_quantiles(tested), KEY).select(
        KEY, DATE, "actual_fuel", "forecast_fuel",
        (F.col("forecast_fuel") + F.col("low_residual")).alias("lower_interval"),
        (F.col("forecast_fuel") + F.col("high_residual")).alias("upper_interval"),
        F.lit(fv.FORECAST_MODELS.get(model, model)).alias("model_name"))


def climatology(series: DataFrame, targets: DataFrame, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """Mean and spread of past values around the same day of the year, for (series_key, target_date).

    The near days of the year of each target are listed, which turns the circular range condition into
    an equi-join; with fewer than three values the whole history serves.
    """
    past = series.where(F.col("y").isNotNull()).select(KEY, F.dayofyear(DATE).alias("doy"), "y")
    def is_near(day: Column) -> Column:
        away = F.abs(day - F.dayofyear("target_date"))
        return F.least(away, 365 - away) <= cfg.climatology_days

    year = F.sequence(F.lit(1), F.lit(366))
    near = (targets.select(KEY, "target_date").distinct()
            .withColumn("day", F.explode(F.filter(year, is_near))))

    def figures(prefix: str) -> list[Column]:
        return [F.avg("y").alias(f"{prefix}point"), F.percentile("y", 0.1).alias(f"{prefix}lower"),
                F.percentile("y", 0.9).alias(f"{prefix}upper"), F.count("y").alias(f"{prefix}n")]

    around = (near.join(past.withColumnRenamed("doy", "day"), [KEY, "day"]).groupBy(KEY, "target_date")
              .agg(*figures("near_")))
    whole = past.groupBy(KEY).agg(*figures("all_"))
    joined = targets.join(around, [KEY, "target_date"], "left").join(whole, KEY, "left")
    use_near = F.coalesce(F.col("near_n"), F.lit(0)) >= 3

    def pick(name: str) -> Column:
        return F.when(use_near, F.col(f"near_{name}")).otherwise(F.col(f"all_{name}"))

    return joined.select(*targets.columns, pick("point").alias("point"), pick("lower").alias("lower"),
                         pick("upper").alias("upper"), pick("n").alias("n_reference_points"))


def forecast_for_dates(series: DataFrame, targets: DataFrame, model: str, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """Forecast of (series_key, target_date): the actual value, a recursive forecast or climatology.

    `n_reference_points` counts the past days that climatology draws on.

    warning: "in_history", "no_value", "long_horizon" or "beyond_reliable_horizon", else missing.
    """
    ends = series.groupBy(KEY).agg(F.max(DATE).alias("last_date"))
    placed = targets.join(ends, KEY).withColumn("horizon_days", F.datediff("target_date", "last_date"))
    ahead = F.col("horizon_days")
    nothing, unused = F.lit(None).cast("double"), F.lit(None).cast("long")
    past = (placed.where(ahead <= 0)
            .join(series.withColumnRenamed(DATE, "target_date"), [KEY, "target_date"], "left")
            .select(KEY, "target_date", F.lit("historical_actual").alias("method"), F.col("y").alias("point"),
                    nothing.alias("lower"), nothing.alias("upper"), "horizon_days", unused.alias("n_reference_points"),
                    F.when(F.col("y").isNull(), "no_value").otherwise("in_history").alias("warning")))
    path = forecast_path(series, cfg.reliable_horizon, model, cfg).withColumnRenamed(DATE, "target_date")
    spread = residual_quantiles(one_step_forecasts(series, model, cfg))
    near = (placed.where((ahead > 0) & (ahead <= cfg.reliable_horizon))
            .join(path, [KEY, "target_date"]).join(spread, KEY)
            .select(KEY, "target_date", F.lit("recursive_forecast").alias("method"),
                    F.col("forecast").alias("point"), (F.col("forecast") + F.col("low_residual")).alias("lower"),
                    (F.col("forecast") + F.col("high_residual")).alias("upper"), "horizon_days",
                    unused.alias("n_reference_points"),
                    F.when(ahead > cfg.warn_horizon, "long_horizon").alias("warning")))
    far = climatology(series, placed.where(ahead > cfg.reliable_horizon), cfg).select(
        KEY, "target_date", F.lit("climatology_fallback").alias("method"), "point", "lower", "upper",
        "horizon_days", F.col("n_reference_points").cast("long").alias("n_reference_points"),
        F.lit("beyond_reliable_horizon").alias("warning"))
    return reduce(DataFrame.unionByName, [past, near, far]).withColumn("model_name", F.lit(model))


def cross_year_validation(series: DataFrame, cutoff: str, model: str, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """Forecasts from the days up to the cutoff against the actual values after it."""
    known = series.where(F.col("y").isNotNull())
    history = training_part(known, cutoff)
    future = known.where(F.col(DATE) > F.lit(cutoff).cast("date"))
    ends = history.groupBy(KEY).agg(F.max(DATE).alias("last_date"))
    placed = future.join(ends, KEY).withColumn("ahead", F.datediff(DATE, "last_date"))
    near = placed.where(F.col("ahead") <= cfg.reliable_horizon).join(
        forecast_path(history, cfg.reliable_horizon, model, cfg).select(KEY, DATE, "forecast"), [KEY, DATE])
    far = climatology(history, placed.where(F.col("ahead") > cfg.reliable_horizon)
                      .withColumnRenamed(DATE, "target_date"), cfg)
    both = near.select(KEY, DATE, F.col("y").alias("actual"), "forecast",
                       F.lit("recursive_forecast").alias("method")).unionByName(
        far.select(KEY, F.col("target_date").alias(DATE), F.col("y").alias("actual"),
                   F.col("point").alias("forecast"), F.lit("climatology_fallback").alias("method")))
    residual = F.col("actual") - F.col("forecast")
    return both.withColumn("residual", residual).withColumn(
        "abs_pct_error", share(F.abs(residual), F.col("actual")))


def validation_summary(validation: DataFrame) -> DataFrame:
    """Days per method, MAE and WAPE of an out-of-sample validation."""
    size = F.abs("residual")
    return validation.groupBy(KEY).agg(
        F.count_if(F.col("method") == "recursive_forecast").alias("n_recursive"),
        F.count_if(F.col("method") == "climatology_fallback").alias("n_climatology"),
        F.avg(size).alias("mae"), (F.try_divide(F.sum(size), F.sum(F.abs("actual"))) * 100).alias("wape"))
