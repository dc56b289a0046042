"""Tree ensembles over the feature matrix: one model learned across all series with Spark ML.

`trees` fits each series on its own, as forecasts by name and backtests do; this is for series that are to share a model.
"""

from __future__ import annotations

from datetime import timedelta
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import DEFAULT, LedgerConfig
from ledgerlens.operators.forecast import (CALENDAR, FEATURES, KEY, LAGS, MEANS, SPREADS, _mean_of,
                                           calendar_columns, feature_matrix, tails)
from ledgerlens.schema import DATE
from ledgerlens.scratch import cut, spread

MIN_ROWS = 40
STEPS_PER_CUT = 5
# Fits of a backtest at a time.
FITS = 8


def estimator(model: str, cfg: LedgerConfig = DEFAULT):
    """The regressor of a model name."""
    if model == "random_forest":
        return RandomForestRegressor(labelCol="y", numTrees=300, maxDepth=8, maxBins=cfg.tree_bins, maxMemoryInMB=1024,
                                     seed=cfg.seed, featureSubsetStrategy="all")
    if model == "hist_gradient_boosting":
        return GBTRegressor(labelCol="y", maxDepth=6, maxIter=100, stepSize=0.1, maxBins=cfg.tree_bins,
                            minInstancesPerNode=cfg.boosting_leaf_rows, seed=cfg.seed)
    raise ValueError(f"unknown model: {model}")


def _vectors(rows: DataFrame, invalid: str = "skip") -> DataFrame:
    """Rows with a feature vector; training skips incomplete rows, prediction keeps them."""
    return VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid=invalid).transform(rows)


def train(series: DataFrame, model: str, cfg: LedgerConfig = DEFAULT, learner=None):
    """Model fitted on all complete feature rows of all series."""
    rows = _vectors(feature_matrix(series).where(F.col("y").isNotNull())).select(KEY, DATE, "features", "y")
    rows = cut(spread(rows, KEY, DATE))
    if rows.count() < MIN_ROWS:
        raise ValueError(f"at least {MIN_ROWS} complete days are needed")
    return (learner or estimator(model, cfg)).fit(rows)


def _last(n: int) -> Column:
    return F.slice(F.col("tail"), F.greatest(F.size("tail") - n + 1, F.lit(1)), n)


def _spread_of(values: Column) -> Column:
    present = F.filter(values, lambda v: v.isNotNull())
    mean = _mean_of(values)
    squares = F.aggregate(F.transform(present, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda a, v: a + v)
    return F.sqrt(F.try_divide(squares, F.size(present) - 1))


def state_features(day: Column) -> dict[str, Column]:
    """Features of the day after a series whose recent values are in `tail`; missing values are skipped."""
    columns = calendar_columns(day)
    columns.update({f"lag_{n}": F.try_element_at("tail", F.lit(-n)) for n in LAGS})
    columns.update({f"rolling_mean_{n}": _mean_of(_last(n)) for n in MEANS})
    columns.update({f"rolling_std_{n}": _spread_of(_last(n)) for n in SPREADS})
    return {name: columns[name] for name in FEATURES}


def learned_path(series: DataFrame, horizon: int, model: str, cfg: LedgerConfig = DEFAULT, learner=None) -> DataFrame:
    """Recursive forecasts: predict a day for all series, append it to their tails, go on.

    The state is one short array per series. Lineage is cut every few days.
    """
    series = cut(series)
    fitted = train(series, model, cfg, learner)
    state = tails(series).withColumn("path", F.array().cast("array<double>"))
    for step in range(1, horizon + 1):
        rows = state.withColumns(state_features(F.date_add("last_date", step)))
        guess = fitted.transform(_vectors(rows, "keep")).select(KEY, "last_date", "tail", "path", "prediction")
        grown = F.concat(F.slice("tail", 2, 60), F.array("prediction"))
        state = guess.select(KEY, "last_date", grown.alias("tail"),
                             F.concat("path", F.array("prediction")).alias("path"))
        if step % STEPS_PER_CUT == 0 or step == horizon:
            state = cut(state)
    rows = state.select(KEY, "last_date", F.posexplode("path").alias("at", "forecast"))
    return rows.select(KEY, F.date_add("last_date", F.col("at") + 1).alias(DATE), "forecast",
                       (F.col("at") + 1).alias("step"))


def walk_forward(rows: DataFrame, model: str, cfg: LedgerConfig = DEFAULT, refit_every: int = 1,
                 learner=None) -> DataFrame:
    """One-step forecasts of the evaluated rows.

    Blocks are ranges of `refit_every` calendar days; 1 refits for every day. The model of a block learns from
    the days before its first day, of every series, so no series shows it a later day. Features always come
    from the days before the predicted one. A block with too few earlier rows has missing forecasts.
    """
    rows = cut(rows)
    start = rows.where("evaluated").agg(F.min(DATE)).first()[0]
    known = cut(_vectors(feature_matrix(rows).where(F.col("y").isNotNull())).select(KEY, DATE, "features", "y"))
    block_of = F.floor(F.datediff(DATE, F.lit(start)) / refit_every).cast("int")
    asked = cut(_vectors(feature_matrix(rows, full_windows=False).where("evaluated"), "keep")
                .select(KEY, DATE, "features", "y", block_of.alias("_block")))
    # Both lists are bounded by the calendar.
    blocks = sorted(r[0] for r in asked.select("_block").distinct().collect())
    held = {r[0]: r[1] for r in known.groupBy(DATE).count().collect()}
    def tested(block: int) -> DataFrame:
        first = start + timedelta(days=block * refit_every)
        days = asked.where(F.col("_block") == block)
        if sum(n for day, n in held.items() if day < first) < MIN_ROWS:
            days = days.withColumn("prediction", F.lit(None).cast("double"))
        else:
            earlier = spread(known.where(F.col(DATE) < F.lit(first)), KEY, DATE).select("features", "y")
            days = (learner or estimator(model, cfg)).fit(earlier).transform(days)
        return days.select(KEY, DATE, "y", F.col("prediction").alias("forecast_fuel"))

    none = asked.where("false").select(KEY, DATE, "y", F.lit(None).cast("double").alias("forecast_fuel"))
    # Fits are chains of small jobs that do not depend on each other, so some go on side by side.
    with ThreadPool(FITS) as pool:
        return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(rows.sparkSession)(tested), blocks, 1), none)


__all__ = ["CALENDAR", "estimator", "train", "learned_path", "walk_forward", "state_features"]
