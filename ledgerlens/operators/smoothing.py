"""Holt-Winters: additive trend and weekly season (Holt 1957; Winters 1960).

Each series is fitted on its own, one group per series; a series has one value per calendar day.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import DEFAULT, LedgerConfig
from ledgerlens.operators.forecast import KEY
from ledgerlens.schema import DATE
from ledgerlens.scratch import spread

SEASON = 7


def _start(y: np.ndarray):
    """Level, trend and season from the first weeks."""
    weeks = min(max(len(y) // SEASON, 1), 5)
    block = y[:weeks * SEASON].reshape(weeks, SEASON) if len(y) >= SEASON else None
    if block is None:
        return float(y[0]), 0.0, np.zeros(SEASON)
    means = block.mean(axis=1)
    trend = (means[-1] - means[0]) / ((weeks - 1) * SEASON) if weeks > 1 else 0.0
    season = (block - means[:, None]).mean(axis=0)
    return float(means[0] - trend * (SEASON + 1) / 2), float(trend), season


def _run(y: np.ndarray, ends: np.ndarray, weights: np.ndarray, starts):
    """Squared one-step error and last states of many fits at once; fit i has its weight triples, begins with starts[i] and
    ends before ends[i]."""
    a, b, g = np.moveaxis(weights, -1, 0)
    level = np.repeat([[s[0]] for s in starts], a.shape[1], axis=1)
    trend = np.repeat([[s[1]] for s in starts], a.shape[1], axis=1)
    season = np.repeat([[s[2]] for s in starts], a.shape[1], axis=1)
    loss = np.zeros(a.shape)
    for t in range(int(ends.max())):
        go = int(np.searchsorted(ends, t, side="right"))
        at, run = t % SEASON, slice(go, None)
        error = y[t] - (level[run] + trend[run] + season[run, :, at])
        loss[run] += error ** 2
        before = level[run].copy()
        level[run] = a[run] * (y[t] - season[run, :, at]) + (1 - a[run]) * (before + trend[run])
        trend[run] = b[run] * (level[run] - before) + (1 - b[run]) * trend[run]
        season[run, :, at] += g[run] * (1 - a[run]) * error
    return loss, level, trend, season


def _estimated(y: np.ndarray, ends: np.ndarray, weights: np.ndarray):
    """The starting states with the least squared one-step error for one weight triple per fit.

    For given weights every error is linear in the starting level, trend and season. Their responses go through the recursion beside
    the errors of a start from zero, and the state solves the normal equations of their sums; of equal solutions, as level
    and season can make up for each other, it is the shortest.
    """
    fits, size = len(ends), SEASON + 2
    a, b, g = weights.T[:, :, None]
    # Column 0 is the series from a state of zeros; the others are unit states without a series.
    level, trend, season = (np.zeros(shape) for shape in ((fits, 1 + size), (fits, 1 + size), (fits, 1 + size, SEASON)))
    level[:, 1], trend[:, 2] = 1, 1
    season[:, np.arange(3, 3 + SEASON), np.arange(SEASON)] = 1
    seen = np.zeros(1 + size)
    seen[0] = 1
    squares, products = np.zeros((fits, size, size)), np.zeros((fits, size))
    for t in range(int(ends.max())):
        run, at = slice(int(np.searchsorted(ends, t, side="right")), None), t % SEASON
        error = y[t] * seen - (level[run] + trend[run] + season[run, :, at])
        squares[run] += error[:, 1:, None] * error[:, None, 1:]
        products[run] -= error[:, 1:] * error[:, :1]
        before = level[run].copy()
        level[run] = a[run] * (y[t] * seen - season[run, :, at]) + (1 - a[run]) * (before + trend[run])
        trend[run] = b[run] * (level[run] - before) + (1 - b[run]) * trend[run]
        season[run, :, at] += g[run] * (1 - a[run]) * error
    return [(s[0], s[1], s[2:]) for s in (np.linalg.pinv(q, hermitian=True) @ p for q, p in zip(squares, products))]


def fit_states(y: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Weights, starting state and last state of a fit on y[:end] for each of the rising ends, of least squared one-step error.

    A coarse grid of the three weights is searched from the first weeks' means, then refined around the best; from there on
    starting states are estimated and the grid goes on around the best weights with them, in turn.
    """
    rows, starts = np.arange(len(ends)), [_start(y[:end]) for end in ends]
    centre, width = np.tile([0.5, 0.25, 0.25], (len(ends), 1)), 0.5
    least, kept = np.full(len(ends), np.inf), None
    for step in range(6):
        steps = np.array(np.meshgrid(*[np.linspace(-1, 1, 5)] * 3, indexing="ij")).reshape(3, -1).T
        grid = np.clip(centre[:, None, :] + width * steps, 1e-4, 0.9999)
        loss, level, trend, season = _run(y, ends, grid, starts)
        at = loss.argmin(axis=1)
        better = loss[rows, at] <= least
        now = {"weights": grid[rows, at], "level": level[rows, at], "trend": trend[rows, at], "season": season[rows, at],
               "first_level": np.array([s[0] for s in starts]), "first_trend": np.array([s[1] for s in starts]),
               "first_season": np.array([s[2] for s in starts])}
        least = np.where(better, loss[rows, at], least)
        kept = now if kept is None else {k: np.where(better.reshape(-1, *[1] * (v.ndim - 1)), v, kept[k]) for k, v in now.items()}
        centre = kept["weights"]
        width /= 2
        if step >= 3:
            starts = _estimated(y, ends, centre)
            # The estimated start with the same weights is never worse than the start that it replaces.
            width = max(width, 0.0625)
    return kept


def fit_forecasts(y: np.ndarray, ends: np.ndarray, horizon: int) -> np.ndarray:
    """Forecasts after y[:end] for each of the rising ends."""
    out = np.full((len(ends), horizon), np.nan)
    gaps = np.flatnonzero(np.isnan(y))
    fit = (ends > 0) & (ends <= (gaps[0] if len(gaps) else len(y)))
    if not fit.any():
        return out
    ends = ends[fit]
    found, ahead = fit_states(y, ends), np.arange(1, horizon + 1)
    out[fit] = (found["level"][:, None] + found["trend"][:, None] * ahead
                + np.take_along_axis(found["season"], (ends[:, None] + ahead - 1) % SEASON, 1))
    return out


def fit_forecast(y: np.ndarray, horizon: int) -> np.ndarray:
    """Forecasts after the end of y."""
    return fit_forecasts(y, np.array([len(y)]), horizon)[0]


def holt_winters_path(series: DataFrame, horizon: int, model: str = "holt_winters",
                      cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """(series_key, date, forecast, step) after the end of each series."""
    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(DATE)
        ahead = fit_forecast(part["y"].to_numpy(float), horizon)
        last = pd.Timestamp(part[DATE].iloc[-1])
        return pd.DataFrame({KEY: part[KEY].iloc[0], DATE: [(last + pd.Timedelta(days=i + 1)).date()
                                                           for i in range(horizon)],
                             "forecast": ahead, "step": np.arange(1, horizon + 1)})

    found = spread(series.select(KEY, DATE, "y"), KEY).groupBy(KEY).applyInPandas(
        one, f"{KEY} string, {DATE} date, forecast double, step int")
    return found.withColumn("forecast", F.nanvl("forecast", F.lit(None)))


STATES = f"{KEY} string, last_date date, weights array<double>, level double, trend double, season array<double>"


def fitted_states(series: DataFrame) -> DataFrame:
    """Weights and starting state of each series without missing days."""
    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(DATE)
        y = part["y"].to_numpy(float)
        if np.isnan(y).any():
            return pd.DataFrame({name.split()[0]: [] for name in STATES.split(", ")})
        found = fit_states(y, np.array([len(y)]))
        return pd.DataFrame({KEY: [part[KEY].iloc[0]], "last_date": [part[DATE].iloc[-1]], "weights": [found["weights"][0]],
                             "level": found["first_level"], "trend": found["first_trend"], "season": [found["first_season"][0]]})

    return spread(series.select(KEY, DATE, "y"), KEY).groupBy(KEY).applyInPandas(one, STATES)


def rerun(series: DataFrame, states: DataFrame, horizon: int) -> DataFrame:
    """(series_key, date, forecast, step) by the recursion alone, from weights and starting states, in column expressions."""
    values = series.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct(DATE, "y"))), lambda r: r["y"]).alias("values"))
    rows = values.join(states, KEY)
    a, b, g = (F.get("weights", F.lit(i)) for i in range(3))
    zero = F.struct(F.col("level").alias("level"), F.col("trend").alias("trend"), F.col("season").alias("season"), F.lit(0).alias("at"))

    def step(acc, y):
        here = F.get(acc["season"], acc["at"])
        level = a * (y - here) + (1 - a) * (acc["level"] + acc["trend"])
        trend = b * (level - acc["level"]) + (1 - b) * acc["trend"]
        error = y - acc["level"] - acc["trend"] - here
        season = F.transform(acc["season"], lambda s, i: F.when(i == acc["at"], s + g * (1 - a) * error).otherwise(s))
        return F.struct(level.alias("level"), trend.alias("trend"), season.alias("season"),
                        ((acc["at"] + 1) % SEASON).cast("int").alias("at"))

    ends = rows.select(KEY, "last_date", F.aggregate("values", zero, step).alias("s"),
                       F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    season = F.get("s.season", (F.col("s.at") + F.col("step") - 1) % SEASON)
    return ends.select(KEY, F.date_add("last_date", F.col("step")).alias(DATE),
                       (F.col("s.level") + F.col("s.trend") * F.col("step") + season).alias("forecast"), "step")


def walk_forward(rows: DataFrame, model: str = "holt_winters", cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """One-step forecasts of the evaluated rows, refitted for every day; a series is one group and moves once."""
    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("position")
        at = np.flatnonzero(part["evaluated"].to_numpy(bool))
        tested = part.iloc[at][[KEY, DATE, "y"]]
        return tested.assign(forecast_fuel=fit_forecasts(part["y"].to_numpy(float), at, 1)[:, 0])

    steps = spread(rows.select(KEY, DATE, "y", "position", "evaluated"), KEY).groupBy(KEY).applyInPandas(
        one, f"{KEY} string, {DATE} date, y double, forecast_fuel double")
    return steps.select(KEY, DATE, F.nanvl("y", F.lit(None)).alias("y"),
                        F.nanvl("forecast_fuel", F.lit(None)).alias("forecast_fuel"))
