"""Tree ensembles of one series at a time: boosting and random forests over binned features.

Features are put into bins once per series, and every split is found from sums per (model, node, feature, bin). Models that learn
from prefixes of the same calendar, as the origins of a backtest, or trees on different draws of the same days, are grown
side by side with the same bins. A series has a row per calendar day, so a group is bounded by the calendar; series and blocks of
origins are groups of their own.

A fitted model is a table of nodes in heap order: node i has the children 2i + 1 and 2i + 2. A row goes right where its feature
is missing or above the cut, and left where a node has no feature; the value of a model is the sum over the nodes reached at the last level.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import DEFAULT, LedgerConfig
from ledgerlens.operators.forecast import FEATURES, KEY, LAGS, MEANS, SPREADS, feature_matrix
from ledgerlens.schema import DATE
from ledgerlens.scratch import spread, stored

MIN_ROWS = 40
DEPTHS = {"hist_gradient_boosting": 6, "random_forest": 8}
# Rounds and their weight; trees of a forest; origins and trees that are grown side by side.
ROUNDS, RATE, TREES, ORIGINS, TREES_AT_ONCE = 100, 0.1, 300, 8, 10
NODES = f"{KEY} string, tree int, node int, feature string, cut double, value double"


def edges_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Rising borders of each feature's bins, at quantiles of its values."""
    return [np.unique(np.quantile(column, np.linspace(0, 1, bins)[1:-1])) for column in x.T]


def binned(x: np.ndarray, edges: list[np.ndarray], bins: int) -> np.ndarray:
    """The number of borders below each value; missing values are in the last bin."""
    out = np.stack([np.searchsorted(e, column) for e, column in zip(edges, x.T)], axis=1)
    return np.where(np.isnan(x), bins - 1, out)


def grow(x: np.ndarray, target: np.ndarray, weight: np.ndarray, depth: int, leaf: float, bins: int):
    """One tree for each row of `target` and `weight` (models, rows): features and bins of its inner nodes, and the node
    of the last level that each row reaches."""
    (models, rows), features = target.shape, x.shape[1]
    cells = features * bins
    place = x + np.arange(features) * bins
    feature, cut = np.full((models, 2 ** depth - 1), -1), np.zeros((models, 2 ** depth - 1), dtype=int)
    node, which = np.zeros((models, rows), dtype=int), np.arange(models)[:, None]
    sums = np.repeat((target * weight).ravel(), features), np.repeat(weight.ravel(), features)
    for level in range(depth):
        nodes = 2 ** level
        spot = (((which * nodes + node) * cells)[:, :, None] + place).ravel()
        s, c = (np.bincount(spot, v, models * nodes * cells).reshape(models, nodes, features, bins) for v in sums)
        whole, held = (v[:, :, :1].sum(axis=3, keepdims=True) for v in (s, c))
        left, below = (np.cumsum(v, axis=3)[..., :-1] for v in (s, c))
        allowed = (below >= leaf) & (held - below >= leaf)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(allowed, left ** 2 / below + (whole - left) ** 2 / (held - below) - whole ** 2 / held, -np.inf)
        gain = gain.reshape(models, nodes, -1)
        best = gain.argmax(axis=2)
        found = np.take_along_axis(gain, best[:, :, None], 2)[:, :, 0] > 1e-9
        here = slice(nodes - 1, 2 * nodes - 1)
        feature[:, here], cut[:, here] = np.where(found, best // (bins - 1), -1), best % (bins - 1)
        asked = feature[which, nodes - 1 + node]
        right = (asked >= 0) & (x[np.arange(rows), asked] > cut[which, nodes - 1 + node])
        node = 2 * node + right
    return feature, cut, node


def leaf_means(target: np.ndarray, weight: np.ndarray, node: np.ndarray, depth: int) -> np.ndarray:
    models = len(target)
    spot = (np.arange(models)[:, None] * 2 ** depth + node).ravel()
    s, c = (np.bincount(spot, v.ravel(), models * 2 ** depth) for v in (target * weight, weight))
    return (s / np.where(c > 0, c, 1)).reshape(models, -1)


class Ensemble:
    """Trees (models, trees, nodes) with a start value for each model."""

    def __init__(self, start: np.ndarray, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.start, self.feature, self.cut, self.value = start, feature, cut, value

    def predict(self, model: int, x: np.ndarray) -> np.ndarray:
        """Values of one model for binned rows."""
        feature, cut = self.feature[model], self.cut[model]
        which, node = np.arange(len(feature))[:, None], np.zeros((len(feature), len(x)), dtype=int)
        for _ in range(int(np.log2(self.value.shape[2]))):
            asked = feature[which, node]
            node = 2 * node + 1 + ((asked >= 0) & (x[np.arange(len(x)), asked] > cut[which, node]))
        return self.start[model] + self.value[model][which, node - feature.shape[1]].sum(axis=0)


def boost(x: np.ndarray, y: np.ndarray, ends: np.ndarray, cfg: LedgerConfig = DEFAULT) -> Ensemble:
    """Gradient boosting with squared error; model i learns from the rows before ends[i]."""
    depth, bins = DEPTHS["hist_gradient_boosting"], cfg.series_bins
    weight = (np.arange(len(y)) < ends[:, None]).astype(float)
    start = (weight * y).sum(axis=1) / ends
    guess, trees = np.repeat(start[:, None], len(y), axis=1), []
    for _ in range(ROUNDS):
        feature, cut, node = grow(x, y - guess, weight, depth, cfg.boosting_leaf_rows, bins)
        value = RATE * leaf_means(y - guess, weight, node, depth)
        guess += np.take_along_axis(value, node, 1)
        trees.append((feature, cut, value))
    return Ensemble(start, *(np.stack(v, axis=1) for v in zip(*trees)))


def plant(x: np.ndarray, y: np.ndarray, end: int, cfg: LedgerConfig = DEFAULT) -> Ensemble:
    """A random forest on the rows before `end`; each tree learns from as many rows, drawn with replacement."""
    depth, bins, draw = DEPTHS["random_forest"], cfg.series_bins, np.random.default_rng(cfg.seed)
    trees = []
    for _ in range(0, TREES, TREES_AT_ONCE):
        weight = np.zeros((TREES_AT_ONCE, len(y)))
        weight[:, :end] = draw.multinomial(end, np.full(end, 1 / end), TREES_AT_ONCE)
        target = np.repeat(y[None], TREES_AT_ONCE, axis=0)
        feature, cut, node = grow(x, target, weight, depth, 1, bins)
        trees.append((feature, cut, leaf_means(target, weight, node, depth) / TREES))
    return Ensemble(np.zeros(1), *(np.concatenate(v)[None] for v in zip(*trees)))


def fitted(x: np.ndarray, y: np.ndarray, end: int, model: str, cfg: LedgerConfig) -> Ensemble:
    return boost(x, y, np.array([end]), cfg) if model == "hist_gradient_boosting" else plant(x, y, end, cfg)


def next_features(day: dt.date, tail: np.ndarray) -> list[float]:
    """Features of a day from the values of the days before it; missing ones are skipped."""
    def over(n, value, least):
        some = tail[-n:][~np.isnan(tail[-n:])]
        return value(some) if len(some) >= least else np.nan

    calendar = [day.weekday(), day.day, day.isocalendar()[1], day.month, float(day.weekday() >= 5)]
    return (calendar + [tail[-n] if len(tail) >= n else np.nan for n in LAGS] + [over(n, np.mean, 1) for n in MEANS]
            + [over(n, lambda v: v.std(ddof=1), 2) for n in SPREADS])


def _complete() -> Column:
    whole = F.col("y").isNotNull()
    for name in FEATURES:
        whole = whole & F.col(name).isNotNull()
    return whole


def _learnt(part: pd.DataFrame, cfg: LedgerConfig):
    """Features, targets and days of the complete rows of a series by date."""
    rows = part[part["complete"]].sort_values(DATE)
    return rows[FEATURES].to_numpy(float), rows["y"].to_numpy(float), rows[DATE].to_numpy()


def path(series: DataFrame, horizon: int, model: str, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """Recursive forecasts, each series by its own model; missing where a series has too few complete days."""
    def one(part: pd.DataFrame) -> pd.DataFrame:
        x, y, _ = _learnt(part, cfg)
        last, tail = part[DATE].max(), part.sort_values(DATE)["y"].to_numpy(float)[-60:]
        out = []
        if len(y) >= MIN_ROWS:
            edges = edges_of(x, cfg.series_bins)
            known = fitted(binned(x, edges, cfg.series_bins), y, len(y), model, cfg)
            for step in range(1, horizon + 1):
                row = np.array([next_features(last + dt.timedelta(days=step), tail)])
                out.append(float(known.predict(0, binned(row, edges, cfg.series_bins))[0]))
                tail = np.append(tail, out[-1])
        out = out or [np.nan] * horizon
        return pd.DataFrame({KEY: part[KEY].iloc[0], DATE: [last + dt.timedelta(days=i + 1) for i in range(horizon)],
                             "forecast": out, "step": np.arange(1, horizon + 1)})

    rows = feature_matrix(series).withColumn("complete", _complete())
    found = spread(rows, KEY).groupBy(KEY).applyInPandas(one, f"{KEY} string, {DATE} date, forecast double, step int")
    return found.withColumn("forecast", F.nanvl("forecast", F.lit(None)))


def node_table(series: DataFrame, model: str, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """The model of each series as nodes; the start value is node 0 of tree -1."""
    def one(part: pd.DataFrame) -> pd.DataFrame:
        x, y, _ = _learnt(part, cfg)
        if len(y) < MIN_ROWS:
            # Objects, as Arrow refuses an empty column of doubles as one of strings.
            return pd.DataFrame({c.split()[0]: [] for c in NODES.split(", ")}, dtype=object)
        edges = edges_of(x, cfg.series_bins)
        known = fitted(binned(x, edges, cfg.series_bins), y, len(y), model, cfg)
        feature, cut, value = known.feature[0], known.cut[0], known.value[0]
        inner, leaves = feature.shape[1], value.shape[1]
        names = np.array([*FEATURES, None], dtype=object)
        places = [edges[f][min(c, len(edges[f]) - 1)] if f >= 0 and len(edges[f]) else np.nan
                  for f, c in zip(feature.ravel(), cut.ravel())]
        nodes = pd.DataFrame({"tree": np.repeat(np.arange(len(feature)), inner), "node": np.tile(np.arange(inner), len(feature)),
                              "feature": names[feature.ravel()], "cut": places, "value": np.nan})
        ends = pd.DataFrame({"tree": np.repeat(np.arange(len(feature)), leaves),
                             "node": np.tile(np.arange(inner, inner + leaves), len(feature)), "feature": None, "cut": np.nan,
                             "value": value.ravel()})
        start = pd.DataFrame({"tree": [-1], "node": [0], "feature": [None], "cut": [np.nan], "value": [known.start[0]]})
        return pd.concat([start, nodes, ends]).assign(**{KEY: part[KEY].iloc[0]})[[c.split()[0] for c in NODES.split(", ")]]

    rows = feature_matrix(series).withColumn("complete", _complete())
    found = spread(rows, KEY).groupBy(KEY).applyInPandas(one, NODES)
    return found.withColumns({c: F.nanvl(c, F.lit(None)) for c in ("cut", "value")})


def walked(series: DataFrame, nodes: DataFrame, model: str) -> DataFrame:
    """(series_key, date, y, forecast_fuel) of all complete days, by joins with a table of nodes alone."""
    nodes = stored(nodes)
    rows = stored(feature_matrix(series).where(_complete()))
    values = F.create_map(*(x for name in FEATURES for x in (F.lit(name), F.col(name).cast("double"))))
    trees = nodes.where("tree >= 0").select(KEY, "tree").distinct()
    state = rows.select(KEY, DATE, "y", values.alias("values")).join(trees, KEY).withColumn("node", F.lit(0))
    inner = nodes.where("value is null").select(KEY, "tree", "node", "feature", "cut")
    for _ in range(DEPTHS[model]):
        asked = F.element_at("values", F.col("feature"))
        right = F.col("feature").isNotNull() & (asked.isNull() | (asked > F.col("cut")))
        state = state.join(inner, [KEY, "tree", "node"]).select(
            KEY, DATE, "y", "values", "tree", (2 * F.col("node") + 1 + right.cast("int")).alias("node"))
    leaves = nodes.where("tree >= 0 and value is not null").select(KEY, "tree", "node", "value")
    start = nodes.where("tree = -1").select(KEY, F.col("value").alias("start"))
    return (state.join(leaves, [KEY, "tree", "node"]).groupBy(KEY, DATE, "y").agg(F.sum("value").alias("sum"))
            .join(start, KEY).select(KEY, DATE, "y", (F.col("start") + F.col("sum")).alias("forecast_fuel")))


def walk_forward(rows: DataFrame, model: str, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """One-step forecasts of the evaluated rows, refitted for every day on the days before it of its series.

    `n_learned` are the days that a model learned from; with too few of them the forecast is missing. Bins come from the days
    before the first origin of a block.
    """
    def one(part: pd.DataFrame) -> pd.DataFrame:
        block = part["block"].iloc[0]
        asked = part[part["evaluated"] & (part["own"] == block)].sort_values(DATE)
        x, y, days = _learnt(part, cfg)
        ends = np.searchsorted(days, asked[DATE].to_numpy())
        out = np.full(len(asked), np.nan)
        ready = np.flatnonzero(ends >= MIN_ROWS)
        if len(ready):
            edges, bins = edges_of(x[:ends[ready[0]]], cfg.series_bins), cfg.series_bins
            known, ask = binned(x, edges, bins), binned(asked[[f"next_{f}" for f in FEATURES]].to_numpy(float), edges, bins)
            if model == "hist_gradient_boosting":
                models = boost(known, y, ends[ready], cfg)
                out[ready] = [models.predict(k, ask[i:i + 1])[0] for k, i in enumerate(ready)]
            else:
                out[ready] = [plant(known, y, ends[i], cfg).predict(0, ask[i:i + 1])[0] for i in ready]
        return asked[[KEY, DATE, "y"]].assign(forecast_fuel=out, n_learned=ends)

    rows = stored(rows)
    complete = feature_matrix(rows).withColumn("complete", _complete())
    asked = feature_matrix(rows, full_windows=False).select(KEY, DATE, *(F.col(f).alias(f"next_{f}") for f in FEATURES))
    whole = complete.join(asked, [KEY, DATE])
    first = rows.where("evaluated").groupBy(KEY).agg(F.min("position").alias("_first"), F.count(F.lit(1)).alias("_asked"))
    whole = whole.join(first, KEY).withColumn("own", F.floor((F.col("position") - F.col("_first")) / ORIGINS).cast("int"))
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.col("_asked") - 1) / ORIGINS).cast("int"))).alias("block")
    groups = spread(whole.select(*whole.columns, blocks), KEY, "block").groupBy(KEY, "block")
    found = groups.applyInPandas(one, f"{KEY} string, {DATE} date, y double, forecast_fuel double, n_learned long")
    return found.withColumns({c: F.nanvl(c, F.lit(None)) for c in ("y", "forecast_fuel")})
