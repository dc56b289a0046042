"""Isolation forest per category (Liu, Ting & Zhou 2008): every tree draws its own points and is grown in a task of its own.

A row has a place in the order of each tree, a fixed function of its key and the tree. A tree takes the rows that come first in its
order, `forest_sample` of them, or all of a smaller category; so the draw is the same rule at every size, and what moves are
little more than the points of the trees. Every row is then scored where it lies, with the forests broadcast,
as long as their measured bytes allow it. Beyond that the rows of a category are split over as many tasks
as its size asks for, and each task meets the category's trees by cogrouping; the scores are the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import DEFAULT, LedgerConfig
from ledgerlens.functions.ranks import group_quantiles
from ledgerlens.schema import AMOUNT, CATEGORY, DATE, UNIT
from ledgerlens.scratch import join_measured, spread, stored

FEATURES = [AMOUNT, "deviation_from_category_median", "day_of_week", "month_num"]
# Rows scored beside one copy of a category's trees (1.6 MB). Small categories are split further, for
# parallelism, down to the second figure.
ROWS_PER_TASK = 200_000
LEAST_ROWS_PER_TASK = 10_000
# Forests of all categories together are broadcast up to this size, about 40 categories of 200 trees.
BROADCAST_BYTES = 64 << 20

# Places in a tree's order, a prime below 2^31, so that products stay within 64 bits.
PLACES = (1 << 31) - 1
# One tree as arrays in heap order: node i has the children 2i + 1 and 2i + 2; a leaf has feature -1.
FOREST = f"{CATEGORY} string, tree int, sample int, feature array<int>, cut array<double>, size array<int>"


def _path_left(n) -> np.ndarray:
    """Average path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator) -> dict:
    """A tree over all points given, level by level.

    A node splits a random feature that varies in it at a random place, until points are alone or alike or the
    depth log2(points) is reached.
    """
    depth = int(np.ceil(np.log2(max(len(x), 2))))
    n_nodes, n_features = 2 ** (depth + 1) - 1, x.shape[1]
    feature, place, held = np.full(n_nodes, -1), np.zeros(n_nodes), np.zeros(n_nodes, dtype=int)
    point, node = np.arange(len(x)), np.zeros(len(x), dtype=int)
    for level in range(depth + 1):
        held += np.bincount(node, minlength=n_nodes)
        if level == depth or len(point) == 0:
            break
        here, index = np.unique(node, return_inverse=True)
        low, high = np.full((n_features, len(here)), np.inf), np.full((n_features, len(here)), -np.inf)
        for f in range(n_features):
            np.minimum.at(low[f], index, x[point, f])
            np.maximum.at(high[f], index, x[point, f])
        draw = np.where(high > low, rng.random(low.shape), -1.0)
        chosen, at = draw.argmax(axis=0), np.arange(len(here))
        split = draw.max(axis=0) >= 0
        feature[here] = np.where(split, chosen, -1)
        place[here] = low[chosen, at] + rng.random(len(here)) * (high - low)[chosen, at]
        go = split[index]
        point, node = point[go], node[go]
        node = 2 * node + 1 + (x[point, feature[node]] > place[node])
    return {"sample": len(x), "feature": feature, "cut": place, "size": held}


def _leveled(feature: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree whose rows all go down to the last level: features, cuts, and the path length of each node there.

    Below a leaf a row goes left, and the leaf's path length with it.
    """
    levels = int(np.log2(len(feature) + 1)) - 1
    length, inner = np.repeat(np.arange(levels + 1.0), 2 ** np.arange(levels + 1)) + _path_left(size), feature >= 0
    for level in range(levels):
        ends = np.flatnonzero(~inner[2 ** level - 1:2 ** (level + 1) - 1]) + 2 ** level - 1
        length[2 * ends + 1] = length[ends]
    return np.where(inner, feature, 0), np.where(inner, place, np.inf), length[2 ** levels - 1:]


def _depths(x: np.ndarray, feature: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Path length of every row in one tree of `_leveled`, level by level for all rows at once."""
    node, flat, row = np.zeros(len(x), dtype=int), x.ravel(), np.arange(len(x)) * x.shape[1]
    for _ in range(int(np.log2(len(length)))):
        node = 2 * node + 1 + (flat.take(row + feature.take(node)) > place.take(node))
    return length.take(node - (len(length) - 1))


def drawn_points(rows: DataFrame, sizes: DataFrame, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """(category, tree, place, key, features): rows that may be among the first of a tree's order, so many that
    too few come along for about one tree in 10^14."""
    factors = np.random.default_rng(cfg.seed).integers(1, PLACES, size=(cfg.forest_trees, 2)).tolist()
    share = (cfg.forest_sample + 10 * cfg.forest_sample ** 0.5) / F.col("n_rows")
    last = F.ceil(F.least(share, F.lit(1.0)) * PLACES)
    base = F.pmod(F.xxhash64(CATEGORY, UNIT, DATE), F.lit(PLACES))
    asked = join_measured(rows, sizes, CATEGORY, "inner").select(
        CATEGORY, UNIT, DATE, *FEATURES, base.alias("_base"), last.alias("_last"))

    def draw(batches):
        for b in batches:
            base, last = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_base", "_last"))
            points = b.select([CATEGORY, UNIT, DATE, *FEATURES])
            for tree, (factor, shift) in enumerate(factors):
                place = (base * factor + shift) % PLACES
                some = np.flatnonzero(place < last)
                if len(some):
                    found = points.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays(
                        [*found.columns, pa.array(np.full(len(some), tree), pa.int32()), pa.array(place[some])],
                        names=[*found.schema.names, "tree", "place"])

    kinds = ", ".join(f"{c} {t}" for c, t in asked.dtypes[:-2])
    return asked.mapInArrow(draw, f"{kinds}, tree int, place long")


def fit_forest(rows: DataFrame, sizes: DataFrame, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """The trees of each category, one group per tree."""
    size, seed = cfg.forest_sample, cfg.seed

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["place", UNIT, DATE]).head(size)
        tree = _grow(part[FEATURES].to_numpy(float), np.random.default_rng([seed, part["tree"].iloc[0]]))
        return pd.DataFrame([{CATEGORY: part[CATEGORY].iloc[0], "tree": part["tree"].iloc[0], **tree}])

    points = spread(drawn_points(rows, sizes, cfg), CATEGORY, "tree")
    return points.groupBy(CATEGORY, "tree").applyInPandas(fit, FOREST)


def _score(x: np.ndarray, trees: list) -> np.ndarray:
    """Minus the anomaly score of every row: nearer to -1 the fewer splits part it from the others."""
    depth = np.zeros(len(x))
    for tree, _ in trees:
        depth += _depths(x, *tree)
    return -np.power(2.0, -depth / (len(trees) * float(_path_left([trees[0][1]])[0])))


def _arrays(trees: pd.DataFrame) -> list:
    return [(_leveled(np.asarray(t.feature), np.asarray(t.cut), np.asarray(t.size)), t.sample)
            for t in trees.sort_values("tree")[["feature", "cut", "size", "sample"]].itertuples(index=False)]


def _scored_in_place(features: DataFrame, complete: Column, forest: DataFrame) -> DataFrame:
    """Rows with `_raw`, no shuffle; the forests are of checked size."""
    trees = forest.toPandas()
    shared = features.sparkSession.sparkContext.broadcast({name: _arrays(part) for name, part in trees.groupby(CATEGORY)})

    @F.pandas_udf("double")
    def score(category: pd.Series, ready: pd.Series, values: pd.DataFrame) -> pd.Series:
        out, x = np.full(len(category), np.nan), values.to_numpy(float)
        asked = category.where(ready)
        for name, at in asked.groupby(asked).indices.items():
            if name in shared.value:
                out[at] = _score(x[at], shared.value[name])
        return pd.Series(out)

    raw = score(CATEGORY, F.coalesce(complete, F.lit(False)), F.struct(*FEATURES))
    return features.withColumn("_raw", F.nanvl(raw, F.lit(None)))


def _scored_by_category(features: DataFrame, complete: Column, forest: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows with `_raw`, each category's rows split over tasks that get a copy of its trees."""
    tasks = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = F.greatest(F.ceil(F.col("n_rows") / ROWS_PER_TASK),
                       F.least(F.ceil(F.col("n_rows") / LEAST_ROWS_PER_TASK), F.lit(tasks))).cast("int")
    salted = (join_measured(features.where(complete), sizes, CATEGORY, "inner")
              .withColumn("salt", F.pmod(F.xxhash64(UNIT, DATE), salts).cast("int"))
              .select(CATEGORY, UNIT, DATE, "salt", *FEATURES))
    copies = forest.join(sizes, CATEGORY).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))

    def score(part: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        out = part[[CATEGORY, UNIT, DATE]].copy()
        if len(part) == 0 or len(trees) == 0:
            return out.assign(_raw=np.nan).iloc[:0]
        return out.assign(_raw=_score(part[FEATURES].to_numpy(float), _arrays(trees)))

    groups = [spread(rows, CATEGORY, "salt").groupBy(CATEGORY, "salt") for rows in (salted, copies)]
    raw = groups[0].cogroup(groups[1]).applyInPandas(
        score, f"{CATEGORY} string, {UNIT} string, {DATE} date, _raw double")
    return features.join(raw, [CATEGORY, UNIT, DATE], "left")


def isolation_scores(features: DataFrame, cfg: LedgerConfig = DEFAULT, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows with isolation_score (below 0: anomalous), missing where a category is too small.

    Only rows of units with enough observations take part. The zero point is set per category so that
    the share `contamination` of its rows lies below it.
    """
    complete = F.col("sufficient")
    for name in FEATURES:
        complete = complete & F.col(name).isNotNull()
    features = stored(features)
    rows = features.where(complete)
    sizes = (rows.groupBy(CATEGORY).agg(F.count(F.lit(1)).alias("n_rows"))
             .where(F.col("n_rows") >= cfg.forest_min_rows))
    sizes = stored(sizes)
    forest = stored(fit_forest(rows, sizes, cfg))
    held = forest.agg(F.sum(F.size("feature").cast("long") * 16)).first()[0] or 0
    scored = stored(_scored_in_place(features, complete, forest) if held <= broadcast_bytes
                    else _scored_by_category(features, complete, forest, sizes))
    zero = group_quantiles(scored, [CATEGORY], "_raw", {"_zero": cfg.contamination})
    return (join_measured(scored, zero, CATEGORY)
            .withColumn("isolation_score", F.col("_raw") - F.col("_zero")).drop("_raw", "_zero"))
