"""Centroid clustering in whole numbers, with bounds that are loosened by the norm of a total displacement.

A component x counts as floor(SCALE * x). Every round assigns each vector to its nearest centroid and then moves each centroid to
the floor of the mean of its vectors; the last assignment follows the last move. All distances that decide are exact.

A vector keeps its distance to its centroid and to each other one as it was when it was last computed, and the round of that. The
driver keeps the centroids of all rounds and sends them along. Since its last evaluation in round s a distance has changed by
at most |c(t) - c(s)|, the norm of the whole way from there to here, which is never more than the sum of the rounds' ways. If
the upper bound of its own centroid stays below the lower bounds of all others, a vector keeps its cluster, and nothing of it is
computed or changed. Else its own distance is computed anew, then those to the centroids whose bounds still fail. Bounds are
rounded away from a decision, so ties are always left to exact distances, and the centroid of the smaller number wins.

Vectors lie in blocks of `BLOCK`, a row each, with what is kept of them; a round reads and writes the table of blocks once. Each
block carries what its moved vectors add to and take from the sums of clusters, so that only sums reach the driver.

Defined results: vectors that are null, of another length, or have a null, NaN or infinite component are left out, and so is a
vector with a component beyond +-REACH, whose squared distances need not fit 64 bits; repeated rows are vectors each; the
first centroids are the vectors with the smallest hash of the seed and their id (ties by their components), an id that is
null counting as the text `null`; with fewer vectors than centroids there are as many centroids as vectors; a sum of
distances that does not fit 64 bits is null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

DIMS, CLUSTERS, ROUNDS, SEED = 64, 8, 10, 3
SCALE = 1024
REACH = 1 << 17
BLOCK = 4096
# Bounds are kept as float32 and rounded by this share.
SLACK = 1e-6


def components(vectors: DataFrame, dims: int) -> DataFrame:
    """(vec_id, x): the vectors that are kept, in whole numbers."""
    x = F.col("embedding").cast("array<double>")
    sound = (F.size(x) == dims) & F.forall(x, lambda c: F.coalesce(F.abs(c) <= float(REACH), F.lit(False)))
    return vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"),
                                       F.transform(x, lambda c: F.floor(c * SCALE).cast("int")).alias("x"))


def first_centroids(kept: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes, `clusters` rows at most."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    rows = kept.select(digest.alias("digest"), "x").orderBy("digest", "x").limit(clusters).collect()
    return np.array([r.x for r in rows], np.int64)


STATE = pa.schema([("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("x", pa.binary()), ("cluster", pa.binary()),
                   ("near", pa.binary()), ("seen", pa.binary()), ("moved", pa.list_(pa.int64())), ("rescans", pa.int64())])
STATE_DDL = ("n int, ids array<long>, x binary, cluster binary, near binary, seen binary, moved array<long>, rescans long")


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    gap = x - centroid
    return np.einsum("ij,ij->i", gap, gap)


class Bounds:
    """What is kept of the vectors of a block: cluster, distances as last computed (n, k), and their rounds (n, k)."""

    def __init__(self, x: np.ndarray, cluster: np.ndarray, near: np.ndarray, seen: np.ndarray):
        self.x, self.cluster, self.near, self.seen = x, cluster, near, seen

    @classmethod
    def first(cls, x: np.ndarray, centroids: np.ndarray) -> Bounds:
        """All distances, computed in round 0."""
        every = np.stack([squared(x, c) for c in centroids], axis=1)
        return cls(x, every.argmin(axis=1), np.sqrt(every).astype(np.float32), np.zeros(every.shape, np.uint16))

    def again(self, history: np.ndarray) -> int:
        """Assigns to the last centroids of the history; how many vectors were computed anew."""
        now = len(history) - 1
        ways = np.sqrt(((history - history[-1]).astype(np.float64) ** 2).sum(axis=2))  # (rounds, k), to here
        number = np.arange(ways.shape[1])
        drift = ways[self.seen, number]
        own = self.cluster[:, None]
        upper = (np.take_along_axis(self.near, own, 1) + np.take_along_axis(drift, own, 1))[:, 0] * (1 + SLACK) + SLACK
        lower = self.near * (1 - SLACK) - drift * (1 + SLACK) - SLACK
        np.put_along_axis(lower, own, np.inf, 1)
        failed = np.flatnonzero(upper >= lower.min(axis=1))
        if not len(failed):
            return 0
        # Exact distances of those that fail: to the own centroid first, then wherever the bound still does not exclude it.
        x, mine = self.x[failed], self.cluster[failed]
        best = squared(x, history[-1][mine])
        self.renew(failed, mine, best, now)
        close = lower[failed] <= (np.sqrt(best) * (1 + SLACK) + SLACK)[:, None]
        winner = mine.copy()
        for k in number.tolist():
            some = np.flatnonzero(close[:, k] & (mine != k))
            exact = squared(x[some], history[-1][k])
            self.renew(failed[some], np.full(len(some), k), exact, now)
            better = (exact < best[some]) | (exact == best[some]) & (k < winner[some])
            best[some[better]], winner[some[better]] = exact[better], k
        self.cluster[failed] = winner
        return len(failed)

    def renew(self, rows: np.ndarray, centroid: np.ndarray, exact: np.ndarray, now: int) -> None:
        self.near[rows, centroid] = np.sqrt(exact)
        self.seen[rows, centroid] = now


def sums_of(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, k: int) -> np.ndarray:
    """(k, 1 + dims): by how much counts and sums of clusters change."""
    out = np.zeros((k, 1 + x.shape[1]), np.int64)
    some = np.arange(len(x)) if old is None else np.flatnonzero(old != new)
    rows = np.concatenate([np.ones((len(some), 1), np.int64), x[some]], axis=1)
    np.add.at(out, new[some], rows)
    if old is not None:
        np.subtract.at(out, old[some], rows)
    return out


def row_of(ids: list, bounds: Bounds, moved: np.ndarray, rescans: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for f, v in zip(STATE, (
        [len(ids)], [ids], [bounds.x.astype("<i4").tobytes()], [bounds.cluster.astype(np.uint16).tobytes()],
        [bounds.near.astype("<f4").tobytes()], [bounds.seen.astype("<u2").tobytes()], [moved.ravel().tolist()], [rescans]))],
        schema=STATE)


def bounds_of(row: dict, k: int) -> Bounds:
    n = row["n"]
    return Bounds(np.frombuffer(row["x"], "<i4").reshape(n, -1).astype(np.int64),
                  np.frombuffer(row["cluster"], "<u2").astype(np.int64), np.frombuffer(row["near"], "<f4").reshape(n, k).copy(),
                  np.frombuffer(row["seen"], "<u2").reshape(n, k).copy())


def first_round(kept: DataFrame, start: np.ndarray) -> DataFrame:
    """Blocks of vectors, assigned to the first centroids."""
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                some = b.slice(lo, BLOCK)
                x = some.column(1).flatten().to_numpy().reshape(some.num_rows, -1).astype(np.int64)
                bounds = Bounds.first(x, start)
                yield row_of(some.column(0).to_pylist(), bounds, sums_of(x, None, bounds.cluster, len(start)), len(x))

    return kept.mapInArrow(run, STATE_DDL)


def next_round(blocks: DataFrame, history: np.ndarray) -> DataFrame:
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                bounds = bounds_of(row, history.shape[1])
                old = bounds.cluster.copy()
                rescans = bounds.again(history)
                yield row_of(row["ids"], bounds, sums_of(bounds.x, old, bounds.cluster, history.shape[1]), rescans)

    return blocks.mapInArrow(run, STATE_DDL)


def totals(blocks: DataFrame, k: int) -> np.ndarray:
    """What all blocks add to the sums of clusters: k * (1 + dims) numbers, summed by Spark."""
    rows = blocks.select(F.posexplode("moved").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows), object)
    for r in rows:
        out[r.at] = r.v
    return out.reshape(k, -1)


def fit(vectors: DataFrame, dims: int = DIMS, clusters: int = CLUSTERS, rounds: int = ROUNDS,
        seed: int = SEED) -> tuple[DataFrame | None, np.ndarray]:
    """The blocks after the last assignment, and the centroids of all rounds (rounds + 1, k, dims)."""
    kept = components(vectors, dims)
    start = first_centroids(kept, clusters, seed)
    history = start[None]
    if not len(start):
        return None, history
    blocks = stored(first_round(kept, start), "blocks")
    sums = totals(blocks, len(start))
    for _ in range(rounds):
        moved = [[*(s // int(row[0]) for s in row[1:])] if row[0] else old.tolist() for row, old in zip(sums, history[-1])]
        history = np.concatenate([history, np.array(moved, np.int64)[None]])
        blocks = stored(next_round(blocks, history), "blocks")
        sums = sums + totals(blocks, len(start))
    return blocks, history


ASSIGNED = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])
ASSIGNED_DDL = "vec_id long, cluster int, distance long"


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                bounds = bounds_of(row | {"near": b"", "seen": b""}, 0)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["ids"], pa.int64()), pa.array(bounds.cluster, pa.int32()),
                    pa.array(squared(bounds.x, centroids[bounds.cluster]), pa.int64())], schema=ASSIGNED)

    return blocks.select("n", "ids", "x", "cluster").mapInArrow(run, ASSIGNED_DDL)


def cluster(vectors: DataFrame, dims: int = DIMS, clusters: int = CLUSTERS, rounds: int = ROUNDS,
            seed: int = SEED) -> DataFrame:
    """Cluster and squared distance of every kept vector, with sums over its cluster and over all, and its centroid's digest."""
    spark = vectors.sparkSession
    blocks, history = fit(vectors, dims, clusters, rounds, seed)
    ddl = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if blocks is None:
        return spark.createDataFrame([], f"{ASSIGNED_DDL}, {ddl.removeprefix('cluster int, ')}")
    found = stored(assigned(blocks, history[-1]), "assigned")
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row per cluster
    fits = lambda s: s if s < 1 << 63 else None
    facts = [(k, fits(sums[k]), fits(sum(sums.values())),
              hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(history[-1].tolist()) if k in sums]
    return found.join(F.broadcast(spark.createDataFrame(facts, ddl)), "cluster")  # at most `clusters` rows
