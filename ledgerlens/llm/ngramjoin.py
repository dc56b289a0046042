"""N-gram Jaccard join in the metric space of sets: pivots, regions, triangle-inequality windows.

The distance of two sets of word shingles is 1 - Jaccard, a metric; documents link within the radius r = 1 - similarity.

1. Equal sets are one set from here on. A set keeps only the shingles that another set of fitting size has as well; the
   others cannot be in an intersection that counts.
2. Sets that share no shingle are at distance 1 and never meet. A set stands in one cell for each of its rarest shingles:
   two sets within r have one in common among the first n - ceil(s n) + 1 of each, the smaller among fewer still.
3. In each cell the set with the fewest shingles of its own, the centre of copies, is the pivot, and the distances of
   all others to it are computed. Those within r form its Voronoi ball and are linked to it; they need not be compared
   with each other, as their component is known. A boundary set outside is compared only with those inside the ball for
   which the triangle inequality leaves room: d(y, p) - d(x, p) <= r.
4. What lies outside the balls is joined again in the same way, with pivots of its own, `ROUNDS` times; what then remains
   is compared directly inside the cell, by bands of size.
All pairs are verified on their whole sets, so the result is exact; a cell never gives all of its pairs.

Defined results: A-Z are lowered; a null or empty text, or one of white space alone, has no set and no links; fewer words
than a shingle count as one shingle; documents with equal sets are linked; rows with equal doc_id are documents each, in one
component if their sets are equal (`keep_first` judges rows, not ids); a null doc_id gives the component the smallest doc_id that is known, or null; other
columns are not read.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, batch, kept, mix64, partitions, stored, text_slices
from .graph import components

SLICE = 2_000_000
WORDS = 200_000
ROUNDS = 2
# Rows that leave or have copies are broadcast up to this number, some 50 bytes each, so that texts stay where they are.
FEW = 1_000_000
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class Shingler:
    """Sets of hashed word shingles, and a hash of each set."""

    def __init__(self, words: int):
        self.words = words
        self.hashes = Memo(xxhash.xxh3_64_intdigest, WORDS)

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
        counts = np.array([len(w) for w in words], np.int64)
        hashed = np.fromiter(map(self.hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(counts.sum()))
        ends = np.cumsum(counts)
        out = []
        if len(hashed) >= self.words:
            rows = hashed[:len(hashed) - self.words + 1].copy()
            for step in range(1, self.words):
                rows = mix64(rows) * ODD[step % 4] + hashed[step:len(hashed) - self.words + 1 + step]
            rows = mix64(rows)
        for n, end in zip(counts.tolist(), ends.tolist()):
            if n >= self.words:
                out.append(np.unique(rows[end - n:end - self.words + 1]))
            elif n:
                out.append(np.array([xxhash.xxh3_64_intdigest(hashed[end - n:end].tobytes(), seed=n)], np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
        return out


def fingerprint(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


MEMBERS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.int64()), ("row", pa.int64())])


def members(docs: DataFrame, words: int, row: Column) -> DataFrame:
    """The size and the hash of every document's set, and a key of its row; no hash where the set is empty."""
    def run(batches):
        own = kept(("shingles", words), lambda: Shingler(words))
        for b in batches:
            for lo, hi, texts in text_slices(b.column(1), SLICE):
                sets = own.sets(texts)
                yield batch(MEMBERS, b.column(0).slice(lo, hi - lo), [len(s) for s in sets],
                            [fingerprint(s) if len(s) else None for s in sets], b.column(2).slice(lo, hi - lo))

    return (docs.select(F.col("doc_id").cast("long"), "text", row.cast("long"))
            .mapInArrow(run, "doc_id long, n_shingles long, fp long, row long"))


BLOCKS = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("of", pa.binary()), ("fps", pa.binary()), ("sizes", pa.binary())])
SHARED = pa.schema([("fp", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("df", pa.int64())])
FLUSH = 200_000


def shared_shingles(docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """(fp, n, key, df) of every distinct set and each shingle that another set of fitting size has.

    Shingles travel in blocks of packed numbers, one for each slice of documents and target partition; each
    partition holds a range of hashes.
    """
    parts = partitions(docs.sparkSession)

    def emit(batches):
        own = kept(("shingles", words), lambda: Shingler(words))
        for b in batches:
            for _, _, texts in text_slices(b.column(0), SLICE, each=64):
                found = {fingerprint(s): s for s in own.sets(texts) if len(s)}
                if not found:
                    continue
                fps, sizes = np.array(list(found), "<i8"), np.array([len(s) for s in found.values()], "<u4")
                keys, of = np.concatenate(list(found.values())), np.repeat(np.arange(len(fps)), sizes)
                part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
                order = np.argsort(part, kind="stable")
                ends = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
                for p, (first, last) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                    if last > first:
                        some, index = np.unique(of[order[first:last]], return_inverse=True)
                        yield batch(BLOCKS, [p], [keys[order[first:last]].astype("<u8").tobytes()],
                                    [index.astype("<u2").tobytes()], [fps[some].tobytes()], [sizes[some].tobytes()])

    def meet(batches):
        keys, fps, sizes = [], [], []
        for b in batches:
            for row in b.to_pylist():
                of = np.frombuffer(row["of"], "<u2")
                keys.append(np.frombuffer(row["keys"], "<u8"))
                fps.append(np.frombuffer(row["fps"], "<i8")[of])
                sizes.append(np.frombuffer(row["sizes"], "<u4")[of])
        if not keys:
            return
        keys, fps, sizes = np.concatenate(keys), np.concatenate(fps), np.concatenate(sizes).astype(np.int64)
        order = np.lexsort((fps, sizes, keys))
        keys, fps, sizes = keys[order], fps[order], sizes[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1])
        keys, fps, sizes = keys[new], fps[new], sizes[new]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(first)
        df = np.repeat(np.diff(at, append=len(keys)), np.diff(at, append=len(keys)))
        fits = ~first[1:] & (100 * sizes[:-1] >= similarity * sizes[1:])  # sizes ascend: a neighbour fits if any does
        keep = np.zeros(len(keys), bool)
        keep[1:] |= fits
        keep[:-1] |= fits
        keys, fps, sizes, df = keys[keep].view(np.int64), fps[keep], sizes[keep], df[keep]
        for lo in range(0, len(keys), FLUSH):
            some = slice(lo, lo + FLUSH)
            yield batch(SHARED, fps[some], sizes[some], keys[some], df[some])

    return (docs.select("text").mapInArrow(emit, "part int, keys binary, of binary, fps binary, sizes binary")
            .repartitionById(parts, F.col("part")).mapInArrow(meet, "fp long, n long, key long, df long"))


def least_common(a: Column, b: Column, similarity: int) -> Column:
    """The smallest intersection of sets of these sizes that links them."""
    return F.ceil((a + b) * similarity / (100 + similarity))


def may_link(x: str, y: str, similarity: int) -> Column:
    """Whether sets that meet in a cell may link, if their shingle there is the first that they share.

    The smaller one stands in the cell by a shingle of its short prefix, their sizes fit, and what follows the shingle in
    each of them is enough.
    """
    nx, ny, px, py = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.at"), F.col(f"{y}.at")
    smaller_short = F.when(nx < ny, F.col(f"{x}.short")).when(nx > ny, F.col(f"{y}.short")).otherwise(
        F.col(f"{x}.short") & F.col(f"{y}.short"))
    return ((100 * F.least(nx, ny) >= similarity * F.greatest(nx, ny)) & smaller_short
            & (1 + F.least(nx - px, ny - py) >= least_common(nx, ny, similarity)))


def cells(sets: DataFrame, similarity: int) -> DataFrame:
    """(key, x): a row for each set and each shingle of its prefix, rarest first; `own` orders pivots."""
    n, shared = F.col("n"), F.size("rare")
    alone = n - shared
    long = n - F.ceil(n * similarity / 100) + 1 - alone
    short = n - F.ceil(n * 2 * similarity / (100 + similarity)) + 1
    return (sets.select("fp", "n", alone.alias("alone"), short.alias("reach"),
                        F.posexplode(F.slice("rare", 1, F.greatest(long, F.lit(0)).cast("int"))).alias("i", "s"))
            .select(F.col("s.key").alias("key"), F.struct(
                F.floor(F.col("alone") * 1000 / F.col("n")).alias("own"), "fp", "n",
                (F.col("alone") + F.col("i") + 1).alias("at"),
                (F.col("alone") + F.col("i") + 1 <= F.col("reach")).alias("short")).alias("x")))


def distances(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Adds to pairs (a, b) of set hashes: whether they link, and their distance. Whole sets are compared."""
    side = lambda c: sets.select(F.col("fp").alias(c), F.col("n").alias(f"n_{c}"), F.col("rare.key").alias(f"k_{c}"))
    common = F.size(F.array_intersect("k_a", "k_b"))
    union = F.col("n_a") + F.col("n_b") - F.col("common")
    return (pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").withColumn("common", common)
            .select("a", "b", (100 * F.col("common") >= similarity * union).alias("linked"),
                    (1 - F.col("common") / union).alias("d")))


def set_links(sets: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) that join all sets which links of the given similarity join."""
    radius = 1 - similarity / 100 + 1e-9
    outside = stored(cells(sets, similarity), "cells")
    links, doubts = [], []
    for _ in range(ROUNDS):
        heads = stored(outside.groupBy("key").agg(F.min("x").alias("p"), F.count("*").alias("c")).where("c > 1")
                       .select("key", "p"), "pivots")
        placed = outside.join(heads, "key").where("x.fp <> p.fp")
        near = placed.where(may_link("x", "p", similarity)).select("key", F.col("x.fp").alias("a"), F.col("p.fp").alias("b"))
        known = stored(distances(near, sets, similarity), "distances")
        links.append(known.where("linked").select("a", "b"))
        # A pair that cannot meet first in this cell has no distance here, and no window.
        apart = (placed.withColumn("a", F.col("x.fp")).withColumn("b", F.col("p.fp")).join(known, ["a", "b"], "left")
                 .select("key", "x", F.coalesce("linked", F.lit(False)).alias("inside"), "d"))
        regions = stored(apart, "regions")
        ball = regions.where("inside").select("key", "x", F.col("d").alias("dx"))
        rest = regions.where("not inside").select("key", F.col("x").alias("y"), F.col("d").alias("dy"))
        window = F.col("dy").isNull() | (F.col("dy") - F.col("dx") <= radius)
        doubts.append(ball.join(rest, "key").where(window & may_link("x", "y", similarity))
                      .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))
        outside = rest.select("key", F.col("y").alias("x"))
    # The rest meets by size: a short one with those of its own band of sizes and of the next.
    band = lambda c: F.floor(F.log(F.col(f"{c}.n").cast("double")) / -math.log(similarity / 100) + 1e-6)
    small = outside.where("x.short").withColumn("band", F.explode(F.array(band("x"), band("x") + 1, band("x") + 2)))
    large = outside.select("key", F.col("x").alias("y"), band("x").alias("band"))
    ordered = (F.col("x.n") < F.col("y.n")) | (F.col("x.n") == F.col("y.n")) & (F.col("x.fp") < F.col("y.fp"))
    doubts.append(small.join(large, ["key", "band"]).where(ordered & may_link("x", "y", similarity))
                  .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))
    left = doubts[0]
    for more in doubts[1:]:
        left = left.unionByName(more)
    out = distances(stored(left.distinct(), "doubts"), sets, similarity).where("linked").select("a", "b")
    for more in links:
        out = out.unionByName(more)
    return out


def rooted(docs: DataFrame, words: int, similarity: int, row: Column) -> DataFrame:
    """(doc_id, n_shingles, row, root) of every document; equal roots are one component, an empty set has none."""
    each = stored(members(docs, words, row), "members")
    sets = stored(shared_shingles(docs, words, similarity).groupBy("fp").agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "key"))).alias("rare"))
        # Where too many shingles are the set's own, no cell holds it.
        .where(F.col("n") - F.size("rare") < F.col("n") - F.ceil(F.col("n") * similarity / 100) + 1), "sets")
    roots = stored(components(set_links(sets, similarity)), "roots")
    return stored(each.join(roots, each.fp == roots.node, "left")
                  .select("doc_id", "n_shingles", "row", F.coalesce("root", "fp").alias("root")), "rooted")


def join(docs: DataFrame, words: int = 4, similarity: int = 85) -> DataFrame:
    """Per document: the size of its set, and its component, the smallest doc_id that links reach."""
    found = rooted(docs, words, similarity, F.lit(None))
    least = found.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return (found.join(stored(least, "least"), "root", "left")
            .select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least"))
                    .alias("component_id")))


def keep_first(docs: DataFrame, words: int = 4, similarity: int = 85) -> DataFrame:
    """One row of each component, and all rows without a set; all columns are kept.

    The row with the smallest doc_id stays, a missing one being the last, and of several the one with the smallest hash of
    all its columns. Of rows that are alike in every column one stays. Rows are told apart by that hash and doc_id, so two
    documents with the same doc_id, or without one, are judged each.
    """
    row = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    found = rooted(docs, words, similarity, row).where("root is not null")
    first = stored(found.groupBy("root").agg(F.min(order).alias("first")), "first")
    judged = found.withColumn("own", order).join(first, "root").select(
        F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("row").alias("_row"), (F.col("own") == F.col("first")).alias("_stays"))
    # A key that stays more than once stands for rows that are alike.
    verdict = stored(judged.groupBy("_id", "_row").agg(F.max("_stays").alias("_stays"), F.count("*").alias("_times"))
                     .where("not _stays or _times > 1"), "verdicts")
    if verdict.count() <= FEW:
        verdict = F.broadcast(verdict)
    keyed = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_row": row})
    marked = keyed.join(verdict, ["_id", "_row"], "left").where("coalesce(_stays, true)")
    once = marked.where("_times is null").select(*docs.columns)
    return once.unionByName(marked.where("_times is not null").select(*docs.columns).dropDuplicates())
