"""Document fingerprints by locally consistent parsing.

A text is parsed level by level. Runs of equal symbols become one symbol; deterministic coin tossing, repeated four
times, gives each symbol a label below 6 that differs from its neighbours' and depends on a few symbols to the left only;
a phrase begins at each local maximum of the labels and is named by a hash of its symbols. The names are the symbols of
the next level. So equal substrings have equal phrases inside, wherever they stand; a change touches a few phrases of
each level. The fingerprint holds the smallest hashes of the distinct phrases of level 3, some 25 characters each, and
where there are few of them also those of level 2, and then of level 1. Likeness is the Jaccard estimate from these.

Defined results: a null text is the empty one, whose fingerprint is empty; two empty fingerprints are alike 1, an empty
and another one 0; equal texts have equal fingerprints; documents follow each other by doc_id, nulls first, ties by
text; the only document follows itself; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, mix64, partitions, slices, stored, texts_of

SLICE = 400_000
LEVELS = 3
# Hashes kept of level 3 and of lower levels; a level with fewer phrases than FEW calls for the one below.
KEPT, KEPT_BELOW, FEW = 48, 32, 16
DIGITS = 6
NAMED = np.uint64(0x9E3779B97F4A7C15)


def toss(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One coin toss: the place of the lowest bit that differs from the left neighbour, and this bit."""
    left = np.empty_like(symbols)
    left[1:] = symbols[:-1]
    left[first] = ~symbols[first]
    low = symbols ^ left
    low &= -low
    return (np.bitwise_count(low - symbols.dtype.type(1)) * np.uint8(2) + ((symbols & low) != 0)).astype(np.uint8)


def level_up(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of one level, and the text each belongs to."""
    fresh = np.empty(len(symbols), bool)
    fresh[0] = True
    np.not_equal(owner[1:], owner[:-1], out=fresh[1:])
    new = fresh.copy()
    new[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(new)
    length = np.diff(at, append=len(symbols)).astype(np.uint64)
    symbols, owner, fresh = symbols[at] + (length - np.uint64(1)) * NAMED, owner[at], fresh[at]
    first = np.flatnonzero(fresh)
    labels = toss(symbols, first)
    for _ in range(3):
        labels = toss(labels, first)
    begins = fresh.copy()
    peak = labels[1:-1] > labels[:-2]
    peak &= labels[1:-1] > labels[2:]
    peak &= ~fresh[2:]
    begins[1:-1] |= peak
    at = np.flatnonzero(begins)
    place = np.arange(len(symbols)) - np.repeat(at, np.diff(at, append=len(symbols)))
    sums = np.add.reduceat(mix64(symbols + place.astype(np.uint64) * NAMED), at)
    return mix64(sums), owner[at]


def smallest(names: np.ndarray, owner: np.ndarray, texts: int, kept: int) -> tuple[list[str], np.ndarray]:
    """Per text the smallest hashes of its distinct phrases as hex digits, and how many distinct ones there are."""
    bits = 4 * DIGITS
    keys = np.unique(owner.astype(np.int64) << bits | (mix64(names ^ NAMED) >> np.uint64(64 - bits)).astype(np.int64))
    of = keys >> bits
    count = np.bincount(of, minlength=texts)
    first = np.cumsum(count) - count
    keys = keys[np.arange(len(keys)) - first[of] < kept] & (1 << bits) - 1
    digits = "".join(f"{k:0{DIGITS}x}" for k in keys.tolist())
    ends = np.cumsum(np.minimum(count, kept)) * DIGITS
    return [digits[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())], count


def fingerprint(texts: list[str]) -> list[str]:
    joined = "".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    out = [""] * len(texts)
    if not joined:
        return out
    symbols = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    levels = []
    for _ in range(LEVELS):
        symbols, owner = level_up(symbols, owner)
        levels.append((symbols, owner))
    wanted = sizes > 0
    for level in range(LEVELS, 0, -1):
        names, owner = levels[level - 1]
        here = wanted[owner]
        hashes, count = smallest(names[here], owner[here], len(texts), KEPT if level == LEVELS else KEPT_BELOW)
        for i in np.flatnonzero(wanted).tolist():
            out[i] += f"{'|' if out[i] else ''}{level}:{hashes[i]}"
        wanted &= count < FEW
    return out


def likeness(a: str, b: str) -> float:
    """Jaccard estimate from the lowest level that both fingerprints hold."""
    if a == b:
        return 1.0
    a, b = (dict(part.split(":") for part in x.split("|") if part) for x in (a, b))
    both = a.keys() & b.keys()
    if not both:
        return 0.0
    level = min(both)
    one, other = ({x[i:i + DIGITS] for i in range(0, len(x), DIGITS)} for x in (a[level], b[level]))
    kept = sorted(one | other)[:KEPT if level == str(LEVELS) else KEPT_BELOW]
    return sum(x in one and x in other for x in kept) / len(kept)


PRINTS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprint of every document."""
    def run(batches):
        for b in batches:
            texts = texts_of(b.column(1))
            for lo, hi in slices([len(t) for t in texts], SLICE):
                some = texts[lo:hi]
                yield batch(PRINTS, b.column(0).slice(lo, hi - lo), [len(t) for t in some], fingerprint(some))

    return (docs.select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(run, "doc_id long, n_chars long, fingerprint string"))


def edited(text: str, after: str) -> str:
    """The text with its last quarter replaced by as much of the beginning of the next one."""
    n = len(text) // 4
    return text[:len(text) - n] + after[:n]


RESULT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
          ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
RESULT_DDL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
# A row with a text is the first (1) or last (2) of its shard and waits for its neighbour.
SHARDED = pa.schema([*RESULT, ("edge", pa.int32()), ("shard", pa.int32()), ("text", pa.string())])
WHOLE, FIRST, LAST = 0, 1, 2


def compare(ids: list, texts: list[str], after: list[str]) -> list[list]:
    """The columns of the result for texts and the ones that follow them."""
    changed = [edited(t, n) for t, n in zip(texts, after)]
    n = len(texts)
    prints = fingerprint([*texts, *changed])
    follow = {t: p for t, p in zip(texts, prints)}
    rest = [t for t in after if t not in follow]
    follow |= zip(rest, fingerprint(rest))
    return [ids, [len(t) for t in texts],
            [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], prints[:n], prints[n:],
            [likeness(a, b) for a, b in zip(prints[:n], prints[n:])],
            [likeness(a, follow[t]) for a, t in zip(prints[:n], after)]]


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, likeness to that and to the next document's."""
    spark = docs.sparkSession

    def run(batches):
        shard, held, size, begun = TaskContext.get().partitionId(), [], 0, False

        def edge(kind):
            doc_id, text = held[-1]
            return batch(SHARDED, [doc_id], [len(text)], *([None] for _ in range(5)), [kind], [shard], [text])

        def done(rows):
            columns = compare([i for i, _ in rows[:-1]], [t for _, t in rows[:-1]], [t for _, t in rows[1:]])
            k = len(rows) - 1
            return batch(SHARDED, *columns, [WHOLE] * k, [shard] * k, [None] * k)

        for b in batches:
            for row in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                held.append(row)
                size += len(row[1])
                if not begun:
                    begun = True
                    yield edge(FIRST)
                if size > SLICE and len(held) > 1:
                    yield done(held)
                    held, size = held[-1:], len(row[1])
        if len(held) > 1:
            yield done(held)
        if held:
            yield edge(LAST)

    ordered = (docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(partitions(spark), "doc_id")
               .sortWithinPartitions("doc_id", "text"))
    made = stored(ordered.mapInArrow(run, f"{RESULT_DDL}, edge int, shard int, text string"), "fingerprints")
    # Two rows per shard wait; only their shard numbers are put in order.
    order = Window.orderBy("shard")
    shards = made.where(F.col("edge") == FIRST).select("shard")
    follows = (shards.withColumn("next", F.lead("shard").over(order))
               .join(shards.agg(F.min("shard").alias("least")))
               .select("shard", F.coalesce("next", "least").alias("next")))
    lasts = made.where(F.col("edge") == LAST).select("shard", "doc_id", "text").join(follows, "shard")
    firsts = made.where(F.col("edge") == FIRST).select(F.col("shard").alias("next"), F.col("text").alias("after"))

    def finish(batches):
        for b in batches:
            yield batch(pa.schema(RESULT), *compare(b.column(0).to_pylist(), *(c.to_pylist() for c in b.columns[1:])))

    ends = lasts.join(firsts, "next").select("doc_id", "text", "after").mapInArrow(finish, RESULT_DDL)
    return made.where(F.col("edge") == WHOLE).select(*(n for n, _ in RESULT)).unionByName(ends)
