"""Helpers shared by the operators: inputs, slices of Arrow batches, tokenizer files, bounded memory."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.scratch import shared_dir

# What counts as white space between words everywhere in this package.
WORD = "[^\\x20\\x09-\\x0D]+"
CLEANUP = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.shuffleDependency.fileCleanup.enabled")
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet below the shared folder and go on from that table.

    Cuts lineage so that a lost executor costs a read, and keeps column pruning for those that read it.
    """
    return written(df, fresh(df.sparkSession, name))


def written(df: DataFrame, path: str) -> DataFrame:
    """The same in a given folder, for a table that is dropped later."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package wrote and that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Within this, Spark's settings have these values."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def shuffles_go(spark: SparkSession):
    """Within this, Spark deletes the shuffle files of a query when it has ended; for steps whose results are stored."""
    return settings(spark, dict.fromkeys(CLEANUP, "true"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(lengths: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of at most `limit` in sum, of one row at least."""
    start, total = 0, 0
    for at, n in enumerate(lengths):
        if at > start and total + n > limit:
            yield start, at
            start, total = at, 0
        total += n
    if len(lengths) > start:
        yield start, len(lengths)


def texts_of(column: pa.Array) -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def text_slices(column: pa.Array, limit: int, each: int = 0) -> Iterator[tuple[int, int, list[str]]]:
    """Ranges of rows of at most `limit` bytes of text, with their texts; only these are made at a time.

    A row counts for `each` bytes besides its text.
    """
    for lo, hi in slices([(n or 0) + each for n in pc.binary_length(column).to_pylist()], limit):
        yield lo, hi, texts_of(column.slice(lo, hi - lo))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on uint64, a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Memo(dict):
    """A memo of bounded size in two generations: what was used of late outlives a change of generation."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value


# Between these, cutting a text at single spaces would move the borders of pieces.
RUNS = re.compile(r"\s \s")


class WordTable:
    """Encodes texts by words that were met before, each with the space before it.

    A border of pieces lies before every single space that follows another character than white space, so a word has the
    ids that it has in the whole text. `learn` encodes new words, `whole` a text in which spaces stand side by side. The
    table is started anew when it has grown beyond `limit`.
    """

    def __init__(self, learn, whole, limit: int):
        self.learn, self.whole, self.limit = learn, whole, limit
        self.words: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        apart = [RUNS.search(t) is not None for t in texts]
        words, ends = [], []
        for text, alone in zip(texts, apart):
            if text and not alone:
                first, *rest = text.split(" ")
                if first:
                    words.append(first)
                words += [" " + x for x in rest]
            ends.append(len(words))
        packed = [*map(self.words.get, words)]
        new = [i for i, p in enumerate(packed) if p is None]
        if new:
            if len(self.words) > self.limit:
                self.words.clear()
            self.words.update(self.learn([*dict.fromkeys(words[i] for i in new)]))
            for i in new:
                packed[i] = self.words[words[i]]
        return [self.whole(t) if alone else b"".join(packed[a:b])
                for t, alone, a, b in zip(texts, apart, [0, *ends], ends)]


_KEPT: dict = {}


def give_back() -> None:
    """Return freed memory to the system, as workers live on; where the C library cannot, it stays with the worker."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def kept(key, build):
    """One large helper per worker process: kept from task to task, given up when another one is asked for."""
    if key not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            give_back()
        _KEPT[key] = build()
    return _KEPT[key]


def file_bytes(spark: SparkSession, path: str):
    """A tokenizer's file, read on the driver and broadcast; its size is checked, as it is a fixed small file."""
    with open(path, "rb") as f:
        content = f.read()
    if len(content) > 64 << 20:
        raise ValueError(f"{path} is too large to broadcast")
    return spark.sparkContext.broadcast(content)
