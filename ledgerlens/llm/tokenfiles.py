"""Token ids in files, with document boundaries as Elias-Fano sequences.

Documents in ascending doc_id order are encoded, an end id is put after each, and the ids of about `SEGMENT` tokens at a
time are one row of a Parquet file in the given folder: the ids as one block of 16- or 32-bit little-endian integers, and
the ends of the documents in it as an Elias-Fano sequence, some two bits a document above the logarithm of the mean
length, with the places of every 64th upper bit for selection. Shards are the partitions of a range partitioning, so
the order over files is the order of doc_id; offsets inside a shard are stored with it, and the first offset of each shard
follows from the sums of the shards, one row each. A document is never parted; its segment is as long as it needs.

Defined results: a null or empty text is the end id alone; rows with equal doc_id stand side by side, ordered by text; a
null doc_id comes first; an empty table gives a folder of no rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import WordTable, batch, file_bytes, kept, partitions, slices, stored, texts_of

SEGMENT = 1 << 20
WORDS = 900_000
SLICE = 2_000_000


class EliasFano:
    """An ascending sequence of n numbers up to `top`: low bits side by side, high parts in unary."""

    EVERY = 64

    def __init__(self, n: int, low: int, lows: bytes, highs: bytes, places: bytes):
        self.n, self.low, self.lows, self.highs, self.places = n, low, lows, highs, places

    @classmethod
    def of(cls, values: np.ndarray, top: int) -> EliasFano:
        n = len(values)
        low = max(0, (top // n).bit_length() - 1) if n else 0
        values = values.astype(np.uint64)
        bits = (values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
        lows = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        highs = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        highs[ones] = 1
        return cls(n, low, lows, np.packbits(highs, bitorder="little").tobytes(),
                   ones[::cls.EVERY].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The i-th number, without the others."""
        at = int.from_bytes(self.places[i // self.EVERY * 4:i // self.EVERY * 4 + 4], "little")
        left = i % self.EVERY
        byte = at >> 3
        word = int.from_bytes(self.highs[byte:byte + 8], "little") >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 8
            word = int.from_bytes(self.highs[byte:byte + 8], "little")
        for _ in range(left):
            word &= word - 1
        high = byte * 8 + (word & -word).bit_length() - 1 - i
        first = i * self.low
        part = int.from_bytes(self.lows[first >> 3:(first + self.low + 7) >> 3], "little") >> (first & 7)
        return high << self.low | part & ((1 << self.low) - 1)


class Encoder:
    """The library's encoder; words that were met before are looked up, new ones of many texts are encoded in one call."""

    def __init__(self, content: bytes):
        self.tokenizer = Tokenizer.from_buffer(content)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.wide = max(vocabulary.values()) >= 1 << 16
        self.kind, self.width = ("<u4", 4) if self.wide else ("<u2", 2)
        # A byte is one character of a token's name.
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.sizes[[*vocabulary.values()]] = [len(t) for t in vocabulary]
        self.encode = WordTable(self.learn, self.ids, WORDS).encode

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of new words: all in one call, but those that begin or end with white space of their own."""
        plain = [w for w in words if w[1:2].strip() and w[-1].strip() and w[0] == " "]
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(plain)], add_special_tokens=False)[0].ids, self.kind)
        ends = np.cumsum([len(w.encode("utf-8", "surrogatepass")) for w in plain])
        cuts = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1
        packed, cuts = ids.tobytes(), (cuts * self.width).tolist()
        known = {w: packed[a:b] for w, a, b in zip(plain, [0, *cuts], cuts)}
        return known | {w: self.ids(w) for w in words if w not in known}


def encoder(content: bytes) -> Encoder:
    return kept(("files", content), lambda: Encoder(content))


SEGMENTS = pa.schema([
    ("shard", pa.int32()), ("at", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
    ("low", pa.int32()), ("lows", pa.binary()), ("highs", pa.binary()), ("places", pa.binary()), ("ids", pa.binary())])
SEGMENTS_DDL = ("shard int, at long, n_ids long, width int, doc_ids array<long>, low int, lows binary, highs binary, "
                "places binary, ids binary")


def segment(shard: int, at: int, doc_ids: list, blocks: list[bytes], width: int) -> pa.RecordBatch:
    ends = np.cumsum([len(b) // width for b in blocks])
    index = EliasFano.of(ends, int(ends[-1]))
    return batch(SEGMENTS, [shard], [at], [int(ends[-1])], [width], [doc_ids], [index.low], [index.lows], [index.highs],
                 [index.places], [b"".join(blocks)])


def write(docs: DataFrame, vocabulary: str, path: str, end_id: int = 0) -> None:
    """Encode all documents and write the files."""
    spark = docs.sparkSession
    content = file_bytes(spark, vocabulary)

    def run(batches):
        own = encoder(content.value)
        end, width = end_id.to_bytes(own.width, "little"), own.width
        shard, at, held, ids, blocks = TaskContext.get().partitionId(), 0, 0, [], []
        for b in batches:
            names, texts = b.column(0).to_pylist(), texts_of(b.column(1))
            for lo, hi in slices([len(t) for t in texts], SLICE):
                for doc_id, packed in zip(names[lo:hi], own.encode(texts[lo:hi])):
                    blocks.append(packed + end)
                    ids.append(doc_id)
                    held += len(blocks[-1]) // width
                    if held >= SEGMENT:
                        yield segment(shard, at, ids, blocks, width)
                        at, held, ids, blocks = at + held, 0, [], []
        if blocks:
            yield segment(shard, at, ids, blocks, width)

    (docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(partitions(spark), "doc_id")
     .sortWithinPartitions("doc_id", "text").mapInArrow(run, SEGMENTS_DDL).write.parquet(path))


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def boundaries(row: dict) -> list[int]:
    """Ends of the documents of a segment, each by selection."""
    index = EliasFano(len(row["doc_ids"]), row["low"], row["lows"], row["highs"], row["places"])
    return [index.select(i) for i in range(index.n)]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back: per document where its ids start among all, how many there are, and their checksum."""
    files = spark.read.schema(SEGMENTS_DDL).parquet(path)
    # One row per shard, so this order is over the files, not the documents.
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(files.groupBy("shard").agg(F.sum("n_ids").alias("all")).withColumn("base", F.coalesce(
        F.sum("all").over(order), F.lit(0))).select("shard", "base"), "shards")
    placed = files.join(bases, "shard").withColumn("at", F.col("at") + F.col("base")).select(*files.columns)

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                ends = boundaries(row)
                ids = np.frombuffer(row["ids"], "<u2" if row["width"] == 2 else "<u4")
                starts = [0, *ends[:-1]]
                sums = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(starts, ends)]
                yield batch(READ, row["doc_ids"], [row["at"] + s for s in starts],
                            [e - s for s, e in zip(starts, ends)], sums)

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
