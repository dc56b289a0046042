"""Benchmark decontamination: windows of normalised words of test items, found in training texts.

A-Z are lower-cased, and words are runs of digits, a-z and characters beyond ASCII. A window is `WINDOW` consecutive words of an
item; an item of fewer words, but not none, is one window. The windows of all items go to every task as a hash set: each has a
hash that follows from the one of the window before it, and a match of hashes is verified word by word. Words inside an
occurrence of a window are hit. `scan` gives hits and items of every document, `remove_spans` cuts the hit words out,
`remove_documents` leaves out documents by their share of hit words.

Items are sent in pieces of at most `PIECE` windows, and words of over `LONG` bytes as their digest. Only `LIMIT` bytes of pieces
are broadcast at a time; a benchmark beyond that goes in blocks, a pass over the documents for each, whose hits are united. The
result does not depend on the number of blocks.

Defined results: a null or empty text has no words and no hits; rows with the same item_id are one item, null ids too, whose
name is then the empty text; an empty benchmark hits nothing; repeated documents are judged each; other columns are kept
by the functions that remove, whatever their names, and not read otherwise.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, kept, mix64, stored, text_slices

WINDOW = 10
PIECE, LONG, LIMIT = 4096, 64, 16 << 20
SLICE = 2_000_000
# Bytes of a text to bytes of its words; all else is a space.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32
             for c in range(256))
PIECES = pa.schema([("item", pa.string()), ("n_words", pa.int32()), ("words", pa.binary())])
RUN = "array<struct<first:int,last:int>>"


def short(word: bytes) -> bytes:
    """A word, or a name for a long one that no word can have."""
    return word if len(word) <= LONG else b"#" + hashlib.sha256(word).hexdigest().encode()


def pieces(bench: DataFrame, window: int) -> DataFrame:
    """The words of every item in pieces whose windows are the windows of the item."""
    def cut(batches):
        for b in batches:
            for lo, _, texts in text_slices(b.column(1), SLICE):
                for at, text in enumerate(texts, start=lo):
                    words = [*map(short, text.encode("utf-8", "surrogatepass").translate(FOLD).split())]
                    starts = range(0, max(len(words) - window + 1, min(len(words), 1)), PIECE)
                    for i in starts:
                        some = words[i:i + PIECE + window - 1]
                        yield batch(PIECES, [b.column(0)[at].as_py()], [len(some)], [b" ".join(some)])

    item = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    return bench.select(item.alias("item"), "text").mapInArrow(cut, "item string, n_words int, words binary").distinct()


def blocks(bench: DataFrame, window: int, limit: int) -> list[pa.Table]:
    """The pieces of all items, in tables of at most `limit` bytes by their measured size."""
    cut = stored(pieces(bench, window), "pieces")
    cost = F.octet_length("words") + 16 * F.col("n_words") + F.octet_length("item")
    total = cut.agg(F.sum(cost).alias("cost")).first().cost or 0
    number = 1 if total <= limit else -(-2 * total // limit)
    while True:
        block = F.pmod(F.xxhash64("item", "words"), F.lit(number))
        sizes = cut.groupBy(block.alias("block")).agg(F.sum(cost).alias("cost"), F.count("*").alias("n")).collect()
        if all(r.cost <= limit or r.n == 1 for r in sizes):
            return [cut.where(block == r.block).toArrow() for r in sorted(sizes, key=lambda r: r.block)]
        number *= 2


class Windows:
    """The windows of some pieces, by length and hash."""

    def __init__(self, table: pa.Table, window: int):
        rows = table.sort_by([("item", "ascending"), ("words", "ascending")]).to_pydict()
        words = [w.split() for w in rows["words"]]
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        ids = np.array([number(w, len(self.vocabulary)) for piece in words for w in piece], np.int32)
        self.long = any(w[0] == 35 for w in self.vocabulary)
        self.items = sorted(set(rows["item"]))
        place = {name: k for k, name in enumerate(self.items)}
        of_piece = np.array([place[x] for x in rows["item"]], np.int64)
        counts = np.array([len(w) for w in words], np.int64)
        begins = np.cumsum(counts) - counts
        salt = 0
        while not self.hashed(ids, begins, counts, of_piece, window, salt):
            salt += 1

    def hashed(self, ids, begins, counts, of_piece, window, salt) -> bool:
        """Fills the tables by length; false if different windows have the same hash."""
        self.mixed = mix64(np.arange(len(self.vocabulary) + 1, dtype=np.uint64) + np.uint64(1 + (salt << 40)))
        self.factors = mix64(np.arange(window, dtype=np.uint64) + np.uint64(1 << 32)) | np.uint64(1)
        self.by_length, sets = {}, {}
        self.members: list[list[int]] = [[k] for k in range(len(self.items))]
        for length in np.unique(np.minimum(counts, window)).tolist():
            some = np.flatnonzero(np.minimum(counts, window) == length)
            n = counts[some] - length + 1
            owner = np.repeat(of_piece[some], n)
            at = np.repeat(begins[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
            content = ids[at[:, None] + np.arange(length)]
            hashes = (self.mixed[content] * self.factors[:length]).sum(axis=1, dtype=np.uint64)
            order = np.lexsort((owner, hashes))
            hashes, content, owner = hashes[order], content[order], owner[order]
            new = np.append(True, hashes[1:] != hashes[:-1])
            first = np.flatnonzero(new)
            if (content != content[first][np.cumsum(new) - 1]).any():
                return False
            # Windows of the same items share one set of them.
            ends = np.append(first[1:], len(hashes))
            holders = owner[first].copy()
            for k in np.flatnonzero((owner[ends - 1] != owner[first])).tolist():
                own = tuple(dict.fromkeys(owner[first[k]:ends[k]].tolist()))
                if own not in sets:
                    sets[own] = len(self.members)
                    self.members.append([*own])
                holders[k] = sets[own]
            bits = min(24, max(10, int(len(first)).bit_length() + 4))
            seen = np.zeros(1 << bits, bool)
            seen[hashes[first] >> np.uint64(64 - bits)] = True
            self.by_length[length] = hashes[first], content[first], holders, seen, np.uint64(64 - bits)
        return True

    def find(self, ids: np.ndarray, left: np.ndarray):
        """(first word, length, set of items) of all verified windows; `left` counts the words to the end of each text."""
        hashes = np.zeros(len(ids), np.uint64)
        mixed = self.mixed[ids]
        for k in range(max(self.by_length, default=0)):
            if k >= len(ids):
                return
            hashes[:len(ids) - k] += mixed[k:] * self.factors[k]
            if (length := k + 1) in self.by_length:
                known, content, holders, seen, shift = self.by_length[length]
                at = np.flatnonzero(seen[hashes[:len(ids) - k] >> shift])
                at = at[left[at] >= length]
                where = np.searchsorted(known, hashes[at]).clip(max=len(known) - 1)
                same = known[where] == hashes[at]
                at, where = at[same], where[same]
                same = (ids[at[:, None] + np.arange(length)] == content[where]).all(axis=1)
                yield at[same], length, holders[where[same]]


def words_of(texts: list[str]):
    """Folded bytes of all texts, their words, where these begin and end, and the words before each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = b" ".join(raw).translate(FOLD)
    inside = np.frombuffer(b" " + data + b" ", np.uint8) != 32
    begins, ends = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    borders = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return raw, data.split(), begins, ends, np.searchsorted(begins, borders), borders


def hits_of(texts: list[str], windows: Windows, before: list):
    """Per text: number of words, of words hit, runs of hit words (also those `before`), and its items as a set."""
    raw, words, begins, ends, cuts, borders = words_of(texts)
    ids = np.fromiter(map(windows.vocabulary.get, words, repeat(-1)), np.int32, len(words))
    if windows.long:
        for i in np.flatnonzero(ends - begins > LONG).tolist():
            ids[i] = windows.vocabulary.get(short(words[i]), -1)
    n_words = np.diff(cuts)
    owner = np.repeat(np.arange(len(texts)), n_words)
    cover = np.zeros(len(words) + 1, np.int64)
    for text, runs in enumerate(before):
        for run in runs:
            cover[cuts[text] + run["first"]] += 1
            cover[cuts[text] + run["last"]] -= 1
    items: list[set[int]] = [set() for _ in texts]
    for at, length, holders in windows.find(ids, cuts[1:][owner] - np.arange(len(words))):
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
        found = np.unique(owner[at] * len(windows.members) + holders)
        for text, held in zip((found // len(windows.members)).tolist(), (found % len(windows.members)).tolist()):
            items[text].update(windows.members[held])
    hit = np.cumsum(cover[:-1]) > 0
    return (raw, n_words, np.bincount(owner[hit], minlength=len(texts)), runs_of(hit, owner, cuts),
            [[windows.items[k] for k in found] for found in items], begins, ends, cuts, borders)


def runs_of(hit: np.ndarray, owner: np.ndarray, cuts: np.ndarray) -> list[list[tuple[int, int]]]:
    """Per text the runs of hit words as (first, one past the last), counted within the text."""
    out: list[list[tuple[int, int]]] = [[] for _ in cuts[1:]]
    at = np.flatnonzero(hit)
    if len(at):
        apart = np.append(True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]]))
        last = at[np.append(np.flatnonzero(apart)[1:] - 1, len(at) - 1)] + 1
        for a, b, text in zip(at[apart].tolist(), last.tolist(), owner[at[apart]].tolist()):
            out[text].append((a - int(cuts[text]), b - int(cuts[text])))
    return out


def code_points(raw: bytes, places: list[int]) -> list[int]:
    """Places in bytes, ascending, as places in code points."""
    out, at, n = [], 0, 0
    for place in places:
        n += len(raw[at:place].decode("utf-8", "surrogatepass"))
        out.append(n)
        at = place
    return out


def passes(docs: DataFrame, bench: DataFrame, keep: tuple[str, ...], cut: bool, window: int, limit: int) -> DataFrame:
    """A struct `own` of the columns to keep, the words and hits of every document, and its spans, or its text without them."""
    spark = docs.sparkSession
    own = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.struct(F.lit(0).alias("none"))
    found = docs.select(own.alias("own"), F.col("text").alias("text"), F.array().cast(RUN).alias("runs"),
                        F.array().cast("array<string>").alias("items"))
    tables = blocks(bench, window, limit) or [PIECES.empty_table()]
    for k, part in enumerate(tables):
        last = k == len(tables) - 1
        shared = spark.sparkContext.broadcast(part)  # `limit` bytes at most, by measured size
        more = "n_words long, n_hit long, " + ("clean string" if cut else "spans array<struct<start:int,end:int>>")
        ddl = f"own {found.schema['own'].dataType.simpleString()}, text string, runs {RUN}, items array<string>"
        ddl = f"{ddl}, {more}" if last else ddl
        found = found.mapInArrow(one_pass(uuid.uuid4().hex, shared, window, last, cut), ddl)
        if not last:
            found = stored(found, "scanned")
    return found


def one_pass(name: str, shared, window: int, last: bool, cut: bool):
    def run(batches):
        windows = kept(name, lambda: Windows(shared.value, window))
        runs_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            for lo, hi, texts in text_slices(b.column(1), SLICE):
                raw, n_words, n_hit, runs, items, begins, ends, cuts, borders = hits_of(
                    texts, windows, b.column(2).slice(lo, hi - lo).to_pylist())
                items = [sorted({*mine, *old}) for mine, old in zip(items, b.column(3).slice(lo, hi - lo).to_pylist())]
                columns = {"own": b.column(0).slice(lo, hi - lo)}
                text = b.column(1).slice(lo, hi - lo)
                columns["text"] = pa.nulls(hi - lo, pa.string()) if last else text
                columns["runs"] = pa.array([[] if last else [{"first": a, "last": z} for a, z in r] for r in runs], runs_type)
                columns["items"] = pa.array(items, pa.list_(pa.string()))
                if last:
                    columns |= {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64())}
                    places = [[(int(begins[cuts[i] + a] - borders[i]), int(ends[cuts[i] + z - 1] - borders[i]))
                               for a, z in found] for i, found in enumerate(runs)]
                    if cut:
                        columns["clean"] = pa.array([t.as_py() if not p else without(r, p)
                                                     for t, r, p in zip(text, raw, places)], pa.string())
                    else:
                        columns["spans"] = pa.array([spans(r, p) for r, p in zip(raw, places)], spans_type)
                yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

    return run


def spans(raw: bytes, places: list[tuple[int, int]]) -> list[dict]:
    points = code_points(raw, [x for place in places for x in place])
    return [{"start": a, "end": z} for a, z in zip(points[::2], points[1::2])]


def without(raw: bytes, places: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, z in places:
        out.append(raw[at:a])
        at = z
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def scan(docs: DataFrame, bench: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW,
         limit: int = LIMIT) -> DataFrame:
    """The columns to keep, `n_words`, `n_hit`, `items` (ids as sorted strings) and `spans` (code points, end exclusive)."""
    found = passes(docs, bench, keep, False, window, limit)
    return found.select("own.*", "n_words", "n_hit", "items", "spans")


def remove_spans(docs: DataFrame, bench: DataFrame, window: int = WINDOW, limit: int = LIMIT) -> DataFrame:
    """The documents without their hit words and what stands between these; `n_chars` follows where there is one."""
    found = passes(docs, bench, (*docs.columns,), True, window, limit)
    out = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(F.col("n_hit") > 0, F.length("clean").cast(kind)).otherwise(F.col("own.n_chars"))
    return found.select(*(out.get(c, F.col(f"own.`{c}`")).alias(c) for c in docs.columns))


def remove_documents(docs: DataFrame, bench: DataFrame, share: float = 0.0, window: int = WINDOW,
                     limit: int = LIMIT) -> DataFrame:
    """The documents of whose words not more than `share` are hit."""
    found = passes(docs, bench, (*docs.columns,), False, window, limit)
    return found.where(F.col("n_hit") <= F.lit(share) * F.col("n_words")).select("own.*")
