"""LM scoring by online logistic context mixing over the counts of contexts.

A token is coded in two parts: the `BITS` bits of its hash class, decision by decision, and the token within its class.
Each decision is predicted from several contexts (none, the last token, the one before it, the last two) by counts of
zeros and ones that followed the context and the bits so far in all training documents. Counts are joined to the documents by
context, so they grow with the corpus and are never in one place. A token of a context is known by a hash whose bits grow with
the number of different words, so that few share their counts; of the last two, the later one is known by the
`BITS + EXTRA` bits of its class and beside it. The predictions, as logits, are combined by weights that a
gate selects (the decision, and whether the longest context was seen with the bits so far), and the weights follow the
errors through the document, token by token. They begin with what they have become at the end of all training documents, in the
mean by visits. Within its class a token has the probability (c + 1) / (C + V + 1) of its counts. The sum of both
logarithms scores the text.

Three tokens in a row make one path: from the first to the class of the second, which is what the last token tells, and on to the
class of the third, which the last two tell. A slice of documents sends each of its paths once to where those of a
context meet, and gets back the counts on them: of every node once, and only below nodes that anything else has
reached, as what leaves the path there. What the token before the last tells goes by paths of its own.

Paths meet in ranges, one at a time in a task. Contexts are dealt evenly over ranges, but the paths of a frequent word's context
grow with the corpus, so a range with many paths is parted further, also inside a context; where, marks tell, one path of `STEP`.
Every slice then sends along how many of its tokens lie in the nodes that the ends of a range cut, so these have their whole counts.

The counts of tokens grow with the corpus and are never in one place: frequent words (at most `HEAD`, of 64 bytes at
most) are broadcast, all others are joined by word. Both give the same sums.

A token of a training document is left out of the context counts that predict it, as if its place were unknown.

Defined results: a null or empty text is the end token alone; a null doc_id is trained on; repeated rows are trained on
and scored each; with nothing to train on every token is unknown and N is 0; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, drop, fresh, give_back, mix64, partitions, settings, shuffles_go, slices, stored, text_slices, texts_of, written

SLICE = 4_000_000
# Tokens whose logits are laid out at a time, if texts allow it; ranges of contexts that a task takes one after the other.
AT_ONCE, RANGES = 150_000, 4
# Ranges of contexts whose counts a slice opens at a time.
OPENED = 8
# One path of so many is a mark; a range that has far more paths than this, by its marks, is parted into such of about so many.
STEP, WIDTH = 1 << 13, 1 << 19
# Rows with blocks or answers that reach Python at a time; they are far larger than other rows.
ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500"}
FOLDS, HELD_OUT = 7, 2
BITS, ORDERS, SPARE, EXTRA = 12, 4, 12, 3
CLASSES = 1 << BITS
SALTS = [np.uint64(x) for x in (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
# What a counter counts as before it has seen anything; where logits end; weights before anything is learned; rate.
PRIOR, TOP, WEIGHTS, RATE = 0.4, 8.0, (0.3, 0.4, 0.25, 0.25), 0.02
# By longest context (not seen, seen), order and decision.
START = np.broadcast_to(np.array(WEIGHTS, np.float32)[:, None], (2, ORDERS, BITS))
# The first weights of texts are those at the end of all training documents; a number here takes about so many tokens of them.
LEARN = None
HEAD, HEAD_BYTES, FLUSH = 1 << 18, 64, 400_000
END = ""


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def tokens_of(text: str) -> list[bytes]:
    return [*text.encode("utf-8", "surrogatepass").lower().split(), b""]


def hash_all(rows: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every token, and where each text begins."""
    counts = [len(r) for r in rows]
    return (np.fromiter(map(zlib.crc32, chain.from_iterable(rows)), np.uint32, sum(counts)),
            np.cumsum([0, *counts[:-1]]))


GATHERED = pa.schema([("word", pa.string()), ("c", pa.int64())])


def gather(docs: DataFrame) -> DataFrame:
    """Counts of words that each task gathers from training documents."""
    def run(batches):
        words = Counter()
        for b in batches:
            for _, _, texts in text_slices(b.column(0), SLICE):
                words.update(chain.from_iterable(map(tokens_of, texts)))
                if len(words) > FLUSH:
                    yield from spill(words)
                    words = Counter()
        yield from spill(words)

    def spill(words):
        names, counts = [w.decode("utf-8", "replace") for w in words], list(words.values())
        for lo in range(0, len(names), 50_000):
            yield batch(GATHERED, names[lo:lo + 50_000], counts[lo:lo + 50_000])

    return docs.select("text").mapInArrow(run, "word string, c long")


def sided(taken: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The logit of the side that was taken, by the counts of both."""
    return np.log((taken + PRIOR) / (other + PRIOR)).clip(-TOP, TOP).astype(np.float32)


def alone(of_class: np.ndarray) -> np.ndarray:
    """Logits without a context, (is in training, class, bit); a training token is left out of its own counts."""
    level = [of_class.reshape(1 << d, -1).sum(axis=1).repeat(CLASSES >> d) for d in range(BITS + 1)]
    return np.stack([[sided(np.maximum(level[d + 1] - own, 0), level[d] - level[d + 1]) for d in range(BITS)]
                     for own in (0, 1)]).transpose(0, 2, 1).copy()


def context_bits(words: int) -> int:
    """Bits of a token's hash in a corpus of so many different words."""
    return min(63 - 2 * BITS - EXTRA, max(20, words.bit_length() + SPARE))


# Of both kinds of paths the shifts that leave the nodes of each level: the context, the bits of the class (after them, for three
# tokens, what else tells the second one apart, and the bits of the third), and whether a training document has the path.
_THIRD = [*range(BITS, 0, -1)]
_SECOND = [*range(2 * BITS + EXTRA, BITS + EXTRA, -1)]
LEVELS = ([2 * BITS + EXTRA + 1, *_SECOND, BITS + 1, *_THIRD], [BITS + 1, *_THIRD])
# Levels whose decisions the last token and the last two tell; the token before the last.
LAST, LAST_TWO, BEFORE = slice(0, BITS), slice(BITS + 1, 2 * BITS + 1), slice(0, BITS)
NOTHING, START_OF_TEXT = np.uint64(0), np.uint64(1 << 40)


def paths(hashes: np.ndarray, first: np.ndarray, sizes: np.ndarray, train: np.ndarray, bits: int):
    """Paths of three tokens, one for each token as the third and one that ends each text; and paths of the token before the last.

    Token i of text t has the paths i + t, as the third, and i + t + 1, as the second.
    """
    text = np.repeat(np.arange(len(sizes)), sizes + 1)
    place = np.arange(len(text)) - (first + np.arange(len(sizes)))[text]
    at = np.arange(len(text)) - text
    wide = np.concatenate([hashes, np.zeros(1, hashes.dtype)]).astype(np.uint64)
    third = np.where(place < sizes[text], wide[at], NOTHING) & np.uint64(CLASSES - 1)
    second = np.where(place > 0, wide[at - 1], NOTHING)
    one = np.where(place > 1, wide[at - 2] + np.uint64(1), np.where(place > 0, NOTHING, START_OF_TEXT))
    code = (second & np.uint64(CLASSES - 1)) << np.uint64(EXTRA) | second >> np.uint64(BITS) & np.uint64((1 << EXTRA) - 1)
    named = lambda x, salt: mix64(x * SALTS[1] + SALTS[salt]) >> np.uint64(64 - bits)
    taught = train[at - (place == sizes[text])].astype(np.uint64)
    three = ((named(one, 1) << np.uint64(BITS + EXTRA) | code) << np.uint64(BITS) | third) << np.uint64(1) | taught
    two = (named(np.where(place > 1, one, NOTHING), 2) << np.uint64(BITS) | third) << np.uint64(1) | taught
    return three, two[place < sizes[text]]


def borders(bits: int, ranges: int, kind: int) -> np.ndarray:
    """Where each range of contexts begins among the paths of a kind; the paths of a context are in one."""
    return np.array([((k << bits) // ranges) << LEVELS[kind][0] for k in range(ranges)], np.uint64)


def parted(begins: np.ndarray, marks: np.ndarray, kind: int) -> np.ndarray:
    """Where ranges begin, and more of them in ranges with many marks.

    A new one is moved to the begin of the largest node around it that has few marks, so that it cuts no more levels than it must.
    """
    marks, most = np.sort(marks), max(1, WIDTH // STEP)
    at = np.append(np.searchsorted(marks, begins), len(marks))
    held = np.diff(at)
    pieces = np.where(2 * held > 3 * most, -(-held // most), 1)
    places = [at[k] + np.arange(1, pieces[k]) * held[k] // pieces[k] for k in np.flatnonzero(pieces > 1)]
    if not places:
        return begins
    new = marks[np.concatenate(places)]
    free = np.ones(len(new), bool)
    for shift in map(np.uint64, LEVELS[kind]):
        node, of = new >> shift, marks >> shift
        few = free & (4 * (np.searchsorted(of, node, "right") - np.searchsorted(of, node)) <= most)
        new[few] = node[few] << shift
        free &= ~few
    return np.unique(np.concatenate([begins, new]))


class Ranges:
    """Ranges of paths in which these meet; those of the second kind are numbered after those of the first.

    `depths` has for the begin of each range, and for the end of the last, of how many levels, from the contexts down, it cuts a node.
    """

    def __init__(self, bits: int, ranges: int, marks: list[np.ndarray] | None = None):
        self.begins = [borders(bits, ranges, kind) for kind in (0, 1)]
        if marks:
            self.begins = [parted(b, marks[kind], kind) for kind, b in enumerate(self.begins)]
        self.first = [0, len(self.begins[0])]
        self.depths = [np.append(sum((b & np.uint64((1 << shift) - 1)) > 0 for shift in LEVELS[kind]), 0)
                       for kind, b in enumerate(self.begins)]

    def of(self, part: int) -> tuple[int, int]:
        """The kind of a range, and its place among those of the kind."""
        kind = int(part >= self.first[1])
        return kind, part - self.first[kind]

    def cuts(self, kind: int, keys: np.ndarray, taught: np.ndarray) -> list[np.ndarray]:
        """Per border the training tokens of sorted paths in the nodes that it cuts, from the context down."""
        begins, depths, done = self.begins[kind], self.depths[kind], np.append(0, np.cumsum(taught))
        out = [done[:0]] * len(depths)
        inner = np.flatnonzero(depths)
        if len(inner):
            nodes = []
            for shift in LEVELS[kind]:
                rest = np.uint64((1 << shift) - 1)
                low = begins[inner] & ~rest
                nodes.append(done[np.searchsorted(keys, low | rest, "right")] - done[np.searchsorted(keys, low)])
            for k, counts in zip(inner.tolist(), np.transpose(nodes)):
                out[k] = counts[:depths[k]]
        return out

    def whole(self, part: int, level: int, keys: np.ndarray, sums: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """The sums of a level's nodes in a range; the first and the last one have whole counts in `cut` if they go on outside."""
        kind, at = self.of(part)
        shift, (low, high) = np.uint64(LEVELS[kind][level]), self.depths[kind][at:at + 2]
        if level < low and keys[0] >> shift == self.begins[kind][at] >> shift:
            sums[0] = cut[level]
        if level < high and keys[-1] >> shift == self.begins[kind][at + 1] >> shift:
            sums[-1] = cut[low + level]
        return sums


def slice_arrays(hashes: bytes, sizes: bytes, train: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, where texts begin, how long they are, and for every token if it is one of training."""
    sizes = np.frombuffer(sizes, "<u4").astype(np.int64)
    return (decoded(hashes), np.cumsum(sizes) - sizes, sizes, np.repeat(np.frombuffer(train, bool), sizes))


def squeezed(values: np.ndarray) -> bytes:
    """The bytes of an array under zstd, after their number."""
    data = values.tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def opened(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), kind)


def planes(values: np.ndarray) -> np.ndarray:
    """Byte by byte of all values, so that zeros lie side by side."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T


def packed(keys: np.ndarray) -> bytes:
    """Differences of sorted keys."""
    return squeezed(planes(np.diff(keys, prepend=np.uint64(0)).astype("<u8")))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(opened(data, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)


def small(values: np.ndarray) -> bytes:
    """Whole numbers that are mostly below 255: their number, a byte each, and then the others."""
    some = values >= 255
    return squeezed(np.concatenate([np.array([len(values)], "<u8").view(np.uint8), np.minimum(values, 255).astype(np.uint8),
                                    planes(values[some].astype("<u8")).ravel()]))


def small_opened(data: bytes) -> np.ndarray:
    raw = opened(data, np.uint8)
    n = 8 + int.from_bytes(raw[:8].tobytes(), "little")
    out = raw[8:n].astype(np.int64)
    out[raw[8:n] == 255] = raw[n:].reshape(8, -1).T.copy().view("<u8").ravel()
    return out


def coded(codes: np.ndarray, hashes: np.ndarray) -> bytes:
    """Tokens as ranks by frequency, and the hashes that these stand for; `hashes` are those of the codes."""
    counts = np.bincount(codes, minlength=len(hashes))
    some = np.flatnonzero(counts)
    some = some[np.argsort(hashes[some], kind="stable")]
    order = np.argsort(-counts[some], kind="stable")
    rank = np.zeros(len(hashes), "<u4")
    rank[some[order]] = np.arange(len(order))
    parts = squeezed(planes(rank[codes])), packed(hashes[some].astype(np.uint64)), squeezed(planes(counts[some].astype("<u4")))
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def decoded(data: bytes) -> np.ndarray:
    parts, at = [], 0
    for _ in range(3):
        size = int.from_bytes(data[at:at + 8], "little")
        parts.append(data[at + 8:at + 8 + size])
        at += 8 + size
    ranks, counts = (opened(p, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel() for p in (parts[0], parts[2]))
    return unpacked(parts[1]).astype(np.uint32)[np.argsort(-counts.astype(np.int64), kind="stable")][ranks]


class Tree:
    """Paths in blocks, sorted within each: the nodes of a level are runs of neighbours of a block."""

    def __init__(self, keys: np.ndarray, begins: np.ndarray, kind: int):
        self.keys, self.begins, self.levels = keys, begins, LEVELS[kind]
        self.own = (keys & np.uint64(1)).astype(np.int64)

    def nodes(self, level: int) -> np.ndarray:
        """Where the nodes of a level begin; level 0 are the contexts."""
        node = self.keys >> np.uint64(self.levels[level])
        fresh = np.append(True, node[1:] != node[:-1])
        fresh[self.begins] = True
        return np.flatnonzero(fresh)

    def asked(self, nodes: np.ndarray, above: np.ndarray) -> np.ndarray:
        """Nodes whose count is not known from above: something besides a path's own tokens has come so far."""
        return above[nodes] > np.minimum.reduceat(self.own, nodes)

    def runs(self, nodes: np.ndarray) -> np.ndarray:
        return np.diff(np.append(nodes, len(self.keys)))


BLOCKS = pa.schema([("part", pa.int32()), ("slice", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
MET = pa.schema([("slice", pa.int64()), ("part", pa.int32()), ("left", pa.binary())])


def meet_contexts(made: DataFrame, bits: int, ranges: Ranges | None = None) -> DataFrame:
    """Per slice and range of contexts: the counts of all training documents on the slice's paths.

    A slice sends every path once, with its count. Where the paths of a range meet, sorted, the counts of all nodes are sums
    over neighbours; those of nodes that a border of the range cuts are sums of what slices send before the counts of paths.
    The answer has, from the contexts down, the count of each context, and of each node that is asked what
    leaves the path there.
    """
    tasks = partitions(made.sparkSession)
    ranges = ranges or Ranges(bits, tasks * RANGES)

    def emit(batches):
        for b in batches:
            for row in b.to_pylist():
                for kind, keys in enumerate(paths(*slice_arrays(row["hashes"], row["sizes"], row["train"]), bits)):
                    keys, counts = np.unique(keys, return_counts=True)
                    at = np.append(np.searchsorted(keys, ranges.begins[kind]), len(keys)).tolist()
                    cuts = ranges.cuts(kind, keys, counts * (keys & np.uint64(1)).astype(np.int64))
                    sent = [(ranges.first[kind] + k, lo, hi, np.concatenate([low, high, counts[lo:hi]]))
                            for k, (lo, hi, low, high) in enumerate(zip(at, at[1:], cuts, cuts[1:]))
                            if hi > lo or low.any() or high.any()]
                    yield batch(BLOCKS, [x[0] for x in sent], [row["slice"]] * len(sent),
                                [packed(keys[lo:hi]) for _, lo, hi, _ in sent], [small(x[3]) for x in sent])

    def answer(part, of, packs, counts):
        kind, place = ranges.of(part)
        ends = int(ranges.depths[kind][place:place + 2].sum())
        counts = [*map(small_opened, counts)]
        cut = sum(c[:ends] for c in counts)
        keys = [*map(unpacked, packs)]
        some = [k for k, own in enumerate(keys) if len(own)]
        if not some:
            return
        begins = np.cumsum([0, *(len(keys[k]) for k in some)])
        tree = Tree(np.concatenate(keys), begins[:-1], kind)
        taught = np.concatenate([c[ends:] for c in counts]) * tree.own
        del keys, counts
        order = np.argsort(tree.keys, kind="stable")  # merges the blocks
        every = tree.keys[order]
        new = np.append(True, every[1:] != every[:-1])
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        taught = np.add.reduceat(taught[order], np.flatnonzero(new))
        whole = Tree(every[new], np.zeros(1, np.int64), kind)
        del order, every, new
        above, streams = None, []
        for level in range(len(tree.levels)):
            nodes = whole.nodes(level)
            sums = ranges.whole(part, level, whole.keys, np.add.reduceat(taught, nodes), cut)
            here = np.repeat(sums, whole.runs(nodes))[at]
            nodes = tree.nodes(level)
            if level:
                nodes = nodes[tree.asked(nodes, above)]
                gone = above[nodes] - here[nodes]
            else:
                gone = here[nodes]
            # In as few bytes as the counts take, as all levels are held.
            streams.append((gone.astype(np.min_scalar_type(int(gone.max(initial=0)))), np.searchsorted(nodes, begins).tolist()))
            above = here
        for lo in range(0, len(some), 64):
            left = [small(np.concatenate([values[to[k]:to[k + 1]] for values, to in streams]))
                    for k in range(lo, min(lo + 64, len(some)))]
            yield batch(MET, [of[k] for k in some[lo:lo + 64]], [part] * len(left), left)

    def meet(batches):
        part, held = None, ([], [], [])
        for b in batches:
            for row in b.to_pylist():
                if row["part"] != part and held[0]:
                    yield from answer(part, *held)
                    held = ([], [], [])
                part = row["part"]
                for column, name in zip(held, ("slice", "keys", "counts")):
                    column.append(row[name])
        if held[0]:
            yield from answer(part, *held)
        give_back()

    return (made.select("slice", "hashes", "sizes", "train")
            .mapInArrow(emit, "part int, slice long, keys binary, counts binary")
            .repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int")).sortWithinPartitions("part")
            .mapInArrow(meet, "slice long, part int, left binary"))


def logits_of(keys: np.ndarray, begins: np.ndarray, left: list[bytes], kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(paths, levels below the context) of blocks of sorted paths and their answers: logits of the sides taken, and which
    have counts. A token of a training document is left out of the counts that predict it."""
    levels = len(LEVELS[kind])
    logits, found = np.zeros((len(keys), levels - 1), np.float32), np.zeros((len(keys), levels - 1), bool)
    if not len(keys):
        return logits, found
    tree, values = Tree(keys, begins, kind), [*map(small_opened, left)]
    # Where the next value of each block lies among all of them.
    next_value = np.cumsum([0, *map(len, values[:-1])])
    values, above = np.concatenate(values), None
    for level in range(levels):
        nodes = tree.nodes(level)
        asked = np.flatnonzero(tree.asked(nodes, above)) if level else np.arange(len(nodes))
        held = np.diff(np.append(np.searchsorted(nodes[asked], begins), len(asked)))
        gone = np.zeros(len(nodes), np.int64)
        gone[asked] = values[np.repeat(next_value - np.cumsum(held) + held, held) + np.arange(len(asked))]
        next_value = next_value + held
        here = np.repeat(above[nodes] - gone if level else gone, tree.runs(nodes))
        if level:
            known = np.flatnonzero(above > tree.own)
            found[known, level - 1] = True
            logits[known, level - 1] = sided((here - tree.own)[known], (above - here)[known])
        above = here
    return logits, found


class Slice:
    """The tokens of a slice with the logits of all their decisions."""

    def __init__(self, row: dict, answers: list[tuple[int, bytes]], table: np.ndarray, bits: int, ranges: Ranges | int):
        ranges = Ranges(bits, ranges) if isinstance(ranges, int) else ranges
        self.hashes, self.first, self.sizes, self.train = slice_arrays(row["hashes"], row["sizes"], row["train"])
        self.table, self.where, self.logits, self.found = table, [], [], []
        self.text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        for kind, keys in enumerate(paths(self.hashes, self.first, self.sizes, self.train, bits)):
            every, where = np.unique(keys, return_inverse=True)
            own = sorted((place, left) for (of, place), left in ((ranges.of(part), left) for part, left in answers) if of == kind)
            at = np.searchsorted(every, ranges.begins[kind])[[place for place, _ in own]].astype(np.int64)
            shape = len(every), len(LEVELS[kind]) - 1
            logits, found = np.zeros(shape, np.float32), np.zeros(shape, bool)
            # Some ranges at a time, as counts take more room than the logits they give.
            for k in range(0, len(own), OPENED):
                lo, hi = at[k], at[k + OPENED] if k + OPENED < len(at) else len(every)
                logits[lo:hi], found[lo:hi] = logits_of(every[lo:hi], at[k:k + OPENED] - lo,
                                                        [left for _, left in own[k:k + OPENED]], kind)
            self.where.append(where)
            self.logits.append(logits)
            self.found.append(found)

    def groups(self):
        """Ranges of texts that go side by side."""
        return slices(self.sizes.tolist(), AT_ONCE)

    def inputs(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some texts, logits (tokens, orders, bits), whether the longest context was seen, and the sizes of texts."""
        some = slice(self.first[lo], self.first[hi - 1] + self.sizes[hi - 1])
        code = self.hashes[some] & np.uint32(CLASSES - 1)
        inputs = np.empty((len(code), ORDERS, BITS), np.float32)
        third = np.arange(some.start, some.stop) + self.text[some]
        inputs[:, 0] = self.table[self.train[some].astype(np.int64), code]
        inputs[:, 1] = self.logits[0][self.where[0][third + 1], LAST]
        inputs[:, 2] = self.logits[1][self.where[1][some], BEFORE]
        inputs[:, 3] = self.logits[0][self.where[0][third], LAST_TWO]
        return inputs, self.found[0][self.where[0][third], LAST_TWO], self.sizes[lo:hi]


def over_slices(made: DataFrame, met: DataFrame, finish, ddl: str) -> DataFrame:
    """`finish` of each slice's row and of the answers to it."""
    def run(batches):
        row, answers = None, []
        for b in batches:
            for i in range(b.num_rows):
                part = b.column(1)[i].as_py()
                if part < 0:
                    if row:
                        yield from finish(row, answers)
                    row, answers = b.slice(i, 1).to_pylist()[0], []
                else:
                    answers.append((part, b.column(2)[i].as_py()))
        if row:
            yield from finish(row, answers)
        give_back()

    none = F.lit(None).cast("binary")
    own = made.select("slice", F.lit(-1).alias("part"), none.alias("left"), "hashes", "sizes", "train", "refs")
    lacking = [none.alias(c) for c in ("hashes", "sizes", "train", "refs")]
    return (own.unionByName(met.select("*", *lacking)).repartition(partitions(made.sparkSession), "slice")
            .sortWithinPartitions("slice", "part").mapInArrow(run, ddl))


LEARNED = pa.schema([("at", pa.int32()), ("v", pa.int64())])
# Weights are summed as whole multiples of this, exactly in any order.
GRAIN = 1 << 20


def first_weights(made: DataFrame, met: DataFrame, table: np.ndarray, bits: int, ranges: Ranges) -> np.ndarray:
    """The mean of the last weights of the texts to learn from, by visits."""
    shared = made.sparkSession.sparkContext.broadcast(table)

    def finish(row, answers):
        own = Slice(row, answers, shared.value, bits, ranges)
        total = np.zeros(START.size + 2 * BITS, np.int64)
        for lo, hi in own.groups():
            _, ends, visits = follow(*own.inputs(lo, hi))
            total += np.concatenate([np.rint(ends * GRAIN).astype(np.int64).ravel(), visits.ravel()])
        yield batch(LEARNED, np.arange(len(total)), total)

    own = F.col("slice") % 2 == 1
    rows = (over_slices(made.where(own), met.where(own), finish, "at int, v long")
            .groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect())  # a few hundred rows
    sums = np.zeros(START.size + 2 * BITS)
    for r in rows:
        sums[r.at] = int(r.v)
    ends, visits = sums[:START.size].reshape(START.shape) / GRAIN, sums[START.size:].reshape(2, 1, BITS)
    return np.where(visits > 0, ends / np.maximum(visits, 1), START).astype(np.float32)


MIXED = pa.schema([("ref", pa.int64()), ("mixed", pa.float64())])


def mix(made: DataFrame, met: DataFrame, table: np.ndarray, start: np.ndarray, bits: int, ranges: Ranges) -> DataFrame:
    """(ref, mixed): the natural logarithm of the probability of all decisions of a document."""
    shared = made.sparkSession.sparkContext.broadcast((table, start))

    def finish(row, answers):
        table, start = shared.value
        own, refs = Slice(row, answers, table, bits, ranges), np.frombuffer(row["refs"], "<i8")
        for lo, hi in own.groups():
            yield batch(MIXED, refs[lo:hi], follow(*own.inputs(lo, hi), start)[0])

    return over_slices(made, met, finish, "ref long, mixed double")


def follow(inputs: np.ndarray, seen: np.ndarray, sizes: np.ndarray, start: np.ndarray = START):
    """Per text the natural logarithm of the probability of all its decisions, with weights that follow the errors.

    The texts go side by side, token by token. Also their last weights, times the visits of each, summed, and the visits.
    """
    order = np.argsort(-sizes, kind="stable")
    rank = np.empty(len(sizes), np.int64)
    rank[order] = np.arange(len(sizes))
    text = np.repeat(rank, sizes)
    place = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    turn = np.lexsort((text, place))
    # A decision has two sets of weights, by whether the longest context was seen; each follows its own errors.
    low, high = (np.repeat(w[None], len(sizes), axis=0) for w in start)
    right = np.empty((len(text), BITS), np.float32)  # the probabilities of what came
    at = 0
    for texts in np.bincount(place).tolist():
        some = turn[at:at + texts]
        x, gate = inputs.take(some, axis=0), seen.take(some, axis=0)[:, None]
        p = 1 / (1 + np.exp(-(np.where(gate, high[:texts], low[:texts]) * x).sum(axis=1).clip(-30, 30)))
        right[at:at + texts] = p
        x *= (RATE * (1 - p))[:, None]
        np.add(high[:texts], x, out=high[:texts], where=gate)
        np.add(low[:texts], x, out=low[:texts], where=~gate)
        at += texts
    out = np.bincount(text[turn], np.log(right).sum(axis=1, dtype=np.float64), len(sizes))
    gated = np.add.reduceat(seen, np.cumsum(sizes) - sizes, axis=0, dtype=np.int64)[order]
    visits = np.stack([sizes[order][:, None] - gated, gated])
    ends = (np.stack([low, high]).astype(np.float64) * visits[:, :, None]).sum(axis=1)
    return out[rank], ends, visits.sum(axis=1)


PARTS = pa.schema([("ref", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()),
                   ("known", pa.int64()), ("head", pa.float64()), ("model", pa.float64()),
                   ("words", pa.list_(pa.string())), ("times", pa.list_(pa.int32())), ("slice", pa.int64()),
                   ("hashes", pa.binary()), ("sizes", pa.binary()), ("train", pa.binary()), ("refs", pa.binary()),
                   ("marks", pa.list_(pa.binary()))])
PARTS_DDL = ("ref long, doc_id long, n_bytes long, n_tokens long, known long, head double, model double, "
             "words array<string>, times array<int>, slice long, hashes binary, sizes binary, train binary, refs binary, "
             "marks array<binary>")


class Lexicon(dict):
    """Words to dense ids, with hashes and the logarithms of frequent words; started anew when it has grown large."""

    LIMIT = 300_000

    def __init__(self, head: dict[bytes, float]):
        super().__init__()
        self.head = head
        self.names, self.hashes, self.logs = [], [], []

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self.names)
        self.names.append(word)
        self.hashes.append(zlib.crc32(word))
        self.logs.append(self.head.get(word, math.nan))
        return at

    def renew(self) -> None:
        if len(self.names) > self.LIMIT:
            self.clear()
            self.names, self.hashes, self.logs = [], [], []


def rare_words(rest: np.ndarray, owner: np.ndarray, codes: np.ndarray, lexicon: Lexicon, texts: int):
    """Per text its words that are not frequent, and how often each occurs, as list arrays."""
    size = len(lexicon.names) + 1
    found, times = np.unique(owner[rest] * size + codes[rest], return_counts=True)
    ends = np.searchsorted(found, np.arange(texts + 1) * size).astype(np.int32)
    words = pa.array([lexicon.names[k].decode("utf-8", "replace") for k in (found % size).tolist()], pa.string())
    return (pa.ListArray.from_arrays(pa.array(ends), words),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(times, pa.int32())))


def parts(docs: DataFrame, head: dict[bytes, float], spread: np.ndarray, one_of: int = 1, bits: int | None = None) -> DataFrame:
    """Per document what needs no join, frequent words, and its other words; and a row for each slice of documents.

    The slices of odd numbers are of training documents to learn first weights from, one of `one_of` by doc_id. With `bits` of a
    context's name, a slice has marks: of the paths of each kind one of `STEP`.
    """
    shared = docs.sparkSession.sparkContext.broadcast((head, spread))

    def run(batches):
        head, spread = shared.value
        lexicon, ref = Lexicon(head), TaskContext.get().partitionId() << 33
        for b in batches:
            learn = np.array(b.column(2).to_pylist(), bool)
            lengths = np.array([n or 0 for n in pc.binary_length(b.column(3)).to_pylist()], np.int64)
            for odd in (0, 1):
                index = np.flatnonzero(learn == odd)
                for lo, hi in slices(lengths[index].tolist(), SLICE):
                    some = b.take(pa.array(index[lo:hi]))
                    lexicon.renew()
                    rows = [tokens_of(t) for t in texts_of(some.column(3))]
                    sizes = np.array([len(r) for r in rows], np.int64)
                    codes = np.fromiter(map(lexicon.__getitem__, chain.from_iterable(rows)), np.int64, int(sizes.sum()))
                    first, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(rows)), sizes)
                    hash_of = np.array(lexicon.hashes, np.uint32)
                    hashes, logs = hash_of[codes], np.array(lexicon.logs)[codes]
                    rest = np.flatnonzero(np.isnan(logs))
                    words, times = rare_words(rest, owner, codes, lexicon, len(rows))
                    refs, none = np.arange(ref, ref + len(rows)), [None] * len(rows)
                    yield batch(PARTS, refs, some.column(0), lengths[index[lo:hi]], sizes,
                                sizes - np.bincount(owner[rest], minlength=len(rows)),
                                np.add.reduceat(np.nan_to_num(logs), first),
                                -np.add.reduceat(spread[hashes & np.uint32(CLASSES - 1)], first), words, times, *[none] * 6)
                    train, marks = ~np.array(some.column(1).to_pylist(), bool), None
                    if bits:
                        begin = int(mix64(np.array([2 * ref + odd], np.uint64))[0] % np.uint64(STEP))
                        marks = [keys[begin::STEP].astype("<u8").tobytes()
                                 for keys in paths(hashes, first, sizes, np.repeat(train, sizes), bits)]
                    yield batch(PARTS, *[[None]] * 9, [2 * ref + odd], [coded(codes, hash_of)], [sizes.astype("<u4").tobytes()],
                                [train.tobytes()], [refs.astype("<i8").tobytes()], [marks])
                    ref += len(rows)

    held = held_out(F.col("doc_id"))
    learn = ~held & (F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(one_of)) == 0)
    return (docs.select(F.col("doc_id").cast("long"), held.alias("held"), learn.alias("learn"), "text")
            .mapInArrow(run, PARTS_DDL))


def frequent(counts: DataFrame) -> float:
    """The least count of a frequent word, so that at most HEAD words are."""
    level = F.floor(F.log2("c") * 8).cast("int")
    found = counts.where(F.octet_length("word") <= HEAD_BYTES).groupBy(level.alias("level")).count().collect()  # <= 512
    total, least = 0, 1 << 62
    for row in sorted(found, key=lambda r: -r.level):
        total += row["count"]
        if total > HEAD:
            break
        least = row.level
    return least


def score(docs: DataFrame) -> DataFrame:
    """Scores of all documents by what those that are not held out teach."""
    with shuffles_go(docs.sparkSession):
        return _score(docs)


def _score(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    taught = docs.where(~held_out(F.col("doc_id"))).select("text")
    counts = stored(gather(taught).groupBy("word").agg(F.sum("c").alias("c")), "counts")
    klass = (F.crc32(F.col("word").cast("binary")) % CLASSES).cast("int")
    of_class = np.zeros((CLASSES, 2))
    for row in counts.groupBy(klass.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        of_class[row.k] = row.c, row.v
    total, distinct = (int(x) for x in of_class.sum(axis=0))
    level = F.floor(F.log2("c") * 8).cast("int")
    often = (level >= F.lit(frequent(counts))) & (F.octet_length("word") <= HEAD_BYTES)
    log = F.log10(F.col("c") + 1)
    table = counts.where(often).select("word", "c").toArrow()  # HEAD words at most
    head = {w.encode(): math.log10(c + 1) for w, c in zip(table["word"].to_pylist(), table["c"].to_pylist())}
    bits, none = context_bits(distinct), alone(of_class[:, 0])
    # In natural logarithms: what the class of a token takes away.
    every = parts(docs, head, np.log(of_class.sum(axis=1) + 1), max(1, total // (LEARN or total or 1)), bits)
    path, met_path = fresh(spark, "parts"), fresh(spark, "contexts")
    every = every.withColumn("whole", F.col("slice").isNull())
    every.write.partitionBy("whole").parquet(path)
    every = spark.read.schema(every.schema).parquet(path)
    of_docs, cut = every.where("whole"), every.where("not whole")
    rare = (of_docs.select("ref", F.explode(F.arrays_zip("words", "times")).alias("w"))
            .select("ref", F.col("w.words").alias("word"), F.col("w.times").alias("times")))
    tail = (rare.join(counts.where(~often).select("word", log.alias("log")), "word").groupBy("ref")
            .agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.col("log")).alias("tail")))
    own = of_docs.select("ref", "doc_id", "n_bytes", "n_tokens", "known", "head", "model")
    base = stored(own.join(tail, "ref", "left"), "base")
    # The words are summed up.
    drop(spark, f"{path}/whole=true")
    marks = cut.select("marks").toArrow()["marks"].to_pylist()  # two numbers for each STEP tokens
    ranges = Ranges(bits, partitions(spark) * RANGES, [np.frombuffer(b"".join(m[kind] for m in marks), "<u8") for kind in (0, 1)])
    with settings(spark, ROWS):
        met = written(meet_contexts(cut, bits, ranges), met_path)
        start = first_weights(cut, met, none, bits, ranges)
        mixed = stored(mix(cut, met, none, start, bits, ranges), "mixed")
    # The texts are scored.
    drop(spark, met_path)
    drop(spark, path)
    sums = F.col("head") + F.coalesce("tail", F.lit(0.0))
    return (base.join(mixed, "ref").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        F.round(sums - F.col("n_tokens") * math.log10(total + distinct + 1), 6).alias("base_score"),
        F.round((F.col("mixed") + F.col("model")) / math.log(10) + sums, 6).alias("score"), "n_bytes")
        .withColumn("bits_per_byte", F.when(F.col("n_bytes") > 0, -F.col("score") * math.log2(10) / F.col("n_bytes"))))

