"""Byte-level BPE: encoding by longest matches and backtracking, and decoding.

Bytes are mapped to Latin-1, so that an automaton over strings gives the longest match that can start at a byte. A row
of tokens is what the merges would give exactly if each two neighbours are compatible, that is, if the merges turn the
bytes of the two into these two tokens and nothing else: no merge then ever crosses a border. So a piece is encoded from
the left by the longest match that is compatible with the token before it; where none is, the last token is given back for
its next shorter match, and a position once given up is not tried again. Compatibility of two tokens is memoised, as are
pieces and words that were met before, in memory of a fixed bound.

Text is cut into pieces by the published pattern; each piece is encoded apart.

Defined results: a null or empty text has no tokens and decodes to no bytes; equal texts have equal ids; rows are
encoded each, with whatever doc_id they have; other columns are kept by `encode` unless they are named like its results,
which replace them.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, WordTable, batch, file_bytes, kept, slices, text_slices

SLICE = 1_000_000
# Bounds of the memos of a worker: words, pieces, neighbours.
WORDS, PIECES, PAIRS = 400_000, 50_000, 200_000


def read_ranks(content: bytes) -> list[bytes]:
    """The tokens of a rank file by id."""
    ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, content.splitlines())}
    return [ranks[i] for i in range(len(ranks))]


class Codec:
    """Encoder and decoder of one vocabulary whose ids are its ranks."""

    def __init__(self, content: bytes, pattern: str):
        self.tokens = read_ranks(content)
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.latin = {t.decode("latin-1"): i for t, i in self.ids.items()}
        self.longest = max(map(len, self.tokens))
        self.find = regex.compile(pattern).findall
        self.compatible = Memo(self._compatible, PAIRS)
        self.pieces = Memo(self._piece, PIECES)
        self.encode_all = WordTable(lambda words: {w: self._word(w) for w in words}, self._text, WORDS).encode

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Built when first needed; decoding needs none."""
        automaton = ahocorasick.Automaton()
        for i, token in enumerate(self.tokens):
            automaton.add_word(token.decode("latin-1"), i)
        return automaton

    def merge(self, data: bytes) -> list[int]:
        """The merges themselves, for the few bytes of two tokens: again and again the leftmost pair of lowest rank."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ids.get(parts[i] + parts[i + 1], len(self.ids)), i) for i in range(len(parts) - 1))
            if rank == len(self.ids):
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def _compatible(self, pair: int) -> bool:
        """Of two neighbours, the left one in the upper bits."""
        left, right = pair >> 24, pair & 0xFFFFFF
        return self.merge(self.tokens[left] + self.tokens[right]) == [left, right]

    def encode_piece(self, data: bytes) -> list[int]:
        if (whole := self.ids.get(data)) is not None:
            return [whole]
        text, given_up, row = data.decode("latin-1"), set(), []
        known, compatible, reach, end = self.latin.get, self.compatible, self.automaton.longest_prefix, len(data)
        at, before, size = 0, -1, reach(text[:self.longest])
        while at < end:
            while size:
                token = known(text[at:at + size])
                if token is not None and at + size not in given_up and (before < 0 or compatible[before << 24 | token]):
                    break
                size -= 1
            if size:
                row.append((token, size))
                at, before = at + size, token
                if at < end:
                    size = reach(text[at:at + self.longest])
            else:  # back to the next shorter match of the token before
                given_up.add(at)
                _, size = row.pop()
                at -= size
                size -= 1
                before = row[-1][0] if row else -1
        return [token for token, _ in row]

    def _piece(self, piece: str) -> bytes:
        return np.array(self.encode_piece(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if word[0] == " ":  # letters, or letters and a sign, as most words are
            if word[1:].isalpha():
                return self._piece(word)
            if word[-1] in ",.;:!?" and word[1:-1].isalpha():
                return self.pieces[word[:-1]] + self.pieces[word[-1]]
        pieces = self.find(word)
        return self._piece(word) if len(pieces) == 1 else b"".join(map(self.pieces.__getitem__, pieces))

    def _text(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def codec(content: bytes, pattern: str) -> Codec:
    return kept((content, pattern), lambda: Codec(content, pattern))


def encode(docs: DataFrame, ranks: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and the ids of every whole text: `ids` (binary, little-endian unsigned 32-bit), `n_tokens`."""
    content = file_bytes(docs.sparkSession, ranks)
    chosen = docs.select(*(F.col(f"`{c}`") for c in keep if c not in ("ids", "n_tokens")), F.col("text").alias("_text"))

    def run(batches):
        own = codec(content.value, pattern)
        for b in batches:
            for lo, hi, texts in text_slices(b.column(b.num_columns - 1), SLICE):
                packed = own.encode_all(texts)
                some = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:-1], pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())],
                    names=[*b.schema.names[:-1], "ids", "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, f"{schema}, ids binary, n_tokens long")


DECODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Adds the bytes that the ids stand for."""
    content = file_bytes(encoded.sparkSession, ranks)

    def run(batches):
        own = codec(content.value, pattern)
        for b in batches:
            packed = b.column(2).to_pylist()
            for lo, hi in slices([len(p) for p in packed], 4 * SLICE):
                yield batch(DECODED, b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo),
                            b.column(2).slice(lo, hi - lo), [own.decode(p) for p in packed[lo:hi]])

    return (encoded.select(F.col("doc_id").cast("long"), "n_tokens", "ids")
            .mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary"))


HASHED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                    ("decoded_sha256", pa.string())])


def digests(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Hashes of the decimal ids of every document, and of the bytes that they decode to."""
    content = file_bytes(encoded.sparkSession, ranks)

    def run(batches):
        own = codec(content.value, pattern)
        names = [str(i) for i in range(len(own.tokens))]
        for b in batches:
            ids, decoded = [], []
            for packed in b.column(2).to_pylist():
                numbers = map(names.__getitem__, np.frombuffer(packed, "<u4").tolist())
                ids.append(hashlib.sha256(",".join(numbers).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(packed)).hexdigest())
            yield batch(HASHED, b.column(0), b.column(1), ids, decoded)

    return (encoded.select(F.col("doc_id").cast("long"), "n_tokens", "ids")
            .mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
