"""Token counts by compiled finite-state tokenizers.

Two deterministic transducers count the tokens of a text without making them.

The first cuts text into words. It reads classes of characters, has five states, and marks the characters that begin a
word. A text is read in chunks all at once: each chunk gives a map from the state before it to the state after it, the
maps compose through a parallel prefix scan, and with the states so found every chunk is read once more for its marks.

The second reads the bytes of a word. Its state is the longest end of what was read that some token could still extend,
with the last token of the encoding of each prefix inside that end. The next last token is the one that is compatible
with the token before it, where two tokens are compatible if the merges turn their symbols into these two tokens. Each
transition carries the number of tokens by which the encoding grows; the last byte, which ends the word, has transitions
of its own. States and transitions are compiled when first met, and compiled anew beyond a bound.

Defined results: a null or empty text has 0 bytes and 0 tokens; equal texts have equal counts; rows are counted each,
with whatever doc_id they have; other columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, batch, file_bytes, kept, slices, texts_of

SLICE = 1_000_000
CHUNK = 512
STATES, WORDS, PAIRS = 100_000, 300_000, 400_000

# Classes of characters; an apostrophe that begins a contraction of one or two letters has a class of its own.
SPACE, LETTER, NUMBER, OTHER, SHORT, LONG = range(6)
# States: between words, in letters, in signs, one or two characters before the end of a contraction.
FREE, LETTERS, SIGNS, ONE_LEFT, TWO_LEFT = range(5)
NEXT = np.zeros((5, 6), np.uint8)
for _state in (FREE, LETTERS, SIGNS):
    NEXT[_state] = [FREE, LETTERS, FREE, SIGNS, ONE_LEFT, TWO_LEFT]
NEXT[SIGNS, [SHORT, LONG]] = SIGNS
NEXT[ONE_LEFT], NEXT[TWO_LEFT] = FREE, ONE_LEFT
BEGINS = np.zeros((5, 6), bool)
BEGINS[[FREE, LETTERS, SIGNS], 1:] = True
BEGINS[LETTERS, LETTER] = BEGINS[SIGNS, OTHER] = BEGINS[SIGNS, SHORT] = BEGINS[SIGNS, LONG] = False
STEP = NEXT.ravel()
BEGIN = BEGINS.ravel()

# White space of the Unicode property of this name.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def class_table() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    table[WHITE] = SPACE
    return table


def classes(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of every character, contractions marked."""
    out = table[points]
    for at in np.flatnonzero(points == 0x27).tolist():
        after = points[at + 1:at + 3].tolist()
        if after and chr(after[0]) in "stmd":
            out[at] = SHORT
        elif len(after) == 2 and chr(after[0]) + chr(after[1]) in ("re", "ve", "ll"):
            out[at] = LONG
    return out


def scan(maps: np.ndarray) -> np.ndarray:
    """Maps composed with all maps before them, in as many steps as their number has binary digits."""
    done, reach = maps, 1
    while reach < len(maps):
        done = np.concatenate([done[:reach], np.take_along_axis(done[reach:], done[:-reach], axis=1)])
        reach *= 2
    return done


def marks(kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Which characters begin a word."""
    pad = -len(kinds) % chunk
    columns = np.concatenate([kinds, np.zeros(pad, np.uint8)]).reshape(-1, chunk).T.copy()
    maps = np.tile(np.arange(5, dtype=np.uint8), (columns.shape[1], 1))
    for column in columns:
        maps = STEP[maps * np.uint8(6) + column[:, None]]
    state = np.zeros(columns.shape[1], np.uint8)
    state[1:] = scan(maps)[:-1, FREE]
    out = np.empty(columns.shape, bool)
    for row, column in zip(out, columns):
        key = state * np.uint8(6) + column
        row[:] = BEGIN[key]
        state = STEP[key]
    return out.T.ravel()[:len(kinds)]


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordCounter:
    """The transducer of words. A symbol is a byte, or 256 + a byte where the word ends."""

    def __init__(self, content: bytes):
        model = json.loads(content)["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_alphabet()
        self.base = [ids[letters[b]] for b in range(256)] + [ids[letters[b] + end] for b in range(256)]
        symbols = {i: (s,) for s, i in enumerate(self.base)}
        self.rules = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            made = ids[a + b]
            self.rules[ids[a], ids[b]] = (rank, made)
            symbols.setdefault(made, symbols[ids[a]] + symbols[ids[b]])
        self.symbols = symbols
        self.tokens = {s: i for i, s in symbols.items()}
        self.prefixes = {s[:n] for s in self.tokens for n in range(len(s))}
        self.whole = Memo(lambda token: self.merge(self.symbols[token]) == [token], PAIRS)
        self.compatible = Memo(
            lambda pair: self.merge(self.symbols[pair[0]] + self.symbols[pair[1]]) == [*pair], PAIRS)
        self.counts = Memo(self.count, WORDS)
        self.start()

    def start(self) -> None:
        self.keys = [((), (-1,), (0,))]
        self.numbers = {self.keys[0]: 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def merge(self, symbols: tuple[int, ...]) -> list[int]:
        parts = [self.base[s] for s in symbols]
        none = (len(self.rules), -1)
        while len(parts) > 1:
            (rank, made), at = min((self.rules.get((parts[i], parts[i + 1]), none), i) for i in range(len(parts) - 1))
            if made < 0:
                break
            parts[at:at + 2] = [made]
        return parts

    def move(self, state: int, symbol: int) -> tuple[int, int]:
        """The next state and the tokens that the encoding grows by; compiled here when first met."""
        read, lasts, counts = self.keys[state]
        read += (symbol,)
        for at in range(len(read)):
            token = self.tokens.get(read[at:])
            if token is not None and (self.whole[token] if lasts[at] < 0 else self.compatible[lasts[at], token]):
                break
        grown = counts[at] + 1
        if symbol >= 256:
            found = (0, grown)
        else:
            lasts, counts = (*lasts, token), (*counts, grown)
            drop = 0
            while read[drop:] not in self.prefixes:
                drop += 1
            key = (read[drop:], lasts[drop:], tuple(c - grown for c in counts[drop:]))
            if key not in self.numbers:
                self.numbers[key] = len(self.keys)
                self.keys.append(key)
                self.moves.append({})
            found = (self.numbers[key], grown)
        self.moves[state][symbol] = found
        return found

    def count(self, word: str) -> int:
        if len(self.keys) > STATES:
            self.start()
        *body, last = word.encode("utf-8", "surrogatepass")
        state = total = 0
        for symbol in (*body, 256 + last):
            state, grown = self.moves[state].get(symbol) or self.move(state, symbol)
            total += grown
        return total


class Counter:
    """Counts of the tokens of texts, with the normal forms and special tokens of one vocabulary file."""

    def __init__(self, content: bytes):
        special = [t["content"] for t in json.loads(content)["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.words = WordCounter(content).counts
        self.table = class_table()

    def normal(self, text: str) -> tuple[str, int]:
        """The text as its words are read, and its special tokens, which part words like white space."""
        text, found = self.special.subn("\n", text)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each letter lowered by itself
        return text.lower(), found

    def count(self, texts: list[str]) -> np.ndarray:
        forms, found = zip(*map(self.normal, texts))
        joined = "\n".join(forms)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = classes(points, self.table)
        begins = marks(kinds) if len(kinds) else np.zeros(0, bool)
        starts = np.flatnonzero(begins)
        borders = np.append(np.flatnonzero(begins | (kinds == SPACE)), len(kinds))
        ends = borders[np.searchsorted(borders, starts, side="right")]
        words = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        counts = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        firsts = np.cumsum([0, *(len(f) + 1 for f in forms[:-1])])
        owner = np.searchsorted(firsts, starts, side="right") - 1
        out = np.array(found, np.int64)
        np.add.at(out, owner, counts)
        return out


def counter(content: bytes) -> Counter:
    return kept(("counts", content), lambda: Counter(content))


COUNTED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more tokens than the limit."""
    content = file_bytes(docs.sparkSession, vocabulary)

    def run(batches):
        own = counter(content.value)
        for b in batches:
            texts = texts_of(b.column(1))
            for lo, hi in slices([len(t) for t in texts], SLICE):
                n = own.count(texts[lo:hi])
                size = [len(t.encode("utf-8", "surrogatepass")) for t in texts[lo:hi]]
                yield batch(COUNTED, b.column(0).slice(lo, hi - lo), size, n, n > limit)

    return (docs.select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"))
