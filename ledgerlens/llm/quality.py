"""Quality rules: hashed n-gram log-likelihood ratio between trusted and raw text.

Words and pairs of neighbouring words are hashed into `BUCKETS` buckets. Two multinomials over the buckets are
counted: the raw one over every document, the trusted one over documents labelled good and not toxic. A document's
score is the mean, over its n-grams, of log p_trusted - log p_raw, kept in whole millionths so that sums are exact in
any order. The cut is set on trusted documents that were held out from the counts. All labelled documents take part.

Defined results: a null or empty text has no words, score 0.0, and fails the base rule; documents with equal texts get
equal scores; repeated rows are scored each; a null doc_id is kept as null; with no labelled documents, or none held
out, the cut is minus infinity and only the base rule decides; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.ranks import value_ranks

from .common import SPACES, batch, kept, stored, text_slices

BUCKETS = 4096
# The SQL of op1 reads at most so many trusted documents, those with the smallest md5(doc_id); the operator reads all.
TRUSTED = 20_000
# Trusted documents whose md5(doc_id) starts with one of these digits are held out to set the cut.
HELD = "012"
# Ids of trusted documents are broadcast up to this number, some 20 bytes each, so that texts stay where they are.
FEW = 1_000_000
# The cut lies so many times (median - 5 % quantile) below the median of the held-out scores.
WIDTH = 2.5
SYMBOLS = b"#*$%&|<>"
SLICE = 1_500_000
FAR = -1e300

COLUMNS = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, score double, cut double, kept boolean")
SCORED = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()),
    ("score", pa.float64()), ("cut", pa.float64()), ("kept", pa.bool_())])


class Lexicon(dict):
    """Words to dense ids, with a 32-bit hash of each; started anew when it has grown large."""

    LIMIT = 250_000

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self.hashes)
        self.hashes.append(int.from_bytes(hashlib.md5(word).digest()[:4], "big"))
        return at

    def renew(self) -> None:
        if len(self.hashes) > self.LIMIT:
            self.clear()
            self.hashes.clear()


def split(texts: list[str], lexicon: Lexicon):
    """Per slice of texts: raw bytes, number of words of each, ids of all words, the owner of each word."""
    lexicon.renew()
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    words = [r.split() for r in raw]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    codes = np.fromiter(map(lexicon.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
    return raw, counts, codes, np.repeat(np.arange(len(texts)), counts)


def buckets(codes: np.ndarray, owner: np.ndarray, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words and word pairs, and whose they are."""
    hashed = np.array(lexicon.hashes, dtype=np.int64)[codes] if len(codes) else codes
    same = owner[1:] == owner[:-1]
    pairs = (hashed[:-1] * 1_000_003 + hashed[1:] + 7)[same]
    return np.concatenate([hashed, pairs]) % BUCKETS, np.concatenate([owner, owner[1:][same]])


def repeated(codes: np.ndarray, owner: np.ndarray, texts: int, lexicon: Lexicon) -> np.ndarray:
    """Per text, the words that lie in a three-word window found twice or more in it."""
    at = np.flatnonzero(owner[2:] == owner[:-2]) if len(codes) > 2 else np.empty(0, np.int64)
    if not len(at):
        return np.zeros(texts, np.int64)
    size = len(lexicon.hashes) + 1
    key = pd.factorize(codes[at] * size + codes[at + 1])[0]
    key = pd.factorize(key * size + codes[at + 2])[0]
    key = pd.factorize(key * texts + owner[at])[0]
    at = at[np.bincount(key)[key] > 1]
    inside = np.zeros(len(codes), bool)
    for step in range(3):
        inside[at + step] = True
    return np.bincount(owner[inside], minlength=texts)


def duplicate_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def fails(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def rate(texts: list[str], lexicon: Lexicon, weights: np.ndarray, cut: float):
    """Base figures, score and verdict of each text of a slice."""
    raw, n, codes, owner = split(texts, lexicon)
    bucket, whose = buckets(codes, owner, lexicon)
    total = np.zeros(len(texts), np.int64)
    np.add.at(total, whose, weights[bucket])
    score = total / np.maximum(np.bincount(whose, minlength=len(texts)), 1) / 1e6
    chars = [len(t) - (len(r) - len(r.translate(None, SPACES))) for t, r in zip(texts, raw)]
    symbols = [len(r) - len(r.translate(None, SYMBOLS)) for r in raw]
    again = repeated(codes, owner, len(texts), lexicon)
    failed = fails(n, again)
    return n, chars, symbols, [duplicate_lines(r) for r in raw], again, failed, score, ~failed & (score >= cut)


def count_grams(docs: DataFrame) -> DataFrame:
    """(bucket, raw, trusted) of documents (text, counted); summed in each task first."""
    schema = pa.schema([("bucket", pa.int64()), ("raw", pa.int64()), ("trusted", pa.int64())])

    def count(batches):
        lexicon, raw, trusted = kept("quality", Lexicon), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            marks = b.column(1).to_pylist()
            for lo, hi, texts in text_slices(b.column(0), SLICE):
                _, _, codes, owner = split(texts, lexicon)
                bucket, whose = buckets(codes, owner, lexicon)
                raw += np.bincount(bucket, minlength=BUCKETS)
                trusted += np.bincount(bucket[np.array(marks[lo:hi], bool)[whose]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield batch(schema, some, raw[some], trusted[some])

    return docs.mapInArrow(count, "bucket long, raw long, trusted long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def bucket_weights(counts: DataFrame) -> np.ndarray:
    """log p_trusted - log p_raw of each bucket in whole millionths; brings BUCKETS rows to the driver at most."""
    raw, trusted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():
        raw[r.bucket], trusted[r.bucket] = r.raw, r.trusted
    p_trusted, p_raw = (trusted + 1) / (trusted.sum() + BUCKETS), (raw + 1) / (raw.sum() + BUCKETS)
    return np.rint(1e6 * np.log(p_trusted / p_raw)).astype(np.int64)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, held) of the trusted documents."""
    digest = F.md5(F.col("doc_id").cast("string"))
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return (good.where("doc_id is not null and quality = 1 and toxic = 0")
            .select("doc_id", F.substring(digest, 1, 1).isin(*HELD).alias("held")))


def cut_of(scores: DataFrame) -> float:
    """The cut by the held-out scores: their ranks come from counts of equal ones, two rows reach the driver."""
    wanted = [F.floor(F.col("_n") / n).between(F.col("_before"), F.col("_before") + F.col("_ties") - 1) for n in (2, 20)]
    ranks = value_ranks(scores.withColumn("all", F.lit(0)), ["all"], "score")
    middle, low = ranks.agg(*(F.max(F.when(here, F.col("score"))) for here in wanted)).first()
    return FAR if middle is None else middle - WIDTH * (middle - low)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Weights of the buckets, from every document, and the cut on the score."""
    ids = stored(trusted_ids(labels), "trusted")
    few = ids.count() <= FEW
    marked = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left").select("doc_id", "text", "held")
    # Without a broadcast texts move once, and both readers find them marked.
    marked = marked if few else stored(marked, "marked")
    weights = bucket_weights(count_grams(marked.select("text", F.expr("held is not null and not held").alias("c"))))
    held = rated(marked.where("held"), weights, FAR).where("n_words > 0").select("score")
    return weights, cut_of(stored(held, "held"))


def rated(docs: DataFrame, weights: np.ndarray, cut: float) -> DataFrame:
    def score(batches):
        lexicon = kept("quality", Lexicon)
        for b in batches:
            for lo, hi, texts in text_slices(b.column(1), SLICE):
                n, chars, symbols, lines, again, failed, scores, passed = rate(texts, lexicon, weights, cut)
                yield batch(SCORED, b.column(0).slice(lo, hi - lo), n, chars, symbols, lines, again, failed, scores,
                            np.full(hi - lo, cut), passed)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, COLUMNS)


def rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base figures, score, cut and verdict of every document."""
    return rated(docs, *fit(docs, labels))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""
    weights, cut = fit(docs, labels)
    at = docs.columns.index("text")

    def choose(batches):
        lexicon = kept("quality", Lexicon)
        for b in batches:
            for lo, hi, texts in text_slices(b.column(at), SLICE):
                yield b.slice(lo, hi - lo).filter(pa.array(rate(texts, lexicon, weights, cut)[-1]))

    return docs.mapInArrow(choose, docs.schema)
