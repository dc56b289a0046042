"""Divergence of sources: how far the term shares of the sources of a language lie apart, and which terms mark a source.

Terms are runs of letters and characters beyond ASCII, A-Z lower-cased. A language keeps the terms of at least `LEAST` of its
documents. A (lang, source) group gives each kept term the share p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)),
also those that it never has: these have all the same share, its zero share.

Two groups are compared by Gustavson's row accumulation. The term-major index, the entries of a term side by side, is cut into
blocks of terms. In a block a group takes its terms one after the other, looks up the entries of the term, and adds to a dense
accumulator with one place per peer; no pair of entries is ever a row. The accumulator takes a term that both have as
|p - q| - |p - zero of the peer| - |q - zero of the group| + |zero - zero|. What a group's own terms differ from the peer's zero
share follows from the sorted shares and their running sums, and the terms that neither has are added at the end, so the sum
over all kept terms comes out without a dense row. Sums of blocks are added up by Spark. All sums are whole numbers below
2^53, so that floating-point accumulators hold them exactly.

Counts are gathered per task, and what travels is a row per term and group of a task. A language with more entries has more blocks
of terms; beyond `PEERS` groups its groups are cut into blocks too, and every two of these meet.

Defined results: null text, lang and source are empty texts; a group whose documents have no terms is a peer like any other; a
language without kept terms has pairs with value 0 and no terms; repeated rows count each; a language with one source has
no pairs; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, stored, text_slices

LEAST, SMOOTH, SCALE = 30, 5, 1_000_000_000
TERMS = 50
SLICE, FLUSH = 2_000_000, 300_000
# Groups of a block; entries of a block of terms, at least and at most. Between these they are the pairs of a block, so that sums
# that travel are no more than entries.
PEERS, FEWEST, MOST = 1024, 1 << 14, 1 << 21
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))
GATHERED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("c", pa.int64()),
                      ("docs", pa.int64())])


def group_of(docs: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def gather(docs: DataFrame) -> DataFrame:
    """Occurrences and documents of each term of a group, as far as a task has met them."""
    def run(batches):
        counts, inside = defaultdict(Counter), defaultdict(Counter)
        for b in batches:
            langs, sources = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, _, texts in text_slices(b.column(2), SLICE):
                for at, text in enumerate(texts, start=lo):
                    words = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
                    key = langs[at], sources[at]
                    counts[key].update(words)
                    inside[key].update(set(words))
                if sum(map(len, counts.values())) > FLUSH:
                    yield from spill(counts, inside)
                    counts.clear()
                    inside.clear()
        yield from spill(counts, inside)

    def spill(counts, inside):
        for (lang, source), found in counts.items():
            terms = [*found]
            for lo in range(0, len(terms), 50_000):
                some = terms[lo:lo + 50_000]
                yield batch(GATHERED, [lang] * len(some), [source] * len(some), [t.decode("utf-8", "replace") for t in some],
                            [found[t] for t in some], [inside[lang, source][t] for t in some])

    return docs.select(*group_of(docs), "text").mapInArrow(
        run, "lang string, source string, term string, c long, docs long")


def entries(docs: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, c, of_lang, leads) of kept terms; `leads` marks one entry of each term of a language."""
    term = Window.partitionBy("lang", "term")
    summed = (gather(docs).repartition("lang", "term").groupBy("lang", "term", "source")
              .agg(F.sum("c").alias("c"), F.sum("docs").alias("docs")))
    return (summed.withColumns({"in_docs": F.sum("docs").over(term), "of_lang": F.sum("c").over(term),
                                "leads": F.col("source") == F.min("source").over(term)})
            .where(F.col("in_docs") >= least).select("lang", "source", "term", "c", "of_lang", "leads"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), by long division in steps that stay within 64 bits."""
    bottom, rest = total + SMOOTH * terms, count + SMOOTH
    value = F.call_function("div", rest, bottom)
    for _ in range(3):
        rest = rest % bottom * 1000
        value = value * 1000 + F.call_function("div", rest, bottom)
    return value + 1


def groups(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Every group with its number in its language, its sums and its zero share, and the sums of the language."""
    sums = found.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.count("*").alias("own_terms"))
    per_lang = found.groupBy("lang").agg(F.sum("c").alias("lang_n"), F.count_if("leads").alias("terms"),
                                         F.count("*").alias("entries"))
    known = (docs.select(*group_of(docs)).distinct().join(sums, ["lang", "source"], "left").join(per_lang, "lang", "left")
             .na.fill(0, ["n", "own_terms", "lang_n", "terms", "entries"]))
    lang = Window.partitionBy("lang")
    return known.withColumns({
        "no": F.row_number().over(lang.orderBy("source")).cast("int") - 1, "size": F.count("*").over(lang).cast("int"),
        "zero": F.when(F.col("terms") > 0, share(F.lit(0), F.col("n"), F.col("terms"))).otherwise(0)})


def with_blocks(rows: DataFrame, peers: int, fewest: int) -> DataFrame:
    """`low` and `high`, the two blocks of groups that meet, and `cuts`, in how many blocks the terms of the language lie."""
    parts = F.ceil(F.col("size") / peers).cast("int")
    own = F.floor(F.col("no") / peers).cast("int")
    side = F.least(F.col("size"), F.lit(peers)).cast("long")
    at_once = F.greatest(F.lit(fewest), F.least(F.lit(MOST), side * side))
    return (rows.withColumn("cuts", F.greatest(F.lit(1), F.ceil(F.col("entries") / at_once)).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
            .withColumns({"low": F.least(own, F.col("other")), "high": F.greatest(own, F.col("other"))}))


SUMS = pa.schema([("lang", pa.string()), ("one", pa.int32()), ("two", pa.int32()), ("value", pa.int64())])


def beyond(shares: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Of sorted shares, the sum of their distances to each zero share."""
    running = np.append(0, np.cumsum(shares))
    below = np.searchsorted(shares, zeros)
    return zeros * below - running[below] + running[-1] - running[below] - zeros * (len(shares) - below)


def accumulate(table: pa.Table) -> pa.Table:
    """For every two groups of a block of terms: the differences over terms that one of them has, corrected as said above."""
    lang = table.column("lang")[0].as_py()
    low, high = (np.int64(table.column(c)[0].as_py()) for c in ("low", "high"))
    marks = table.filter(pc.is_null(table.column("term")))
    order = np.argsort(numbers := marks.column("no").to_numpy())
    numbers, zeros = numbers[order], marks.column("zero").to_numpy()[order]
    part = marks.column("part").to_numpy()[order]
    rows = table.filter(pc.is_valid(table.column("term")))
    code = np.asarray(rows.column("term").combine_chunks().dictionary_encode().indices)
    group = np.searchsorted(numbers, rows.column("no").to_numpy())
    p = rows.column("p").to_numpy()
    # Term-major: the entries of term t are those from starts[t] on.
    major = np.argsort(code, kind="stable")
    peer_of, p_of = group[major], p[major]
    starts = np.append(0, np.cumsum(np.bincount(code)))
    # Group-major: the terms of group g.
    mine = np.argsort(group, kind="stable")
    ends = np.append(0, np.cumsum(np.bincount(group, minlength=len(numbers))))
    own_of = [mine[a:z] for a, z in zip(ends[:-1], ends[1:])]
    rest = np.stack([beyond(np.sort(p[own]), zeros) for own in own_of])
    sides = np.flatnonzero(part == low), np.flatnonzero(part == high)
    one, two, value = [], [], []
    for g in sides[0].tolist():
        own = own_of[g]
        at, counts = starts[code[own]], starts[code[own] + 1] - starts[code[own]]
        places = np.repeat(at - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        peers, q, mine_p = peer_of[places], p_of[places], np.repeat(p[own], counts)
        step = (np.abs(mine_p - q) - np.abs(mine_p - zeros[peers]) - np.abs(q - zeros[g]) + np.abs(zeros[g] - zeros[peers]))
        total = np.bincount(peers, step, len(numbers)).astype(np.int64) + rest[g] + rest[:, g]
        others = sides[1][sides[1] > g] if low == high else sides[1]
        one.append(np.full(len(others), numbers[g]))
        two.append(numbers[others])
        value.append(total[others])
    one, two, value = (np.concatenate([np.empty(0, np.int64), *x]) for x in (one, two, value))
    return pa.table([pa.array([lang] * len(one), pa.string()), pa.array(one, pa.int32()), pa.array(two, pa.int32()),
                     pa.array(value, pa.int64())], schema=SUMS)


def pairs(known: DataFrame, shared: DataFrame, peers: int, fewest: int) -> DataFrame:
    """(lang, source, item, value) for every group and every other source of its language."""
    cut = F.pmod(F.xxhash64("term"), F.col("cuts")).cast("int")
    part = F.floor(F.col("no") / peers).cast("int").alias("part")
    some = with_blocks(shared, peers, fewest).select("lang", "low", "high", cut.alias("cut"), "no", part, "term", "p",
                                                     F.lit(None).cast("long").alias("zero"))
    marks = with_blocks(known, peers, fewest).select(
        "lang", "low", "high", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), "no", part,
        F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"), "zero")
    sums = (some.unionByName(marks).groupBy("lang", "low", "high", "cut")
            .applyInArrow(accumulate, "lang string, one int, two int, value long")
            .groupBy("lang", "one", "two").agg(F.sum("value").alias("value")))
    side = known.select("lang", "no", "source", "own_terms", "zero", "terms")
    for name, place in (("a", "one"), ("b", "two")):
        sums = sums.join(side.select("lang", F.col("no").alias(place), *(
            F.col(c).alias(f"{name}_{c}") for c in ("source", "own_terms", "zero", "terms"))), ["lang", place])
    neither = F.col("a_terms") - F.col("a_own_terms") - F.col("b_own_terms")
    full = F.col("value") + neither * F.abs(F.col("a_zero") - F.col("b_zero"))
    both = F.array(*(F.struct(F.col(x).alias("source"), F.col(y).alias("item"))
                     for x, y in (("a_source", "b_source"), ("b_source", "a_source"))))
    return sums.select("lang", full.alias("value"), F.explode(both).alias("way")).select("lang", "way.*", "value")


def ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"),
                       F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, least: int = LEAST, terms: int = TERMS, peers: int = PEERS, fewest: int = FEWEST) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs of sources of a language, and the `terms` first terms of each group."""
    found = stored(entries(docs, least), "entries")
    known = stored(groups(docs, found), "groups")
    shared = (found.join(known.select("lang", "source", "no", "size", "n", "lang_n", "terms", "entries"), ["lang", "source"])
              .withColumn("p", share(F.col("c"), F.col("n"), F.col("terms"))))
    pair = ranked(pairs(known, shared, peers, fewest), "pair")
    more = F.col("p") - share(F.col("of_lang"), F.col("lang_n"), F.col("terms"))
    term = shared.select("lang", "source", F.col("term").alias("item"), more.alias("value")).where("value > 0")
    return pair.unionByName(ranked(term, "term").where(F.col("rank") <= terms))
