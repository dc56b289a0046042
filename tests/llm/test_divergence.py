import random
import re
from collections import Counter

import pytest

from ledgerlens.llm import divergence

from .brute import lower

WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, least, terms):
    """The audit of (text, lang, source) rows by dense tables of shares."""
    rows = [(WORD.findall(lower(t)), lang or "", source or "") for t, lang, source in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        of_lang = [r for r in rows if r[1] == lang]
        inside = Counter(w for words, *_ in of_lang for w in set(words))
        kept = [w for w, n in inside.items() if n >= least]

        def shares(words):
            counts = Counter(w for w in words if w in set(kept))
            bottom = counts.total() + divergence.SMOOTH * len(kept)
            return counts, {w: 1 + divergence.SCALE * (counts[w] + divergence.SMOOTH) // bottom for w in kept}

        groups = {s: shares([w for words, _, x in of_lang if x == s for w in words]) for s in {r[2] for r in of_lang}}
        _, q = shares([w for words, *_ in of_lang for w in words])
        for source, (counts, p) in groups.items():
            apart = [(-sum(abs(p[w] - other[w]) for w in kept), s) for s, (_, other) in groups.items() if s != source]
            marks = [(q[w] - p[w], w) for w in kept if counts[w] and p[w] > q[w]]
            for part, found in (("pair", sorted(apart)), ("term", sorted(marks)[:terms])):
                out |= {(lang, source, part, item, -value, k) for k, (value, item) in enumerate(found, start=1)}
    return out


def some_rows():
    draw = random.Random(5)
    names = ["a", "B", "é", "straße", "中文", "word", "Word", "rare", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = [(" ".join(draw.choices(names, k=draw.randint(1, 40))) + draw.choice(["", "1x2", "\x00y"]),
             draw.choice(["en", "en", "de", None]), draw.choice(["s1", "s2", "s3", "s10", "é", None])) for _ in range(150)]
    rows += [("onlyhere onlyhere", "en", "lone"), ("", "en", "empty"), (None, "en", "none"), ("1 2 3", "xx", "p"), ("- -", "xx", "q"),
             ("solo", "one", "source"), (rows[0][0], *rows[0][1:]), ("long " * 5_000, "de", "s1")]
    return rows


@pytest.mark.parametrize("peers, fewest", [(divergence.PEERS, divergence.FEWEST), (2, 8), (3, 1)])
def test_audit_against_dense_tables(spark, peers, fewest):
    rows = some_rows()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    got = divergence.audit(docs.selectExpr("*", "1 as term", "2 as p"), least=5, terms=6, peers=peers, fewest=fewest).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == plain(rows, 5, 6)


def test_no_rows_and_no_terms(spark):
    schema = "text string, lang string, source string"
    assert divergence.audit(spark.createDataFrame([], schema)).count() == 0
    rows = [("a b", "en", "x"), ("a", "en", "y"), (None, None, None)]
    got = {tuple(r) for r in divergence.audit(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}


def test_shares_of_large_counts(spark):
    cases = [(9, 9, 1), (123_456_789_012, 4_000_000_000_000_000, 70_000), (0, 10**15, 10**6), (10**15, 10**15, 3)]
    rows = spark.createDataFrame(cases, "c long, n long, v long")
    got = [r.p for r in rows.select(divergence.share(rows.c, rows.n, rows.v).alias("p")).collect()]
    assert got == [1 + divergence.SCALE * (c + 5) // (n + 5 * v) for c, n, v in cases]
