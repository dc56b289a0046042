import hashlib
import random
import re

import pytest

from ledgerlens.llm import decontaminate, queries

from .brute import lower
from .conftest import SMALL

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(lower(text))


def plain(text, bench, window=10):
    """Words, hit words, items and the spans of runs of hit words of a text, by comparing slices."""
    found = [m.span() for m in WORD.finditer(lower(text))]
    mine = words(text)
    hit, items = set(), set()
    for item, test in bench:
        theirs = words(test)
        n = min(window, len(theirs))
        slices = {tuple(theirs[i:i + n]) for i in range(len(theirs) - n + 1)} if n else set()
        for i in range(len(mine) - n + 1):
            if tuple(mine[i:i + n]) in slices:
                hit.update(range(i, i + n))
                items.add("" if item is None else str(item))
    runs = []
    for i in sorted(hit):
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return len(mine), len(hit), sorted(items), [(found[a][0], found[z][1]) for a, z in runs]


@pytest.fixture(scope="module")
def benchmark(spark):
    def build(rows):
        return spark.createDataFrame(rows, "item_id long, text string").repartition(2)

    return build


def texts(seed=4):
    """Items and documents of few words, so that windows, short items and passages meet often."""
    draw = random.Random(seed)
    common = ["a", "B", "é", "中文", "x9", "z" * 70, "word"]

    def prose(n):
        return "".join(draw.choice(common) + draw.choice([" ", "  ", "\n", "-", "\x00", " "]) for _ in range(n))

    items = [(k, prose(draw.randint(8, 40))) for k in range(20)]
    shared = prose(30)
    items += [(30, "one two"), (31, "One, TWO!"), (32, ""), (33, None), (None, "null item " + prose(12)), (34, "..."),
              (7, prose(15)), (35, shared), (36, shared), (37, "q " * 3 + shared)]
    docs = [None, "", "...", "one", "a one-two b", "oneTwo", "ONE two", prose(400), "lead " + items[0][1] + " tail",
            "É " + items[3][1] + " mid " + items[4][1], " ".join(t or "" for _, t in items[:9]), shared, shared[:20], "y" * 40_000,
            "pre " + shared * 3, "z" * 71 + " " + items[5][1], prose(5_000)]
    return docs, items


@pytest.mark.parametrize("limit", [decontaminate.LIMIT, 900])
def test_hits_items_and_spans(documents, benchmark, limit):
    docs, items = texts()
    rows = [*enumerate(docs), (4, docs[4]), (None, docs[9])]
    got = decontaminate.scan(documents(rows), benchmark(items), keep=("doc_id", "text"), limit=limit).collect()
    assert len(got) == len(rows) and any(r.n_hit for r in got)
    for r in got:
        assert (r.n_words, r.n_hit, r.items, [(s.start, s.end) for s in r.spans]) == plain(r.text, items)


def slices(words, n=10):
    n = min(n, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def test_blocks_hold_every_window(benchmark):
    items = [*texts()[1], (50, "long item " + " ".join(f"w{i}" for i in range(9_000)))]
    some = decontaminate.blocks(benchmark(items), 10, 50_000)
    assert len(some) > 2
    keys = [(r["item"], r["words"]) for t in some for r in t.to_pylist()]
    assert len(keys) == len(set(keys)) and sum(item == "50" for item, _ in keys) == 3
    every = [[*map(decontaminate.short, (t or "").encode().translate(decontaminate.FOLD).split())] for _, t in items]
    assert set().union(*(slices(words.split()) for _, words in keys)) == set().union(*map(slices, every))


def test_removal_keeps_all_else(spark, documents, benchmark):
    docs, items = texts()
    table = documents([*enumerate(docs)]).withColumnRenamed("lang", "own").withColumnRenamed("source", "items")
    out = decontaminate.remove_spans(table, benchmark(items))
    assert out.columns == table.columns
    for r in out.collect():
        text = docs[r.doc_id]
        want, at = "", 0
        for a, z in plain(text, items)[3]:
            want, at = want + text[at:a], z
        want = None if text is None else want + text[at:]
        assert r.text == want and r.n_chars == (None if text is None else len(want)) and r.own == "en"
    clean = {r.doc_id for r in decontaminate.remove_documents(table, benchmark(items)).collect()}
    assert clean == {i for i, t in enumerate(docs) if plain(t, items)[1] == 0}
    half = {r.doc_id for r in decontaminate.remove_documents(table, benchmark(items), share=0.5).collect()}
    assert half == {i for i, t in enumerate(docs) if 2 * plain(t, items)[1] <= plain(t, items)[0]} and half > clean


def test_empty_tables(documents, benchmark):
    docs, items = texts()
    assert decontaminate.scan(documents([]), benchmark(items)).count() == 0
    got = decontaminate.scan(documents([*enumerate(docs)]), benchmark([])).collect()
    assert len(got) == len(docs) and not any(r.n_hit or r["items"] or r.spans for r in got)


def test_query_over_a_whole_table(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op12_benchmark_decontamination(spark, SMALL).collect()
    assert len(got) == len(docs) and any(r.contaminated for r in got)
    for r in got:
        n, hit, found, _ = plain(docs[r.doc_id], items)
        digest = hashlib.sha256(",".join(found).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), digest, hit > 0)
