import random

from ledgerlens.llm import graph, ngramjoin, queries

from .brute import join_components
from .conftest import SMALL


def check(got, rows, **how):
    want = join_components(rows, **how)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def copies(draw, n_groups, size, words, edits):
    """Groups of a text and copies of it with some words changed, taken out or put in; some share a passage."""
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for g in range(n_groups):
        base = [f"w{draw.randint(0, 300)}" for _ in range(draw.randint(*words))]
        if g % 3 == 0:
            base[5:5] = passage
        for _ in range(size):
            text = list(base)
            for _ in range(draw.randint(0, edits)):
                at = draw.randrange(len(text))
                text[at:at + draw.randint(0, 2)] = [f"e{draw.randint(0, 10**6)}"] * draw.randint(0, 2)
            rows.append((len(rows), " ".join(text)))
    return rows


def test_groups_of_near_copies(documents):
    draw = random.Random(7)
    rows = copies(draw, 12, 25, (40, 160), 8) + [(1000 + i, " ".join(f"u{draw.randint(0, 500)}" for _ in range(90))) for i in range(40)]
    want = join_components(rows)
    assert 60 < len(set(want.values())) and len({c for _, c in want.values()}) < len(rows) - 60
    check(ngramjoin.join(documents(rows)).collect(), rows)
    check(ngramjoin.join(documents(rows), words=5, similarity=80).collect(), rows, words=5, similarity=80)
    check(ngramjoin.join(documents(rows), words=2, similarity=60).collect(), rows, words=2, similarity=60)


def test_short_texts_and_chains(documents):
    draw = random.Random(8)
    rows = [(i, " ".join(draw.choice("abc") for _ in range(draw.randint(0, 12)))) for i in range(250)]
    check(ngramjoin.join(documents(rows)).collect(), rows)
    chain = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(chain[i * 8:i * 8 + 200])) for i in range(25)]
    check(ngramjoin.join(documents(rows)).collect(), rows)


def test_one_large_group(documents):
    draw = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        text = list(base)
        for _ in range(draw.randint(0, 6)):
            text[draw.randrange(150)] = f"e{draw.randint(0, 10**6)}"
        rows.append((i, " ".join(text)))
    check(ngramjoin.join(documents(rows)).collect(), rows)


def test_odd_texts_and_repeated_rows(documents, odd_texts):
    rows = [*enumerate(odd_texts)]
    check(ngramjoin.join(documents(rows)).collect(), rows)
    more = [(5, "a b c"), (5, "a b c"), (None, "a b c"), (7, None), (8, "q r s t u v"), (None, "lone")]
    got = sorted(((r.doc_id, r.component_id) for r in ngramjoin.join(documents(more)).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (None, 5), (7, 7), (8, 8), (None, None)], key=str)
    assert ngramjoin.join(documents([])).count() == 0


def test_first_of_each_group_stays_with_all_columns(documents):
    rows = [(4, "a b c d e f"), (2, "A b c d e f"), (9, "x y"), (3, None), (1, None)]
    docs = documents(rows).withColumnRenamed("lang", "component_id").withColumnRenamed("source", "n_shingles")
    out = ngramjoin.keep_first(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 3, 9]


def test_components_of_long_paths_and_hubs(spark):
    links = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    random.Random(1).shuffle(links)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 101)} | {i: 500 for i in range(501, 560)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_over_a_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check(queries.op9_ngram_jaccard_join(spark, SMALL).collect(), rows)


def test_one_row_of_each_group_stays(documents):
    text, near, other = (" ".join(f"{c}{i}" for i in range(60)) for c in ("a", "a", "b"))
    near = near.replace("a59", "z")
    rows = [(5, text), (5, text), (3, near), (3, other), (None, text), (None, "lone " + other[::-1]), (None, other), (7, ""), (7, ""),
            (8, None), (9, other, "b"), (2, "q " * 80), (2, "q " * 80), (2, "q " * 80, "b")]
    out = ngramjoin.keep_first(documents(rows).withColumnRenamed("lang", "row").withColumnRenamed("n_chars", "root"))
    assert out.columns == ["doc_id", "text", "row", "source", "root"]
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    # Of the copies of `text` the near one has the smallest id; `other` stays where its id is smallest.
    assert got == sorted([(3, near), (3, other), (None, "lone " + other[::-1]), (7, ""), (7, ""), (8, None), (2, "q " * 80)], key=str)
    unknown = ngramjoin.keep_first(documents([(None, text), (None, text), (None, near)])).collect()
    assert len(unknown) == 1 and unknown[0].text in (text, near)
    assert ngramjoin.keep_first(documents([])).count() == 0


def test_a_shingle_in_a_third_of_all_documents(documents):
    draw = random.Random(11)
    common = " ".join(f"licence{i}" for i in range(20))
    rows = [(i, " ".join(f"u{draw.randint(0, 400)}" for _ in range(draw.randint(20, 60))) + (f" {common}" if i % 3 == 0 else ""))
            for i in range(300)]
    rows += [(1000 + i, rows[3 * i][1]) for i in range(20)]
    check(ngramjoin.join(documents(rows)).collect(), rows)
