import hashlib
import random

from ledgerlens.llm import fingerprints as fp
from ledgerlens.llm import queries

from .conftest import SMALL


def prose(draw, words):
    return " ".join("".join(draw.choice("aeioustrnlmd") for _ in range(draw.randint(1, 9))) for _ in range(words))


def phrases(text, level):
    import numpy as np

    symbols, owner = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64), np.zeros(len(text), np.int32)
    for _ in range(level):
        symbols, owner = fp.level_up(symbols, owner)
    return set(symbols.tolist())


def test_equal_substrings_share_phrases_at_any_offset():
    draw = random.Random(1)
    core = prose(draw, 400)
    for shift in range(1, 12):
        a, b = phrases(core, 3), phrases(prose(draw, 30)[:shift * 7] + core, 3)
        assert len(a - b) <= 4
    assert not phrases(core, 3) & phrases(prose(draw, 400), 3)


def test_phrases_are_short_and_shrink_level_by_level():
    text = prose(random.Random(2), 3000)
    sizes = [len(text), *(len(phrases(text, k)) for k in (1, 2, 3))]
    assert sizes[3] < len(text) / 10 and sizes[3] > len(text) / 120


def test_batches_do_not_matter(odd_texts):
    texts = [t or "" for t in odd_texts] + [prose(random.Random(k), k * 7) for k in range(40)]
    together = fp.fingerprint(texts)
    assert together == [fp.fingerprint([t])[0] for t in texts]
    assert together[texts.index("a b c d")] == together[len(texts) - texts[::-1].index("a b c d") - 1]


def test_likeness():
    draw = random.Random(4)
    a, b = prose(draw, 800), prose(draw, 800)
    x, y, mixed = fp.fingerprint([a, b, a[:len(a) * 3 // 4] + b[:len(a) // 4]])
    assert fp.likeness(x, x) == 1.0 and fp.likeness(x, y) < 0.05 and 0.35 < fp.likeness(x, mixed) < 0.85
    assert fp.likeness("", "") == 1.0 and fp.likeness("", x) == 0.0


def check(got, rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        changed = fp.edited(text, after)
        prints = fp.fingerprint([text, changed, after])
        want.append((-1 if i is None else i, len(text), hashlib.sha256(changed.encode()).hexdigest(), *prints[:2],
                     fp.likeness(*prints[:2]), fp.likeness(prints[0], prints[2])))
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == sorted(want)


def test_edits_over_partition_borders(documents, odd_texts):
    rows = [*enumerate(odd_texts), (3, "again"), (3, "again"), (None, "x"), (10**12, prose(random.Random(9), 500))]
    docs = documents(rows).withColumnRenamed("lang", "shard").withColumnRenamed("n_chars", "edge")
    check(fp.edit_likeness(docs).collect(), rows)
    check(fp.edit_likeness(documents([(4, "only one")])).collect(), [(4, "only one")])
    assert fp.edit_likeness(documents([])).count() == 0
    assert fp.edited("abcdefgh", "x") == "abcdefx"


def test_query_over_a_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = queries.op5_document_fingerprints(spark, SMALL).collect()
    check(got, rows)
    long = [r for r in got if r.n_chars > 400]
    assert sum(r.near_edited for r in long) / len(long) > 0.5 and sum(r.near_next for r in long) / len(long) < 0.1
    assert len(fp.fingerprints(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()) == len(rows)
