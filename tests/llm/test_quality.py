import math
import re
from collections import Counter

from ledgerlens.llm import quality

from .brute import md5_int

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def grams(text):
    hashes = [md5_int(w) for w in WORD.findall(text or "")]
    return [h % quality.BUCKETS for h in hashes] + [
        (a * 1_000_003 + b + 7) % quality.BUCKETS for a, b in zip(hashes, hashes[1:])]


def test_base_figures_of_odd_texts(documents, odd_texts, spark):
    labels = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    texts = [*odd_texts, "a b c a b c\na b c\n\n \na b c a", "x x x x", "p | q\np | q\r\np | q"]
    got = {r.doc_id: r for r in quality.rules(documents(texts), labels).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r, want = got[i], base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(text)[:80]
        assert r.base_failed == (want[0] < 50 or 2 * want[4] > want[0])
        assert r.kept == (not r.base_failed)  # no labels, no cut


def test_scores_and_cut_against_brute_force(spark, documents):
    import random

    draw = random.Random(3)
    good = [" ".join(draw.choice(["the", "of", "and", "sea", "ship", "sail"]) for _ in range(80)) for _ in range(60)]
    bad = [" ".join(draw.choice(["BUY", "NOW!!", "the", "###"]) for _ in range(80)) for _ in range(15)]
    texts = good + bad
    labels = [(i, int(i < len(good)), 0) for i in range(0, len(texts), 2)] + [(1, 1, 1), (None, 1, 0)]
    got = {r.doc_id: r for r in quality.rules(
        documents(texts), spark.createDataFrame(labels, "doc_id long, quality long, toxic long")).collect()}
    trusted = sorted((i for i, q, t in labels if q and not t and i is not None), key=lambda i: quality.hashlib.md5(str(i).encode()).hexdigest())
    held = [i for i in trusted if quality.hashlib.md5(str(i).encode()).hexdigest()[0] in quality.HELD]
    raw = Counter(g for t in texts for g in grams(t))
    kind = Counter(g for i in trusted if i not in held for g in grams(texts[i]))
    n_raw, n_kind = sum(raw.values()) + quality.BUCKETS, sum(kind.values()) + quality.BUCKETS
    weight = {g: round(1e6 * math.log(((kind[g] + 1) / n_kind) / ((raw[g] + 1) / n_raw))) for g in raw}
    score = [sum(weight[g] for g in grams(t)) / len(grams(t)) / 1e6 for t in texts]
    for i, s in enumerate(score):
        assert abs(got[i].score - s) < 1e-9
    ranked = sorted(score[i] for i in held)
    middle, low = ranked[len(ranked) // 2], ranked[len(ranked) // 20]
    assert abs(got[0].cut - (middle - quality.WIDTH * (middle - low))) < 1e-9
    assert all(got[i].kept == (not got[i].base_failed and got[i].score >= got[i].cut) for i in range(len(texts)))
    # Junk of few words repeats its windows as well; the score alone tells it apart.
    assert max(got[i].score for i in range(len(good), len(texts))) < min(got[i].score for i in range(len(good)))


def test_keep_keeps_all_columns_and_rows_that_pass(spark, documents):
    text = " ".join(f"w{i}" for i in range(60))
    docs = documents([(1, text), (1, text), (None, text), (2, "short"), (3, None)]).selectExpr(
        "lang as kept", "text", "doc_id", "source as score")
    labels = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    out = quality.keep(docs, labels)
    assert out.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 1]
    assert quality.keep(documents([]), labels).count() == 0


def test_every_labelled_document_counts(spark, documents, monkeypatch):
    import random

    draw = random.Random(5)
    texts = [" ".join(draw.choice(["the", "of", "sea", "ship", f"w{i % 9}"]) for _ in range(70)) for i in range(80)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality long, toxic long")
    rows = lambda: sorted(tuple(r) for r in quality.rules(documents(texts), labels).collect())
    before = rows()
    monkeypatch.setattr(quality, "TRUSTED", 7)
    assert quality.trusted_ids(labels).count() == 60 and rows() == before
    monkeypatch.setattr(quality, "FEW", 0)  # ids beyond what is broadcast
    assert rows() == before


def test_cut_by_ranks_of_scores(spark):
    values = [0.25, -1.5, 0.25, 3e-7, 0.0, -1.5, 2.0] * 9 + [7.125]
    ranked = sorted(values)
    middle, low = ranked[len(ranked) // 2], ranked[len(ranked) // 20]
    scores = spark.createDataFrame([(v,) for v in values], "score double")
    assert quality.cut_of(scores) == middle - quality.WIDTH * (middle - low)
    assert quality.cut_of(scores.limit(1)) == values[0]
    assert quality.cut_of(scores.limit(0)) == quality.FAR
