import math

from ledgerlens.llm import mixing

from .brute import WORD


def fill(sizes, weights, budget, epochs):
    """Targets by plain rounds: share by weight, clamp, share the excess."""
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = budget - sum(target[i] for i in range(len(sizes)) if i not in open_)
        level = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if level * weights[i] > epochs * sizes[i]}
        for i in over:
            target[i] = epochs * sizes[i]
        open_ -= over
        if not over:
            for i in open_:
                target[i] = level * weights[i]
            break
    return target


def test_targets_and_what_is_taken(documents):
    words = {"a": 100, "b": 7, "Z": 55, "é": 21, "": 13, None: 40}
    rows = [(i * 10 + k, " ".join(["w"] * (n // 10 + (1 if k < n % 10 else 0))), s)
            for i, (s, n) in enumerate(words.items()) for k in range(10)]
    got = mixing.shares(documents(rows)).collect()
    order = sorted((s for s in words if s is not None)) + [None]
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(order))]
    want = dict(zip(order, fill([words[s] for s in order], weights, 1.5 * sum(words.values()), 2.0)))
    for s in words:
        some = [r for r in got if r.source == s]
        assert len(some) == 10 and all(abs(r.target - want[s]) < 1e-5 and r.source_size == words[s] for r in some)
        assert sum(r.taken for r in some) == math.floor(want[s] + 1e-9)
        assert all(0 <= r.taken <= 2 * r.size for r in some)
    again = mixing.shares(documents(rows[::-1], parts=5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_odd_texts_ties_and_repeated_rows(documents, odd_texts):
    rows = [(i, t, "s") for i, t in enumerate(odd_texts)] * 2 + [(None, "a b", "s"), (None, "a b", "s"), (5, "", "t")]
    got = mixing.shares(documents(rows)).collect()
    assert len(got) == len(rows)
    size = lambda t: len(WORD.findall(t or ""))
    assert sorted(r.size for r in got) == sorted(size(t) for _, t, _ in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault((r.doc_id, r.source), set()).add(r.taken)
    assert all(len(v) == 1 for v in by_id.values())
    assert mixing.shares(documents([])).count() == 0


def test_mix_repeats_whole_rows_and_keeps_columns(documents):
    rows = [(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(200)]
    docs = documents(rows).withColumnRenamed("lang", "copies").withColumnRenamed("n_chars", "own")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    want = {r.doc_id: r for r in mixing.shares(docs).collect()}
    for s in "ab":
        taken = sum(got.get(i, 0) * r.size for i, r in want.items() if r.source == s)
        assert abs(taken - next(r.target for r in want.values() if r.source == s)) <= 5
    assert all(got.get(i, 0) <= 2 for i in want)
    assert mixing.mix(documents([])).count() == 0
