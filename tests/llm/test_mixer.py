import math
import random
import zlib
from collections import Counter

import numpy as np

from ledgerlens.llm import mixer, queries

from .brute import WORD, lower
from .conftest import SMALL


SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
FIBONACCI = np.uint32(0x9E3779B1)


def slots(hashes, first):
    """Slots in tables of hashed (context, node) pairs, (orders, tokens, bits), and the bits themselves."""
    one = np.concatenate([[0], hashes[:-1]]).astype(np.uint64) + np.uint64(1)
    one[first] = 0
    two = np.concatenate([[0], one[:-1]]).astype(np.uint64)
    two[first] = 0
    code = hashes.astype(np.int32) & (mixer.CLASSES - 1)
    node = (code[:, None] | mixer.CLASSES) >> np.arange(mixer.BITS, 0, -1, dtype=np.int32)
    bits = code[:, None] >> np.arange(mixer.BITS - 1, -1, -1, dtype=np.int32) & 1
    out = np.empty((mixer.ORDERS, len(hashes), mixer.BITS), np.int32)
    out[0] = node
    for order, context in enumerate((one, two, mixer.mix64(one) + two), start=1):
        base = (mixer.mix64(context * mixer.SALTS[1] + mixer.SALTS[order]) >> np.uint64(32)).astype(np.uint32)
        key = (base[:, None] + node.astype(np.uint32) * FIBONACCI) * FIBONACCI
        out[order] = key >> np.uint32(32 - SLOT_BITS)
    return out, bits.astype(bool)


def mixed(rows, value, seen):
    """Scores of texts with logits from given tables of slots, in place of joined counts."""
    hashes, first = mixer.hash_all(rows)
    found, bits = slots(hashes, first)
    inputs = np.stack([value[order].take(found[order]) for order in range(mixer.ORDERS)], axis=1)
    inputs *= np.where(bits, np.float32(1), np.float32(-1))[:, None]
    return mixer.follow(inputs, seen.take(found[-1]), np.array([len(r) for r in rows]))[0]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


def tokens(text):
    return [*WORD.findall(lower(text)), ""]


def check_base(got, rows):
    train = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = train.total(), len(train)
    texts = {}
    for i, x in rows:
        texts.setdefault(i, []).append(x)
    for r in got:
        options = []
        for x in texts[r.doc_id]:
            some = tokens(x)
            options.append((len(some), sum(t in train for t in some),
                            sum(math.log10((train[t] + 1) / (n + v + 1)) for t in some)))
        assert r.held_out == held(r.doc_id) and r.train_tokens == n
        assert any((r.n_tokens, r.n_known) == o[:2] and abs(r.base_score - o[2]) < 1e-4 for o in options)
        assert r.score < 0


def test_base_scores_over_odd_texts(documents, odd_texts):
    rows = [*enumerate(odd_texts), (3, "again"), (3, "again"), (None, "x y"), *((100 + i, f"w{i} w{i % 3} the") for i in range(40))]
    docs = documents(rows).withColumnRenamed("lang", "word").withColumnRenamed("source", "c")
    got = mixer.score(docs).collect()
    assert len(got) == len(rows)
    check_base(got, rows)
    assert mixer.score(documents([])).count() == 0


def test_frequent_and_other_words_give_the_same_sums(documents, monkeypatch):
    draw = random.Random(3)
    rows = [(i, " ".join(f"w{int(draw.paretovariate(0.7)) % 500}" for _ in range(60))) for i in range(120)]
    one = sorted(map(str, mixer.score(documents(rows)).collect()))
    monkeypatch.setattr(mixer, "HEAD", 20)
    assert sorted(map(str, mixer.score(documents(rows)).collect())) == one
    monkeypatch.setattr(mixer, "FLUSH", 10)
    assert sorted(map(str, mixer.score(documents(rows, parts=7)).collect())) == one


def test_decisions_are_probabilities():
    """Over all classes of the next token the probabilities sum to one."""
    draw = np.random.default_rng(1)
    value = draw.normal(size=(mixer.ORDERS, SLOTS)).astype(np.float32)
    seen = draw.random(SLOTS) < 0.5
    names, at = {}, 0
    while len(names) < mixer.CLASSES:
        word = str(at).encode()
        names.setdefault(zlib.crc32(word) % mixer.CLASSES, word)
        at += 1
    history = [b"a", b"b"]
    base = mixed([history], value, seen)[0]
    rows = [[*history, w] for w in names.values()]
    total = sum(math.exp(x - base) for k in range(0, len(rows), 512) for x in mixed(rows[k:k + 512], value, seen))
    assert abs(total - 1) < 1e-3


def test_texts_do_not_depend_on_their_neighbours():
    draw = random.Random(5)
    value = np.random.default_rng(2).normal(size=(mixer.ORDERS, SLOTS)).astype(np.float32)
    seen = np.ones(SLOTS, bool)
    rows = [[str(draw.randint(0, 50)).encode() for _ in range(draw.randint(1, 150))] for _ in range(20)]
    together = mixed(rows, value, seen)
    alone = [mixed([r], value, seen)[0] for r in rows]
    assert np.allclose(together, alone, rtol=1e-5)


def test_contexts_help_on_held_out_texts(documents):
    """Words that follow each other by rule are predicted better than by their counts."""
    draw = random.Random(6)
    rows = []
    for i in range(400):
        word, out = draw.randint(0, 199), []
        for _ in range(80):
            out.append(f"w{word}")
            word = (word * 7 + 3) % 200 if draw.random() < 0.9 else draw.randint(0, 199)
        rows.append((i, " ".join(out)))
    got = [r for r in mixer.score(documents(rows)).collect() if r.held_out]
    assert len(got) > 30
    assert sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)


def test_query_over_a_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = queries.op10_context_mixing(spark, SMALL).collect()
    assert len(got) == len(rows)
    check_base(got, rows)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_logits_are_those_of_exact_counts_without_the_token_itself(spark, documents):
    draw = random.Random(8)
    rows = [(i, " ".join(f"w{draw.randint(0, 8)}" for _ in range(draw.randint(0, 30)))) for i in range(60)]
    every = mixer.parts(documents(rows, parts=3), {}, np.zeros(mixer.CLASSES)).where("slice is not null")
    paths, codes = {}, {}
    for i, x in rows:
        codes[i] = [zlib.crc32(t.encode()) for t in tokens(x)]
        for order, at, c in visits(codes[i]):
            for d in range(mixer.BITS + 1):
                node = order, at, d, c % mixer.CLASSES >> mixer.BITS - d
                paths[node] = paths.get(node, 0) + (not held(i))
    bits, ranges = 34, 4 * mixer.RANGES
    met = mixer.meet_contexts(every, bits).collect()
    checked = 0
    for row in every.collect():
        blocks = sorted((r for r in met if r.slice == row.slice), key=lambda r: r.part)
        own = mixer.Slice(row.asDict(), [(r.part, r.left) for r in blocks],
                          np.zeros((2, mixer.CLASSES, mixer.BITS), np.float32), bits, ranges)
        inputs, seen, sizes = own.inputs(0, len(own.sizes))
        ids = [r.doc_id for r in mixer.parts(documents(rows, parts=3), {}, np.zeros(mixer.CLASSES)).where("slice is null").collect()
               if r.ref in np.frombuffer(row.refs, "<i8")]
        assert [len(codes[i]) for i in ids] == sizes.tolist()
        at = 0
        for i in ids:
            for k, (order, context, c) in enumerate(visits(codes[i])):
                n = [paths[order, context, d, c % mixer.CLASSES >> mixer.BITS - d] - (not held(i)) for d in range(mixer.BITS + 1)]
                want = [math.log((n[d + 1] + mixer.PRIOR) / (n[d] - n[d + 1] + mixer.PRIOR)) for d in range(mixer.BITS)]
                assert np.allclose(inputs[at + k // 3, order], want, atol=1e-5)
                if order == 3:
                    assert seen[at + k // 3].tolist() == [x > 0 for x in n[:-1]]
                checked += 1
            at += len(codes[i])
    assert checked > 1000


def test_a_frequent_words_context_is_parted(documents, monkeypatch):
    """Paths that meet at a time are bounded also where most of them have one context, and all counts stay whole."""
    draw = random.Random(11)
    rows = [(i, " ".join(f"the w{draw.randint(0, 300)}" for _ in range(draw.randint(0, 60)))) for i in range(160)]
    want = sorted(map(str, mixer.score(documents(rows)).collect()))
    monkeypatch.setattr(mixer, "STEP", 1)
    monkeypatch.setattr(mixer, "WIDTH", 100)
    bits, every = 34, mixer.parts(documents(rows, parts=3), {}, np.zeros(mixer.CLASSES), bits=34).where("slice is not null")
    made = [r.asDict() for r in every.collect()]
    marks = [np.frombuffer(b"".join(r["marks"][kind] for r in made), "<u8") for kind in (0, 1)]
    ranges, none = mixer.Ranges(bits, 16, marks), np.zeros((2, mixer.CLASSES, mixer.BITS), np.float32)
    met, whole = mixer.meet_contexts(every, bits, ranges).collect(), mixer.meet_contexts(every, bits).collect()
    for row in made:
        own, one = (mixer.Slice(row, [(r.part, r.left) for r in found if r.slice == row["slice"]], none, bits, n)
                    for found, n in ((met, ranges), (whole, 16)))
        for a, b in zip(own.logits + own.found, one.logits + one.found):
            assert (a == b).all()
    for kind in (0, 1):
        keys = np.concatenate([np.unique(mixer.paths(*mixer.slice_arrays(r["hashes"], r["sizes"], r["train"]), bits)[kind]) for r in made])
        held = lambda begins: np.bincount(np.searchsorted(begins, keys, "right") - 1).max()
        assert held(ranges.begins[kind]) <= 2 * mixer.WIDTH < held(mixer.borders(bits, 16, kind)) // 2
    assert max(d.max() for d in ranges.depths) > mixer.BITS and len(ranges.begins[0]) > 40
    assert sorted(map(str, mixer.score(documents(rows)).collect())) == want


def test_a_slice_opens_few_ranges_at_a_time(documents, monkeypatch):
    rows = [(i, " ".join(f"w{k % (7 + i)}" for k in range(40 + i))) for i in range(30)]
    row = mixer.parts(documents(rows, parts=1), {}, np.zeros(mixer.CLASSES)).where("slice is not null")
    bits, ranges = 34, 4 * mixer.RANGES
    answers = [(r.part, r.left) for r in mixer.meet_contexts(row, bits).collect() if r.slice == row.first().slice]
    row, none, opened = row.first().asDict(), np.zeros((2, mixer.CLASSES, mixer.BITS), np.float32), []
    monkeypatch.setattr(mixer, "logits_of", lambda *a, f=mixer.logits_of: opened.append(len(a[2])) or f(*a))
    some = mixer.Slice(row, answers, none, bits, ranges)
    assert max(opened) <= mixer.OPENED < len(answers) // 2
    monkeypatch.setattr(mixer, "OPENED", 1 << 20)
    every = mixer.Slice(row, answers, none, bits, ranges)
    for a, b in zip(some.logits + some.found, every.logits + every.found):
        assert (a == b).all()


def test_arrays_come_back_as_they_were():
    draw = np.random.default_rng(7)
    for n in (0, 1, 5, 3_000):
        hashes, codes = draw.integers(0, 1 << 32, 500).astype(np.uint32), draw.zipf(1.3, n) % 500
        hashes[7] = hashes[3]  # words may share a hash
        assert (mixer.decoded(mixer.coded(codes, hashes)) == hashes[codes]).all()
        values = (draw.zipf(1.2, n) % (1 << 62)).astype(np.int64)
        assert (mixer.small_opened(mixer.small(values)) == values).all()
        keys = np.sort(draw.integers(0, 1 << 63, n).astype(np.uint64))
        assert (mixer.unpacked(mixer.packed(keys)) == keys).all()
    assert [mixer.context_bits(n) for n in (0, 1 << 20, 1 << 60)] == [20, 21 + mixer.SPARE, 36]


def visits(codes):
    """(order, context, token) for every token and order with a context."""
    for k, c in enumerate(codes):
        last, before = codes[k - 1] if k else None, codes[k - 2] if k > 1 else None
        known = None if last is None else last & (1 << mixer.BITS + mixer.EXTRA) - 1
        yield from ((1, last, c), (2, before, c), (3, (known, before), c))


def test_contexts_do_not_average_out_in_a_large_corpus(documents):
    """Many contexts, each with one successor: all of them stay apart, however many there are."""
    draw = random.Random(9)
    words = 40_000
    rows = [(i, " ".join(f"w{(start + k) % words}" for k in range(100)))
            for i in range(2000) for start in [draw.randrange(words)]]
    got = [r for r in mixer.score(documents(rows)).collect() if r.held_out]
    gain = sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got) * math.log2(10)
    assert gain > 8


def test_weights_follow_every_token():
    draw = np.random.default_rng(4)
    value = draw.normal(size=(mixer.ORDERS, SLOTS)).astype(np.float32)
    seen = draw.random(SLOTS) < 0.5
    rows = [[str(k * k % 7).encode() for k in range(n)] for n in (40, 3, 1, 17)]
    for row, got in zip(rows, mixed(rows, value, seen)):
        found, bits = slots(*mixer.hash_all([row]))
        weights, total = np.tile(np.array(mixer.WEIGHTS)[:, None, None], (1, mixer.BITS, 2)), 0.0
        for t in range(len(row)):
            for b in range(mixer.BITS):
                gate = int(seen[found[-1, t, b]])
                x = np.array([value[k, found[k, t, b]] for k in range(mixer.ORDERS)]) * (1 if bits[t, b] else -1)
                p = 1 / (1 + math.exp(-x @ weights[:, b, gate]))
                total += math.log(p)
                weights[:, b, gate] += mixer.RATE * (1 - p) * x
        assert abs(got - total) < 1e-3


def test_first_weights_are_learned_on_training_documents(documents, monkeypatch):
    draw = random.Random(10)
    rows = [(i, " ".join(f"w{(draw.randint(0, 3) + k * 7) % 50}" for k in range(draw.randint(1, 30)))) for i in range(300)]
    learned = sum(r.score for r in mixer.score(documents(rows)).collect() if r.held_out)
    starts = []
    monkeypatch.setattr(mixer, "first_weights", lambda *a, f=mixer.first_weights: starts.append(f(*a)) or mixer.START)
    assert learned > sum(r.score for r in mixer.score(documents(rows)).collect() if r.held_out)
    monkeypatch.setattr(mixer, "LEARN", 500)
    mixer.score(documents(rows)).collect()
    assert starts[0].shape == starts[1].shape == mixer.START.shape and not np.allclose(starts[0], starts[1], atol=1e-3)


def test_first_weights_are_learned_on_all_training_documents(documents, monkeypatch):
    """However many tokens there are: a corpus of more than four million, in few words."""
    rows = [(i, "a b " * 40_000) for i in range(70)]
    taken = []

    def learn(made, *rest):
        taken.extend(np.frombuffer(r.sizes, "<u4").sum() for r in made.where("slice % 2 = 1").collect())
        return mixer.START

    monkeypatch.setattr(mixer, "first_weights", learn)
    mixer.score(documents(rows))
    assert sum(taken) == sum(80_001 for i, _ in rows if not held(i)) > 4_000_000
