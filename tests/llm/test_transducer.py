import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import queries
from ledgerlens.llm import transducer as T

from .conftest import SMALL

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def counter():
    return T.Counter(open(PATH, "rb").read())


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_random_texts_count_as_the_library(counter, library, odd_texts):
    draw = random.Random(6)
    letters = "abcLM  \n\t'strevmd01éüß中文🙂́̇İΣσς\x1c\x85\xa0 .,!?½Ⅷ"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(draw.choice("abein're") for _ in range(draw.randint(0, 300))) for _ in range(500)]
    texts += [t or "" for t in odd_texts]
    assert counter.count(texts).tolist() == [library(t) for t in texts]


def test_state_maps_compose_over_chunks():
    draw = np.random.default_rng(1)
    for n in (1, 7, 511, 512, 5000):
        kinds = draw.integers(0, 6, n).astype(np.uint8)
        state, want = 0, []
        for kind in kinds.tolist():
            want.append(bool(T.BEGINS[state, kind]))
            state = int(T.NEXT[state, kind])
        for chunk in (1, 3, 64, 512):
            assert T.marks(kinds, chunk).tolist() == want


def test_states_are_compiled_anew_beyond_the_bound(counter, library, monkeypatch):
    monkeypatch.setattr(T, "STATES", 50)
    words = [f"w{i}x{i * 7}" for i in range(300)]
    assert counter.count(words).tolist() == [library(w) for w in words]


def test_tables_and_query(spark, documents, odd_texts, library):
    rows = [*enumerate(odd_texts), (3, "again"), (None, "x")]
    got = T.count_tokens(documents(rows).withColumnRenamed("lang", "n_tokens"), PATH, limit=3).collect()
    want = sorted((-1 if i is None else i, len((t or "").encode()), library(t or ""), library(t or "") > 3) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == want
    assert T.count_tokens(documents([]), PATH).count() == 0
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.op6_token_counts(spark, SMALL).collect():
        n = library(docs[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 2048)
