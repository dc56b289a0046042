import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from ledgerlens.llm import bpe, queries

from .conftest import SMALL

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(open(PATH, "rb").read(), P.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ids, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_random_texts_give_the_ids_of_the_library(codec, library, odd_texts):
    draw = random.Random(5)
    letters = "abc  \n\t'strevmdl01éüß中文🙂 \x1c\x85\xa0.,!?"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(draw.choice("abein") for _ in range(draw.randint(0, 400))) for _ in range(300)]
    for text in texts + [t or "" for t in odd_texts]:
        packed = codec.encode(text)
        assert ids(packed) == library.encode_ordinary(text), repr(text)[:100]
        assert codec.decode(packed) == text.encode()


def test_long_pieces_take_linear_time(codec, library):
    for text in ("a" * 100_000, " " * 50_000 + "x", "abcdefghij" * 10_000):
        assert ids(codec.encode(text)) == library.encode_ordinary(text)


def test_memos_stay_bounded(codec):
    small = bpe.Memo(lambda k: k + 1, 10)
    assert [small[k] for k in range(100)] == list(range(1, 101))
    assert len(small) <= 10 and len(small.old) <= 10
    assert small[95] == 96


def test_tables_with_nulls_clashes_and_no_rows(documents, odd_texts, library):
    docs = documents([*enumerate(odd_texts), (3, "again"), (3, "again"), (None, "x")]).withColumnRenamed("lang", "ids")
    out = bpe.encode(docs, PATH, P.PATTERN, keep=("doc_id", "ids", "source"))
    assert out.columns == ["doc_id", "source", "ids", "n_tokens"]
    assert out.count() == len(odd_texts) + 3
    for r in bpe.decode(out, PATH, P.PATTERN).collect():
        if r.doc_id is not None and r.doc_id != 3:
            assert r.decoded == (odd_texts[r.doc_id] or "").encode()
    for r in bpe.digests(out, PATH, P.PATTERN).collect():
        if r.doc_id is not None and r.doc_id != 3:
            text = odd_texts[r.doc_id] or ""
            want = library.encode_ordinary(text)
            assert r.n_tokens == len(want)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(documents([]), PATH, P.PATTERN).count() == 0


def test_query_over_a_whole_table(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op4_byte_bpe(spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        want = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
