import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import queries, tokenfiles
from ledgerlens.scratch import new_path

from .conftest import SMALL

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def check(got, rows, library):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for i, text in ordered:
        ids = np.array([*library(text or ""), 0], "<u4")
        want.append((-1 if i is None else i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == sorted(want)


def test_selection_in_elias_fano_sequences():
    for seed in range(60):
        draw = np.random.default_rng(seed)
        values = np.cumsum(draw.integers(0, [2, 60, 5000][seed % 3], draw.integers(1, 700)))
        values[-1] += [0, 10**6][seed % 2]
        index = tokenfiles.EliasFano.of(values, int(values[-1]))
        assert [index.select(i) for i in range(len(values))] == values.tolist()
        mean = max(int(values[-1]) / len(values), 1)
        assert 8 * (len(index.lows) + len(index.highs)) <= len(values) * (np.log2(mean) + 3) + 16


def test_files_round_trip(spark, documents, odd_texts, library, monkeypatch):
    rows = [*enumerate(odd_texts), (3, "again"), (3, "again"), (None, "x"), (-5, "minus"), (10**12, "far")]
    path = new_path(spark, "test")
    tokenfiles.write(documents(rows).withColumnRenamed("lang", "shard"), PATH, path)
    check(tokenfiles.read(spark, path).collect(), rows, library)
    empty = new_path(spark, "test")
    tokenfiles.write(documents([]), PATH, empty)
    assert tokenfiles.read(spark, empty).count() == 0


def test_query_over_a_whole_table(spark, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check(queries.op8_token_files(spark, SMALL).collect(), rows, library)
