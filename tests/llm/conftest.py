import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from texts, or from (doc_id, text[, source]) tuples."""
    def build(rows, parts=3):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, "en", *(rest or ("a",)), None if t is None else len(t)) for i, t, *rest in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and very long texts, ties, repeated rows, odd white space, several scripts."""
    return [None, "", " ", "\n\n", "a", "a b c", "a b c d", "A B C D", "a b c d", "x" * 50_000, "ab " * 20_000,
            "Ünïcödé ßtraße 中文字 🙂🙂 ́", "it's we're I'll 'street ''s", "a\x85b\x1cc\xa0d  e   f \n g \n\n h",
            "<|endoftext|> and <|startoftext|><|endoftext|>", "ΑΣ İstanbul ǅ ﬁ", "1234 5½ Ⅷ ٣", "tab\tand\x0bvt\x0cff\rcr"]
