import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken

import corpus_pipeline
from ledgerlens.llm import bpe, common, mixing, ngramjoin, quality, secrets

from .brute import base_spans, join_components
from .conftest import SMALL
from .test_secrets import method_spans, redacted


def test_every_stage_acts_on_what_the_last_one_kept(spark, tmp_path):
    folder = str(tmp_path)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = docs.where("doc_id = 1").first().text
    leaking = spark.createDataFrame([(10_001, f"{text} password = hunter2hunter2 {text[::-1]}", "en", "src1", 9)], docs.schema)
    docs.unionByName(leaking).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in quality.rules(docs, labels).collect() if r.kept}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in kept}
    stage = quality.keep(docs, labels)
    assert stage.columns == docs.columns and {r.doc_id for r in stage.collect()} == kept
    groups = join_components([(i, r.text) for i, r in rows.items()], words=5, similarity=80)
    first = {i for i, (_, c) in groups.items() if c == i}
    second = ngramjoin.keep_first(stage, words=5, similarity=80)
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} == first < kept
    clean = {i: redacted(rows[i].text, sorted(base_spans(rows[i].text) + method_spans(rows[i].text))) for i in first}
    third = secrets.redact(second)
    assert {r.doc_id: (r.text, r.n_chars) for r in third.collect()} == {i: (t, len(t)) for i, t in clean.items()}
    assert any(secrets.MARK in t for t in clean.values())
    fourth = mixing.mix(third)
    assert fourth.columns == docs.columns
    times = {}
    for r in fourth.collect():
        assert r.text == clean[r.doc_id]
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    got = corpus_pipeline.run(spark, folder).collect()
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={}, mergeable_ranks=bpe.Codec(
        open(corpus_pipeline.RANKS, "rb").read(), P.PATTERN).ids)
    assert {r.doc_id: sum(x.doc_id == r.doc_id for x in got) for r in got} == times
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(clean[r.doc_id])


def test_no_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0


def test_stages_hand_texts_over_in_small_batches(spark, documents):
    """A batch is whole on both sides of a worker, so its size bounds what a task holds."""
    key, before = corpus_pipeline.BATCH, spark.conf.get(corpus_pipeline.BATCH)
    docs = documents([f"word{i} and more words" for i in range(2 * corpus_pipeline.ROWS)], parts=1)

    def largest():
        sizes = docs.select("doc_id").mapInArrow(
            lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
        return max(r.n for r in sizes.collect())

    try:
        for limit, want in (("10000", corpus_pipeline.ROWS), ("0", corpus_pipeline.ROWS), ("70", 70)):
            spark.conf.set(key, limit)
            dict(corpus_pipeline.STAGES)["byte-level BPE"](spark, docs, SMALL)
            assert largest() == want
    finally:
        spark.conf.set(key, before)


def test_a_worker_gives_memory_back_when_it_changes_helpers(monkeypatch):
    given = []
    monkeypatch.setattr(common, "_KEPT", {})
    monkeypatch.setattr(common, "give_back", lambda: given.append(dict(common._KEPT)))
    assert [common.kept(k, lambda k=k: k + k) for k in ("a", "a", "b")] == ["aa", "aa", "bb"]
    assert given == [{}]
    monkeypatch.undo()
    common.give_back()


def test_slices_count_what_a_row_needs_besides_its_text():
    texts = pa.array(["ab", None, "ü", "abcdef"])
    assert [x for x in common.text_slices(texts, 4)] == [(0, 3, ["ab", "", "ü"]), (3, 4, ["abcdef"])]
    assert [x for x in common.text_slices(texts, 4, each=2)] == [(0, 1, ["ab"]), (1, 2, [""]), (2, 3, ["ü"]), (3, 4, ["abcdef"])]
