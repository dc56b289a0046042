"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next one."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import bpe, mixing, ngramjoin, quality, secrets
from ledgerlens.llm.common import stored, table

BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id; shingles of five words, similarity 0.8."""
    return ngramjoin.keep_first(docs, words=5, similarity=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark."""
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document in place of its text."""
    return bpe.encode(docs, RANKS, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"))


def in_small_batches(stage):
    """The stage, with at most `ROWS` texts in a batch for Python: a task holds one on either side.

    The setting stays when the stage returns, as Spark reads it once the result is run; a smaller one is left as it is.
    """
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = int(spark.conf.get(BATCH))
        if not 0 < before <= ROWS:
            spark.conf.set(BATCH, str(ROWS))
        return stage(spark, docs, sf_dir)

    return run


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("secret scans", secret_scans),
          ("mixing sources to target weights", source_mixing), ("byte-level BPE", tokens)]
STAGES = [(name, in_small_batches(stage)) for name, stage in STAGES]
# SQL can express neither the quality model nor the merges; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
