"""The corpus pipeline: documents pass a quality filter, near-copy removal, benchmark decontamination, secret redaction
and BPE encoding. Each stage's rows are written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, ngram_join, quality, runtime, secrets

#: Of the near-copy stage; op10's own are those of its query.
SHINGLE, NEAR = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    runtime.prepare(spark)
    model = quality.train(docs, runtime.table(spark, sf_dir, "labels"), ~quality.held_out())
    return quality.keep(docs, model)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group of near copies (``NEAR`` per cent of their shingles of ``SHINGLE``
    words in common); of rows that repeat, one."""
    runtime.prepare(spark)
    return ngram_join.representatives(docs, threshold=NEAR, size=SHINGLE)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.clean(docs, runtime.table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets within the texts."""
    runtime.prepare(spark)
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document."""
    runtime.prepare(spark)
    return bpe.encode(docs, bpe.public_vocabulary(), keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("ngram_join", keep_one_of_each_group),
    ("decontaminate", drop_benchmark),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: SQL can't express the classifier, the retrieval or the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``; a stage's table goes once the next one's is written."""
    docs, before = runtime.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, path = runtime.written(stage(spark, docs, sf_dir))
        if before:
            runtime.forget(spark, before)
        before = path
    return docs
