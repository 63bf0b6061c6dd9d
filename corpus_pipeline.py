"""From raw documents to packed training sequences: classifier, exact and near dedup, mixing, packing."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tallyfield.llm import exact, jaccard, mixing, packing, quality
from tallyfield.llm.queries import tokenizer_file
from tallyfield.llm.shared import discard, stash


#: Rows of a batch that a Python worker gets at a time, and words that a packing worker keeps the ids of: workers stay small beside a full heap.
BATCH_ROWS, CACHE_WORDS = 1000, 100_000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is computed meanwhile goes to Python workers in batches of at most BATCH_ROWS rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, min(BATCH_ROWS, int(was)) if int(was) > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, _labels(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact.keep_one(docs)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id stays; five-word shingles, similarity 0.8 or more."""
    with small_batches(spark):
        return jaccard.one_of_each_group(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says."""
    return mixing.mixed_documents(docs, mixing.label_domains(_labels(spark, sf_dir)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 4096 tokens."""
    with small_batches(spark):
        return packing.packed_documents(docs, tokenizer_file("word_bpe_49k.json"), cache=CACHE_WORDS)


STAGES = [("quality classifier", classify), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_similar), ("mixing to target weights", mix), ("best-fit packing", pack)]

#: The classifier and the packing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with small_batches(spark):
            docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(*before)  # one stage's documents are kept at a time
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
