"""A training-corpus pipeline over ``documents``: every stage works on what the one before it kept.

Toxic documents go, one document of each near-duplicate group stays, sentences that repeat an
earlier passage go, documents that hold a benchmark passage go, and the rest is encoded. All stages
but the last return the columns they were given; the last adds the encoding.

Null texts are kept by every filter (as one near-duplicate group with other wordless texts) and have
no ids; rows that share a doc_id are judged each, except that their passages count as one
document's; empty tables give empty results; extra columns pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from folioframe.llm import decontaminate, pieces, simhash, spans, toxicity
from folioframe.llm.common import shared_dir, table

#: Near-duplicate stages use five-word shingles.
SHINGLE = 5
#: Whole texts go to Python workers in batches of at most so many rows and bytes (one text may be larger):
#: Spark's own 10,000 rows are held at once by the JVM's queue, its Arrow buffers and the worker.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.ordinary(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs, SHINGLE)


def drop_repeated_sentences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spans.substring_dedup(docs, counts=False)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.with_ids(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", one_of_each_group),
    ("substring_dedup", drop_repeated_sentences),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("sentencepiece", encode),
]

#: The stages train models and hash with functions that SQL has no counterpart for.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written as Parquet to shared storage and read again by the next.

    Sets the session's Arrow batch sizes and leaves them set: the last stage runs after the return.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    docs = table(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
