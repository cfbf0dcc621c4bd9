"""A corpus pipeline of five of the training-data operators.

Toxic documents go, then exact copies, then near copies (one document of each group stays); what is left is
mixed to the target weights and encoded. The mixture is given by mix_block and mix_row, which the last stage
returns too: sorted by them, the rows follow the weights for as long as every source lasts. Every stage works on all that its predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import bpe, exact_dedup, mixing, near_dedup, queries, toxicity
from gleanery.llm.shared import scratch
from gleanery.session import ship_package, small_batches


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(ship_package(spark))
    return toxicity.without_toxic(docs, toxicity.learn(docs, queries.table(spark, sf_dir, "labels")))


def exact_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(ship_package(spark))
    return exact_dedup.drop_exact_duplicates(docs)


def near_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(ship_package(spark))
    return near_dedup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(ship_package(spark))
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document: token count, digests of the ids and of the decoded text, and its place in the mixture."""
    small_batches(ship_package(spark))
    return bpe.round_trip(docs, queries.tokenizer_file(), carried=("mix_block", "mix_row"))


STAGES = [("toxicity", toxic_out), ("exact_dedup", exact_out), ("near_dedup", near_out), ("mixing", mix), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next."""
    docs = queries.table(spark, sf_dir, "documents")
    scratch(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The toxicity stage learns a model, which SQL cannot express.
ORACLE_SQL = None
