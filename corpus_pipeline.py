"""A training corpus from raw documents: five stages, each written as Parquet and read again.

The classifier teaches SQL nothing it could repeat, so ORACLE_SQL is None; the tests hold
the stages against brute-force versions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from siftloom.llm import decontaminate, exact_dedup, mixing, quality, simhash
from siftloom.llm.common import table
from siftloom.session import removed, shared_dir, ship


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    ship(spark)
    weights = quality.train(docs, table(spark, sf_dir, "labels").filter(~quality.held_out()))
    return quality.keep_good(docs, weights)


def exact_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.keep_one(docs)


def near_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by five-word shingles at 0.8, the document with the smallest id stays."""
    ship(spark)
    return simhash.keep_one(docs)


def decontamination_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ship(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    ship(spark)
    return mixing.mix(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_dedup_filter", exact_dedup_filter),
    ("near_dedup_filter", near_dedup_filter),
    ("decontamination_filter", decontamination_filter),
    ("source_mix", source_mix),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder, last = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", ""
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            removed(spark, last)
        last = path
    return docs
