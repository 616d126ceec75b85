"""Sinks: JSON Lines, compacted logs, write-once and write-or-validate tables, staged publication."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.operators.logs import KEY, last_wins


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_once(df: DataFrame, path: str) -> None:
    """Writes a table that must not be there yet."""
    df.write.mode("errorifexists").parquet(path)


def compact(log: DataFrame, path: str, order: str = "seq", files: int = 1) -> None:
    """A log as one row a key, sorted by key."""
    last_wins(log, order).repartitionByRange(files, *KEY).sortWithinPartitions(*KEY).write.mode("overwrite").parquet(path)


def content_digest(df: DataFrame) -> DataFrame:
    """One row: count and an order-free digest of the rows, the same for the same rows in any order or layout."""
    row = F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"d{k}") for k in range(8)]
    return df.agg(F.count("*").alias("rows"), *parts).select("rows", F.sha2(F.concat_ws("-", *(F.coalesce(f"d{k}", F.lit("0")) for k in range(8))), 256).alias("digest"))


def write_or_validate(df: DataFrame, path: str) -> str:
    """Writes a table, or checks that the one that is there has equal rows; returns written or validated."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        write_once(df, path)
        return "written"
    if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        raise ValueError(f"{path} is there, but is no finished table")
    if content_digest(df).first() != content_digest(spark.read.parquet(path)).first():
        raise ValueError(f"{path} holds other rows")
    return "validated"


def publish(df: DataFrame, path: str) -> None:
    """Writes beside the place and renames: readers see all or nothing; an existing place is an error."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    staging, target = f"{path}.staging-{uuid.uuid4().hex}", jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise ValueError(f"{path} exists")
    df.write.parquet(staging)
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), target):
        raise ValueError(f"cannot publish {path}")


def save_json(data: object, path: str) -> None:
    """A small document, written beside the place and renamed."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f"{target.name}.{uuid.uuid4().hex}")
    part.write_text(json.dumps(data, indent=2, sort_keys=True, ensure_ascii=False, allow_nan=False) + "\n", encoding="utf-8")
    os.replace(part, target)


class Claim:
    """A claim file that only one run can hold."""

    def __init__(self, path: str):
        self.path = Path(path)

    def __enter__(self) -> Claim:
        os.close(os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        return self

    def __exit__(self, *_: object) -> None:
        self.path.unlink()


def reemit(spark: SparkSession, specs: DataFrame, keys: DataFrame, path: str) -> None:
    """The specs of some keys, written again for a retry."""
    write_jsonl(specs.join(keys, "identity", "left_semi"), path)
