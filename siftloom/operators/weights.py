"""Training weights: replay, mean-one normalisation, clipped means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions import scoring as s
from siftloom.operators.ordinal import held, numbered


def with_replay(rows: DataFrame, ratio: float, weight: float, order: list[Column], image: str = "edited_image") -> DataFrame:
    """The rows and, after them, reconstruction rows: max(1, round(n * ratio)) of them, in the rows' order."""
    n = rows.agg(F.count("*").alias("_n"))
    want = s.replay_count(F.col("_n"), ratio)
    base = rows.withColumn("kind", F.lit("sft"))
    again = numbered(rows, order, "_seq").join(F.broadcast(n))
    again = again.filter(F.col("_seq") <= want).drop("_seq", "_n")
    again = again.withColumn("kind", F.lit("reconstruction_replay")).withColumn("weight", F.lit(weight))
    if image in again.columns and "image" in again.columns:
        again = again.withColumn("image", F.col(image))
    return base.unionByName(again)


def mean_one(rows: DataFrame, weight: str = "weight") -> DataFrame:
    """Adds sample_weight = weight / mean(weight); raises where a weight is negative, not finite, or all are 0.

    The mean comes from an aggregate of one row that is joined to all; the rows are held in
    a checkpoint, so the plan that made them runs once.
    """
    rows = held(rows)
    w = F.col(weight)
    bad = w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")) | (w < 0)
    mean = rows.agg(F.avg(w).alias("_mean"), F.count_if(bad).alias("_bad"))
    fault = F.raise_error(F.lit("weights must be finite, not negative, and not all zero")).cast("double")
    return rows.join(F.broadcast(mean)).withColumn("sample_weight", F.when((F.col("_bad") > 0) | (F.col("_mean") <= 0), fault).otherwise(w / F.col("_mean"))).drop("_mean", "_bad")


def clipped_mean(rewards: Column, low: float, high: float) -> Column:
    if not 0 < low <= high < float("inf"):
        raise ValueError("bounds must be finite with 0 < low <= high")
    return F.avg(F.greatest(F.lit(low), F.least(F.lit(high), rewards)))


def repeated(rows: DataFrame, n: int) -> DataFrame:
    """Each row n times."""
    return rows.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(n))))
