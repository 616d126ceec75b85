"""Append logs of candidates: last write wins, first accepted wins, completion, resumption."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftloom.operators.rank import best_by

KEY = ["group_id", "candidate_index"]


def last_wins(log: DataFrame, order: str = "seq", keys: list[str] | None = None) -> DataFrame:
    """The last row written of each key.

    An aggregate with a map-side combine, not a window: a key with very many writes is
    reduced before it is shuffled.
    """
    keys = keys or KEY
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"))
    return last.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest))


def first_accepted(log: DataFrame, order: str = "seq") -> DataFrame:
    """The first row of each key, if it is accepted: a first row that is not hides a later one that is."""
    rest = [c for c in log.columns if c not in KEY]
    first = log.groupBy(*KEY).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return first.select(*KEY, *(F.col(f"_first.{c}").alias(c) for c in rest)).filter("status = 'accepted'")


def completed_groups(log: DataFrame, k: int) -> DataFrame:
    """Groups with k rows or more whose first k, by index, are all decided."""
    place = F.row_number().over(Window.partitionBy("group_id").orderBy("candidate_index"))
    first = log.withColumn("_place", place).filter(F.col("_place") <= k)
    done = first.groupBy("group_id").agg(F.count("*").alias("n"), F.bool_and(F.col("status").isin("accepted", "rejected")).alias("decided"))
    return done.filter((F.col("n") >= k) & F.col("decided")).select("group_id")


def pending(groups: DataFrame, done: DataFrame) -> DataFrame:
    return groups.join(done.select("group_id"), "group_id", "left_anti")


def retry_merge(first: DataFrame, retried: DataFrame, key: str) -> DataFrame:
    """Rows of both; of a key in both the retried one."""
    both = first.withColumn("_round", F.lit(0)).unionByName(retried.withColumn("_round", F.lit(1)))
    return best_by(both, [key], [F.desc("_round")]).drop("_round")


def torn_tail(lines: DataFrame) -> DataFrame:
    """Rows of a JSON log that do not parse and are not its last line; these are faults.

    lines: path, line, bad (boolean). A bad last line is a write that was cut off.
    """
    last = lines.groupBy("path").agg(F.max("line").alias("_last"))
    return lines.filter("bad").join(last, "path").filter(F.col("line") < F.col("_last")).drop("_last")
