"""Violations, reconciliations and disjointness as relations: no rows, no fault."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(rule, key) of every row that breaks a rule: one pass for all row rules."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in rules)))
    return df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def reconcile(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys of one side only: (key, state) with missing or unexpected."""
    e, a = expected.select(F.col(key).alias("e")).distinct(), actual.select(F.col(key).alias("a")).distinct()
    both = e.join(a, F.col("e") == F.col("a"), "full_outer")
    state = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected")
    return both.select(F.coalesce("e", "a").alias(key), state.alias("state")).filter("state IS NOT NULL")


def duplicate_content(df: DataFrame, key: str, content: str) -> DataFrame:
    """Groups of equal content by its digest: the digest, how many, and the keys in order."""
    digests = df.select(F.col(key).alias("k"), F.sha2(content, 256).alias("digest"))
    return digests.groupBy("digest").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("k")).alias("keys")).filter("n > 1")


def overlap(training: DataFrame, benchmark: DataFrame, key: str, keys_of: Column, bench_key: str, bench_keys_of: Column) -> DataFrame:
    """Pairs of rows that share a content key; keys_of gives the array of a row's keys."""
    t = training.select(F.col(key), F.explode(keys_of).alias("_k")).distinct()
    b = benchmark.select(F.col(bench_key), F.explode(bench_keys_of).alias("_k")).distinct()
    return t.join(b, "_k").groupBy(key, bench_key).agg(F.count("*").alias("shared"))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def unsorted(df: DataFrame, order: list[str], ordinal: str, partition: list[str]) -> DataFrame:
    """Rows that stand before a row they should follow, within a partition."""
    from pyspark.sql import Window

    now = F.struct(*order)
    before = F.lag(now).over(Window.partitionBy(*partition).orderBy(ordinal))
    return df.withColumn("_before", before).filter(F.col("_before") > now).drop("_before")


def exact_match(rows: DataFrame, contract: DataFrame, on: list[str], row_key: str) -> DataFrame:
    """Rows with the number of contract records that have their signature; anything but 1 is a fault."""
    counts = contract.groupBy(*on).agg(F.count("*").alias("_n"))
    return rows.join(counts, on, "left").select(row_key, F.coalesce("_n", F.lit(0)).cast("long").alias("matches"))


def coverage(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """One row: expected, found, missing, unexpected, and the share found."""
    e, a = expected.select(F.col(key).alias("e")).distinct(), actual.select(F.col(key).alias("a")).distinct()
    both = e.join(a, F.col("e") == F.col("a"), "full_outer")
    out = both.agg(F.count("e").alias("expected"), F.count_if(F.col("e").isNotNull() & F.col("a").isNotNull()).alias("found"), F.count_if(F.col("a").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("unexpected"))
    return out.withColumn("share", F.try_divide(F.col("found").cast("double"), F.col("expected")))
