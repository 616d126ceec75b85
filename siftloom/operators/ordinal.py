"""Row numbers over a total order, without a window that puts all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.session import shared_dir


def held(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint in the session's shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """Adds the row's number from 1 in the order.

    Rows are sorted by ranges. The counts of the ranges, one row each, become offsets; a
    checkpoint holds the ranges as they are between the two passes.
    """
    sorted_ = held(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    listed = counts.agg(F.array_sort(F.collect_list(F.struct("_part", "_n"))).alias("c"))
    before = lambda x: F.aggregate(F.filter(F.col("c"), lambda y: y["_part"] < x["_part"]), F.lit(0).cast("long"), lambda a, y: a + y["_n"])
    offsets = listed.select(F.explode(F.transform("c", lambda x: F.struct(x["_part"].alias("_part"), before(x).alias("_before")))).alias("o")).select("o.*")
    return sorted_.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + place + 1).drop("_at", "_part", "_before")
