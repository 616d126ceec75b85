"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.session import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints that nothing refers to any more.

    It learns of them when the driver collects its garbage, which a driver with little to do
    does rarely; so a long operator calls this between its steps.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of narrow tables (ids and digests, 100 bytes a row at most) that may be broadcast.
BROADCAST_ROWS = 200_000


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow table for a join: broadcast if its rows, counted, are few; else joined as it is."""
    held = cut(df)
    return F.broadcast(held) if held.count() <= most else held


#: A key with a larger share of all rows than one in so many is heavy; so there are fewer heavy keys than this.
HEAVY = 10_000


def looked_up(rows: DataFrame, facts: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """rows left-joined with facts (one row a key; n, the rows that have it, of ``total``), whatever the keys' sizes.

    Facts of heavy keys, fewer than HEAVY, are broadcast, so their rows stay where they are. The
    other rows are dealt by key, and no key has more than a small share of them.
    """
    heavy, light = facts.filter(F.col("n") * HEAVY > total), facts.filter(F.col("n") * HEAVY <= total)
    first = rows.join(F.broadcast(heavy), key, "left")
    rest = first.filter(F.col("n").isNull()).select(*rows.columns).join(light, key, "left")
    return first.filter(F.col("n").isNotNull()).unionByName(rest)


def one_of_each(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of each group of documents the one with the smallest id, all columns.

    rows has doc_id, mark (text_mark of the text) and root, the name of the row's group, for
    each row of docs. A null id sorts last; of texts under one id the one with the smallest
    mark stays, of rows alike in id and text one.
    """
    last = F.lit((1 << 63) - 1)
    own = F.struct(F.coalesce("doc_id", last).alias("at"), F.col("doc_id").isNull().alias("none"), F.col("mark"))
    of = cut(rows.groupBy("root", own.alias("own")).agg(F.count("*").alias("twins")))
    first = cut(of.groupBy("root").agg(F.min("own").alias("first"), F.count("*").alias("n"), F.sum("twins").alias("all")).filter("all > 1"))
    told = cut(looked_up(of, first, "root", of.count()).filter("own <> first OR own = first AND twins > 1").select(F.col("own.at").alias("__at"), F.col("own.none").alias("__none"), F.col("own.mark").alias("__mark"), (F.col("own") == F.col("first")).alias("stays")))
    same = (F.coalesce(F.col(id_col).cast("long"), last) == F.col("__at")) & (F.col(id_col).isNull() == F.col("__none")) & (text_mark(F.col(text_col)) == F.col("__mark"))
    keys = ["__at", "__none", "__mark"]
    kept = docs.join(sized(told.select(*keys)), same, "left_anti")
    twins = docs.join(sized(told.filter("stays").select(*keys)), same).dropDuplicates(keys)
    return kept.unionByName(twins.select(*docs.columns))


def text_mark(text: Column) -> Column:
    """Tells texts under one id apart."""
    return F.xxhash64(text.isNull(), text)


#: Rows of an Arrow batch of texts: few, since a text may be long.
TEXT_ROWS = 1000


def text_batches(docs: DataFrame) -> DataFrame:
    """docs, in a session whose Arrow batches hold TEXT_ROWS rows at most, so that a worker holds few texts at once.

    The setting is read when a query runs, so it stays lowered in the session.
    """
    conf = docs.sparkSession.conf
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key)) > TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return docs


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is.

    lower() works byte by byte on a text without other letters; only texts with
    multi-byte characters take the slower translate().
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
