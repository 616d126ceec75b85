"""Append logs as Structured Streaming: upserts, windowed counts, completion.

Streams run with the available-now trigger; their checkpoints and tables are in the
shared folder, so a restarted query goes on where the last one ended.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftloom.operators.logs import KEY, last_wins
from siftloom.session import removed, shared_dir, ship

PAIRS = pa.schema([("group_id", pa.string()), ("candidate_index", pa.int64())])
#: of groups that share a state: fewer would hold more at once, more would take longer with few groups
BUCKETS = 1024


def shared_folder(spark: SparkSession) -> str:
    """A folder of its own in the session's shared folder."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str, files_a_batch: int = 64) -> DataFrame:
    """A stream of a folder's Parquet files, or of one file."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    whole = path.rstrip("/")
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(whole)
    is_file = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    return reader.option("pathGlobFilter", name).parquet(folder) if is_file else reader.parquet(whole)


def latest_states(spark: SparkSession, path: str, to_log: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The last state of each key after all of a log's files.

    Each batch is reduced to its own last writes, merged with the table so far, and
    written as the table's next version; a batch run twice writes its version again.
    """
    folder = shared_folder(spark)

    def upsert(batch: DataFrame, version: int) -> None:
        new = last_wins(to_log(batch))
        if version:
            new = last_wins(new.unionByName(batch.sparkSession.read.parquet(f"{folder}/v{version - 1}")))
        new.write.mode("overwrite").parquet(f"{folder}/v{version}")
        if version > 1:  # the one before stays: a batch that runs again reads it
            removed(batch.sparkSession, f"{folder}/v{version - 2}")

    query = file_stream(spark, path).writeStream.foreachBatch(upsert).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    versions = query.lastProgress["batchId"] if query.lastProgress else -1
    while versions >= 0:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{folder}/v{versions}/_SUCCESS")
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return spark.read.parquet(f"{folder}/v{versions}")
        versions -= 1
    return last_wins(to_log(spark.read.parquet(path).limit(0)))


def windowed_counts(spark: SparkSession, path: str, ts: str, size: str, late: str | None, keys: list[str]) -> DataFrame:
    """Rows by tumbling window and keys; rows later than ``late`` behind the watermark are dropped, none without it."""
    folder = shared_folder(spark)
    rows = file_stream(spark, path).withColumn(ts, F.col(ts).cast("timestamp"))
    counts = (rows.withWatermark(ts, late) if late else rows).groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("n"))
    flat = counts.select(F.col("window.start").alias("window_start"), *keys, "n")

    def keep(batch: DataFrame, version: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/version={version}")

    query = flat.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    last = rows.groupBy("window_start", *keys).agg(F.max_by("n", "version").alias("n"))
    return last


def distinct(pairs: pa.Table) -> pa.Table:
    return pairs.group_by(KEY, use_threads=False).aggregate([])


def packed(pairs: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, pairs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(pairs.combine_chunks())
    return out.getvalue().to_pybytes()


def completions(log: DataFrame, k: int, buckets: int = BUCKETS) -> DataFrame:
    """A stream's groups, each emitted once when it has k decided candidates (k from 1); n is their number then.

    State is kept per bucket of groups' hashes, not per group, so that Python works on columns
    of many groups at once. A bucket has up to k - 1 indexes of each open group, and one row
    without an index for each group told. Null indexes count for nothing. A checkpoint holds
    for one number of buckets.
    """
    ship(log.sparkSession)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # a group with very many rows is reduced before it is shuffled
        for batch in batches:
            yield from distinct(pa.Table.from_batches([batch])).to_batches()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [pa.ipc.open_stream(bytes(state.get[0])).read_all() if state.exists else PAIRS.empty_table()]
        parts += (distinct(pa.Table.from_pandas(batch[KEY], PAIRS, preserve_index=False)) for batch in batches)
        pairs = distinct(pa.concat_tables(parts))
        groups = pairs.group_by("group_id", use_threads=False).aggregate([("candidate_index", "count"), ([], "count_all")])
        n, told = groups["candidate_index_count"], pc.not_equal(groups["candidate_index_count"], groups["count_all"])
        closed = pc.or_(told, pc.greater_equal(n, k))
        ended = groups["group_id"].filter(closed)
        state.update((packed(pa.concat_tables([pairs.filter(pc.invert(pc.is_in(pairs["group_id"], ended))), pa.table([ended, pa.nulls(len(ended), pa.int64())], PAIRS)])),))
        yield groups.filter(pc.and_not(closed, told)).select(["group_id", "candidate_index_count"]).rename_columns(["group_id", "n"]).to_pandas()

    decided = log.filter(F.col("status").isin("accepted", "rejected") & F.col("candidate_index").isNotNull())
    rows = decided.select(F.col("group_id").cast("string").alias("group_id"), F.col("candidate_index").cast("long").alias("candidate_index"))
    rows = rows.mapInArrow(once, "group_id string, candidate_index long").withColumn("bucket", F.pmod(F.xxhash64("group_id"), F.lit(buckets)))
    return rows.groupBy("bucket").applyInPandasWithState(step, "group_id string, n long", "pairs binary", "append", GroupStateTimeout.NoTimeout)


def completed_groups(spark: SparkSession, path: str, to_log: Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
    """The groups that a stream of a log's files completes, each once, in the order of no batch."""
    folder = shared_folder(spark)
    files = file_stream(spark, path, 1024)  # few batches: each one that comes to a bucket writes its state anew
    query = completions(to_log(files), k).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("group_id string, n long").parquet(f"{folder}/out")


class Progress(StreamingQueryListener):
    """Heartbeats of streams: one row a batch, with rows read, kept state and seconds; ``rows()`` gives them so far."""

    def __init__(self) -> None:
        self.seen: list[tuple[str, int, int, int, float]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.seen.append((str(p.id), p.batchId, p.numInputRows, sum(s.numRowsTotal for s in p.stateOperators), p.batchDuration / 1000.0))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.seen, "query string, batch long, rows long, state_rows long, seconds double")


def deduplicated(log: DataFrame, ts: str, late: str) -> DataFrame:
    """A stream without repeats of a key within the watermark."""
    return log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(KEY)
