"""Queries over the candidates' append log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.functions import scoring as s
from siftloom.operators import logs
from siftloom.plans import adapters as a
from siftloom.plans.registry import query, r6

LAST = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id, candidate_index ORDER BY seq DESC) AS k FROM log) WHERE k = 1)"


@query(f"WITH {a.LOG}, {LAST} SELECT group_id, candidate_index, seq, status, {r6('total_score')} AS total_score FROM last")
def candidate_log_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.last_wins(a.candidate_log(spark, sf_dir)).select("group_id", "candidate_index", "seq", "status", s.round6(F.col("total_score")).alias("total_score"))


@query(f"""
    WITH {a.LOG}, f AS (SELECT *, row_number() OVER (PARTITION BY group_id, candidate_index ORDER BY seq) AS k FROM log)
    SELECT group_id, candidate_index, seq, {r6("total_score")} AS total_score FROM f WHERE k = 1 AND status = 'accepted'
""")
def accepted_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.first_accepted(a.candidate_log(spark, sf_dir)).select("group_id", "candidate_index", "seq", s.round6(F.col("total_score")).alias("total_score"))


DONE = """
    p AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY candidate_index) AS place FROM last),
    done AS (SELECT group_id FROM p WHERE place <= 2 GROUP BY 1 HAVING count(*) >= 2 AND bool_and(status IN ('accepted', 'rejected')))
"""


@query(f"WITH {a.LOG}, {LAST}, {DONE} SELECT group_id FROM done")
def completed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.completed_groups(logs.last_wins(a.candidate_log(spark, sf_dir)), 2)


@query(f"WITH {a.LOG}, {LAST}, {DONE} SELECT DISTINCT group_id FROM log WHERE group_id NOT IN (SELECT group_id FROM done)")
def pending_groups_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = a.candidate_log(spark, sf_dir)
    return logs.pending(log.select("group_id").distinct(), logs.completed_groups(logs.last_wins(log), 2))


@query("""
    WITH first AS (SELECT event_id AS key, value AS score FROM events WHERE event_id % 3 <> 0),
    retried AS (SELECT event_id AS key, value * 2e0 AS score FROM events WHERE event_id % 5 = 0)
    SELECT coalesce(r.key, f.key) AS key, coalesce(r.score, f.score) AS score, r.key IS NOT NULL AS retried FROM first f FULL JOIN retried r ON f.key = r.key
""")
def retry_merge_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "events")
    first = e.filter(F.col("event_id") % 3 != 0).select(F.col("event_id").alias("key"), F.col("value").alias("score"), F.lit(False).alias("retried"))
    again = e.filter(F.col("event_id") % 5 == 0).select(F.col("event_id").alias("key"), (F.col("value") * 2.0).alias("score"), F.lit(True).alias("retried"))
    return logs.retry_merge(first, again, "key")


@query(f"""
    WITH {a.LOG}, {LAST} SELECT status, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT group_id) AS BIGINT) AS groups, CAST(max(seq) AS BIGINT) AS last_seq FROM last GROUP BY 1
""")
def stream_upsert_available_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream of files, upserted to its last states, then counted."""
    from siftloom.streaming.upsert import latest_states

    state = latest_states(spark, f"{sf_dir}/events.parquet", lambda df: a.log_of(df))
    return state.groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("groups"), F.max("seq").alias("last_seq"))


@query("""
    SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2
""")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour in a stream; a replay of a whole table, so without a watermark. An addition of this library."""
    from siftloom.streaming.upsert import windowed_counts

    out = windowed_counts(spark, f"{sf_dir}/events.parquet", "ts", "1 hour", None, ["event_type"])
    return out.select(F.floor(F.unix_timestamp("window_start") / 3600).cast("long").alias("hour"), "event_type", "n")


@query(f"""
    WITH {a.LOG}, c AS (SELECT group_id, count(DISTINCT candidate_index) AS n FROM log GROUP BY 1)
    SELECT group_id, CAST(n AS BIGINT) AS n, n >= 2 + (CASE WHEN hash_key % 3 = 0 THEN 1 ELSE 0 END) AS complete
    FROM (SELECT *, CAST(split_part(group_id, '_', 1) AS BIGINT) AS hash_key FROM c)
""")
def group_completion_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = a.candidate_log(spark, sf_dir).groupBy("group_id").agg(F.count_distinct("candidate_index").alias("n"))
    need = 2 + F.when(F.split_part("group_id", F.lit("_"), F.lit(1)).cast("long") % 3 == 0, 1).otherwise(0)
    return counts.select("group_id", "n", (F.col("n") >= need).alias("complete"))


@query(f"""
    WITH {a.LOG}, c AS (SELECT group_id, count(DISTINCT candidate_index) AS n FROM log WHERE status IN ('accepted', 'rejected') GROUP BY 1) SELECT group_id FROM c WHERE n >= 2
""")
def stream_completed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream; each group is told once, when two of its candidates are decided."""
    from siftloom.streaming.upsert import completed_groups

    return completed_groups(spark, f"{sf_dir}/events.parquet", lambda df: a.log_of(df), 2).select("group_id")
