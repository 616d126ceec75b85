"""The domain's relations, made from the test tables; the same arithmetic in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftloom.functions import scoring as s
from siftloom.operators.gates import Gates

EDIT_TYPE_OF = {"STANDARD": "object_replacement", "ECONOMY": "object_removal", "MEDIUM": "object_addition", "PROMO": "color_change", "LARGE": "style_transfer", "SMALL": "background_change"}
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
THRESHOLDS = {"edit": 0.40, "taxonomy": 0.35, "preservation": 0.20, "validity": 0.50, "reward": 0.30}
TOP_M = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(x: Column, values: dict[str, str], default: str) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(x == k, v) if out is None else out.when(x == k, v)
    return out.otherwise(default)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of groups (orders), with their scores."""
    # named before the first window, so that all windows and aggregates of a group share one exchange
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "group_id")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    place = F.row_number().over(Window.partitionBy("group_id").orderBy(*LINE_ORDER)) - 1
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    return joined.select(
        "group_id",
        place.cast("long").alias("candidate_index"),
        F.when(F.col("l_returnflag") == "R", "reference:base").otherwise("policy").alias("role"),
        (F.col("l_quantity") / 50.0).alias("specificity"),
        ((F.col("l_partkey") % 97 + 1) / F.lit(97.0)).alias("taxonomy"),
        (1.0 - 5.0 * F.col("l_discount")).alias("preservation"),
        (1.0 - 10.0 * F.col("l_tax")).alias("validity"),
        (F.col("l_linestatus") == "F").alias("judge_supported"),
        ((F.col("l_suppkey") % 100 + 0.5) / 100.0).alias("judge_score"),
        lookup(F.col("p_type"), EDIT_TYPE_OF, "unknown").alias("edit_type"),
        F.coalesce("p_brand", F.lit("unknown")).alias("family"),
        "l_partkey",
        "l_suppkey",
    )


CANDIDATES = """
    candidates AS (
      SELECT l_orderkey AS group_id,
             CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity,
                  l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS BIGINT) AS candidate_index,
             CASE WHEN l_returnflag = 'R' THEN 'reference:base' ELSE 'policy' END AS role,
             l_quantity / 5e1 AS specificity, CAST(l_partkey % 97 + 1 AS DOUBLE) / 97e0 AS taxonomy,
             1e0 - 5e0 * l_discount AS preservation, 1e0 - 1e1 * l_tax AS validity, l_linestatus = 'F' AS judge_supported,
             (CAST(l_suppkey % 100 AS DOUBLE) + 5e-1) / 1e2 AS judge_score,
             CASE p_type WHEN 'STANDARD' THEN 'object_replacement' WHEN 'ECONOMY' THEN 'object_removal' WHEN 'MEDIUM' THEN 'object_addition'
                  WHEN 'PROMO' THEN 'color_change' WHEN 'LARGE' THEN 'style_transfer' WHEN 'SMALL' THEN 'background_change' ELSE 'unknown' END AS edit_type,
             coalesce(p_brand, 'unknown') AS family, l_partkey, l_suppkey
      FROM lineitem LEFT JOIN part ON l_partkey = p_partkey),
    scored AS (
      SELECT *, sqrt(greatest(specificity * taxonomy, 0e0)) AS edit,
             sqrt(greatest(sqrt(greatest(specificity * taxonomy, 0e0)) * preservation, 0e0)) AS raw_reward FROM candidates),
    gated AS (
      SELECT *, CASE WHEN NOT specificity >= 4e-1 THEN 'edit_specificity' WHEN NOT taxonomy >= 35e-2 THEN 'taxonomy'
                     WHEN NOT preservation >= 2e-1 THEN 'preservation' WHEN NOT validity >= 5e-1 THEN 'validity'
                     WHEN NOT raw_reward >= 3e-1 THEN 'reward' END AS reject_reason FROM scored),
    rated AS (SELECT *, reject_reason IS NULL AS feasible, CASE WHEN reject_reason IS NULL THEN raw_reward ELSE 0e0 END AS reward FROM gated),
    ranked AS (
      SELECT *, CASE WHEN feasible THEN CAST(row_number() OVER (PARTITION BY group_id ORDER BY feasible DESC, reward DESC, candidate_index) AS BIGINT) ELSE 0 END AS rnk
      FROM rated),
    judged AS (
      SELECT *, feasible AND rnk <= 1 AS accepted, CASE WHEN feasible AND rnk <= 1 THEN 'accepted' ELSE 'rejected' END AS status FROM ranked)
"""


def candidate_gates() -> Gates:
    c = F.col
    t = THRESHOLDS
    return Gates(
        ("edit_specificity", c("specificity") >= t["edit"]),
        ("taxonomy", c("taxonomy") >= t["taxonomy"]),
        ("preservation", c("preservation") >= t["preservation"]),
        ("validity", c("validity") >= t["validity"]),
        ("reward", c("raw_reward") >= t["reward"]),
    )


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with edit score, raw reward, gates and gated reward."""
    scored = candidates(spark, sf_dir).withColumn("edit", s.edit_score("specificity", "taxonomy"))
    scored = scored.withColumn("raw_reward", s.raw_reward("edit", "preservation"))
    gates = candidate_gates()
    gated = scored.withColumn("reject_reason", gates.reason()).withColumn("feasible", gates.feasible())
    return gated.withColumn("reward", F.when(F.col("feasible"), F.col("raw_reward")).otherwise(0.0))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated candidates with rank, acceptance and status: best of N."""
    from siftloom.operators.rank import best_of_n

    return best_of_n(rated(spark, sf_dir), top_m=TOP_M)


def candidate_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append log of candidates' states; seq is the order of writing."""
    return log_of(table(spark, sf_dir, "events"))


def log_of(e: DataFrame) -> DataFrame:
    status = lookup(F.col("event_type"), {"signup": "planned", "view": "generated", "purchase": "accepted"}, "rejected")
    return e.select(
        F.concat_ws("_", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("group_id"),
        (F.col("event_id") % 4).alias("candidate_index"),
        F.col("event_id").alias("seq"),
        status.alias("status"),
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("total_score"),
        F.to_date("ts").alias("day"),
    )


LOG = """
    log AS (
      SELECT CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y-%m-%d') AS group_id, event_id % 4 AS candidate_index, event_id AS seq,
             CASE event_type WHEN 'signup' THEN 'planned' WHEN 'view' THEN 'generated' WHEN 'purchase' THEN 'accepted' ELSE 'rejected' END AS status,
             least(value / 1e2, 1e0) AS total_score, CAST(ts AS DATE) AS day
      FROM events)
"""


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to select from: task, language, key, instruction."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("task"), F.col("lang").alias("language"), F.col("doc_id").cast("string").alias("key"), F.col("text").alias("instruction"))


POOL = "pool AS (SELECT source AS task, lang AS language, CAST(doc_id AS VARCHAR) AS key, text AS instruction FROM documents)"
