"""Queries that select, apportion and schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftloom.functions import scoring as s
from siftloom.operators import rank
from siftloom.operators.schedule import BANK, bank, cyclic_next, distractors, feasible_types, tiered
from siftloom.plans import adapters as a
from siftloom.plans.registry import query, r6

SELECTED = f"""
    {a.POOL}, h AS (SELECT task, language, key, sha256('42' || chr(0) || task || chr(0) || language || chr(0) || key) AS digest FROM pool),
    o AS (SELECT *, CAST(row_number() OVER (PARTITION BY task, language ORDER BY digest, key) AS BIGINT) AS place FROM h)
"""


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.stratified(a.pool(spark, sf_dir).select("task", "language", "key"), ["task", "language"], "key", 42, 3)


@query(f"WITH {SELECTED} SELECT task, language, key, place, digest FROM o WHERE place <= 3")
def stratified_hash_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection(spark, sf_dir).filter("selected").select("task", "language", "key", "place", "digest")


@query(f"WITH {a.POOL} SELECT task, language, CAST(count(*) AS BIGINT) AS found, CAST(12 AS BIGINT) AS need FROM pool GROUP BY 1, 2 HAVING count(*) < 12")
def stratified_deficits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.deficits(a.pool(spark, sf_dir), ["task", "language"], 12)


@query(f"WITH {SELECTED} SELECT task, language, CAST(count(*) AS BIGINT) AS n, min(task || '::' || language || '::' || key) AS first_identity FROM o WHERE place <= 3 GROUP BY 1, 2")
def selection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection(spark, sf_dir).filter("selected").groupBy("task", "language").agg(F.count("*").alias("n"), F.min(F.concat_ws("::", "task", "language", "key")).alias("first_identity"))


@query("""
    WITH l AS (SELECT source AS label, CAST(count(*) AS DOUBLE) AS weight, row_number() OVER (ORDER BY source) - 1 AS pos FROM documents GROUP BY 1),
    t AS (SELECT sum(weight) AS total FROM l), r AS (SELECT pos, label, weight, weight * 97 / total AS raw FROM l, t),
    f AS (SELECT *, floor(raw) AS fl, raw - floor(raw) AS frac FROM r), u AS (SELECT 97 - sum(fl) AS remaining FROM f),
    k AS (SELECT *, row_number() OVER (ORDER BY frac DESC, weight DESC, pos) AS place FROM f)
    SELECT CAST(pos AS BIGINT) AS pos, label, CAST(fl + CASE WHEN place <= remaining THEN 1 ELSE 0 END AS BIGINT) AS quota FROM k, u
""")
def largest_remainder_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = a.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("label")).agg(F.count("*").cast("double").alias("weight"))
    labels = counts.withColumn("pos", (F.row_number().over(Window.orderBy("label")) - 1).cast("long"))
    return rank.apportion(labels, 97).select("pos", "label", "quota")


QUOTAS = (("src3", 4), ("src1", 2), ("src0", 0), ("src2", 30000))


def cursor_sql(interleave: bool) -> str:
    """The fourth round of the quotas, seed 7, a hundred thousand rows at most."""
    order, once = ("turn, pos", "WHERE turn < size") if interleave else ("pos, turn", "")
    return f"""
    WITH q(pos, source, quota) AS (VALUES {", ".join(f"({k}, '{s_}', {n})" for k, (s_, n) in enumerate(QUOTAS))}),
    o AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('7:4' || chr(0) || source || chr(0) || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS size FROM documents),
    w AS (SELECT q.source, pos, size, unnest(range(0, quota)) AS turn, quota FROM q JOIN (SELECT source, count(*) AS size FROM documents GROUP BY 1) c ON c.source = q.source WHERE quota > 0),
    t AS (SELECT o.source, o.doc_id, w.turn, w.pos FROM (SELECT *, (3 * quota + turn) % size AS k FROM w {once}) w JOIN o ON o.source = w.source AND o.k = w.k),
    f AS (SELECT CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS place, source, doc_id FROM t QUALIFY place <= 30100),
    r AS (SELECT source, doc_id, row_number() OVER (ORDER BY sha256('7:4:fill' || chr(0) || source || chr(0) || CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f))
    SELECT place, source, doc_id, false AS fills FROM f
    UNION ALL SELECT CAST(k + (SELECT count(*) FROM f) AS BIGINT), source, doc_id, true FROM r WHERE k <= 30100 - (SELECT count(*) FROM f)
    """


def cursor(spark: SparkSession, sf_dir: str, interleave: bool) -> DataFrame:
    quotas = spark.createDataFrame([(k, s_, n) for k, (s_, n) in enumerate(QUOTAS)], "pos long, label string, quota long")
    return rank.cursor_sample(a.table(spark, sf_dir, "documents"), "source", "doc_id", quotas, 4, 7, 30_100, interleave)


@query(cursor_sql(False))
def stratified_cursor_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth round of a sample by label: small labels start over, what is missing is filled up."""
    return cursor(spark, sf_dir, False)


@query(cursor_sql(True))
def stratified_cursor_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the labels taking turns."""
    return cursor(spark, sf_dir, True)


@query("""
    WITH n AS (SELECT CAST(count(*) AS BIGINT) AS n FROM documents)
    SELECT doc_id, CAST((doc_id - (5 * 300) % n + n) % n AS BIGINT) AS slot FROM documents, n WHERE (doc_id - (5 * 300) % n + n) % n < 300
""")
def sequential_shard_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = a.table(spark, sf_dir, "documents").select("doc_id")
    n = d.count()
    return rank.shard(d, "doc_id", max(n, 1), 5 * 300 % max(n, 1), 300)


@query("""
    WITH types(pos, kind) AS (VALUES (0, 'object_replacement'), (1, 'object_removal'), (2, 'object_addition'), (3, 'color_change'), (4, 'style_transfer'), (5, 'background_change')),
    f(family, kinds) AS (VALUES ('en', ['object_replacement', 'object_removal']), ('fr', ['color_change']), ('de', ['style_transfer', 'background_change']), ('es', [])),
    r AS (SELECT doc_id, lang, doc_id % 6 AS at FROM documents),
    c AS (SELECT r.doc_id, r.lang, t.kind, (t.pos - r.at + 6) % 6 AS distance FROM r JOIN f ON f.family = r.lang JOIN types t ON len(f.kinds) = 0 OR list_contains(f.kinds, t.kind)),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance) AS k FROM c)
    SELECT doc_id, lang, kind, CAST(distance AS BIGINT) AS distance FROM o WHERE k = 1
""")
def coverage_schedule_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next type of the cycle that a record's language allows."""
    kinds = ["object_replacement", "object_removal", "object_addition", "color_change", "style_transfer", "background_change"]
    families = {"en": ["object_replacement", "object_removal"], "fr": ["color_change"], "de": ["style_transfer", "background_change"]}
    d = a.table(spark, sf_dir, "documents").select("doc_id", "lang")
    allowed = feasible_types(F.col("lang"), families, kinds)
    picked = cyclic_next(F.col("doc_id") % len(kinds), kinds, allowed)
    return d.withColumn("p", picked).select("doc_id", "lang", F.col("p.kind").alias("kind"), F.col("p.distance").cast("long").alias("distance"))


def values_sql() -> str:
    rows = ", ".join(f"({k}, '{b.operation_id}', '{b.family}', {b.difficulty}, '{b.scope}', '{b.metric}', {f"'{b.inverse}'" if b.inverse else 'NULL'})" for k, b in enumerate(BANK))
    return f"bank(pos, operation_id, family, difficulty, scope, metric, inverse) AS (VALUES {rows})"


@query(f"WITH {values_sql()} SELECT operation_id, family, CAST(difficulty AS BIGINT) AS difficulty, scope, metric FROM bank WHERE difficulty <= 2 AND family IN ('exposure', 'tone', 'style')")
def bank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank(spark, 2, ["exposure", "tone", "style"]).select("operation_id", "family", F.col("difficulty").cast("long").alias("difficulty"), "scope", "metric")


@query(f"""
    WITH {values_sql()}, d AS (
      SELECT p.operation_id, q.operation_id AS distractor, CASE WHEN q.operation_id = p.inverse THEN 0 WHEN q.family = p.family OR q.metric = p.metric THEN 1 ELSE 2 END AS tier, q.pos
      FROM bank p JOIN bank q ON p.operation_id <> q.operation_id),
    o AS (SELECT *, CAST(row_number() OVER (PARTITION BY operation_id ORDER BY tier, pos) AS BIGINT) AS place FROM d)
    SELECT operation_id, distractor, CAST(tier AS BIGINT) AS tier, place FROM o WHERE place <= 3
""")
def distractor_topn_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distractors(bank(spark), 3)


@query(f"""
    WITH {values_sql()}, r AS (SELECT doc_id, lang FROM documents),
    t AS (SELECT r.doc_id, b.operation_id, CASE WHEN b.family = CASE lang WHEN 'en' THEN 'color' WHEN 'fr' THEN 'style' ELSE 'tone' END THEN 0 WHEN b.scope = 'local' THEN 1 ELSE 2 END AS tier,
                 sha256('42' || chr(0) || CAST(doc_id AS VARCHAR) || chr(0) || b.operation_id) AS digest FROM r JOIN bank b ON b.difficulty <= 2),
    o AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY tier, digest) AS BIGINT) AS place FROM t)
    SELECT doc_id, operation_id, CAST(tier AS BIGINT) AS tier, place FROM o WHERE place <= 2
""")
def tiered_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two operations for every record, by tier, then by hash."""
    d = a.table(spark, sf_dir, "documents").select("doc_id", "lang")
    primary = F.when(F.col("lang") == "en", "color").when(F.col("lang") == "fr", "style").otherwise("tone")
    return tiered(d, "doc_id", primary, bank(spark, 2), 2, seed=42)


@query(f"""
    SELECT event_id, CAST(42 + 7 + (event_id % 5) * 1000003 + user_id * 1009 + (event_id % 3) * 101 + event_id % 4 AS BIGINT) AS seed,
           CAST(greatest(1, ceil(user_id / 4e0)) AS BIGINT) AS rounds, CAST(round_even(sqrt(1e6 * (1e0 + user_id % 7 / 1e1)) / 32e0, 0) * 32 AS BIGINT) AS width, {r6("1e2 * (value + 1e0 - value) / greatest(value, 1e0)", 4)} AS improvement
    FROM events
""")
def seeds_and_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c = a.table(spark, sf_dir, "events"), F.col
    width, _ = s.rounded_side(F.lit(1e6), 1.0 + c("user_id") % 7 / 10.0)
    return e.select(
        "event_id",
        s.seed(42, c("event_id") % 5, c("user_id"), c("event_id") % 3, c("event_id") % 4, offset=7).alias("seed"),
        s.rounds_needed(c("user_id"), 4).alias("rounds"),
        width.alias("width"),
        s.round6(100.0 * (c("value") + 1.0 - c("value")) / F.greatest(c("value"), F.lit(1.0)), 4).alias("improvement"),
    )
