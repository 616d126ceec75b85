"""Queries over vectors and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.functions import arrays
from siftloom.functions import scoring as s
from siftloom.plans import adapters as a
from siftloom.plans.registry import query, r6

PAIRED = "p AS (SELECT x.vec_id, x.label, x.embedding::DOUBLE[] AS a, y.embedding::DOUBLE[] AS b, z.embedding::DOUBLE[] AS t FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1 JOIN embeddings z ON z.vec_id = x.vec_id + 2)"


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the next two, as original, edited and text."""
    e = a.table(spark, sf_dir, "embeddings")
    x = e.select("vec_id", "label", F.col("embedding").alias("a"))
    y = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    z = e.select((F.col("vec_id") - 2).alias("vec_id"), F.col("embedding").alias("t"))
    return x.join(y, "vec_id").join(z, "vec_id")


COS = "list_dot_product({0}, {1}) / greatest(sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})), 1e-12)"


@query(f"""
    WITH {PAIRED}, c AS (SELECT vec_id, label, {COS.format("b", "t")} AS bt, {COS.format("a", "t")} AS at_, {COS.format("a", "b")} AS ab FROM p)
    SELECT vec_id, {r6("bt - at_", 5)} AS gain, {r6("exp(-(1e0 - 5e-1 * (1e0 + ab)) / 3e-1)", 5)} AS preservation FROM c
""")
def cosine_prompt_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return paired(spark, sf_dir).select(
        "vec_id",
        s.round6(s.prompt_gain(c("b"), c("a"), c("t")), 5).alias("gain"),
        s.round6(s.semantic_preservation(s.cosine01(c("a"), c("b")), 0.3), 5).alias("preservation"),
    )


@query(f"""
    WITH {PAIRED}, d AS (SELECT vec_id, a, b, list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2])) AS d FROM p),
    m AS (SELECT *, list_sum(d) / len(d) AS mean FROM d)
    SELECT vec_id, {r6("CAST(len(list_filter(d, lambda x: x > 1e-1)) AS DOUBLE) / len(d)", 5)} AS changed, {r6("mean", 5)} AS mad,
           {r6("coalesce(list_sum(list_filter(d, lambda x: x > 1e-1)) / len(list_filter(d, lambda x: x > 1e-1)), 0e0)", 5)} AS inside,
           {r6("coalesce(list_sum(list_filter(d, lambda x: x <= 1e-1)) / nullif(len(list_filter(d, lambda x: x <= 1e-1)), 0), 0e0)", 5)} AS outside FROM m
""")
def region_stats_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    stats = arrays.region_statistics(c("a"), c("b"), arrays.difference_mask(c("a"), c("b"), 0.1))
    rows = paired(spark, sf_dir).withColumn("st", stats)
    return rows.select(
        "vec_id",
        s.round6(arrays.changed_fraction(c("a"), c("b"), 0.1), 5).alias("changed"),
        s.round6(arrays.mean_absolute_difference(c("a"), c("b")), 5).alias("mad"),
        s.round6(c("st.inside"), 5).alias("inside"),
        s.round6(c("st.outside"), 5).alias("outside"),
    )


@query(f"""
    WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS a FROM embeddings), m AS (SELECT *, list_sum(a) / len(a) AS mean FROM v),
    d AS (SELECT *, sqrt(list_sum(list_transform(a, lambda x: (x - mean) * (x - mean))) / len(a)) AS sd FROM m)
    SELECT vec_id, {r6("mean", 5)} AS mean, {r6("sd", 5)} AS sd, CAST(len(list_filter(a, lambda x: x > mean + 1e0 * sd)) AS BIGINT) AS above FROM d
""")
def vector_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = a.table(spark, sf_dir, "embeddings"), F.col("embedding")
    # not named like the outputs: in a lambda, Spark takes an output of the same select before the column
    rows = e.withColumn("whole_mean", arrays.mean(v)).withColumn("whole_sd", arrays.std(v))
    above = F.size(F.filter(v, lambda x: x.cast("double") > F.col("whole_mean") + 1.0 * F.col("whole_sd"))).cast("long")
    return rows.select("vec_id", s.round6(F.col("whole_mean"), 5).alias("mean"), s.round6(F.col("whole_sd"), 5).alias("sd"), above.alias("above"))


@query(f"""
    SELECT event_id, CASE WHEN x < 35e-2 THEN {r6("least(greatest(x / 35e-2, 0e0), 1e0)")} WHEN x > 9e-1 THEN {r6("least(greatest(1e0 - (x - 9e-1) / greatest(1e0 - 9e-1, 1e-6), 0e0), 1e0)")} ELSE 1e0 END AS range_score,
           CASE event_id % 3 WHEN 0 THEN {r6("least(greatest(x / 8e-2, 0e0), 1e0)")} WHEN 1 THEN {r6("least(greatest(-x / 8e-2, 0e0), 1e0)")} ELSE CASE WHEN x <= 8e-2 THEN 1e0 ELSE {r6("least(greatest(1e0 - (x - 8e-2) / (1e0 - 8e-2), 0e0), 1e0)")} END END AS directional
    FROM (SELECT event_id, value / 1e2 AS x FROM events)
""")
def range_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "events").withColumn("x", F.col("value") / 100.0)
    direction = F.when(F.col("event_id") % 3 == 0, "increase").when(F.col("event_id") % 3 == 1, "decrease").otherwise("at_most")
    return e.select("event_id", s.round6(s.range_score("x", 0.35, 0.9)).alias("range_score"), s.round6(s.directional_score("x", 0.08, direction)).alias("directional"))


LOGS = "ln(greatest(least(greatest({0}, 0e0), 1e0), 1e-6))"


@query(f"""
    WITH {a.CANDIDATES} SELECT group_id, candidate_index, {r6("exp((" + LOGS.format("specificity") + " + " + LOGS.format("taxonomy") + " + coalesce(CASE WHEN judge_supported THEN " + LOGS.format("judge_score") + " END, 0e0)) / (2 + judge_supported::INT))", 5)} AS gm,
      {r6("exp((7e-1 * " + LOGS.format("edit") + " + 3e-1 * " + LOGS.format("validity") + ") / (7e-1 + 3e-1))", 5)} AS blend FROM scored
""")
def geometric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = a.rated(spark, sf_dir)
    gm = s.geometric_mean([c("specificity"), c("taxonomy"), F.when(c("judge_supported"), c("judge_score"))])
    return rows.select("group_id", "candidate_index", s.round6(gm, 5).alias("gm"), s.round6(s.geometric_blend(c("edit"), 0.7, c("validity"), 0.3), 5).alias("blend"))


@query(f"""
    WITH {PAIRED}, m AS (SELECT *, list_sum(a) / len(a) AS ma, list_sum(b) / len(b) AS mb FROM p),
    k AS (SELECT vec_id, list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - ma) * (z[2] - mb))) AS cov, sqrt(list_sum(list_transform(a, lambda x: (x - ma) * (x - ma))) / len(a)) AS sa,
                 sqrt(list_sum(list_transform(b, lambda x: (x - mb) * (x - mb))) / len(b)) AS sb, len(a) AS n FROM m)
    SELECT vec_id, {r6("cov / greatest(sa * sb * n, 1e-12)", 5)} AS correlation FROM k
""")
def structure_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(spark, sf_dir).select("vec_id", s.round6(arrays.correlation(F.col("a"), F.col("b")), 5).alias("correlation"))


@query(f"""
    SELECT label, CAST(count(*) AS BIGINT) AS n, {r6("avg(embedding[1]::DOUBLE)", 5)} AS first_mean, {r6("stddev_pop(embedding[2]::DOUBLE)", 5)} AS second_spread FROM embeddings GROUP BY 1
""")
def pooled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "embeddings")
    first, second = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    return e.groupBy("label").agg(F.count("*").alias("n"), s.round6(F.avg(first), 5).alias("first_mean"), s.round6(F.stddev_pop(second), 5).alias("second_spread"))
