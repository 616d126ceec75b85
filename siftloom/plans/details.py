"""Queries of the smaller record operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftloom.functions import parsing
from siftloom.functions import scoring as s
from siftloom.functions import text as t
from siftloom.operators import gates, payloads, schedule, weights
from siftloom.plans import adapters as a
from siftloom.plans import scheduling
from siftloom.plans.registry import query, r6


@query(f"""
    WITH {a.CANDIDATES}, n AS (SELECT *, CASE WHEN status <> 'rejected' THEN 'near_miss_status' WHEN edit_type NOT IN ('object_removal', 'object_replacement', 'color_change') THEN 'near_miss_edit_type'
        WHEN NOT coalesce(reject_reason IN ('validity', 'taxonomy'), false) THEN 'near_miss_reject_reason' WHEN NOT judge_supported THEN 'near_miss_judge_unsupported' WHEN judge_score < 4e-1 THEN 'near_miss_judge_confidence'
        WHEN edit < 3e-1 THEN 'near_miss_edit_below_floor' WHEN preservation < 6e-1 THEN 'near_miss_preservation_below_floor' END AS reason FROM judged),
    w AS (SELECT *, count(*) FILTER (accepted) OVER (PARTITION BY group_id) AS anchors FROM n)
    SELECT coalesce(reason, CASE WHEN anchors < 1 THEN 'near_miss_no_anchor' ELSE 'near_miss' END) AS reason, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY 1
""")
def near_miss_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = gates.near_miss(("object_removal", "object_replacement", "color_change"), ("validity", "taxonomy"), {"edit": 0.3, "preservation": 0.6}, 0.4)
    anchors = F.count_if("accepted").over(Window.partitionBy("group_id"))
    rows = a.judged(spark, sf_dir).withColumn("reason", reason).withColumn("anchors", anchors)
    return rows.groupBy(F.coalesce("reason", F.when(F.col("anchors") < 1, "near_miss_no_anchor").otherwise("near_miss")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""
    WITH {a.CANDIDATES}, c AS (SELECT group_id, candidate_index, CASE WHEN specificity < 2e-1 THEN 'generalization_edit_below_floor' WHEN validity < 4e-1 THEN 'generalization_validity_below_floor' END AS reason,
        CASE WHEN judge_supported THEN (5e-1 * specificity + 3e-1 * validity + 2e-1 * judge_score) / (5e-1 + 3e-1 + 2e-1) ELSE (5e-1 * specificity + 3e-1 * validity) / (5e-1 + 3e-1) END AS confidence,
        CASE WHEN judge_supported THEN least(taxonomy, judge_score) ELSE taxonomy END AS axis FROM candidates)
    SELECT group_id, candidate_index, reason, {r6("sqrt(greatest(35e-2, least(greatest(confidence, 0e0), 1e0)))", 5)} AS multiplier, {r6("axis")} AS axis FROM c
""")
def calibration_multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    judge = F.when(c("judge_supported"), c("judge_score"))
    reason, multiplier = gates.calibration([("edit", c("specificity"), 0.2), ("validity", c("validity"), 0.4)], [(c("specificity"), 0.5), (c("validity"), 0.3), (judge, 0.2)], 0.35, 0.5)
    axis = gates.axis_score([c("taxonomy"), judge], "min")
    return a.candidates(spark, sf_dir).select("group_id", "candidate_index", reason.alias("reason"), s.round6(multiplier, 5).alias("multiplier"), s.round6(axis).alias("axis"))


@query(f"""
    WITH {a.CANDIDATES}, g AS (SELECT group_id, count(*) AS n, count(*) FILTER (accepted OR feasible) AS ok FROM judged GROUP BY 1)
    SELECT group_id, CAST(ok AS BIGINT) AS n_ok, {r6("4e-1 + (1e0 - 4e-1) * pow(least(1e0, ok / 3e0), 2e0)")} AS multiplier FROM g
""")
def success_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = a.judged(spark, sf_dir).groupBy("group_id").agg(F.count_if(F.col("accepted") | F.col("feasible")).alias("n_ok"))
    return g.select("group_id", "n_ok", s.round6(s.success_multiplier(F.col("n_ok"), 3.0, 0.4, 2.0)).alias("multiplier"))


@query("""
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 3 = 0 WHEN 1 THEN value / 1e2 >= 5e-1 WHEN 2 THEN event_id % 5 IN (0, 1) ELSE false END AS feasible, event_id % 4 <> 3 AS present FROM events
""")
def explicit_feasibility_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags told as a boolean, a number or a word; absent or malformed ones are not feasible."""
    i = F.col("event_id")
    word = F.element_at(F.array(*map(F.lit, ("yes", " TRUE ", "no", "maybe", ""))), (i % 5 + 1).cast("int"))
    told = gates.flag(F.when(i % 4 == 0, i % 3 == 0), F.when(i % 4 == 1, F.col("value") / 100.0), F.when(i % 4 == 2, word))
    return a.table(spark, sf_dir, "events").withColumn("f", told).select("event_id", "f.feasible", "f.present")


@query("""
    WITH r AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS prompt, CASE WHEN event_id % 11 <> 0 THEN 'e.png' END AS target, 's.png' AS source,
        CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN -1e0 WHEN 2 THEN 'NaN'::DOUBLE ELSE value END AS weight FROM events)
    SELECT event_id, weight FROM r WHERE prompt <> '' AND target IS NOT NULL AND weight IS NOT NULL AND NOT isnan(weight) AND weight >= 0
""")
def trainer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    weight = F.when(i % 5 == 0, None).when(i % 5 == 1, -1.0).when(i % 5 == 2, float("nan")).otherwise(F.col("value"))
    rows = a.table(spark, sf_dir, "events").select("event_id", F.when(i % 7 == 0, "").otherwise(F.col("event_type")).alias("prompt"), F.when(i % 11 != 0, "e.png").alias("target"), F.lit("s.png").alias("source"), weight.alias("weight"))
    return payloads.trainable(rows, "prompt", "target", "source", "weight").select("event_id", "weight")


@query(f"""
    WITH {scheduling.values_sql()} SELECT p.operation_id, p.family, q.operation_id AS inverse_id, q.metric AS inverse_metric FROM bank p LEFT JOIN bank q ON q.operation_id = p.inverse
""")
def inverse_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = schedule.bank(spark)
    q = p.select(F.col("operation_id").alias("inverse_id"), F.col("metric").alias("inverse_metric"))
    return p.join(F.broadcast(q), F.col("inverse") == F.col("inverse_id"), "left").select("operation_id", "family", "inverse_id", "inverse_metric")


@query(f"""
    WITH {a.CANDIDATES}, d AS (SELECT count(*) AS n, count(DISTINCT edit_type) AS kinds FROM judged WHERE accepted)
    SELECT CAST(n AS BIGINT) AS n, CAST(kinds AS BIGINT) AS kinds, CASE WHEN n < 50 THEN 'too_few_selected' WHEN kinds < 3 THEN 'too_few_edit_types' ELSE 'train' END AS status FROM d
""")
def edit_type_diversity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = a.judged(spark, sf_dir).filter("accepted").agg(F.count("*").alias("n"), F.count_distinct("edit_type").alias("kinds"))
    return d.withColumn("status", F.when(F.col("n") < 50, "too_few_selected").when(F.col("kinds") < 3, "too_few_edit_types").otherwise("train"))


@query("""
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(event_id % 10 AS DOUBLE) WHEN 1 THEN 5e-1 END AS edit, CASE event_id % 3 WHEN 1 THEN CAST(event_id % 7 AS DOUBLE) END AS style FROM events
""")
def config_map_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    text = F.when(i % 3 == 0, F.concat(F.lit("edit: "), (i % 10).cast("string"), F.lit(", style: high, :3"))).when(i % 3 == 1, F.concat(F.lit('{"edit": 0.5, "style": '), (i % 7).cast("string"), F.lit("}"))).otherwise("nothing")
    m = t.number_map(text)
    return a.table(spark, sf_dir, "events").withColumn("m", m).select("event_id", F.try_element_at("m", F.lit("edit")).alias("edit"), F.try_element_at("m", F.lit("style")).alias("style"))


@query("""
    SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN [CAST(floor(least(event_id % 1000, 500) / 1e3 * 200) AS INT), CAST(floor(100 / 1e3 * 100) AS INT), CAST(floor(greatest(event_id % 1000, 500) / 1e3 * 200) AS INT), CAST(floor(900 / 1e3 * 100) AS INT)] END AS box,
           CASE WHEN event_id % 100 > 1 THEN least((event_id % 100) / 1e2, 1e0) ELSE CAST(event_id % 100 AS DOUBLE) END AS score FROM events
""")
def grounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    text = F.when(i % 4 == 3, "no box").otherwise(F.concat(F.lit('{"bbox": ['), (i % 1000).cast("string"), F.lit(", 900, 500, 100]}")))
    box = parsing.pixel_box(text, F.lit(200), F.lit(100))
    return a.table(spark, sf_dir, "events").select("event_id", box.alias("box"), parsing.grounding_number(F.concat(F.lit("score "), (i % 100).cast("string"), F.lit(" of 100"))).alias("score"))


@query("""
    WITH c AS (SELECT conv_id, turn, role FROM conversations)
    SELECT role, CAST(count(*) AS BIGINT) AS n, CAST(sum(turn) AS BIGINT) AS turns FROM (SELECT role, turn, unnest(range(3)) AS r FROM c) GROUP BY 1
""")
def dataset_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = a.table(spark, sf_dir, "conversations").select("role", "turn")
    return weights.repeated(c, 3).groupBy("role").agg(F.count("*").alias("n"), F.sum("turn").cast("long").alias("turns"))


@query("""
    WITH s AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents)
    SELECT s.doc_id, s.lang, CAST(length(d.text) AS BIGINT) AS chars FROM s JOIN documents d ON d.doc_id = s.doc_id WHERE k <= 5
""")
def late_materialized_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A choice over narrow columns; texts are read for the chosen rows only."""
    from siftloom.sources.readers import pruned

    def choose(narrow: DataFrame) -> DataFrame:
        order = Window.partitionBy("lang").orderBy(F.sha2(F.col("doc_id").cast("string"), 256), "doc_id")
        return narrow.withColumn("k", F.row_number().over(order)).filter("k <= 5")

    rows = pruned(spark, f"{sf_dir}/documents.parquet", ["lang"], choose, "doc_id", ["text"])
    return rows.select("doc_id", "lang", F.length("text").cast("long").alias("chars"))


@query("""
    SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, CAST(count(*) AS BIGINT) AS n, array_to_string(list(page_id ORDER BY page_id)[1:10], ',') AS first_pages FROM pages GROUP BY 1
""")
def source_reference_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = a.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"))
    first = p.withColumn("k", F.row_number().over(Window.partitionBy("host").orderBy("page_id")))
    preview = F.sort_array(F.collect_list(F.when(F.col("k") <= 10, F.col("page_id"))))
    return first.groupBy("host").agg(F.count("*").alias("n"), F.array_join(preview, ",").alias("first_pages"))


@query("""
    WITH m AS (SELECT doc_id, MAP {'edit': 4e-1, 'validity': 5e-1} AS base, CASE WHEN doc_id % 2 = 0 THEN MAP {'edit': CAST(doc_id % 10 AS DOUBLE) / 1e1, 'style': 1e0} END AS own FROM documents)
    SELECT doc_id, coalesce(own['edit'], base['edit']) AS edit, base['validity'] AS validity, own['style'] AS style FROM m
""")
def merged_threshold_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    base = F.create_map(F.lit("edit"), F.lit(0.4), F.lit("validity"), F.lit(0.5))
    own = F.when(i % 2 == 0, F.create_map(F.lit("edit"), i % 10 / 10.0, F.lit("style"), F.lit(1.0)))
    d = a.table(spark, sf_dir, "documents").select("doc_id", payloads.merged_map(base, own).alias("m"))
    return d.select("doc_id", *(F.try_element_at("m", F.lit(k)).alias(k) for k in ("edit", "validity", "style")))


@query()
def caption_object_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = a.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("A "), "p_name", F.lit(" beside the old "), "p_name", F.lit(" on a wooden table")).alias("caption"))
    return p.select("p_partkey", t.caption_objects(F.col("caption"), ("ring", "widget", "bolt", "table", "gear", "nut")).alias("objects"), t.detector_phrase(F.col("caption")).alias("phrase"))


@query()
def check_prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftloom.operators import edits
    from siftloom.plans.text_rules import instructions

    e = edits.normalized(instructions(spark, sf_dir), "instruction", "family")
    return e.select("id", t.check_prompts(F.col("required_after"), F.col("forbidden_after"), F.col("target_region")).alias("prompts"))
