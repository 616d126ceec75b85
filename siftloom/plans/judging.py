"""Queries that gate by detectors, regions and judges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftloom.functions import scoring as s
from siftloom.operators import judging, payloads
from siftloom.plans import adapters as a
from siftloom.plans.registry import query, r6

SIG = "(1e0 / (1e0 + exp(-({0}))))"
GM = "exp((" + "{0}" + ") / {1})"
LOG = "ln(greatest(least(greatest({0}, 0e0), 1e0), 1e-6))"


def logs(*xs: str) -> str:
    return " + ".join(LOG.format(x) for x in xs)


@query(f"""
    WITH {a.CANDIDATES}, d AS (SELECT *, specificity AS b, taxonomy * 6e-1 AS e, judge_score AS t, greatest(25e-2, specificity * 5e-1) AS cut FROM candidates),
    g AS (SELECT *, {SIG.format("(b - 35e-2) / 1e-1")} AS grounding, {SIG.format("(cut - e) / 1e-1")} AS absence,
                 CASE WHEN edit_type = 'object_replacement' THEN {SIG.format("(t - 35e-2) / 1e-1")} ELSE 1e0 END AS presence FROM d),
    c AS (SELECT *, {GM.format(logs("grounding", "absence", "presence"), "3e0")} AS contract, edit_type IN ('object_removal', 'object_replacement') AS supported FROM g)
    SELECT group_id, candidate_index, supported, {r6("CASE WHEN supported THEN contract ELSE 1e0 END", 5)} AS score,
           NOT supported OR (b >= 35e-2 AND e <= cut AND (edit_type <> 'object_replacement' OR t >= 35e-2) AND contract >= 45e-2) AS passed FROM c
""")
def detector_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = a.candidates(spark, sf_dir)
    d = judging.detector_contract(c("edit_type"), c("specificity"), c("taxonomy") * 0.6, c("judge_score"))
    return rows.withColumn("d", d).select("group_id", "candidate_index", "d.supported", s.round6(F.col("d.score"), 5).alias("score"), "d.passed")


@query(f"""
    WITH {a.CANDIDATES}, d AS (SELECT group_id, candidate_index, edit_type, CASE l_suppkey % 3 WHEN 0 THEN 'object_detector' WHEN 1 THEN 'diff_fallback' ELSE 'none' END AS mask, l_partkey % 4 = 0 AS required,
        taxonomy AS area, specificity AS target_change, preservation AS structure, validity AS structure_edge, judge_score AS localization, 1e0 - preservation AS outside_change, (1e0 - validity) / 2e0 AS outside_fraction FROM candidates),
    g AS (SELECT *, required AND mask <> 'object_detector' AS unsupported, edit_type = 'color_change' AND mask = 'object_detector' AS structural, {SIG.format("(1e-1 - outside_change) / 5e-2")} AS pres,
                 {SIG.format("(25e-2 - outside_fraction) / 8e-2")} AS frac, {SIG.format("(localization - 4e-1) / 1e-1")} AS loc FROM d),
    r AS (SELECT *, {GM.format(logs("target_change", "CASE WHEN structural THEN structure ELSE 1e0 END", "pres", "frac", "loc"), "5e0")} AS reward FROM g),
    v AS (SELECT *, CASE WHEN unsupported THEN 'target_mask_not_supported' WHEN NOT area BETWEEN 1e-2 AND 85e-2 THEN 'target_mask_area' WHEN target_change < 35e-2 THEN 'target_change'
                      WHEN structural AND structure < 3e-1 THEN 'target_structure' WHEN structural AND structure_edge < 25e-2 THEN 'target_structure_edge' WHEN localization < 4e-1 THEN 'localization_precision'
                      WHEN outside_change > 1e-1 THEN 'outside_change' WHEN outside_fraction > 25e-2 THEN 'outside_changed_fraction' WHEN pres < 35e-2 THEN 'outside_preservation' WHEN reward < 3e-1 THEN 'region_reward' END AS failed FROM r)
    SELECT coalesce(failed, CASE WHEN mask = 'object_detector' OR unsupported THEN 'accepted' ELSE 'not_applicable' END) AS reason, NOT (mask = 'object_detector' OR unsupported) OR failed IS NULL AS passed, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY 1, 2
""")
def conservative_region_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = a.candidates(spark, sf_dir)
    mask = F.when(c("l_suppkey") % 3 == 0, "object_detector").when(c("l_suppkey") % 3 == 1, "diff_fallback").otherwise("none")
    st = {"area": c("taxonomy"), "target_change": c("specificity"), "structure": c("preservation"), "structure_edge": c("validity"), "localization": c("judge_score"), "outside_change": 1.0 - c("preservation"), "outside_fraction": (1.0 - c("validity")) / 2.0}
    gates, applicable, _ = judging.region_gates(judging.Region(), c("edit_type"), mask, c("l_partkey") % 4 == 0, st)
    out = rows.withColumn("v", judging.region_verdict(gates, applicable))
    return out.groupBy(c("v.reason").alias("reason"), c("v.passed").alias("passed")).agg(F.count("*").alias("n"))


#: Evidence of the acceptors, each with a number of its own: flags that fail now and then, scores that are low now and then.
FLAGS = (
    "detector_supported", "source_detected", "target_present", "required_pass", "forbidden_pass", "region_pass", "region_reward_pass", "outside_preservation_pass", "outside_change_pass",
    "kept_pass", "preservation_pass", "validity_pass", "removal_pass", "judge_reliable", "judge_pass", "reward_pass",
)
SCORES = (
    "localization", "outside_preservation", "outside_unchanged", "judge_score", "judge_semantic", "judge_absence", "judge_fill", "judge_preservation", "judge_artifact_free", "judge_target", "judge_target_visible",
    "judge_source_before", "judge_edit", "judge_instruction", "judge_overall", "required_score", "pre_raw_reward",
)
MORE = ", ".join([f"(l_partkey * {2 * k + 3} + l_suppkey * 7 + candidate_index) % 29 <> 0 AS {n}" for k, n in enumerate(FLAGS)] + [f"CASE WHEN (l_partkey * {2 * k + 5} + l_suppkey * 11 + candidate_index) % 31 = 0 THEN 45e-2 ELSE 9e-1 END AS {n}" for k, n in enumerate(SCORES)])
EVIDENCE = f"""
    base AS (SELECT group_id, candidate_index, ['object_replacement', 'object_removal', 'subject_extraction', 'action_change', 'compose', 'color_change'][CAST(group_id % 6 + 1 AS BIGINT)] AS kind, feasible, raw_reward,
               CASE WHEN feasible THEN 'accepted' ELSE ['object_detector_contract', 'conservative_region', 'forbidden_gate', 'validity', 'internal_vlm_judge_hard_fail'][CAST((l_partkey + candidate_index) % 5 + 1 AS BIGINT)] END AS told,
               l_suppkey % 5 = 0 AS source_absent, (l_partkey % 11) / 1e1 AS source_before, (l_suppkey % 9) / 1e1 AS source_after, (l_partkey % 6) / 1e1 AS judge_visible_after, l_suppkey % 13 = 0 AS judge_missing,
               l_partkey % 8 = 0 AS hard_fail, row_number() OVER (PARTITION BY group_id ORDER BY raw_reward DESC, candidate_index) <= 2 AS is_best, {MORE} FROM rated),
    derived AS (SELECT *, source_after <= least(source_before * 9e-1, source_before - 4e-2) AS source_score_pass, source_after <= greatest(source_before * 115e-2, source_before + 5e-2) AS source_left_pass,
               required_pass AND forbidden_pass AND source_after <= greatest(source_before * 115e-2, source_before + 5e-2) AND removal_pass AND judge_reliable AND reward_pass AND is_best AND judge_absence >= 85e-2 AND judge_preservation >= 85e-2 AND judge_artifact_free >= 85e-2 AS contract FROM base),
    hits AS (SELECT *, CASE
        WHEN feasible THEN NULL
        WHEN kind = 'object_replacement' AND told = 'object_detector_contract' AND detector_supported AND source_detected AND NOT source_absent AND target_present AND required_pass AND forbidden_pass AND region_reward_pass AND outside_preservation_pass
             AND outside_change_pass AND source_score_pass AND judge_reliable AND judge_pass AND reward_pass AND localization >= 3e-1 AND outside_preservation >= 8e-1 AND judge_semantic >= 8e-1 AND judge_absence >= 8e-1 AND judge_target >= 85e-2
             AND judge_target_visible >= 85e-2 AND judge_preservation >= 85e-2 AND judge_artifact_free >= 85e-2 AND is_best THEN 'replacement_detector'
        WHEN kind = 'object_removal' AND told IN ('object_detector_contract', 'conservative_region', 'internal_vlm_judge_hard_fail') AND contract AND judge_source_before >= 5e-1 AND judge_visible_after <= 2e-1 AND judge_fill >= 5e-1 AND pre_raw_reward >= 55e-2
             AND localization >= 55e-2 AND outside_preservation >= 8e-1 AND outside_unchanged >= 9e-1 THEN 'removal_structured_absence'
        WHEN kind = 'object_removal' AND told IN ('object_detector_contract', 'conservative_region') AND contract AND judge_pass AND judge_semantic >= 8e-1 AND judge_fill >= 8e-1 AND outside_preservation >= 7e-1 AND localization >= 0 AND outside_unchanged >= 9e-1 THEN 'removal_judge'
        WHEN kind = 'object_removal' AND told = 'object_detector_contract' AND contract AND judge_pass AND detector_supported AND source_detected AND NOT source_absent AND region_pass AND judge_semantic >= 8e-1 AND judge_fill >= 8e-1 THEN 'removal_detector'
        WHEN kind = 'subject_extraction' AND told IN ('forbidden_gate', 'validity', 'reward') AND judge_reliable AND judge_pass AND reward_pass AND pre_raw_reward >= 4e-1 AND judge_score >= 8e-1 AND judge_semantic >= 8e-1 AND judge_preservation >= 85e-2
             AND judge_artifact_free >= 85e-2 AND required_score >= 55e-2 THEN 'subject_extraction'
        WHEN kind IN ('action_change', 'compose') AND told IN ('forbidden_gate', 'edit_specificity', 'taxonomy') AND judge_reliable AND NOT judge_missing AND reward_pass AND judge_edit >= 3e-1 AND judge_instruction >= 2e-1 AND judge_overall >= 3e-1
             AND judge_preservation >= 5e-1 AND judge_artifact_free >= 5e-1 AND kept_pass AND preservation_pass AND validity_pass AND required_pass AND region_pass AND outside_preservation >= 8e-1 THEN 'action_compose' END AS hit FROM derived),
    lifted AS (SELECT *, hard_fail AND coalesce(hit NOT IN ('removal_structured_absence', 'subject_extraction', 'action_compose'), true) AS still, feasible OR hit IS NOT NULL AS open FROM hits)
"""


@query(f"""
    WITH {a.CANDIDATES}, {EVIDENCE}
    SELECT group_id, candidate_index, open AND reward_pass AND NOT still AS feasible, CASE WHEN open AND NOT (reward_pass AND NOT still) THEN CASE WHEN still THEN 'internal_vlm_judge_hard_fail' ELSE 'internal_vlm_judge_reward' END
           WHEN hit IS NOT NULL THEN 'accepted_vlm_' || hit || '_fallback' ELSE told END AS reject_reason, {r6("CASE WHEN open AND reward_pass AND NOT still THEN raw_reward ELSE 0e0 END")} AS reward FROM lifted
""")
def fallback_acceptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = a.rated(spark, sf_dir)
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    told = pick(("object_detector_contract", "conservative_region", "forbidden_gate", "validity", "internal_vlm_judge_hard_fail"), (c("l_partkey") + c("candidate_index")) % 5)
    place = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("raw_reward"), F.asc("candidate_index")))
    number = lambda k, m, n: (c("l_partkey") * k + c("l_suppkey") * m + c("candidate_index")) % n
    rows = rows.withColumns(
        {
            "edit_type": pick(("object_replacement", "object_removal", "subject_extraction", "action_change", "compose", "color_change"), c("group_id") % 6),
            "reject_reason": F.when(c("feasible"), "accepted").otherwise(told), "source_absent": c("l_suppkey") % 5 == 0, "source_before": (c("l_partkey") % 11) / 10.0, "source_after": (c("l_suppkey") % 9) / 10.0,
            "judge_visible_after": (c("l_partkey") % 6) / 10.0, "judge_missing": c("l_suppkey") % 13 == 0, "hard_fail": c("l_partkey") % 8 == 0, "is_best": place <= 2,
            **{n: number(2 * k + 3, 7, 29) != 0 for k, n in enumerate(FLAGS)}, **{n: F.when(number(2 * k + 5, 11, 31) == 0, 0.45).otherwise(0.9) for k, n in enumerate(SCORES)},
        }
    )
    return judging.readmit(rows).select("group_id", "candidate_index", "feasible", "reject_reason", s.round6(F.col("reward")).alias("reward"))


@query(f"""
    WITH {a.CANDIDATES}, d AS (SELECT *, least(judge_score, preservation) AS gone FROM candidates)
    SELECT group_id, candidate_index, {r6("CASE edit_type WHEN 'object_removal' THEN " + GM.format(logs("specificity", "validity", "gone", "preservation", "taxonomy"), "5e0") + " WHEN 'object_replacement' THEN " + GM.format(logs("specificity", "gone", "taxonomy", "validity"), "4e0") + " ELSE specificity END", 5)} AS semantic,
           validity >= 5e-1 AND 1e0 - preservation <= 2e-1 AND gone >= 8e-1 AS removed FROM d
""")
def judge_fold_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    after = 1.0 - c("preservation")
    semantic = judging.folded_semantic(c("edit_type"), c("specificity"), c("validity"), after, c("judge_score"), c("taxonomy"), c("taxonomy"), c("validity"))
    removed = judging.removal_gate(c("validity"), after, c("judge_score"), c("taxonomy"))
    return a.candidates(spark, sf_dir).select("group_id", "candidate_index", s.round6(semantic, 5).alias("semantic"), removed.alias("removed"))


@query("""
    WITH p AS (SELECT l_orderkey AS record_key, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT o_orderkey AS key, 'img/' || o_orderkey || '.png' AS image, o_orderpriority AS caption FROM orders WHERE o_orderkey % 10 <> 0)
    SELECT record_key, coalesce(image, 'copy/' || record_key || '.png') AS image, caption, key IS NULL AS rebuilt FROM p LEFT JOIN r ON r.key = p.record_key
""")
def payload_record_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = a.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_key")).distinct()
    rows = lines.withColumn("image_path", F.concat(F.lit("copy/"), F.col("record_key").cast("string"), F.lit(".png")))
    orders = a.table(spark, sf_dir, "orders").filter("o_orderkey % 10 <> 0")
    records = orders.select(F.col("o_orderkey").alias("key"), F.concat(F.lit("img/"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("image"), F.col("o_orderpriority").alias("caption"))
    return payloads.with_records(rows, records).select("record_key", "image", "caption", "rebuilt")


@query("""
    SELECT format('{}__r{:02d}__p{:02d}__{}', CAST(doc_id AS VARCHAR), doc_id % 7, doc_id % 3, lang) AS group_id, coalesce(nullif(CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END, ''), nullif(source, ''), 'unknown') AS edit_type FROM documents
""")
def payload_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    key = payloads.group_id(i.cast("string"), i % 7, i % 3, F.col("lang"))
    kind = payloads.edit_type_of(F.when(i % 4 == 0, "").otherwise(F.col("lang")), F.col("source"))
    return a.table(spark, sf_dir, "documents").select(key.alias("group_id"), kind.alias("edit_type"))


@query("""
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events
""")
def metadata_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("m"))
    return e.select("event_id", payloads.metadata_value(F.col("m"), "k", None, "bigint").alias("k"), payloads.metadata_value(F.col("m"), "missing", "none").alias("missing"))


@query()
def scored_by_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model call behind the plug-in boundary, here a stand-in for a judge."""
    from siftloom.functions import plugins

    plugins.register("scalar", "mean_of_two", lambda: lambda x, y: (x + y) / 2.0)
    rows = a.candidates(spark, sf_dir)
    return rows.select("group_id", "candidate_index", plugins.scalar("mean_of_two", F.col("specificity"), F.col("taxonomy")).alias("score"))
