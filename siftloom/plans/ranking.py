"""Queries that rank candidates within their groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.functions import scoring as s
from siftloom.operators import gates, rank
from siftloom.plans import adapters as a
from siftloom.plans.registry import query, r6


@query(f"""
    WITH {a.CANDIDATES}
    SELECT group_id, candidate_index, feasible, reject_reason, {r6("reward")} AS reward, rnk, accepted FROM judged
""")
def best_of_n_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.judged(spark, sf_dir).select("group_id", "candidate_index", "feasible", "reject_reason", s.round6(F.col("reward")).alias("reward"), "rnk", "accepted")


@query(f"""
    WITH {a.CANDIDATES}
    SELECT coalesce(reject_reason, 'feasible') AS reason, edit_type, CAST(count(*) AS BIGINT) AS n FROM judged GROUP BY 1, 2
""")
def gate_reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.rated(spark, sf_dir).groupBy(F.coalesce("reject_reason", F.lit("feasible")).alias("reason"), "edit_type").agg(F.count("*").alias("n"))


@query(f"""
    WITH {a.CANDIDATES}, v AS (
      SELECT group_id, candidate_index, unnest([
        {{'name': 'edit_specificity', 'passed': specificity >= 4e-1}}, {{'name': 'taxonomy', 'passed': taxonomy >= 35e-2}},
        {{'name': 'preservation', 'passed': preservation >= 2e-1}}, {{'name': 'validity', 'passed': validity >= 5e-1}},
        {{'name': 'reward', 'passed': raw_reward >= 3e-1}}]) AS g FROM scored)
    SELECT g.name AS gate, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (g.passed) AS BIGINT) AS n_passed FROM v GROUP BY 1
""")
def gate_vector_pass_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = a.rated(spark, sf_dir).select(F.explode(a.candidate_gates().vector()).alias("g"))
    return long.groupBy(F.col("g.name").alias("gate")).agg(F.count("*").alias("n"), F.count_if("g.passed").alias("n_passed"))


BASE = "CASE WHEN judge_supported THEN (5e-1 * specificity + 3e-1 * taxonomy + 2e-1 * judge_score) / (5e-1 + 3e-1 + 2e-1) ELSE (5e-1 * specificity + 3e-1 * taxonomy) / (5e-1 + 3e-1) END"


@query(f"""
    WITH {a.CANDIDATES},
    b AS (SELECT *, {BASE} AS base_score, 7e-1 * specificity + 3e-1 * taxonomy AS instruction_score, 55e-2 * preservation + 45e-2 * validity AS preservation_score,
                 abs(specificity - taxonomy) / 2e0 AS spread FROM candidates),
    m AS (SELECT *, min(base_score) OVER (PARTITION BY group_id) AS lo, max(base_score) OVER (PARTITION BY group_id) AS hi FROM b),
    q AS (SELECT *, CASE WHEN hi - lo < 1e-6 THEN 5e-1 ELSE (base_score - lo) / greatest(hi - lo, 1e-6) END AS relative,
                 instruction_score >= 3e-1 AND preservation_score >= 5e-1 AS feasible FROM m),
    w AS (SELECT *, (6e-1 * base_score + 4e-1 * relative) / (6e-1 + 4e-1) AS quality FROM q),
    r AS (SELECT *, CASE WHEN feasible THEN row_number() OVER (PARTITION BY group_id ORDER BY feasible DESC, quality DESC, candidate_index) ELSE 0 END AS rnk FROM w)
    SELECT group_id, candidate_index, feasible, CAST(rnk AS BIGINT) AS rnk, {r6("quality", 4)} AS quality, feasible AND rnk <= 2 AND quality >= 45e-2 AND spread <= 35e-2 AS accepted FROM r
""")
def hard_gated_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    judge = F.when(c("judge_supported"), c("judge_score"))
    base = F.when(c("judge_supported"), (0.5 * c("specificity") + 0.3 * c("taxonomy") + 0.2 * judge) / (0.5 + 0.3 + 0.2)).otherwise((0.5 * c("specificity") + 0.3 * c("taxonomy")) / (0.5 + 0.3))
    ranked = rank.hard_gated(
        a.candidates(spark, sf_dir),
        base,
        0.70 * c("specificity") + 0.30 * c("taxonomy"),
        0.55 * c("preservation") + 0.45 * c("validity"),
        F.abs(c("specificity") - c("taxonomy")) / 2.0,
        floors=(0.3, 0.5),
        weights=(0.6, 0.4),
        top_m=2,
        min_quality=0.45,
        max_spread=0.35,
    )
    return ranked.select("group_id", "candidate_index", "feasible", "rnk", s.round6(c("quality"), 4).alias("quality"), "accepted")


@query(f"""
    WITH {a.CANDIDATES},
    m AS (SELECT *, min(judge_score) OVER (PARTITION BY group_id) AS lo, max(judge_score) OVER (PARTITION BY group_id) AS hi FROM candidates),
    t AS (SELECT *, 7e-1 * judge_score + 3e-1 * CASE WHEN hi - lo < 1e-6 THEN 5e-1 ELSE (judge_score - lo) / greatest(hi - lo, 1e-6) END AS total FROM m),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY group_id ORDER BY total DESC, candidate_index) AS BIGINT) AS rnk FROM t)
    SELECT group_id, candidate_index, {r6("total")} AS total, rnk, rnk <= 1 AS accepted FROM r
""")
def generic_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.generic(a.candidates(spark, sf_dir), F.col("judge_score")).select("group_id", "candidate_index", s.round6(F.col("total")).alias("total"), "rnk", "accepted")


@query(f"""
    WITH {a.CANDIDATES},
    p AS (SELECT *, CAST(row_number() OVER (PARTITION BY group_id ORDER BY feasible DESC, raw_reward DESC, reward DESC, candidate_index) AS BIGINT) AS place FROM rated)
    SELECT group_id, candidate_index, place, feasible FROM p WHERE place <= 2
""")
def judge_shortlist_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.shortlist(a.rated(spark, sf_dir), 2).select("group_id", "candidate_index", "place", "feasible")


@query(f"""
    WITH {a.CANDIDATES},
    t AS (SELECT *, CASE WHEN judge_supported AND judge_score < 3e-1 THEN 'judge_floor' WHEN l_suppkey % 11 = 0 THEN 'detector_contract' END AS hard FROM judged)
    SELECT group_id, candidate_index, feasible AND hard IS NULL AS feasible, CASE WHEN hard IS NOT NULL THEN 0e0 ELSE {r6("reward")} END AS reward,
           CASE WHEN hard IS NOT NULL AND feasible THEN hard ELSE reject_reason END AS reject_reason FROM t
""")
def post_judge_hard_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = gates.Gates(("judge_floor", ~(F.col("judge_supported") & (F.col("judge_score") < 0.3))), ("detector_contract", F.col("l_suppkey") % 11 != 0))
    out = gates.reapply(a.judged(spark, sf_dir), hard)
    return out.select("group_id", "candidate_index", "feasible", F.when(F.col("reward") == 0.0, 0.0).otherwise(s.round6(F.col("reward"))).alias("reward"), "reject_reason")


@query(f"""
    WITH {a.CANDIDATES}, g AS (
      SELECT group_id, candidate_index, specificity - 5e-1 AS gain, specificity - taxonomy AS margin, preservation - 75e-2 AS required, validity - 6e-1 AS old_state,
             edit_type IN ('object_removal', 'object_replacement') AS old_applies, judge_supported FROM candidates),
    e AS (SELECT group_id, candidate_index, gain, margin, required, CASE WHEN judge_supported THEN old_state END AS old_state, old_applies FROM g)
    SELECT group_id, candidate_index,
           CASE WHEN NOT gain > 0 THEN 'raw_true_prompt_gain' WHEN NOT margin > 0 THEN 'raw_true_over_distractor_margin' WHEN NOT required > 0 THEN 'raw_required_after_gain'
                WHEN old_applies AND NOT coalesce(old_state > 0, false) THEN 'raw_old_state_suppression' END AS reason FROM e
""")
def raw_sign_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    g = gates.raw_gates(
        c("specificity") - 0.5,
        c("specificity") - c("taxonomy"),
        c("preservation") - 0.75,
        F.when(c("judge_supported"), c("validity") - 0.6),
        c("edit_type").isin("object_removal", "object_replacement"),
    )
    return a.candidates(spark, sf_dir).select("group_id", "candidate_index", g.reason().alias("reason"))


@query(f"""
    WITH {a.CANDIDATES}, n AS (SELECT greatest(1, CAST(ceil(count(*) * 2e-2) AS BIGINT)) AS share FROM judged WHERE accepted),
    p AS (SELECT *, CAST(row_number() OVER (PARTITION BY edit_type ORDER BY reward DESC, raw_reward DESC, group_id, candidate_index) AS BIGINT) AS place FROM judged WHERE accepted)
    SELECT group_id, candidate_index, edit_type, place FROM p, n WHERE place <= least(300, share)
""")
def family_balance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = a.judged(spark, sf_dir).filter("accepted")
    order = [F.desc("reward"), F.desc("raw_reward"), F.asc("group_id"), F.asc("candidate_index")]
    return rank.family_balance(accepted, "edit_type", order, most=300, fraction=0.02).filter("kept").select("group_id", "candidate_index", "edit_type", "place")


@query(f"""
    WITH {a.CANDIDATES}, p AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY reward DESC, group_id, candidate_index) AS place FROM judged WHERE accepted)
    SELECT family, CASE WHEN place <= 20 THEN 'accepted' ELSE 'family_balance_cap' END AS reason, CAST(count(*) AS BIGINT) AS n,
           {r6("sum(CASE WHEN place <= 20 THEN reward ELSE 0e0 END)", 4)} AS weight FROM p GROUP BY 1, 2
""")
def family_balance_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = a.judged(spark, sf_dir).filter("accepted")
    kept = rank.family_balance(accepted, "family", [F.desc("reward"), F.asc("group_id"), F.asc("candidate_index")], most=20)
    weight = F.sum(F.when(F.col("kept"), F.col("reward")).otherwise(0.0))
    reason = F.when(F.col("kept"), "accepted").otherwise("family_balance_cap").alias("reason")
    return kept.groupBy("family", reason).agg(F.count("*").alias("n"), s.round6(weight, 4).alias("weight"))


@query(f"""
    WITH {a.CANDIDATES}, o(edit_type, name, value) AS (VALUES ('object_removal', 'edit', 55e-2), ('style_transfer', 'edit', 3e-1), ('style_transfer', 'validity', 7e-1)),
    t AS (SELECT c.*, coalesce(e.value, 4e-1) AS min_edit, coalesce(v.value, 5e-1) AS min_validity FROM candidates c
          LEFT JOIN o e ON e.edit_type = c.edit_type AND e.name = 'edit' LEFT JOIN o v ON v.edit_type = c.edit_type AND v.name = 'validity')
    SELECT edit_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (specificity >= min_edit AND validity >= min_validity) AS BIGINT) AS n_pass FROM t GROUP BY 1
""")
def threshold_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([("object_removal", "edit", 0.55), ("style_transfer", "edit", 0.30), ("style_transfer", "validity", 0.70)], "edit_type string, name string, value double")
    c = gates.with_overrides(a.candidates(spark, sf_dir), "edit_type", {"edit": 0.40, "validity": 0.50}, own)
    passed = (F.col("specificity") >= F.col("min_edit")) & (F.col("validity") >= F.col("min_validity"))
    return c.groupBy("edit_type").agg(F.count("*").alias("n"), F.count_if(passed).alias("n_pass"))


@query(f"""
    WITH {a.CANDIDATES}, t AS (SELECT *, sqrt(greatest(preservation * validity, 0e0)) AS pv,
      CASE WHEN judge_score * 1e2 > 1e1 THEN judge_score WHEN judge_score * 1e2 > 5e0 THEN judge_score * 1e1 WHEN judge_score * 1e2 > 1e0 THEN (judge_score * 1e2 - 1e0) / 4e0 ELSE judge_score * 1e2 END AS unit FROM scored)
    SELECT group_id, candidate_index, {r6("pv")} AS preservation_validity, {r6("least(greatest(unit, 0e0), 1e0)")} AS judge_unit,
           {r6("least(greatest(5e-1 + 5e-1 * (specificity - taxonomy) / 8e-1, 0e0), 1e0)")} AS contrast,
           {r6("sqrt(greatest(((specificity + taxonomy + validity) / 3e0 - specificity) * ((specificity + taxonomy + validity) / 3e0 - specificity) + ((specificity + taxonomy + validity) / 3e0 - taxonomy) * ((specificity + taxonomy + validity) / 3e0 - taxonomy) + ((specificity + taxonomy + validity) / 3e0 - validity) * ((specificity + taxonomy + validity) / 3e0 - validity), 0e0) / 3e0)")} AS spread
    FROM t
""")
def component_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return a.candidates(spark, sf_dir).select(
        "group_id",
        "candidate_index",
        s.round6(F.sqrt(F.greatest(c("preservation") * c("validity"), F.lit(0.0)))).alias("preservation_validity"),
        s.round6(s.judge_unit(c("judge_score") * 100.0)).alias("judge_unit"),
        s.round6(s.contrast_margin(c("specificity"), c("taxonomy"), 0.8)).alias("contrast"),
        s.round6(s.disagreement([c("specificity"), c("taxonomy"), c("validity")])).alias("spread"),
    )
