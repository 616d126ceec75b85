"""Queries that mine preference pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.functions import scoring as s
from siftloom.operators import pairs
from siftloom.plans import adapters as a
from siftloom.plans.registry import query, r6

P = pairs.Preference()
PAIRS = f"""
    tagged AS (SELECT *, list_filter([CASE WHEN edit < 35e-2 THEN 'semantic_failure' END, CASE WHEN preservation < 6e-1 THEN 'preservation_failure' END,
        CASE WHEN validity < 7e-1 THEN 'validity_failure' END, CASE WHEN taxonomy < 25e-2 THEN 'taxonomy_failure' END, CASE WHEN raw_reward < 35e-2 THEN 'reward_failure' END], lambda x: x IS NOT NULL) AS t FROM judged),
    withtags AS (SELECT *, CASE WHEN len(t) = 0 THEN ['hard_near_miss'] ELSE t END AS failure_tags FROM tagged),
    best AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY reward DESC, raw_reward DESC, candidate_index) AS k FROM judged WHERE status = 'accepted' AND reward >= 3e-1),
    pr AS (SELECT c.group_id, c.candidate_index AS chosen_index, r.candidate_index AS rejected_index, c.edit_type, r.failure_tags, c.reward - r.reward AS margin,
                  c.judge_supported AND r.judge_supported AS both_judged, c.judge_score AS cj, r.judge_score AS rj, c.edit - r.edit AS edit_delta,
                  r.preservation - c.preservation AS drop_p, r.validity - c.validity AS drop_v, r.reward AS rreward, r.raw_reward AS rraw
           FROM best c JOIN withtags r ON r.group_id = c.group_id AND c.k = 1 AND r.status <> 'accepted'),
    gp AS (SELECT *, CASE WHEN margin < 5e-2 THEN 'margin_too_small' WHEN both_judged AND cj < 5e-2 THEN 'vlm_chosen_explicit_fail' WHEN both_judged AND cj - rj < -5e-2 THEN 'vlm_margin_too_small'
                    WHEN edit_delta < 2e-2 THEN 'pareto_edit_delta_too_small' WHEN drop_p > 2e-2 THEN 'pareto_preservation_degraded' WHEN drop_v > 2e-2 THEN 'pareto_validity_degraded' END AS reason,
             CASE WHEN both_judged THEN 35e-2 + (1e0 - 35e-2) * least(greatest(5e-1 + 5e-1 * (cj - rj), 0e0), 1e0) ELSE 1e0 END AS vlm,
             greatest(75e-2, least(1e0, 75e-2 + 25e-2 * least(greatest(edit_delta, 0e0), 5e-1) / 5e-1)) AS pareto FROM pr),
    placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY group_id ORDER BY rreward DESC, rraw DESC, rejected_index) AS BIGINT) AS place FROM gp WHERE reason IS NULL),
    kept AS (SELECT *, least(15e-1, 1e0 * vlm * pareto * (1e0 + 5e-1 * least(greatest(margin, 0e0), 5e-1))) AS weight FROM placed WHERE place <= 3)
"""


@query(f"""
    WITH {a.CANDIDATES} SELECT c.group_id, c.candidate_index AS chosen_index, r.candidate_index AS rejected_index, {r6("c.raw_reward - r.raw_reward")} AS margin
    FROM judged c JOIN judged r ON r.group_id = c.group_id AND c.status = 'accepted' AND r.status = 'rejected'
""")
def evaluator_pairs_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pairs.evaluator_pairs(a.judged(spark, sf_dir))
    return out.select("group_id", "chosen_index", "rejected_index", s.round6(F.col("chosen_raw") - F.col("rejected_raw")).alias("margin"))


@query(f"WITH {a.CANDIDATES}, {PAIRS} SELECT group_id, chosen_index, rejected_index, place, {r6('margin')} AS margin FROM kept")
def preference_pairs_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pairs.preference_pairs(a.judged(spark, sf_dir), P)
    return out.select("group_id", F.col("chosen.candidate_index").alias("chosen_index"), F.col("rejected.candidate_index").alias("rejected_index"), "place", s.round6(F.col("margin")).alias("margin"))


@query(f"WITH {a.CANDIDATES}, {PAIRS} SELECT edit_type, CAST(count(*) AS BIGINT) AS n, {r6('sum(weight)', 4)} AS weight_sum, {r6('max(weight)')} AS weight_max FROM kept GROUP BY 1")
def preference_pair_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pairs.preference_pairs(a.judged(spark, sf_dir), P)
    return out.groupBy(F.col("chosen.edit_type").alias("edit_type")).agg(F.count("*").alias("n"), s.round6(F.sum("weight"), 4).alias("weight_sum"), s.round6(F.max("weight")).alias("weight_max"))


@query(f"""
    WITH {a.CANDIDATES}, {PAIRS}, sz AS (SELECT group_id, count(*) AS n, count(*) FILTER (status = 'accepted' AND reward >= 3e-1) AS good FROM judged GROUP BY 1),
    u AS (SELECT 'too_few_images' AS reason FROM sz WHERE n < 2 UNION ALL SELECT 'no_accepted_chosen' FROM sz WHERE n >= 2 AND good = 0 UNION ALL SELECT reason FROM gp WHERE reason IS NOT NULL)
    SELECT reason, CAST(count(*) AS BIGINT) AS n FROM u GROUP BY 1
""")
def preference_skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.skips(a.judged(spark, sf_dir), P)


@query(f"WITH {a.CANDIDATES}, {PAIRS} SELECT coalesce(reason, 'kept') AS reason, CAST(count(*) AS BIGINT) AS n, {r6('avg(pareto)')} AS multiplier FROM gp WHERE coalesce(reason, '') NOT LIKE 'vlm%' AND coalesce(reason, '') <> 'margin_too_small' GROUP BY 1")
def pareto_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = pairs.guarded(a.judged(spark, sf_dir), P).withColumn("reason", F.coalesce("reason", F.lit("kept")))
    g = g.filter(~F.col("reason").startswith("vlm") & (F.col("reason") != "margin_too_small"))
    return g.groupBy("reason").agg(F.count("*").alias("n"), s.round6(F.avg("pareto_multiplier")).alias("multiplier"))


@query(f"WITH {a.CANDIDATES}, {PAIRS} SELECT both_judged, coalesce(reason LIKE 'vlm%', false) AS dropped, CAST(count(*) AS BIGINT) AS n, {r6('avg(vlm)')} AS multiplier FROM gp GROUP BY 1, 2")
def vlm_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = pairs.guarded(a.judged(spark, sf_dir), P)
    both = (F.col("chosen.judge_supported") & F.col("rejected.judge_supported")).alias("both_judged")
    dropped = F.coalesce(F.col("reason").startswith("vlm"), F.lit(False)).alias("dropped")
    return g.groupBy(both, dropped).agg(F.count("*").alias("n"), s.round6(F.avg("vlm_multiplier")).alias("multiplier"))


@query(f"WITH {a.CANDIDATES}, {PAIRS}, x AS (SELECT unnest(failure_tags) AS tag, weight FROM kept) SELECT tag, CAST(count(*) AS BIGINT) AS n, {r6('sum(weight)', 4)} AS weight_sum FROM x GROUP BY 1")
def failure_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pairs.preference_pairs(a.judged(spark, sf_dir), P).select(F.explode("rejected.failure_tags").alias("tag"), "weight")
    return out.groupBy("tag").agg(F.count("*").alias("n"), s.round6(F.sum("weight"), 4).alias("weight_sum"))


@query(f"""
    WITH {a.CANDIDATES}, {PAIRS}, t AS (SELECT floor(sum(weight) * 1e-1 / 5e-1) AS room FROM kept),
    o AS (SELECT group_id, rejected_index, row_number() OVER (ORDER BY group_id, rejected_index) AS k FROM kept)
    SELECT group_id, rejected_index, 'preservation_anchor' AS family, 5e-1 AS weight FROM o, t WHERE k <= room
""")
def anchor_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.anchors(pairs.preference_pairs(a.judged(spark, sf_dir), P), 0.1, 0.5)


@query(f"""
    WITH {a.CANDIDATES}, b AS (
      SELECT group_id, max(reward) FILTER (role <> 'policy') AS ref, max(reward) FILTER (role = 'policy') AS pol,
             arg_min(candidate_index, struct_pack(r := -reward, i := candidate_index)) FILTER (role <> 'policy') AS reference_index,
             arg_min(candidate_index, struct_pack(r := -reward, i := candidate_index)) FILTER (role = 'policy') AS policy_index FROM judged GROUP BY 1)
    SELECT group_id, policy_index, reference_index,
           CASE WHEN pol IS NULL THEN 'base_relative_no_policy_candidate' WHEN ref IS NULL THEN 'base_relative_no_reference_candidate' WHEN pol - ref >= 5e-2 THEN 'policy_beats_reference'
                WHEN pol - ref <= -1e-1 THEN 'reference_beats_policy' ELSE 'base_relative_ambiguous' END AS decision FROM b
""")
def base_relative_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.base_relative(a.judged(spark, sf_dir), 0.05, 0.10).select("group_id", "policy_index", "reference_index", "decision")


@query()
def hard_negative_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.judged(spark, sf_dir).filter("status = 'rejected'").withColumn("failure_tags", pairs.tags())
    return pairs.hard_negative_order(rows, ["semantic_failure", "taxonomy_failure", "validity_failure"])


@query(f"""
    WITH {a.CANDIDATES} SELECT group_id, -100000 - candidate_index AS candidate_index, edit_type, 'source_noop' AS status FROM judged
    WHERE accepted AND edit_type IN ('object_removal', 'object_replacement')
""")
def source_noop_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = a.judged(spark, sf_dir).filter("accepted")
    return pairs.noop_negatives(chosen, ["object_removal", "object_replacement"]).select("group_id", F.col("candidate_index").cast("long"), "edit_type", "status")


ST = pairs.Stages()
NEAR = "status = 'rejected' AND edit_type IN ('object_removal', 'object_replacement', 'color_change') AND coalesce(reject_reason IN ('validity', 'taxonomy'), false) AND judge_supported AND judge_score >= 4e-1 AND edit >= 3e-1"
SUCCESS = "CASE WHEN judge_supported THEN judge_score >= 55e-2 ELSE status = 'accepted' END"


@query(f"""
    WITH {a.CANDIDATES}, m AS (SELECT *, {NEAR} AS near, {SUCCESS} AS success, status = 'accepted' AND reward >= 3e-1 AS ok FROM judged),
    o AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY ok DESC, reward DESC, raw_reward DESC, candidate_index) AS ko, row_number() OVER (PARTITION BY group_id ORDER BY near DESC, raw_reward DESC, candidate_index) AS kn FROM m),
    g AS (SELECT group_id, count(*) AS n, count(*) FILTER (success) AS n_success, count(*) FILTER (status = 'accepted') AS anchors,
        max(CASE WHEN ok AND ko = 1 THEN candidate_index END) AS oi, max(CASE WHEN ok AND ko = 1 THEN reward END) AS os, max(CASE WHEN ok AND ko = 1 THEN edit END) AS oe, max(CASE WHEN ok AND ko = 1 THEN validity END) AS ov,
        max(CASE WHEN near AND kn = 1 THEN candidate_index END) AS ni, max(CASE WHEN near AND kn = 1 THEN raw_reward END) AS ns, max(CASE WHEN near AND kn = 1 THEN edit END) AS ne, max(CASE WHEN near AND kn = 1 THEN validity END) AS nv FROM o GROUP BY 1),
    w AS (SELECT *, ni IS NOT NULL AND anchors >= 1 AND (oi IS NULL OR ns >= os + 5e-2) AS wins, CAST(n_success AS DOUBLE) / n AS rate FROM g),
    c AS (SELECT *, CASE WHEN wins THEN 'verified_rejected' WHEN oi IS NOT NULL THEN 'accepted' END AS kind, CASE WHEN wins THEN ni ELSE oi END AS ci, CASE WHEN wins THEN ne ELSE oe END AS ce, CASE WHEN wins THEN nv ELSE ov END AS cv FROM w)
    SELECT group_id, kind, ci AS chosen_index,
      CASE WHEN n < 2 THEN 'too_few_images' WHEN rate < 1e-1 THEN 'productive_group_pass_rate_too_low' WHEN rate > 9e-1 THEN 'productive_group_pass_rate_too_high' WHEN kind IS NULL AND ni IS NOT NULL THEN 'verified_rejected_no_anchor'
           WHEN kind IS NULL THEN 'no_accepted_chosen' WHEN n_success < 1 THEN 'success_consistency_count' WHEN ce < 45e-2 THEN 'generalization_edit_below_floor' WHEN cv < 55e-2 THEN 'generalization_validity_below_floor' ELSE 'passed' END AS reason,
      {r6("5e-1 + (1e0 - 5e-1) * pow(least(1e0, n_success / 2e0), 1e0)")} AS multiplier FROM c
""")
def preference_group_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftloom.operators import gates

    near = gates.near_miss(("object_removal", "object_replacement", "color_change"), ("validity", "taxonomy"), {"edit": 0.3}, 0.4).isNull()
    success = gates.strict_success(F.col("judge_supported"), [(F.col("judge_score"), 0.55)], F.col("status"))
    out = pairs.group_stages(a.judged(spark, sf_dir), P, ST, near, success)
    return out.select("group_id", "kind", "chosen_index", "reason", s.round6(F.col("multiplier")).alias("multiplier"))


ROLES = pairs.Roles(noop_reasons=("productive_group_pass_rate_too_low",), near_reasons=("productive_group_pass_rate_too_high",))


def best_sql(score: str, cond: str) -> str:
    """The place of a group's best row under a condition, and its score."""
    order = f"struct_pack(s := -{score}, r := -raw_reward, i := candidate_index)"
    return f"arg_min(candidate_index, {order}) FILTER ({cond}) AS {{0}}i, max({score}) FILTER ({cond}) AS {{0}}s"


POOLS_SQL = ", ".join(
    f"count(*) FILTER ({cond} AND status = 'accepted') AS {n}_anchors, " + best_sql("reward", f"{cond} AND ok").format(f"{n}_b") + ", " + best_sql("raw_reward", f"{cond} AND near").format(f"{n}_n") + ", " + best_sql("reward", cond).format(f"{n}_p")
    for n, cond in (("positive", "good"), ("policy", "own"), ("anyone", "true"))
)
CHOSEN_SQL = ", ".join(f"CASE pool WHEN 'positive' THEN positive_{x} WHEN 'policy' THEN policy_{x} ELSE anyone_{x} END AS {x}" for x in ("anchors", "bi", "bs", "ni", "ns", "pi", "ps"))


@query(f"""
    WITH {a.CANDIDATES}, m AS (SELECT *, {NEAR} AS near, {SUCCESS} AS success, status = 'accepted' AND reward >= 3e-1 AS ok, role <> 'policy' AS ref, role = 'policy' AND l_suppkey % 3 <> 0 AS own, role = 'policy' AND l_partkey % 4 = 0 AS good FROM judged),
    g AS (SELECT group_id, count(*) AS n, count(*) FILTER (success) AS n_success, count(*) FILTER (own) AS n_policy, count(*) FILTER (good) AS n_positive, max(reward) FILTER (ref) AS reference, {POOLS_SQL} FROM m GROUP BY 1),
    o AS (SELECT *, CASE WHEN n_positive > 0 THEN 'positive' WHEN n_policy > 0 THEN 'policy' ELSE 'all' END AS pool, CAST(n_success AS DOUBLE) / n AS rate FROM g),
    w AS (SELECT group_id, n, n_policy, reference, pool, rate, {CHOSEN_SQL} FROM o),
    k AS (SELECT *, CASE WHEN ni IS NOT NULL AND anchors >= 1 AND (bi IS NULL OR ns >= bs + 5e-2) THEN 'verified_rejected' WHEN bi IS NOT NULL THEN 'accepted' WHEN reference IS NOT NULL THEN 'reference_probe' END AS kind,
             CASE WHEN rate < 1e-1 THEN 'productive_group_pass_rate_too_low' WHEN rate > 9e-1 THEN 'productive_group_pass_rate_too_high' END AS dull FROM w),
    c AS (SELECT *, CASE kind WHEN 'verified_rejected' THEN ni WHEN 'accepted' THEN bi WHEN 'reference_probe' THEN pi END AS chosen_index, CASE kind WHEN 'verified_rejected' THEN ns WHEN 'accepted' THEN bs WHEN 'reference_probe' THEN ps END - reference AS margin FROM k),
    d AS (SELECT *, CASE WHEN kind IS NULL THEN NULL WHEN reference IS NULL THEN 'base_relative_no_reference_candidate' WHEN margin >= 5e-2 THEN CASE WHEN kind = 'reference_probe' THEN 'base_relative_policy_not_positive' ELSE 'policy_beats_reference' END
             WHEN margin <= -1e-1 THEN 'reference_beats_policy' ELSE 'base_relative_ambiguous' END AS decision FROM c)
    SELECT group_id, pool, kind, chosen_index, decision, CASE WHEN n < 2 THEN 'too_few_images' WHEN n_policy = 0 THEN 'base_relative_no_policy_candidate' WHEN kind IS NULL THEN 'no_accepted_chosen' WHEN decision = 'base_relative_policy_not_positive' THEN decision
        WHEN dull IS NOT NULL AND decision NOT IN ('policy_beats_reference', 'reference_beats_policy') THEN CASE WHEN dull = 'productive_group_pass_rate_too_low' OR kind = 'verified_rejected' THEN 'bypassed_' || dull ELSE dull END ELSE 'passed' END AS reason FROM d
""")
def preference_role_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages that split a group by role, probe the reference, and let unproductive groups pass for a reason."""
    from siftloom.operators import gates

    near = gates.near_miss(("object_removal", "object_replacement", "color_change"), ("validity", "taxonomy"), {"edit": 0.3}, 0.4).isNull()
    success = gates.strict_success(F.col("judge_supported"), [(F.col("judge_score"), 0.55)], F.col("status"))
    policy = F.col("role") == "policy"
    return pairs.role_stages(a.judged(spark, sf_dir), P, ST, ROLES, near, success, ~policy, policy & (F.col("l_suppkey") % 3 != 0), policy & (F.col("l_partkey") % 4 == 0))


LN = "ln(greatest(least(greatest({0}, 0e0), 1e0), 1e-6))"


@query(f"""
    WITH {a.CANDIDATES} SELECT group_id, candidate_index, {r6("exp((" + " + ".join(LN.format(x) for x in ("raw_reward", "greatest(edit, specificity)", "preservation", "validity", "taxonomy")) + " + CASE WHEN judge_supported AND judge_score < 35e-2 THEN " + LN.format("judge_score") + " ELSE 0e0 END) / (5 + (judge_supported AND judge_score < 35e-2)::INT))", 5)} AS score FROM judged
""")
def conservative_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    counts = c("judge_supported") & (c("judge_score") < 0.35)
    score = pairs.conservative_score(c("raw_reward"), [c("edit"), c("specificity")], [c("preservation")], [c("validity")], c("taxonomy"), [c("judge_score")], counts)
    return a.judged(spark, sf_dir).select("group_id", "candidate_index", s.round6(score, 5).alias("score"))
