"""Queries that decide what trains, and with what weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.functions import scoring as s
from siftloom.operators import gates, planner, rank, weights
from siftloom.plans import adapters as a
from siftloom.plans.registry import query, r6

ADMISSION = gates.Admission(
    verifiers=("stat", "internal"),
    edit_types=("object_replacement", "object_removal", "object_addition", "color_change", "style_transfer"),
    component_floors={"validity": 0.55},
    ranked_positives=2,
    include_rejected=True,
)
TRAIN = """
    t AS (SELECT *, CASE l_suppkey % 13 WHEN 0 THEN 'manual' WHEN 1 THEN 'internal' ELSE 'stat' END AS verifier,
                 CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE 'edit_' || group_id || '_' || candidate_index || '.png' END AS edited_image, reward AS total FROM judged),
    l AS (SELECT *, CASE
            WHEN verifier NOT IN ('stat', 'internal') THEN 'verifier_filtered'
            WHEN edit_type NOT IN ('object_replacement', 'object_removal', 'object_addition', 'color_change', 'style_transfer') THEN 'edit_type_filtered'
            WHEN edited_image IS NULL THEN 'missing_edited_image'
            WHEN status = 'accepted' AND validity < 55e-2 THEN 'contract_validity_below_threshold'
            WHEN status = 'accepted' THEN 'accepted'
            WHEN status = 'rejected' AND feasible AND rnk BETWEEN 1 AND 2 AND validity < 55e-2 THEN 'contract_validity_below_threshold'
            WHEN status = 'rejected' AND feasible AND rnk BETWEEN 1 AND 2 THEN 'feasible_ranked_positive'
            WHEN status <> 'rejected' THEN 'status_' || status
            WHEN validity < 5e-1 THEN 'validity_below_threshold' WHEN preservation < 2e-1 THEN 'preservation_below_threshold'
            WHEN edit < 2e-1 THEN 'semantic_below_threshold' WHEN taxonomy < 0e0 THEN 'taxonomy_below_threshold' WHEN raw_reward < 15e-2 THEN 'reward_below_threshold'
            ELSE 'weighted_rejected' END AS reason FROM t),
    w AS (SELECT *, CASE reason WHEN 'accepted' THEN total WHEN 'feasible_ranked_positive' THEN total * 75e-2
            WHEN 'weighted_rejected' THEN 5e-2 + (35e-2 - 5e-2) * least(greatest((raw_reward - 15e-2) / greatest(6e-1 - 15e-2, 1e-6), 0e0), 1e0) ELSE 0e0 END AS weight FROM l)
"""


def admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    verifier = F.when(F.col("l_suppkey") % 13 == 0, "manual").when(F.col("l_suppkey") % 13 == 1, "internal").otherwise("stat")
    image = F.when(F.col("l_partkey") % 41 != 0, F.concat(F.lit("edit_"), F.col("group_id").cast("string"), F.lit("_"), F.col("candidate_index").cast("string"), F.lit(".png")))
    rows = a.judged(spark, sf_dir).withColumn("verifier", verifier).withColumn("edited_image", image).withColumn("total", F.col("reward"))
    return gates.admit(rows, ADMISSION)


@query(f"""
    WITH {a.CANDIDATES}, {TRAIN}, m AS (SELECT avg(weight) AS mean FROM w WHERE weight > 0)
    SELECT group_id, candidate_index, reason, {r6("weight")} AS weight, {r6("weight / mean")} AS sample_weight FROM w, m WHERE weight > 0
""")
def sft_weights_mean_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = admitted(spark, sf_dir).filter("weight > 0").select("group_id", "candidate_index", "reason", "weight")
    return weights.mean_one(rows).select("group_id", "candidate_index", "reason", s.round6(F.col("weight")).alias("weight"), s.round6(F.col("sample_weight")).alias("sample_weight"))


@query(f"""
    WITH {a.CANDIDATES}, {TRAIN}
    SELECT reason, status, CAST(count(*) AS BIGINT) AS n, {r6("sum(weight)", 4)} AS weight_sum, {r6("avg(weight)")} AS weight_mean FROM w GROUP BY 1, 2
""")
def sft_reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admitted(spark, sf_dir).groupBy("reason", "status").agg(F.count("*").alias("n"), s.round6(F.sum("weight"), 4).alias("weight_sum"), s.round6(F.avg("weight")).alias("weight_mean"))


@query(f"""
    WITH {a.CANDIDATES}, {TRAIN},
    base AS (SELECT group_id, candidate_index, weight, 'sft' AS kind FROM w WHERE reason = 'accepted' AND total >= 8e-1),
    n AS (SELECT greatest(1, CAST(round_even(count(*) * 25e-2, 0) AS BIGINT)) AS want FROM base),
    again AS (SELECT group_id, candidate_index, 5e-1 AS weight, 'reconstruction_replay' AS kind, row_number() OVER (ORDER BY group_id, candidate_index) AS k FROM base),
    u AS (SELECT group_id, candidate_index, weight, kind FROM base UNION ALL SELECT group_id, candidate_index, weight, kind FROM again, n WHERE k <= want)
    SELECT group_id, candidate_index, kind, {r6("weight / (SELECT avg(weight) FROM u)")} AS sample_weight FROM u
""")
def replay_union_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = admitted(spark, sf_dir).filter("reason = 'accepted' AND total >= 0.8").select("group_id", "candidate_index", "weight")
    both = weights.with_replay(base, 0.25, 0.5, [F.asc("group_id"), F.asc("candidate_index")])
    return weights.mean_one(both).select("group_id", "candidate_index", "kind", s.round6(F.col("sample_weight")).alias("sample_weight"))


PLANNER = planner.Planner(improve_weight=0.1, harm_penalty=0.5, require_accepted=True, min_margin=0.05)
METRICS = """
    told AS (SELECT *, group_id % 11 <> 0 AND (l_partkey % 7 <> 0 OR group_id % 3 <> 0) AS explicit, CASE WHEN group_id % 13 = 0 THEN '' ELSE 'Edit it' END AS instruction FROM judged),
    g AS (SELECT group_id, count(*) AS n, count(*) FILTER (explicit) AS n_explicit, min(instruction) AS instruction, count(*) FILTER (accepted) AS n_accepted,
                 CASE WHEN count(*) FILTER (explicit) = 0 THEN count(*) FILTER (accepted) ELSE count(*) FILTER (explicit AND feasible) END AS n_feasible, count(*) FILTER (role = 'policy') AS n_policy,
                 CASE WHEN count(*) FILTER (explicit) = 0 THEN count(*) FILTER (role = 'policy' AND accepted) ELSE count(*) FILTER (role = 'policy' AND explicit AND feasible) END AS n_policy_feasible,
                 count(*) FILTER (role <> 'policy') AS n_reference,
                 coalesce(max(greatest(reward, raw_reward)) FILTER (role <> 'policy'), 0e0) AS best_reference,
                 coalesce(max(greatest(reward, raw_reward)) FILTER (role = 'policy'), max(raw_reward)) AS best_policy,
                 max(reward) AS best_total, max(raw_reward) AS best_raw, coalesce(max(judge_score) FILTER (role = 'policy' AND judge_supported), 0e0) AS best_judge,
                 max(coalesce(nullif(edit, 0e0), nullif(specificity, 0e0), 0e0)) AS best_edit, max(preservation) AS best_preservation, max(validity) AS best_validity
          FROM told GROUP BY group_id),
    r AS (SELECT *, CAST(n_feasible AS DOUBLE) / n AS feasibility_rate, CAST(n_accepted AS DOUBLE) / n AS acceptance_rate,
                 CASE WHEN n_policy > 0 THEN CAST(n_policy_feasible AS DOUBLE) / n_policy ELSE CAST(n_feasible AS DOUBLE) / n END AS success_rate,
                 CASE WHEN n_reference > 0 THEN best_policy - best_reference ELSE 0e0 END AS margin, greatest(best_total, best_raw, best_judge) AS quality FROM g),
    b AS (SELECT *, exp(-((success_rate - 5e-1) * (success_rate - 5e-1)) / 125e-3) AS band,
                 CASE WHEN n_reference > 0 THEN least(greatest(margin / 5e-1, 0e0), 1e0) ELSE 0e0 END AS improve,
                 CASE WHEN n_reference > 0 THEN least(greatest(-margin / 5e-1, 0e0), 1e0) ELSE 0e0 END AS harm FROM r),
    s AS (SELECT *, (4e-1 * band + 35e-2 * quality + 15e-2 * best_edit + 5e-2 * best_preservation + 5e-2 * best_validity + 1e-1 * improve) * greatest(0e0, 1e0 - 5e-1 * harm) AS plain FROM b),
    p AS (SELECT *, least(greatest(CASE WHEN success_rate <= 0 THEN plain * 35e-2 WHEN success_rate >= 95e-2 THEN plain * 75e-2 ELSE plain END, 0e0), 1e0) AS planner_reward FROM s),
    adm AS (SELECT *, planner_reward >= 35e-2 AND quality >= 3e-1 AND instruction <> '' AND n_explicit IN (0, n) AND success_rate BETWEEN 25e-2 AND 75e-2 AND (n_accepted > 0 OR n_reference > 0 AND margin >= 5e-2) AS use_for_sft FROM p)
"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.judged(spark, sf_dir).withColumn("total", F.col("reward"))
    g = F.col("group_id")
    explicit = (g % 11 != 0) & ((F.col("l_partkey") % 7 != 0) | (g % 3 != 0))
    return planner.group_metrics(rows, F.col("role").startswith("reference"), PLANNER, explicit, F.when(g % 13 == 0, "").otherwise("Edit it"))


@query(f"""
    WITH {a.CANDIDATES}, {METRICS}
    SELECT group_id, CAST(n AS BIGINT) AS n, CAST(n_feasible AS BIGINT) AS n_feasible, CAST(n_accepted AS BIGINT) AS n_accepted, CAST(n_policy AS BIGINT) AS n_policy,
           {r6("success_rate")} AS success_rate, {r6("margin")} AS margin, {r6("improve")} AS improve, {r6("harm")} AS harm, {r6("quality")} AS quality, {r6("band")} AS band,
           {r6("planner_reward")} AS reward FROM p
""")
def planner_group_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics(spark, sf_dir)
    return m.select("group_id", "n", "n_feasible", "n_accepted", "n_policy", *(s.round6(F.col(c)).alias(c) for c in ("success_rate", "margin", "improve", "harm", "quality", "band", "reward")))


@query(f"""
    WITH {a.CANDIDATES}, {METRICS}
    SELECT use_for_sft, CASE WHEN n_explicit = 0 THEN 'legacy_accepted_group_fallback' WHEN n_explicit = n THEN 'explicit_feasible_group' ELSE 'explicit_feasible_group_missing_fail_closed' END AS source,
           CASE WHEN success_rate <= 0 THEN 'all_fail' WHEN success_rate >= 95e-2 THEN 'all_pass' ELSE 'mixed' END AS outcome, CAST(count(*) AS BIGINT) AS n,
           {r6("avg(planner_reward)")} AS reward_mean FROM adm GROUP BY 1, 2, 3
""")
def planner_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = planner.admission(metrics(spark, sf_dir), PLANNER)
    outcome = F.when(F.col("success_rate") <= 0, "all_fail").when(F.col("success_rate") >= 0.95, "all_pass").otherwise("mixed").alias("outcome")
    return out.groupBy("use_for_sft", F.col("feasibility_source").alias("source"), outcome).agg(F.count("*").alias("n"), s.round6(F.avg("reward")).alias("reward_mean"))


@query(f"""
    WITH {a.CANDIDATES}, {METRICS}
    SELECT group_id, {r6("planner_reward")} AS reward FROM adm WHERE use_for_sft ORDER BY group_id DESC LIMIT 256
""")
def planner_cumulative_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = planner.admission(metrics(spark, sf_dir), PLANNER).filter("use_for_sft").select("group_id", s.round6(F.col("reward")).alias("reward"))
    return planner.tail(out, [F.desc("group_id")], 256)


@query(f"""
    WITH {a.CANDIDATES}, g AS (SELECT group_id, count(*) AS n, count(*) FILTER (CASE WHEN judge_supported THEN judge_score >= 55e-2 ELSE status = 'accepted' END) AS n_pass FROM judged GROUP BY 1)
    SELECT group_id, CAST(n AS BIGINT) AS n, CAST(n_pass AS BIGINT) AS n_pass, {r6("CAST(n_pass AS DOUBLE) / n")} AS pass_rate,
           CASE WHEN n < 3 THEN 'productive_group_too_small' WHEN CAST(n_pass AS DOUBLE) / n < 25e-2 THEN 'productive_group_pass_rate_too_low'
                WHEN CAST(n_pass AS DOUBLE) / n > 75e-2 THEN 'productive_group_pass_rate_too_high' ELSE 'productive' END AS reason FROM g
""")
def group_productivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = gates.strict_success(F.col("judge_supported"), [(F.col("judge_score"), 0.55)], F.col("status"))
    out = planner.productivity(a.judged(spark, sf_dir), passed, 0.25, 0.75, 3)
    return out.select("group_id", "n", "n_pass", s.round6(F.col("pass_rate")).alias("pass_rate"), "reason")


@query(f"""
    WITH {a.CANDIDATES}, c AS (SELECT group_id, edit_type, count(*) AS n, min(candidate_index) AS seen FROM candidates GROUP BY 1, 2),
    p AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, seen) AS place FROM c)
    SELECT group_id, edit_type, CAST(n AS BIGINT) AS n FROM p WHERE place = 1
""")
def dominant_edit_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.dominant(a.candidates(spark, sf_dir), ["group_id"], "edit_type", "candidate_index").select("group_id", "edit_type", "n")


@query(f"""
    WITH {a.CANDIDATES}, v AS (
      SELECT edit_type, unnest(['edit', 'taxonomy', 'preservation', 'validity', 'judge']) AS component,
             unnest([edit, taxonomy, preservation, validity, CASE WHEN judge_supported THEN judge_score END]) AS value FROM judged WHERE accepted)
    SELECT edit_type, component, {r6("avg(value)")} AS mean, CAST(count(value) AS BIGINT) AS n FROM v WHERE value IS NOT NULL GROUP BY 1, 2
""")
def component_means_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.judged(spark, sf_dir).filter("accepted").withColumn("judge", F.when(F.col("judge_supported"), F.col("judge_score")))
    out = planner.component_means(rows, ["edit_type"], ["edit", "taxonomy", "preservation", "validity", "judge"])
    return out.select("edit_type", "component", s.round6(F.col("mean")).alias("mean"), "n")


@query(f"""
    WITH {a.CANDIDATES}, req(edit_type, least) AS (VALUES ('object_removal', 100000000), ('color_change', 1), ('compose', 3), ('style_transfer', 100000000)),
    c AS (SELECT edit_type, count(*) AS found FROM judged WHERE accepted GROUP BY 1)
    SELECT req.edit_type, CAST(least AS BIGINT) AS least, CAST(coalesce(found, 0) AS BIGINT) AS found FROM req LEFT JOIN c ON c.edit_type = req.edit_type WHERE coalesce(found, 0) < least
""")
def min_count_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    required = spark.createDataFrame([("object_removal", 100_000_000), ("color_change", 1), ("compose", 3), ("style_transfer", 100_000_000)], "edit_type string, least long")
    return planner.minimum_counts(a.judged(spark, sf_dir).filter("accepted"), "edit_type", required).select("edit_type", "least", "found")


@query(f"""
    WITH {a.LOG}, d AS (
      SELECT day, CAST(count(*) AS BIGINT) AS candidates, CAST(count(*) FILTER (status = 'accepted') AS BIGINT) AS accepted, CAST(count(DISTINCT group_id) AS BIGINT) AS groups,
             CAST(count(DISTINCT CASE WHEN status = 'accepted' THEN group_id END) AS BIGINT) AS accepted_groups FROM log GROUP BY day)
    SELECT day, candidates, accepted, groups, accepted_groups, {r6("CAST(accepted AS DOUBLE) / candidates")} AS candidate_rate, {r6("CAST(accepted_groups AS DOUBLE) / groups")} AS group_rate FROM d
""")
def round_acceptance_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = planner.round_rates(a.candidate_log(spark, sf_dir), "day")
    return out.select("day", "candidates", "accepted", "groups", "accepted_groups", s.round6(F.col("candidate_rate")).alias("candidate_rate"), s.round6(F.col("group_rate")).alias("group_rate"))


FOLD = """
    WITH RECURSIVE {log}, d AS (
      SELECT day, CAST(count(DISTINCT CASE WHEN status = 'accepted' THEN group_id END) AS DOUBLE) / count(DISTINCT group_id) * 2e0 AS rate FROM log GROUP BY day),
    o AS (SELECT day, rate, row_number() OVER (ORDER BY day) AS k FROM d),
    f AS (
      SELECT k, day, rate, CASE WHEN rate >= 65e-2 THEN least(3, 2 + 1) WHEN rate <= 25e-2 THEN greatest(1, 2 - 1) ELSE 2 END AS level FROM o WHERE k = 1
      UNION ALL
      SELECT o.k, o.day, o.rate, CASE WHEN o.rate >= 65e-2 THEN least(3, level + 1) WHEN o.rate <= 25e-2 THEN greatest(1, level - 1) ELSE level END FROM f JOIN o ON o.k = f.k + 1)
    SELECT day, {rate} AS rate, CAST(level AS BIGINT) AS level FROM f
"""


@query(FOLD.format(log=a.LOG, rate=r6("rate")))
def difficulty_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = planner.round_rates(a.candidate_log(spark, sf_dir), "day").select("day", (F.col("group_rate") * 2.0).alias("rate"))
    return rank.fold_difficulty(rates, "day", "rate").select("day", s.round6(F.col("rate")).alias("rate"), "level")
