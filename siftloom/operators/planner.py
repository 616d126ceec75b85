"""Aggregates of proposal groups: admission of a planner's traces, productivity, rounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftloom.functions import scoring as s


@dataclass(frozen=True)
class Planner:
    """Knobs of the planner's reward and admission."""

    center: float = 0.5
    sigma: float = 0.25
    min_reward: float = 0.35
    min_quality: float = 0.30
    band: tuple[float, float] = (0.25, 0.75)
    require_band: bool = True
    require_accepted: bool = False
    improve_weight: float = 0.0
    harm_penalty: float = 0.0
    all_fail: float = 0.35
    all_pass: float = 0.75
    min_margin: float = 0.0


def group_metrics(df: DataFrame, reference: Column, p: Planner, explicit: Column | None = None, instruction: Column | None = None) -> DataFrame:
    """One row a group from candidates with feasible, accepted, total, raw_reward, edit, specificity, preservation, validity, judge columns.

    All of it is one aggregate; ``feasible`` (gates) and ``accepted`` (rank) stay apart. explicit
    marks rows that tell whether they are feasible (all, if not given): in a group where some
    do, the others are not feasible; in one where none does, the accepted ones are. instruction
    is the proposal's text, that of the first row.
    """
    c = F.col
    policy = ~reference
    explicit = F.lit(True) if explicit is None else explicit
    told = F.lit("given") if instruction is None else instruction
    judge = F.when(policy & c("judge_supported"), c("judge_score"))
    own = F.greatest(F.coalesce(s.finite(c("total")), F.lit(0.0)), F.coalesce(s.finite(c("raw_reward")), F.lit(0.0)))
    edit = s.first_truthy([c("edit"), c("specificity")])
    agg = df.groupBy("group_id").agg(
        F.count("*").alias("n"),
        F.count_if(explicit).alias("n_explicit"),
        F.count_if(explicit & c("feasible")).alias("_feasible"),
        F.count_if(c("accepted")).alias("n_accepted"),
        F.count_if(policy).alias("n_policy"),
        F.count_if(policy & explicit & c("feasible")).alias("_policy_feasible"),
        F.count_if(policy & c("accepted")).alias("_policy_accepted"),
        F.min_by(told, "candidate_index").alias("instruction"),
        F.coalesce(F.max(F.when(reference, own)), F.lit(0.0)).alias("best_reference"),
        F.max(F.when(policy, own)).alias("_best_policy"),
        F.count_if(reference).alias("n_reference"),
        F.max(F.coalesce(s.finite(c("total")), F.lit(0.0))).alias("best_total"),
        F.max(F.coalesce(s.finite(c("raw_reward")), F.lit(0.0))).alias("best_raw"),
        F.coalesce(F.max(judge), F.lit(0.0)).alias("best_judge"),
        F.max(edit).alias("best_edit"),
        F.max("preservation").alias("best_preservation"),
        F.max("validity").alias("best_validity"),
    )
    legacy = c("n_explicit") == 0
    agg = agg.withColumn("n_feasible", F.when(legacy, c("n_accepted")).otherwise(c("_feasible"))).withColumn("n_policy_feasible", F.when(legacy, c("_policy_accepted")).otherwise(c("_policy_feasible")))
    source = F.when(legacy, "legacy_accepted_group_fallback").when(c("n_explicit") == c("n"), "explicit_feasible_group").otherwise("explicit_feasible_group_missing_fail_closed")
    agg = agg.withColumn("feasibility_source", source).withColumn("eligible", legacy | (c("n_explicit") == c("n"))).drop("_feasible", "_policy_feasible", "_policy_accepted")
    agg = agg.withColumn("feasibility_rate", c("n_feasible") / c("n")).withColumn("acceptance_rate", c("n_accepted") / c("n"))
    agg = agg.withColumn("success_rate", F.when(c("n_policy") > 0, c("n_policy_feasible") / c("n_policy")).otherwise(c("feasibility_rate")))
    agg = agg.withColumn("best_policy", F.coalesce("_best_policy", "best_raw")).drop("_best_policy")
    agg = agg.withColumn("margin", F.when(c("n_reference") > 0, c("best_policy") - c("best_reference")).otherwise(0.0))
    centre = max(p.center, 1e-6)
    agg = agg.withColumn("improve", F.when(c("n_reference") > 0, s.clamp(c("margin") / centre)).otherwise(0.0))
    agg = agg.withColumn("harm", F.when(c("n_reference") > 0, s.clamp(-c("margin") / centre)).otherwise(0.0))
    agg = agg.withColumn("quality", F.greatest("best_total", "best_raw", "best_judge"))
    agg = agg.withColumn("band", s.difficulty_band(c("success_rate"), p.center, p.sigma))
    reward = 0.40 * c("band") + 0.35 * c("quality") + 0.15 * c("best_edit") + 0.05 * c("best_preservation") + 0.05 * c("best_validity")
    reward = (reward + p.improve_weight * c("improve")) * F.greatest(F.lit(0.0), 1.0 - p.harm_penalty * c("harm"))
    reward = F.when(c("success_rate") <= 0, reward * p.all_fail).when(c("success_rate") >= 0.95, reward * p.all_pass).otherwise(reward)
    return agg.withColumn("reward", s.clamp(reward))


def admission(metrics: DataFrame, p: Planner) -> DataFrame:
    """Adds use_for_sft: reward and quality are enough, the proposal has an instruction, its group tells of all rows or none, and the outcome supports it."""
    c = F.col
    in_band = c("success_rate").between(*p.band) if p.require_band else F.lit(True)
    better = (c("n_reference") > 0) & (c("margin") >= p.min_margin)
    told = ((c("n_accepted") > 0) | better) if p.require_accepted else F.lit(True)
    instructed = F.coalesce(c("instruction") != "", F.lit(False))
    return metrics.withColumn("use_for_sft", (c("reward") >= p.min_reward) & (c("quality") >= p.min_quality) & instructed & c("eligible") & in_band & told)


def tail(traces: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The last ``most`` traces; an ordered limit, merged from each partition's own."""
    return traces.orderBy(*order).limit(most)


def round_rates(df: DataFrame, round_col: str) -> DataFrame:
    """Candidate and group acceptance of each round; they are different rates."""
    out = df.groupBy(round_col).agg(
        F.count("*").alias("candidates"),
        F.count_if(F.col("status") == "accepted").alias("accepted"),
        F.count_distinct("group_id").alias("groups"),
        F.count_distinct(F.when(F.col("status") == "accepted", F.col("group_id"))).alias("accepted_groups"),
    )
    return out.withColumn("candidate_rate", F.col("accepted") / F.col("candidates")).withColumn("group_rate", F.col("accepted_groups") / F.col("groups"))


def productivity(df: DataFrame, passed: Column, low: float, high: float, least: int) -> DataFrame:
    """Pass rate of each group and why it is not productive, if so."""
    out = df.groupBy("group_id").agg(F.count("*").alias("n"), F.count_if(passed).alias("n_pass"))
    rate = F.col("n_pass") / F.col("n")
    reason = F.when(F.col("n") < least, "productive_group_too_small").when(rate < low, "productive_group_pass_rate_too_low").when(rate > high, "productive_group_pass_rate_too_high")
    return out.withColumn("pass_rate", rate).withColumn("reason", F.coalesce(reason, F.lit("productive")))


def dominant(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each key; of equals the one seen first."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("_seen"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc("_seen")))
    return counts.withColumn("_place", place).filter("_place = 1").drop("_place", "_seen")


def minimum_counts(df: DataFrame, key: str, required: DataFrame) -> DataFrame:
    """Rows of ``required`` (key, least) whose count is below; counts of absent keys are 0."""
    counts = df.groupBy(key).agg(F.count("*").alias("found"))
    out = required.join(counts, key, "left").withColumn("found", F.coalesce("found", F.lit(0).cast("long")))
    return out.filter(F.col("found") < F.col("least"))


def component_means(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Mean of each named component; a component counts only where it is present."""
    long = df.select(*keys, F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(n) for n in names)))).alias("component", "value"))
    return long.filter(F.col("value").isNotNull()).groupBy(*keys, "component").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
