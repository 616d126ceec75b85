"""Preference pairs within groups.

A pair needs one chosen row and some rejected rows of its group. The chosen side is one
row a group, so a window brings it to the rejected rows in the group's own partition,
without a join.
Every exit leaves a (group_id, reason) row; ``skips`` counts them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftloom.functions import scoring as s
from siftloom.functions.text import failure_tags
from siftloom.operators.gates import ladder
from siftloom.operators.ordinal import numbered


@dataclass(frozen=True)
class Preference:
    min_margin: float = 0.05
    most_pairs: int = 3
    min_chosen: float = 0.30
    base_weight: float = 1.0
    margin_scale: float = 0.5
    margin_clip: float = 0.5
    weight_cap: float = 1.5
    judge_margin: float = -0.05
    judge_fail: float = 0.05
    judge_least: float = 0.35
    edit_delta: float = 0.02
    allowed_drop: float = 0.02
    pareto_least: float = 0.75
    pareto_scale: float = 0.25
    pareto_clip: float = 0.50


FLOORS = (("semantic_failure", "edit", 0.35), ("preservation_failure", "preservation", 0.60), ("validity_failure", "validity", 0.70), ("taxonomy_failure", "taxonomy", 0.25), ("reward_failure", "raw_reward", 0.35))
SIDE = ["candidate_index", "edit_type", "reward", "raw_reward", "edit", "preservation", "validity", "taxonomy", "judge_supported", "judge_score"]


def evaluator_pairs(df: DataFrame) -> DataFrame:
    """Each accepted row with each rejected row of its group."""
    chosen = df.filter("status = 'accepted'").select("group_id", F.col("candidate_index").alias("chosen_index"), F.col("raw_reward").alias("chosen_raw"))
    rejected = df.filter("status = 'rejected'").select("group_id", F.col("candidate_index").alias("rejected_index"), F.col("raw_reward").alias("rejected_raw"))
    return chosen.join(rejected, "group_id")


def sides(df: DataFrame, p: Preference) -> DataFrame:
    """chosen (struct) and rejected (struct) of each possible pair: the best accepted row with the rows that are not accepted."""
    ok = (F.col("status") == "accepted") & (F.col("reward") >= p.min_chosen)
    order = Window.partitionBy("group_id").orderBy(F.desc(ok), F.desc("reward"), F.desc("raw_reward"), F.asc("candidate_index"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.withColumn("chosen", F.first(F.when(ok, F.struct(*SIDE))).over(whole))
    rejected = F.struct(*SIDE, tags().alias("failure_tags")).alias("rejected")
    return rows.filter("status <> 'accepted' AND chosen IS NOT NULL").select("group_id", "chosen", rejected)


def tags() -> Column:
    return failure_tags([(name, F.col(c), floor) for name, c, floor in FLOORS])


def judge_guard(p: Preference) -> tuple[Column, Column]:
    """Reason and multiplier of the judge's view of a pair; 1 where it has none."""
    a, b = F.col("chosen.judge_score"), F.col("rejected.judge_score")
    both = F.col("chosen.judge_supported") & F.col("rejected.judge_supported")
    reason = ladder([("vlm_chosen_explicit_fail", both & (a < p.judge_fail)), ("vlm_margin_too_small", both & (a - b < p.judge_margin))])
    confidence = s.clamp(0.5 + 0.5 * (a - b))
    return reason, F.when(both, p.judge_least + (1.0 - p.judge_least) * confidence).otherwise(1.0)


def pareto_guard(p: Preference) -> tuple[Column, Column]:
    """Reason and multiplier: the edit must gain and no other axis lose more than allowed."""
    edit = F.col("chosen.edit") - F.col("rejected.edit")
    drop = {axis: F.col(f"rejected.{axis}") - F.col(f"chosen.{axis}") for axis in ("preservation", "validity")}
    reason = ladder([("pareto_edit_delta_too_small", edit < p.edit_delta), *((f"pareto_{axis}_degraded", d > p.allowed_drop) for axis, d in drop.items())])
    gain = F.least(F.greatest(edit, F.lit(0.0)), F.lit(p.pareto_clip))
    return reason, F.greatest(F.lit(p.pareto_least), F.least(F.lit(1.0), p.pareto_least + p.pareto_scale * gain / p.pareto_clip))


def guarded(df: DataFrame, p: Preference) -> DataFrame:
    """The possible pairs with margin, multipliers and the reason that drops them, if any."""
    margin = F.col("chosen.reward") - F.col("rejected.reward")
    vlm_reason, vlm = judge_guard(p)
    pareto_reason, pareto = pareto_guard(p)
    pairs = sides(df, p).withColumn("margin", margin)
    reason = F.coalesce(ladder([("margin_too_small", F.col("margin") < p.min_margin)]), vlm_reason, pareto_reason)
    return pairs.withColumn("reason", reason).withColumn("vlm_multiplier", vlm).withColumn("pareto_multiplier", pareto)


def preference_pairs(df: DataFrame, p: Preference) -> DataFrame:
    """The pairs that stay, at most ``most_pairs`` a group; a pair that is dropped uses none of them up."""
    live = guarded(df, p).filter("reason IS NULL")
    order = Window.partitionBy("group_id").orderBy(F.desc("rejected.reward"), F.desc("rejected.raw_reward"), F.asc("rejected.candidate_index"))
    kept = live.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= p.most_pairs)
    weight = s.pair_weight(F.col("margin"), p.base_weight, [F.col("vlm_multiplier"), F.col("pareto_multiplier")], p.margin_scale, p.margin_clip, p.weight_cap)
    return kept.withColumn("weight", weight)


def skips(df: DataFrame, p: Preference) -> DataFrame:
    """Counts of the reasons for which groups and pairs are left out."""
    sizes = df.groupBy("group_id").agg(F.count("*").alias("n"), F.count_if((F.col("status") == "accepted") & (F.col("reward") >= p.min_chosen)).alias("good"))
    few = sizes.filter("n < 2").select(F.lit("too_few_images").alias("reason"))
    none = sizes.filter("n >= 2 AND good = 0").select(F.lit("no_accepted_chosen").alias("reason"))
    dropped = guarded(df, p).filter("reason IS NOT NULL").select("reason")
    return few.unionByName(none).unionByName(dropped).groupBy("reason").agg(F.count("*").alias("n"))


def hard_negative_order(df: DataFrame, priority: list[str]) -> DataFrame:
    """Rejected rows in mining order: for each tag of the priority the first row that has it and is not yet taken, then the rest.

    A greedy choice needs what was taken before, so each group's rows, in order, are folded.
    """
    rows = df.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("reward")).alias("a"), (-F.col("raw_reward")).alias("b"), F.col("candidate_index").alias("i"), F.col("failure_tags").alias("tags")))).alias("rows"))

    def step(acc: Column, tag: Column) -> Column:
        free = F.filter("rows", lambda r: F.array_contains(r["tags"], tag) & ~F.array_contains(acc, r["i"]))
        return F.when(F.size(free) > 0, F.concat(acc, F.array(F.try_element_at(free, F.lit(1))["i"]))).otherwise(acc)

    first = F.aggregate(F.array(*map(F.lit, priority)), F.array().cast("array<bigint>"), step)
    rest = F.filter(F.transform("rows", lambda r: r["i"]), lambda i: ~F.array_contains(F.col("first"), i))
    ordered = rows.withColumn("first", first).withColumn("order", F.concat("first", rest))
    return ordered.select("group_id", F.posexplode("order").alias("place", "candidate_index")).withColumn("place", F.col("place").cast("long"))


def base_relative(df: DataFrame, min_policy: float, min_reference: float) -> DataFrame:
    """Best policy against best reference row of each group, and what becomes of the pair."""
    reference = F.col("role").startswith("reference")
    best = df.groupBy("group_id").agg(
        F.max(F.when(reference, F.struct(F.col("reward").alias("r"), (-F.col("candidate_index")).alias("i")))).alias("ref"),
        F.max(F.when(~reference, F.struct(F.col("reward").alias("r"), (-F.col("candidate_index")).alias("i")))).alias("pol"),
    )
    margin = F.col("pol.r") - F.col("ref.r")
    decision = (
        F.when(F.col("pol").isNull(), "base_relative_no_policy_candidate")
        .when(F.col("ref").isNull(), "base_relative_no_reference_candidate")
        .when(margin >= min_policy, "policy_beats_reference")
        .when(margin <= -min_reference, "reference_beats_policy")
        .otherwise("base_relative_ambiguous")
    )
    return best.select("group_id", (-F.col("pol.i")).alias("policy_index"), (-F.col("ref.i")).alias("reference_index"), margin.alias("margin"), decision.alias("decision"))


def noop_negatives(chosen: DataFrame, kinds: list[str]) -> DataFrame:
    """The unedited source as a further rejected row of each chosen row, for the kinds named."""
    rows = chosen.filter(F.col("edit_type").isin(*kinds))
    zero = F.lit(0.0)
    return rows.select("group_id", (F.lit(-100_000) - F.col("candidate_index")).alias("candidate_index"), "edit_type", zero.alias("reward"), zero.alias("raw_reward"), zero.alias("edit"), F.lit(1.0).alias("preservation"), F.lit(1.0).alias("validity"), F.lit("source_noop").alias("status"))


def anchors(pairs: DataFrame, weight_share: float, weight: float) -> DataFrame:
    """Preservation anchors: every pair again with its source as the chosen side, as many as a share of the weight allows."""
    total = pairs.agg(F.sum("weight").alias("_total"))
    room = F.floor(F.col("_total") * weight_share / weight).cast("long")
    ranked = numbered(pairs.select("group_id", F.col("rejected.candidate_index").alias("rejected_index"), "weight"), [F.asc("group_id"), F.asc("rejected_index")], "_seq")
    return ranked.join(F.broadcast(total)).filter(F.col("_seq") <= room).select("group_id", "rejected_index", F.lit("preservation_anchor").alias("family"), F.lit(weight).alias("weight"))


@dataclass(frozen=True)
class Stages:
    """Knobs of the stages that a group passes before its pairs are made."""

    min_rows: int = 2
    pass_rate: tuple[float, float] = (0.10, 0.90)
    min_anchors: int = 1
    prefer_margin: float = 0.05
    min_success: int = 1
    success_need: float = 2.0
    success_least: float = 0.5
    min_edit: float = 0.45
    min_validity: float = 0.55


def group_stages(df: DataFrame, p: Preference, st: Stages, near: Column, success: Column) -> DataFrame:
    """One row a group: the chosen row and its kind, the stage that drops the group and why, the consistency multiplier.

    near marks verified near misses, success the strict successes. One aggregate makes all
    the evidence; the stages are a ladder over it.
    """
    c = F.col
    ok = (c("status") == "accepted") & (c("reward") >= p.min_chosen)
    side = F.struct(c("reward").alias("score"), c("raw_reward").alias("raw"), (-c("candidate_index")).alias("place"), c("edit").alias("edit"), c("validity").alias("validity"))
    near_side = F.struct(c("raw_reward").alias("score"), c("raw_reward").alias("raw"), (-c("candidate_index")).alias("place"), c("edit").alias("edit"), c("validity").alias("validity"))
    g = df.groupBy("group_id").agg(
        F.count("*").alias("n"),
        F.count_if(success).alias("n_success"),
        F.count_if(c("status") == "accepted").alias("anchors"),
        F.max(F.when(ok, side)).alias("best"),
        F.max(F.when(near, near_side)).alias("near"),
    )
    wins = c("near").isNotNull() & (c("anchors") >= st.min_anchors) & (c("best").isNull() | (c("near.score") >= c("best.score") + st.prefer_margin))
    g = g.withColumn("kind", F.when(wins, "verified_rejected").when(c("best").isNotNull(), "accepted"))
    g = g.withColumn("chosen", F.when(wins, c("near")).otherwise(c("best"))).withColumn("rate", c("n_success") / c("n"))
    low, high = st.pass_rate
    rungs = [
        ("rows", "too_few_images", c("n") < st.min_rows),
        ("productivity", "productive_group_pass_rate_too_low", c("rate") < low),
        ("productivity", "productive_group_pass_rate_too_high", c("rate") > high),
        ("choice", "verified_rejected_no_anchor", c("kind").isNull() & c("near").isNotNull()),
        ("choice", "no_accepted_chosen", c("kind").isNull()),
        ("consistency", "success_consistency_count", c("n_success") < st.min_success),
        ("calibration", "generalization_edit_below_floor", c("chosen.edit") < st.min_edit),
        ("calibration", "generalization_validity_below_floor", c("chosen.validity") < st.min_validity),
    ]
    stage = F.coalesce(ladder([(s_, cond) for s_, _, cond in rungs]), F.lit("passed"))
    reason = F.coalesce(ladder([(r, cond) for _, r, cond in rungs]), F.lit("passed"))
    return g.select(
        "group_id",
        "kind",
        (-c("chosen.place")).alias("chosen_index"),
        stage.alias("stage"),
        reason.alias("reason"),
        s.success_multiplier(c("n_success"), st.success_need, st.success_least).alias("multiplier"),
    )


@dataclass(frozen=True)
class Roles:
    """Knobs of the stages that set policy rows against reference rows."""

    fallback_to_self_pairs: bool = False
    reference_wins: bool = True
    min_policy: float = 0.05
    min_reference: float = 0.10
    self_pairs_only: bool = True
    noop_reasons: tuple[str, ...] = ()
    hard_negative_reasons: tuple[str, ...] = ()
    near_reasons: tuple[str, ...] = ()


def role_stages(df: DataFrame, p: Preference, st: Stages, r: Roles, near: Column, success: Column, reference: Column, policy: Column, positive: Column) -> DataFrame:
    """One row a group: the pool its chosen row comes from, that row and its kind, the decision against the reference, and what becomes of the group.

    Reference rows are never chosen. The pool is the positive rows, without any the policy rows,
    without any all rows. Without an accepted row or a near miss the pool's best row is a probe
    of the reference, where there is one. The productivity of a group is looked at last: with
    ``self_pairs_only`` a group that a comparison with the reference decides stays, and
    so does one whose reason a bypass names.
    """
    c = F.col
    own = policy & ~reference
    good = positive & ~reference
    pools = {"positive": good, "policy": own, "all": F.lit(True)}
    ok = (c("status") == "accepted") & (c("reward") >= p.min_chosen)
    side = lambda score: F.struct(c(score).alias("score"), c("raw_reward").alias("raw"), (-c("candidate_index")).alias("place"))
    aggs = [F.count("*").alias("n"), F.count_if(success).alias("n_success"), F.count_if(own).alias("n_policy"), F.count_if(good).alias("n_positive"), F.max(F.when(reference, c("reward"))).alias("reference")]
    for name, rows in pools.items():
        aggs += [
            F.count_if(rows & (c("status") == "accepted")).alias(f"anchors_{name}"),
            F.max(F.when(rows & ok, side("reward"))).alias(f"best_{name}"),
            F.max(F.when(rows & near, side("raw_reward"))).alias(f"near_{name}"),
            F.max(F.when(rows, side("reward"))).alias(f"probe_{name}"),
        ]
    g = df.groupBy("group_id").agg(*aggs)
    pool = F.when(c("n_positive") > 0, "positive").when(c("n_policy") > 0, "policy").otherwise("all")
    of = lambda what: F.when(c("pool") == "positive", c(f"{what}_positive")).when(c("pool") == "policy", c(f"{what}_policy")).otherwise(c(f"{what}_all"))
    g = g.withColumn("pool", pool)
    g = g.withColumns({n: of(n) for n in ("anchors", "best", "near", "probe")}).withColumn("rate", c("n_success") / c("n"))
    wins = c("near").isNotNull() & (c("anchors") >= st.min_anchors) & (c("best").isNull() | (c("near.score") >= c("best.score") + st.prefer_margin))
    probes = F.lit(r.reference_wins) & c("reference").isNotNull()
    g = g.withColumn("kind", F.when(wins, "verified_rejected").when(c("best").isNotNull(), "accepted").when(probes, "reference_probe"))
    g = g.withColumn("chosen", F.when(wins, c("near")).when(c("best").isNotNull(), c("best")).when(probes, c("probe")))
    margin = c("chosen.score") - c("reference")
    decision = F.when(c("reference").isNull(), "base_relative_no_reference_candidate").when(margin >= r.min_policy, "policy_beats_reference").when(margin <= -r.min_reference, "reference_beats_policy").otherwise("base_relative_ambiguous")
    decision = F.when((c("kind") == "reference_probe") & (decision == "policy_beats_reference"), "base_relative_policy_not_positive").otherwise(decision)
    g = g.withColumn("decision", F.when(c("kind").isNotNull(), decision))
    low, high = st.pass_rate
    dull = ladder([("productive_group_pass_rate_too_low", c("rate") < low), ("productive_group_pass_rate_too_high", c("rate") > high)])
    g = g.withColumn("dull", dull)
    settled = F.lit(r.self_pairs_only) & c("decision").isin("policy_beats_reference", "reference_beats_policy")
    named = lambda reasons: F.lit(r.self_pairs_only) & (c("dull").isin(*reasons) if reasons else F.lit(False))
    spared = named(r.noop_reasons) | named(r.hard_negative_reasons) | ((c("kind") == "verified_rejected") & named(r.near_reasons))
    rungs = [
        ("too_few_images", c("n") < st.min_rows),
        (c("dull"), c("dull").isNotNull() & F.lit(not r.self_pairs_only)),
        ("base_relative_no_policy_candidate", (c("n_policy") == 0) & F.lit(not r.fallback_to_self_pairs)),
        ("no_accepted_chosen", c("kind").isNull()),
        ("base_relative_policy_not_positive", c("decision") == "base_relative_policy_not_positive"),
        (F.concat(F.lit("bypassed_"), c("dull")), c("dull").isNotNull() & ~settled & spared),
        (c("dull"), c("dull").isNotNull() & ~settled),
    ]
    reason = F.coalesce(ladder(rungs), F.lit("passed"))
    return g.select("group_id", "pool", "kind", (-c("chosen.place")).alias("chosen_index"), "decision", reason.alias("reason"))


def conservative_score(raw: Column, semantic: list[Column], preservation: list[Column], validity: list[Column], taxonomy: Column, judge: list[Column], judge_counts: Column) -> Column:
    """A row's cautious score: the best of its semantic, the worst of its other axes, and the judge's terms where they count."""
    known = lambda xs, f: f(F.array_compact(F.array(*xs)))
    axes = [raw, known(semantic, F.array_max), known(preservation, F.array_min), known(validity, F.array_min), taxonomy]
    return s.geometric_mean([*axes, *(F.when(judge_counts, j) for j in judge)])
