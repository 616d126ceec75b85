"""Gate vectors and reason ladders.

Both are built from a list of (name, condition); the first that applies names the reason.
A condition that is NULL for lack of evidence fails its gate and does not fire its rung.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions import scoring as s
from siftloom.functions.text import role_matches


class Gates:
    """Named conditions, in order; a row is feasible if all hold."""

    def __init__(self, *gates: tuple[str, Column]):
        self.gates = [(name, F.coalesce(c, F.lit(False))) for name, c in gates]

    def feasible(self) -> Column:
        out = F.lit(True)
        for _, c in self.gates:
            out = out & c
        return out

    def reason(self) -> Column:
        """Name of the first gate that fails, else null."""
        return ladder([(name, ~c) for name, c in self.gates])

    def vector(self) -> Column:
        return F.array(*(F.struct(F.lit(name).alias("name"), c.alias("passed")) for name, c in self.gates))


def ladder(rungs: Sequence[tuple[str | Column, Column]]) -> Column:
    """The reason of the first rung whose condition holds, else null."""
    out = None
    for reason, c in rungs:
        value = reason if isinstance(reason, Column) else F.lit(reason)
        out = F.when(c, value) if out is None else out.when(c, value)
    return F.lit(None).cast("string") if out is None else out


def raw_gates(gain: Column, margin: Column, required: Column, old_state: Column, old_applies: Column) -> Gates:
    """Signs of the raw evidence, strictly above zero; the old state counts only where it applies."""
    return Gates(
        ("raw_true_prompt_gain", gain > 0),
        ("raw_true_over_distractor_margin", margin > 0),
        ("raw_required_after_gain", required > 0),
        ("raw_old_state_suppression", ~old_applies | (old_state > 0)),
    )


# The gates' names and order decide the reason.
CHECKED = ("source_grounded", "required_after", "forbidden_gate", "object_detector_contract", "conservative_region", "check_preservation", "edit_specificity", "taxonomy", "preservation", "validity", "reward")


def full_gates(raw: Gates, source: Column, required: Column, forbidden: Column, detector: Column, region: Column, kept: Column, specificity: Column, taxonomy: Column, taxonomy_counts: Column, preservation: Column, validity: Column, reward: Column, floors: dict[str, float]) -> Gates:
    """The signs of the raw evidence and then the eleven checks of a candidate, in order.

    detector and region pass where they do not apply (null); the taxonomy where it does not count.
    floors: source, required, kept, specificity, taxonomy, preservation, validity, reward.
    """
    passed = (
        source >= floors["source"], required >= floors["required"], forbidden, F.coalesce(detector, F.lit(1.0)) >= 0.5, F.coalesce(region, F.lit(1.0)) >= 0.5, kept >= floors["kept"],
        specificity >= floors["specificity"], (taxonomy >= floors["taxonomy"]) | ~taxonomy_counts, preservation >= floors["preservation"], validity >= floors["validity"], reward >= floors["reward"],
    )
    return Gates(*raw.gates, *zip(CHECKED, passed, strict=True))


def reapply(df: DataFrame, gates: Gates) -> DataFrame:
    """Hard gates once more after a judge: a failing row loses reward and feasibility.

    Its reason is overwritten only if it was feasible, had none, or was told accepted.
    """
    failed = ~gates.feasible()
    had = F.col("reject_reason")
    overwrite = F.col("feasible") | had.isNull() | (had == "") | had.startswith("accepted")
    return (
        df.withColumn("reject_reason", F.when(failed & overwrite, gates.reason()).otherwise(had))
        .withColumn("reward", F.when(failed, 0.0).otherwise(F.col("reward")))
        .withColumn("feasible", F.col("feasible") & ~failed)
    )


def flag(bool_: Column, number: Column, text: Column) -> Column:
    """struct(feasible, present) of a flag that may be a boolean, a number (0.5 or more) or a word; malformed is false."""
    word = F.lower(F.trim(text))
    told = F.coalesce(bool_, s.finite(number) >= 0.5, word.isin("true", "yes", "1", "pass"), F.lit(False))
    return F.struct(told.alias("feasible"), (bool_.isNotNull() | number.isNotNull() | text.isNotNull()).alias("present"))


@dataclass(frozen=True)
class Admission:
    """What a training manifest admits; empty sets admit all."""

    verifiers: tuple[str, ...] = ()
    families: tuple[str, ...] = ()
    edit_types: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    component_floors: dict[str, float] = field(default_factory=dict)
    ranked_positives: int = 0
    ranked_positive_scale: float = 0.75
    weighting: bool = True
    include_rejected: bool = False
    minima: dict[str, float] = field(default_factory=lambda: {"validity": 0.50, "preservation": 0.20, "semantic": 0.20, "taxonomy": 0.0, "reward": 0.15})
    accepted_scale: float = 1.0
    rejected_weights: tuple[float, float] = (0.05, 0.35)
    rejected_span: tuple[float, float] = (0.15, 0.60)
    rejected_power: float = 1.0


def admit(df: DataFrame, a: Admission) -> DataFrame:
    """Adds weight and reason; the first rule that applies decides.

    Columns: verifier, family, edit_type, edited_image, role, status, feasible, rnk, total
    and the components named by the floors and minima (semantic: edit, reward: raw_reward).
    """
    c = F.col
    names = {"semantic": "edit", "reward": "raw_reward"}
    accepted = c("status") == "accepted"
    contract = ladder(
        [r for n, floor in a.component_floors.items() for r in ((f"contract_{n}_missing", s.finite(c(n)).isNull()), (f"contract_{n}_below_threshold", c(n) < floor))]
    )
    rungs: list[tuple[str | Column, Column]] = []
    if a.verifiers:
        rungs.append(("verifier_filtered", ~c("verifier").isin(*a.verifiers)))
    if a.families:
        rungs.append(("family_filtered", ~c("family").isin(*a.families)))
    if a.edit_types:
        rungs.append(("edit_type_filtered", ~c("edit_type").isin(*a.edit_types)))
    rungs.append(("missing_edited_image", c("edited_image").isNull() | (c("edited_image") == "")))
    if a.roles:
        rungs.append(("candidate_role_filtered", ~role_matches(c("role"), list(a.roles))))
    rungs.append((contract, accepted & contract.isNotNull()))
    rungs.append(("accepted", accepted))
    if a.ranked_positives:
        near = (c("status") == "rejected") & c("feasible") & (c("rnk") > 0) & (c("rnk") <= max(1, a.ranked_positives))
        rungs += [(contract, near & contract.isNotNull()), ("feasible_ranked_positive", near)]
    if not a.weighting:
        rungs.append(("not_accepted", F.lit(True)))
    elif not a.include_rejected:
        rungs.append(("rejected_disabled", F.lit(True)))
    rungs.append((F.concat(F.lit("status_"), c("status")), c("status") != "rejected"))
    rungs += [(f"{n}_below_threshold", F.coalesce(c(names.get(n, n)) < floor, F.lit(True))) for n, floor in a.minima.items()]
    reason = F.coalesce(ladder(rungs), F.lit("weighted_rejected"))
    full = c("total") * a.accepted_scale
    weight = (
        F.when(c("reason") == "accepted", full)
        .when(c("reason") == "feasible_ranked_positive", full * a.ranked_positive_scale)
        .when(c("reason") == "weighted_rejected", s.rejected_weight(c("raw_reward"), *a.rejected_span, *a.rejected_weights, a.rejected_power))
        .otherwise(0.0)
    )
    return df.withColumn("reason", reason).withColumn("weight", weight)


def strict_success(judge_supported: Column, judge: list[tuple[Column, float]], status: Column) -> Column:
    """All judge floors where a judge speaks, else the status."""
    floors = F.lit(True)
    for value, floor in judge:
        floors = floors & F.coalesce(value >= floor, F.lit(False))
    return F.when(judge_supported, floors).otherwise(status == "accepted")


def first_floor(floors: list[tuple[str, Column, float]]) -> Column:
    """Name of the first component below its floor, or absent."""
    return ladder([(name, value.isNull() | (value < floor)) for name, value, floor in floors])


def rank_only_reject() -> Column:
    """Feasible, and rejected for its rank alone."""
    return (F.col("status") == "rejected") & F.col("feasible") & (F.col("rnk") > 0) & F.coalesce(F.col("reject_reason"), F.lit("accepted")).startswith("accepted")


def with_overrides(df: DataFrame, key: str, base: dict[str, float], overrides: DataFrame) -> DataFrame:
    """Adds the thresholds named in base, overridden per key by a table (key, name, value).

    The table is a configuration, one row a key; the planner broadcasts it by its size.
    """
    own = overrides.groupBy(F.col(key).alias("_key")).pivot("name", list(base)).agg(F.max("value"))
    own = own.select("_key", *(F.col(n).alias(f"_{n}") for n in base))
    out = df.join(own, df[key] == F.col("_key"), "left")
    for name, value in base.items():
        out = out.withColumn(f"min_{name}", F.coalesce(f"_{name}", F.lit(value)))
    return out.drop("_key", *(f"_{n}" for n in base))


def near_miss(edit_types: tuple[str, ...], reasons: tuple[str, ...], floors: dict[str, float], min_confidence: float) -> Column:
    """Why a rejected row is no verified near miss, the first reason that applies; null if it is one."""
    c = F.col
    return ladder(
        [
            ("near_miss_status", c("status") != "rejected"),
            ("near_miss_edit_type", ~c("edit_type").isin(*edit_types)),
            ("near_miss_reject_reason", ~F.coalesce(c("reject_reason").isin(*reasons), F.lit(False))),
            ("near_miss_judge_unsupported", ~F.coalesce(c("judge_supported"), F.lit(False))),
            ("near_miss_judge_confidence", F.coalesce(c("judge_score"), F.lit(0.0)) < min_confidence),
            *((f"near_miss_{n}_below_floor", F.coalesce(s.finite(c(n)), F.lit(-1.0)) < floor) for n, floor in floors.items()),
        ]
    )


def calibration(floors: list[tuple[str, Column, float]], weights: list[tuple[Column, float]], least: float, power: float = 1.0) -> tuple[Column, Column]:
    """Reason (first floor missed) and multiplier from the weighted confidence of a chosen row."""
    reason = ladder([(f"generalization_{n}_below_floor", F.coalesce(v < floor, F.lit(True))) for n, v, floor in floors])
    return reason, F.pow(F.greatest(F.lit(least), s.clamp(s.weighted_mean(weights, 0.0))), F.lit(power))


def axis_score(values: list[Column], how: str) -> Column:
    """The present values of an axis by their least, mean or greatest."""
    present = F.array_compact(F.array(*values))
    if how == "mean":
        return F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present))
    if how not in ("min", "max"):
        raise ValueError(f"no such reduction: {how}")
    return (F.array_min if how == "min" else F.array_max)(present)
