"""Detector contracts, region gates, a judge's scores folded in, and acceptors that re-admit rejected rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions import scoring as s
from siftloom.operators.gates import Gates


@dataclass(frozen=True)
class Detector:
    kinds: tuple[str, ...] = ("object_removal", "object_replacement")
    original_min: float = 0.35
    absent_max: float = 0.25
    absent_ratio: float = 0.5
    target_min: float = 0.35
    threshold: float = 0.45
    temperature: float = 0.1
    require_original: bool = True


def detector_contract(kind: Column, before: Column, after: Column, target: Column, d: Detector = Detector()) -> Column:
    """struct(supported, score, passed) from presence scores of the source before and after, and of the target.

    Types without a contract pass. A replacement needs its target; absent evidence fails.
    """
    cutoff = F.greatest(F.lit(d.absent_max), before * d.absent_ratio)
    replaced = kind == "object_replacement"
    found = F.coalesce(before >= d.original_min, F.lit(False)) if d.require_original else F.lit(True)
    gone = F.coalesce(after <= cutoff, F.lit(False))
    there = F.when(replaced, F.coalesce(target >= d.target_min, F.lit(False))).otherwise(True)
    grounding, absence = s.sigmoid((before - d.original_min) / d.temperature), s.sigmoid((cutoff - after) / d.temperature)
    presence = F.when(replaced, F.coalesce(s.sigmoid((target - d.target_min) / d.temperature), F.lit(0.0))).otherwise(1.0)
    score = s.geometric_mean(([grounding] if d.require_original else []) + [absence, presence])
    supported = kind.isin(*d.kinds)
    return F.struct(supported.alias("supported"), F.when(supported, score).otherwise(1.0).alias("score"), (~supported | (found & gone & there & (score >= d.threshold))).alias("passed"))


@dataclass(frozen=True)
class Region:
    area: tuple[float, float] = (0.01, 0.85)
    min_target_change: float = 0.35
    min_structure: float = 0.30
    min_structure_edge: float = 0.25
    min_localization: float = 0.40
    max_outside_change: float = 0.10
    max_outside_fraction: float = 0.25
    min_outside_preservation: float = 0.35
    min_reward: float = 0.30
    temperature: float = 0.05
    structure_kinds: tuple[str, ...] = ("color_change",)
    fallback_allowed: bool = False


def region_gates(r: Region, kind: Column, mask_source: Column, required: Column, st: dict[str, Column]) -> tuple[Gates, Column, Column]:
    """(gates, applicable, observed reward) of an edit that should stay within a region.

    st: area, target_change, structure, structure_edge, localization, outside_change, outside_fraction.
    """
    detected = mask_source == "object_detector"
    fallback = (mask_source == "diff_fallback") & F.lit(r.fallback_allowed)
    unsupported = required & ~detected & ~fallback
    structural = kind.isin(*r.structure_kinds) & detected
    preservation = s.sigmoid((r.max_outside_change - st["outside_change"]) / r.temperature)
    fraction = s.sigmoid((r.max_outside_fraction - st["outside_fraction"]) / max(0.08, r.temperature))
    local = s.sigmoid((st["localization"] - r.min_localization) / 0.10)
    structure = F.when(structural, st["structure"]).otherwise(1.0)
    reward = s.geometric_mean([st["target_change"], structure, preservation, fraction, local])
    gates = Gates(
        ("target_mask_not_supported", ~unsupported),
        ("target_mask_area", st["area"].between(*r.area)),
        ("target_change", st["target_change"] >= r.min_target_change),
        ("target_structure", ~structural | (st["structure"] >= r.min_structure)),
        ("target_structure_edge", ~structural | (st["structure_edge"] >= r.min_structure_edge)),
        ("localization_precision", st["localization"] >= r.min_localization),
        ("outside_change", st["outside_change"] <= r.max_outside_change),
        ("outside_changed_fraction", st["outside_fraction"] <= r.max_outside_fraction),
        ("outside_preservation", preservation >= r.min_outside_preservation),
        ("region_reward", reward >= r.min_reward),
    )
    return gates, detected | fallback | unsupported, reward


def region_verdict(gates: Gates, applicable: Column) -> Column:
    """struct(passed, reason): where the gates do not apply a row passes; the reason is told all the same."""
    reason = F.coalesce(gates.reason(), F.when(applicable, "accepted").otherwise("not_applicable"))
    return F.struct((~applicable | gates.feasible()).alias("passed"), reason.alias("reason"))


def folded_semantic(kind: Column, semantic: Column, before: Column, after: Column, absence: Column, fill: Column, target: Column, target_visible: Column) -> Column:
    """The judge's semantic score with what it saw of the object, by edit type."""
    gone = F.least(s.clamp(absence), s.clamp(1.0 - after))
    removal = s.geometric_mean([semantic, before, gone, 1.0 - after, fill])
    replacement = s.geometric_mean([semantic, gone, target, target_visible])
    return F.when(kind == "object_removal", removal).when(kind == "object_replacement", replacement).otherwise(semantic)


def removal_gate(before: Column, after: Column, absence: Column, fill: Column) -> Column:
    """The object was there, and is seen to be gone; a field that is missing fails."""
    complete = before.isNotNull() & after.isNotNull() & absence.isNotNull() & fill.isNotNull()
    return complete & (before >= 0.5) & (after <= 0.2) & (F.least(absence, 1.0 - after) >= 0.8)


@dataclass(frozen=True)
class Acceptor:
    """Re-admits rejected rows of some types and reasons that pass flags, reach floors and stay under ceilings.

    Missing evidence fails. An acceptor that lifts hard failures re-admits a row that the
    judge failed; the others do not.
    """

    name: str
    kinds: tuple[str, ...]
    reasons: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    off: tuple[str, ...] = ()
    floors: dict[str, float] = field(default_factory=dict)
    ceilings: dict[str, float] = field(default_factory=dict)
    only_best: bool = False
    lifts: bool = False

    def holds(self) -> Column:
        out = F.col("edit_type").isin(*self.kinds) & ~F.col("feasible")
        tests = [F.col("reject_reason").isin(*self.reasons)] if self.reasons else []
        tests += [F.col(n) >= floor for n, floor in self.floors.items()] + [F.col(n) <= ceiling for n, ceiling in self.ceilings.items()]
        tests += [F.col(n) for n in self.flags] + [~F.col(n) for n in self.off] + ([F.col("is_best")] if self.only_best else [])
        for test in tests:
            out = out & F.coalesce(test, F.lit(False))
        return out


# Reasons, floors and ceilings must be as they are for equal results.
SOURCE_RATIO, SOURCE_DROP = 0.90, 0.04  # of a replaced object's score after the edit, against before
LEFT_RATIO, LEFT_MARGIN = 1.15, 0.05  # of a removed object's
REMOVED = {"judge_absence": 0.85, "judge_preservation": 0.85, "judge_artifact_free": 0.85}
CONTRACT = ("required_pass", "forbidden_pass", "source_left_pass", "removal_pass", "judge_reliable", "reward_pass")
REPLACEMENT = Acceptor(
    "replacement_detector", ("object_replacement",), ("object_detector_contract",),
    ("detector_supported", "source_detected", "target_present", "required_pass", "forbidden_effective", "region_reward_pass", "outside_preservation_pass", "outside_change_pass", "source_score_pass", "judge_reliable", "judge_pass", "reward_pass"),
    ("source_absent",),
    {"localization": 0.30, "outside_preservation": 0.80, "judge_semantic": 0.80, "judge_absence": 0.80, "judge_target": 0.85, "judge_target_visible": 0.85, "judge_preservation": 0.85, "judge_artifact_free": 0.85},
    only_best=True,
)
SETTLED = (
    Acceptor(
        "removal_detector", ("object_removal",), ("object_detector_contract",), ("detector_supported", "source_detected", "region_pass", "judge_pass", *CONTRACT), ("source_absent",),
        {**REMOVED, "judge_semantic": 0.80, "judge_fill": 0.80}, only_best=True,
    ),
    Acceptor(
        "removal_judge", ("object_removal",), ("object_detector_contract", "conservative_region"), ("judge_pass", *CONTRACT), (),
        {**REMOVED, "judge_semantic": 0.80, "judge_fill": 0.80, "outside_preservation": 0.70, "localization": 0.0, "outside_unchanged": 0.90}, only_best=True,
    ),
    Acceptor(
        "removal_structured_absence", ("object_removal",), ("object_detector_contract", "conservative_region", "internal_vlm_judge_hard_fail"), CONTRACT, (),
        {**REMOVED, "judge_fill": 0.50, "judge_source_before": 0.5, "pre_raw_reward": 0.55, "localization": 0.55, "outside_preservation": 0.80, "outside_unchanged": 0.90}, {"judge_visible_after": 0.2}, only_best=True, lifts=True,
    ),
    Acceptor(
        "subject_extraction", ("subject_extraction",), ("forbidden_gate", "validity", "reward"), ("judge_reliable", "judge_pass", "reward_pass"), (),
        {"pre_raw_reward": 0.40, "judge_score": 0.80, "judge_semantic": 0.80, "judge_preservation": 0.85, "judge_artifact_free": 0.85, "required_score": 0.55}, lifts=True,
    ),
)
ACTIONS = Acceptor(
    "action_compose", ("action_change", "compose"), ("forbidden_gate", "edit_specificity", "taxonomy"), ("judge_reliable", "reward_pass", "kept_pass", "preservation_pass", "validity_pass", "required_pass", "region_pass"), ("judge_missing",),
    {"judge_edit": 0.30, "judge_instruction": 0.20, "judge_overall": 0.30, "judge_preservation": 0.50, "judge_artifact_free": 0.50, "outside_preservation": 0.80}, lifts=True,
)


def evidence(df: DataFrame, override: bool = False) -> DataFrame:
    """Adds what the acceptors derive from the detector's scores of the source before and after.

    With override, a replacement whose judge and region say that all is well passes without
    its detector score, and without the forbidden gate where that was the reason.
    """
    before, after = F.coalesce(F.col("source_before"), F.lit(0.0)), F.coalesce(F.col("source_after"), F.lit(1.0))
    told = F.lit(False)
    if override:
        told = F.lit(True)
        for n in ("source_detected", "target_present", "required_pass", "region_reward_pass", "outside_preservation_pass", "outside_change_pass", "judge_reliable", "judge_pass", "reward_pass"):
            told = told & F.coalesce(F.col(n), F.lit(False))
        for n, floor in REPLACEMENT.floors.items():
            told = told & F.coalesce(F.col(n) >= floor, F.lit(False))
    dropped = after <= F.least(before * SOURCE_RATIO, before - SOURCE_DROP)
    return df.withColumns(
        {
            "source_score_pass": dropped | told,
            "source_left_pass": after <= F.greatest(before * LEFT_RATIO, before + LEFT_MARGIN),
            "forbidden_effective": F.col("forbidden_pass") | (told & F.coalesce(F.col("reject_reason") == "forbidden_gate", F.lit(False))),
        }
    )


def admitted(df: DataFrame, acceptors: tuple[Acceptor, ...]) -> DataFrame:
    """Applies acceptors to one state of the rows; of several that hold the last gives the reason."""
    hit, lifted = F.lit(None).cast("string"), F.lit(False)
    for a in acceptors:
        hit = F.when(a.holds(), a.name).otherwise(hit)
        lifted = lifted | a.holds() if a.lifts else lifted
    df = df.withColumn("_hit", hit).withColumn("_lifted", lifted)
    df = df.withColumn("hard_fail", F.col("hard_fail") & ~F.col("_lifted")).withColumn("feasible", F.col("feasible") | F.col("_hit").isNotNull())
    reason = F.when(F.col("_hit").isNotNull(), F.concat(F.lit("accepted_vlm_"), F.col("_hit"), F.lit("_fallback"))).otherwise(F.col("reject_reason"))
    return df.withColumn("reject_reason", reason).drop("_hit", "_lifted")


def readmit(df: DataFrame, override: bool = False, kinds: tuple[str, ...] = ("object_replacement", "object_removal", "subject_extraction", "action_change", "compose")) -> DataFrame:
    """The judge's last word on a group's rows: acceptors of the kinds named, then hard failures and rewards that are too low.

    Columns: those that the acceptors name, hard_fail, raw_reward (with the judge's part) and pre_raw_reward.
    """
    out = evidence(df, override)
    for stage in ((REPLACEMENT,), SETTLED, (ACTIONS,)):
        used = tuple(a for a in stage if set(a.kinds) & set(kinds))
        out = admitted(out, used) if used else out
    c = F.col
    stays = c("feasible") & c("reward_pass") & ~c("hard_fail")
    fails = F.when(c("hard_fail"), "internal_vlm_judge_hard_fail").otherwise("internal_vlm_judge_reward")
    out = out.withColumn("reject_reason", F.when(c("feasible") & ~stays, fails).otherwise(c("reject_reason")))
    out = out.withColumn("reward", F.when(stays, c("raw_reward")).otherwise(0.0)).withColumn("feasible", stays)
    return out.drop("source_score_pass", "source_left_pass", "forbidden_effective")
