"""The proposal bank, distractors, schedules and tiered proposals."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Proposal(NamedTuple):
    operation_id: str
    instruction: str
    family: str
    difficulty: int
    scope: str
    metric: str
    direction: str
    target: float
    changed: tuple[float, float]
    inverse: str | None = None
    verifier: str = "stat"


# Operations, instructions and their targets must be as they are for equal results.
BANK = (
    Proposal("brightness_up", "Make the overall image brighter while preserving the scene structure.", "exposure", 1, "global", "luminance", "increase", 0.08, (0.35, 1.0), "brightness_down"),
    Proposal("brightness_down", "Make the overall image darker while preserving the scene structure.", "exposure", 1, "global", "luminance", "decrease", 0.08, (0.35, 1.0), "brightness_up"),
    Proposal("saturation_up", "Increase the color saturation while keeping the composition unchanged.", "color", 1, "global", "saturation", "increase", 0.08, (0.30, 0.95), "saturation_down"),
    Proposal("saturation_down", "Reduce the color saturation while keeping the composition unchanged.", "color", 1, "global", "saturation", "decrease", 0.08, (0.30, 0.95), "saturation_up"),
    Proposal("contrast_up", "Increase the overall contrast while preserving the original structure.", "contrast", 2, "global", "contrast", "increase", 0.06, (0.25, 0.95), "contrast_down"),
    Proposal("contrast_down", "Soften the image contrast while preserving the original structure.", "contrast", 2, "global", "contrast", "decrease", 0.05, (0.25, 0.95), "contrast_up"),
    Proposal("warm_tone", "Shift the image toward a warmer tone while keeping the content unchanged.", "tone", 2, "global", "warmth", "increase", 0.06, (0.25, 0.90), "cool_tone"),
    Proposal("cool_tone", "Shift the image toward a cooler tone while keeping the content unchanged.", "tone", 2, "global", "warmth", "decrease", 0.06, (0.25, 0.90), "warm_tone"),
    Proposal("grayscale", "Convert the image to black and white while preserving structure and composition.", "style", 3, "global", "saturation_level", "at_most", 0.04, (0.70, 1.0)),
    Proposal("cinematic_grade", "Apply a subtle cinematic color grade while preserving all objects, layout, and identity.", "style", 2, "global", "internal_prompt_gain", "increase", 0.0, (0.20, 0.85), None, "internal"),
    Proposal("background_blur", "Slightly blur the background while keeping the main subject sharp, natural, and unchanged.", "background", 3, "local", "internal_prompt_gain", "increase", 0.0, (0.08, 0.55), None, "internal"),
    Proposal("subject_pop", "Make the main subject stand out with subtly stronger local contrast while preserving the rest of the image.", "local", 3, "local", "internal_prompt_gain", "increase", 0.0, (0.08, 0.50), None, "internal"),
    Proposal("detail_sharpen", "Sharpen the important subject details slightly without changing the scene content, colors, or composition.", "detail", 2, "local", "internal_prompt_gain", "increase", 0.0, (0.04, 0.45), None, "internal"),
)
BANK_SCHEMA = "pos int, operation_id string, instruction string, family string, difficulty int, scope string, metric string, direction string, target double, lo double, hi double, inverse string, verifier string"


def bank(spark: SparkSession, max_difficulty: int = 3, families: list[str] | None = None) -> DataFrame:
    """The bank's rows up to a difficulty, of the families named (all if none)."""
    rows = [(k, b.operation_id, b.instruction, b.family, b.difficulty, b.scope, b.metric, b.direction, b.target, *b.changed, b.inverse, b.verifier) for k, b in enumerate(BANK)]
    df = spark.createDataFrame(rows, BANK_SCHEMA).filter(F.col("difficulty") <= max_difficulty)
    return df.filter(F.col("family").isin(*families)) if families else df


def distractors(proposals: DataFrame, most: int) -> DataFrame:
    """For each operation ``most`` others: its inverse, then the same family or metric, then the rest, in bank order.

    Both sides are the bank, 13 rows.
    """
    p, q = proposals.select(*(F.col(c).alias(f"p_{c}") for c in ("operation_id", "family", "metric", "inverse"))), proposals
    tier = F.when(F.col("operation_id").eqNullSafe(F.col("p_inverse")), 0).when((F.col("family") == F.col("p_family")) | (F.col("metric") == F.col("p_metric")), 1).otherwise(2)
    met = p.join(F.broadcast(q), F.col("p_operation_id") != F.col("operation_id")).withColumn("tier", tier.cast("long"))
    place = F.row_number().over(Window.partitionBy("p_operation_id").orderBy("tier", "pos")).cast("long")
    return met.withColumn("place", place).filter(F.col("place") <= most).select(F.col("p_operation_id").alias("operation_id"), F.col("operation_id").alias("distractor"), "tier", "place")


def feasible_types(family: Column, allowed: dict[str, list[str]], schedule: list[str]) -> Column:
    """The scheduled types that a family allows, in schedule order; all if it names none."""
    by_family = F.create_map(*(v for f, kinds in allowed.items() for v in (F.lit(f), F.array(*map(F.lit, kinds)))))
    named = F.coalesce(F.try_element_at(by_family, family), F.array().cast("array<string>"))
    everything = F.array(*map(F.lit, schedule))
    return F.when(F.size(named) == 0, everything).otherwise(F.array_intersect(everything, named))


def cyclic_next(at: Column, schedule: list[str], allowed: Column) -> Column:
    """struct(distance, kind): the first allowed type from a place of the cycle on."""
    n = len(schedule)
    steps = F.array(*(F.struct(F.pmod(F.lit(k) - at, F.lit(n)).alias("distance"), F.lit(kind).alias("kind")) for k, kind in enumerate(schedule)))
    return F.array_min(F.filter(steps, lambda x: F.array_contains(allowed, x["kind"])))


def tiered(records: DataFrame, key: str, primary: Column, proposals: DataFrame, most: int, seed: int) -> DataFrame:
    """``most`` operations for each record: the primary family first, then local ones, then the rest; by hash within.

    The bank is a constant of 13 rows.
    """
    tier = F.when(F.col("family") == primary, 0).when(F.col("scope") == "local", 1).otherwise(2)
    met = records.join(F.broadcast(proposals)).withColumn("tier", tier.cast("long"))
    digest = F.sha2(F.concat_ws("\0", F.lit(str(seed)), F.col(key).cast("string"), "operation_id"), 256)
    place = F.row_number().over(Window.partitionBy(key).orderBy("tier", digest)).cast("long")
    return met.withColumn("place", place).filter(F.col("place") <= most).select(key, "operation_id", "tier", "place")
