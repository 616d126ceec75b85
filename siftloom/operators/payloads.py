"""Candidate payloads: construction, parts, keys, defaults, diagnostics, joins back to their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_id(key: Column, round_: Column, proposal: Column, operation: Column) -> Column:
    return F.format_string("%s__r%02d__p%02d__%s", key, round_, proposal, operation)


def payload(df: DataFrame) -> DataFrame:
    """The nested fact row: ids, status, a proposal and an evaluation struct."""
    proposal = F.struct("round_index", "proposal_index", "operation_id", "family", "edit_type", "instruction")
    evaluation = F.when(F.col("total_score").isNotNull(), F.struct("total_score", "accepted", "component_scores", "signals"))
    return df.select("group_id", "candidate_index", "role", "record_key", "status", "edited_image", proposal.alias("proposal"), evaluation.alias("evaluator"))


def evaluation(df: DataFrame) -> Column:
    """The evaluation, under its present or its former name."""
    return F.coalesce(*(F.col(c) for c in ("evaluator", "solver") if c in df.columns))


def key_of(group: Column, index: Column) -> tuple[Column, Column]:
    return F.coalesce(group.cast("string"), F.lit("")), F.coalesce(index.try_cast("long"), F.lit(-1).cast("long"))


def edit_type_of(structured: Column, family: Column) -> Column:
    return F.coalesce(F.nullif(structured, F.lit("")), F.nullif(family, F.lit("")), F.lit("unknown"))


def metadata_value(metadata: Column, path: str, default: str | None = None, kind: str = "string") -> Column:
    """A value by a dotted path of an open metadata column, with a default."""
    return F.coalesce(F.try_variant_get(metadata, f"$.{path}", kind), F.lit(default).cast(kind))


def merged_map(base: Column, own: Column) -> Column:
    """A map with another's values over it."""
    return F.map_zip_with(F.coalesce(base, F.create_map().cast("map<string,double>")), F.coalesce(own, F.create_map().cast("map<string,double>")), lambda k, a, b: F.coalesce(b, a))


def with_records(payloads: DataFrame, records: DataFrame) -> DataFrame:
    """Payloads with their source record; one that is gone is rebuilt from the payload."""
    r = records.select(F.col("key").alias("_key"), F.col("image").alias("_image"), F.col("caption").alias("_caption"))
    out = payloads.join(r, F.col("record_key") == F.col("_key"), "left")
    return out.withColumn("image", F.coalesce("_image", "image_path")).withColumn("caption", F.col("_caption")).withColumn("rebuilt", F.col("_key").isNull()).drop("_key", "_image", "_caption")


def defaulted(df: DataFrame, scores: list[str]) -> DataFrame:
    """Rows whose scoring failed: scores 0, infeasible, the error's name as the reason."""
    failed = F.col("error").isNotNull()
    for c in scores:
        df = df.withColumn(c, F.when(failed, 0.0).otherwise(F.col(c)))
    return df.withColumn("feasible", F.col("feasible") & ~failed).withColumn("reject_reason", F.when(failed, F.concat(F.lit("error_"), F.col("error"))).otherwise(F.col("reject_reason")))


def diagnostics(df: DataFrame, stage: str, reason: Column, text: Column) -> DataFrame:
    """A row for each payload that a stage filtered: stage, reason and previews."""
    return df.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("group_id", F.lit(stage).alias("stage"), "reason", F.left(text, F.lit(1200)).alias("preview"))


def trainable(df: DataFrame, prompt: str, target: str, source: str, weight: str) -> DataFrame:
    """Rows that a trainer can use: prompt, target and source there, a finite weight of 0 or more."""
    c = F.col
    there = c(prompt).isNotNull() & (F.trim(prompt) != "") & c(target).isNotNull() & c(source).isNotNull()
    return df.filter(there & c(weight).isNotNull() & ~F.isnan(weight) & (c(weight) >= 0) & (c(weight) < float("inf")))


def balance_axis(record: DataFrame, axis: str) -> Column:
    """The column by which manifests are balanced: family, edit type, or both."""
    if axis == "family":
        return F.coalesce("family", F.lit("unknown"))
    if axis == "edit_type":
        return F.coalesce("edit_type", F.lit("unknown"))
    if axis == "family_edit_type":
        return F.concat_ws("::", F.coalesce("family", F.lit("unknown")), F.coalesce("edit_type", F.lit("unknown")))
    raise ValueError(f"no such axis: {axis}")
