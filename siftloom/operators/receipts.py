"""Receipts of evaluation runs as relations: file sets, manifests, provider answers, bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.operators.gates import ladder


def export_path(*parts: Column) -> Column:
    """Where a record's output is expected."""
    return F.concat(F.concat_ws("/", *parts), F.lit(".png"))


def identity(*parts: Column) -> Column:
    return F.concat_ws("::", *parts)


def collapsed(x: Column) -> Column:
    """Trimmed, runs of white space as one space; null is empty."""
    return F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), r"\s+", " ")


def file_set(expected: DataFrame, found: DataFrame, path: str = "path") -> DataFrame:
    """Paths that are missing or unexpected; none if the sets are equal."""
    a, b = expected.select(F.col(path).alias("_e")).distinct(), found.select(F.col(path).alias("_f")).distinct()
    both = a.join(b, F.col("_e") == F.col("_f"), "full_outer")
    state = F.when(F.col("_f").isNull(), "missing").when(F.col("_e").isNull(), "unexpected")
    return both.select(F.coalesce("_e", "_f").alias(path), state.alias("state")).filter("state IS NOT NULL")


def cached(expected: DataFrame, found: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """Whether each key's cached results can be taken: complete, absent (to be made), or partial, which is refused."""
    there = found.select(F.col(path).alias("_f")).distinct()
    rows = expected.join(there, F.col(path) == F.col("_f"), "left")
    n = rows.groupBy(*keys).agg(F.count("*").alias("expected"), F.count("_f").alias("found"))
    return n.withColumn("state", F.when(F.col("found") == F.col("expected"), "complete").when(F.col("found") == 0, "absent").otherwise("partial"))


def manifest(files: DataFrame, path: str, content: str) -> DataFrame:
    """path, size and digest of every file."""
    return files.select(F.col(path).alias("path"), F.octet_length(content).cast("long").alias("size"), F.sha2(content, 256).alias("digest"))


def manifest_violations(claimed: DataFrame, found: DataFrame) -> DataFrame:
    """Paths whose claim (path, size, digest) is not what is there, and why."""
    a = claimed.select(F.col("path").alias("_p"), F.col("size").alias("_s"), F.col("digest").alias("_d"))
    both = a.join(found, F.col("_p") == F.col("path"), "full_outer")
    reason = ladder([("missing", F.col("path").isNull()), ("unexpected", F.col("_p").isNull()), ("size", F.col("_s") != F.col("size")), ("digest", F.col("_d") != F.col("digest"))])
    return both.select(F.coalesce("_p", "path").alias("path"), reason.alias("reason")).filter("reason IS NOT NULL")


def bundle_violations(receipts: DataFrame, artifacts: DataFrame, roles: list[str]) -> DataFrame:
    """Receipts (receipt, digest of the artefacts named by role) whose bundle is not whole.

    artifacts has receipt, role and digest; receipts has receipt and a map of role to digest. Each
    of the roles must be there once, no other, and each digest must be the one claimed.
    """
    wanted = receipts.select("receipt", "claims", F.explode(F.array(*map(F.lit, roles))).alias("role"))
    counts = artifacts.groupBy("receipt", "role").agg(F.count("*").alias("n"), F.max("digest").alias("digest"))
    known = counts.withColumnsRenamed({"receipt": "_receipt", "role": "_role"})
    own = wanted.join(known, (F.col("receipt") == F.col("_receipt")) & (F.col("role") == F.col("_role")), "left")
    claim = F.try_element_at("claims", F.col("role"))
    reason = ladder([("role_missing", F.col("n").isNull()), ("role_repeated", F.col("n") > 1), ("claim_missing", claim.isNull()), ("digest", claim != F.col("digest"))])
    bad = own.select("receipt", "role", reason.alias("reason")).filter("reason IS NOT NULL")
    extra = artifacts.filter(~F.col("role").isin(*roles)).select("receipt", "role", F.lit("role_unexpected").alias("reason")).distinct()
    return bad.unionByName(extra)


def transaction_reason(requested: Column, returned: Column, model: Column, model_prefix: str, created: Column, since: Column, prompt: Column, completion: Column, total: Column) -> Column:
    """Why a provider's answer is no answer to its request; null if it is one."""
    return ladder(
        [
            ("response_id_missing", F.coalesce(returned == "", F.lit(True))),
            ("request_id_mismatch", F.coalesce(requested != returned, F.lit(True))),
            ("model_mismatch", ~F.coalesce((model == model_prefix) | model.startswith(f"{model_prefix}-"), F.lit(False))),
            ("created_before_request", F.coalesce(created < since, F.lit(True))),
            ("usage_missing", prompt.isNull() | completion.isNull() | total.isNull()),
            ("usage_negative", (prompt < 0) | (completion < 0) | (total < 0)),
            ("usage_arithmetic", prompt + completion != total),
        ]
    )


def differing(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Names of the bindings that differ, in order; absent on both sides is equal."""
    return F.array_compact(F.array(*(F.when(~a[n].eqNullSafe(b[n]), n) for n in a)))


def with_singles(batches: DataFrame, items: str, failed: Column, each: Column) -> DataFrame:
    """Items of batches; those of a failed batch are told one by one: item, batched, error (null if the item is well)."""
    one = batches.withColumn("_failed", failed).select("*", F.explode(items).alias("item"))
    return one.withColumn("batched", ~F.col("_failed")).withColumn("error", F.when(F.col("_failed"), each)).drop("_failed", items)
