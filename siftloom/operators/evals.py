"""Benchmark metrics: pooled and grouped means, macro means, re-aggregation, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edit_score_means(rows: DataFrame, task: str, semantics: str, quality: str) -> DataFrame:
    """Means of semantics, quality and sqrt(semantics * quality) by task, and pooled over all (task null)."""
    overall = F.sqrt(F.col(semantics) * F.col(quality))
    base = rows.select(F.col(task).alias("task"), F.col(semantics).alias("s"), F.col(quality).alias("q"), overall.alias("o"))
    sets = base.groupingSets([[F.col("task")], []], F.col("task"))
    return sets.agg(F.avg("s").alias("semantics"), F.avg("q").alias("quality"), F.avg("o").alias("overall"), F.count("*").alias("n"))


def type_means(rows: DataFrame, kind: str, score: str) -> DataFrame:
    """Mean score by kind, and over all records (kind null)."""
    return rows.groupingSets([[F.col(kind)], []], F.col(kind)).agg(F.avg(score).alias("mean"), F.count("*").alias("n"))


def image_rates(rows: DataFrame, prompt: str, tag: str, correct: str) -> DataFrame:
    """One row: share of correct images, of prompts with any correct image, and the macro mean of the tags' rates."""
    hit = F.col(correct).cast("double")
    images = rows.agg(F.avg(hit).alias("image_rate"), F.count("*").alias("n"))
    prompts = rows.groupBy(prompt).agg(F.max(hit).alias("any")).agg(F.avg("any").alias("prompt_rate"))
    tags = rows.groupBy(tag).agg(F.avg(hit).alias("rate")).agg(F.avg("rate").alias("macro_rate"))
    return images.join(F.broadcast(prompts)).join(F.broadcast(tags))  # each is one row


def macro_over(rows: DataFrame, level: str, metrics: list[str]) -> DataFrame:
    """Mean of each metric by level, and their macro mean (level null)."""
    by = rows.groupBy(level).agg(*(F.avg(m).alias(m) for m in metrics), F.count("*").alias("n"))
    return by.unionByName(by.agg(*(F.avg(m).alias(m) for m in metrics), F.sum("n").alias("n")).withColumn(level, F.lit(None).cast(rows.schema[level].dataType)))


def reaggregated(records: DataFrame, key: str, runs: str, claimed: str, tolerance: float = 1e-9) -> DataFrame:
    """The mean of each record's runs, and whether the claimed mean agrees."""
    mean = F.aggregate(runs, F.lit(0.0), lambda acc, r: acc + r) / F.size(runs)
    return records.select(key, mean.alias("mean"), (F.abs(mean - F.col(claimed)) <= tolerance).alias("agrees"))


def usage(rows: DataFrame, keys: list[str], tokens: list[str], model: str, created: str, response: str) -> DataFrame:
    """Token sums, models in order, first and last time, and whether response ids are unique."""
    return rows.groupBy(*keys).agg(
        *(F.sum(t).cast("long").alias(t) for t in tokens),
        F.array_join(F.sort_array(F.collect_set(model)), ",").alias("models"),
        F.min(created).alias("first_created"),
        F.max(created).alias("last_created"),
        (F.count_distinct(response) == F.count(response)).alias("unique_ids"),
    )


def keyed_overall(alignment: DataFrame, quality: DataFrame, key: str) -> DataFrame:
    """Alignment and quality joined by key, never by place, with the mean of the three metrics."""
    both = alignment.join(quality, key)
    return both.withColumn("overall", (F.col("instruction") + F.col("identity") + F.col("perception")) / 3.0)


def report_sections(lines: DataFrame, path: str, order: str, text: str) -> DataFrame:
    """Values of a report by section: a heading line names the section of the lines after it."""
    section = F.when(F.col(text).rlike("^L[12] category scores:"), F.regexp_extract(text, "^(L[12])", 1))
    current = F.last(section, ignorenulls=True).over(Window.partitionBy(path).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    item = F.regexp_extract(text, r"^\s*([^:]+):\s*([0-9.]+)\s*$", 1)
    value = F.regexp_extract(text, r"^\s*([^:]+):\s*([0-9.]+)\s*$", 2).try_cast("double")
    rows = lines.withColumn("section", current).withColumn("item", F.trim(item)).withColumn("value", value)
    return rows.filter(F.col("value").isNotNull() & F.col("section").isNotNull()).select(path, "section", "item", "value")


def first_numeric(columns: list[Column]) -> Column:
    """The first column that reads as a number."""
    return F.coalesce(*(c.try_cast("double") for c in columns))


def available_mean(columns: list[Column]) -> Column:
    """Mean of the columns that are there."""
    values = F.array_compact(F.array(*columns))
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def sampling_plan(rows: DataFrame, key: str, n: int, chunk: int) -> DataFrame:
    """Requests for n choices in chunks: (key, request, choices)."""
    starts = F.sequence(F.lit(0), F.lit(n - 1), F.lit(chunk))
    return rows.select(key, F.posexplode(starts).alias("request", "start")).select(key, F.col("request").cast("long").alias("request"), F.least(F.lit(chunk), n - F.col("start")).cast("long").alias("choices"))
