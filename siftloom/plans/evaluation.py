"""Queries that compute benchmark metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.functions import parsing
from siftloom.functions import scoring as s
from siftloom.operators import evals
from siftloom.plans import adapters as a
from siftloom.plans.registry import query, r6

SCORES = "scores AS (SELECT doc_id, source AS task, lang AS language, CAST(doc_id * 7 % 101 AS DOUBLE) / 1e1 AS s, CAST(doc_id * 13 % 101 AS DOUBLE) / 1e1 AS q FROM documents)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = a.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("source").alias("task"), F.col("lang").alias("language"), (F.col("doc_id") * 7 % 101 / 10.0).alias("s"), (F.col("doc_id") * 13 % 101 / 10.0).alias("q"))


@query(f"""
    WITH {SCORES} SELECT task, {r6("avg(s)")} AS semantics, {r6("avg(q)")} AS quality, {r6("avg(sqrt(s * q))")} AS overall, CAST(count(*) AS BIGINT) AS n FROM scores GROUP BY GROUPING SETS ((task), ())
""")
def gedit_group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evals.edit_score_means(scores(spark, sf_dir), "task", "s", "q")
    return out.select("task", *(s.round6(F.col(c)).alias(c) for c in ("semantics", "quality", "overall")), "n")


KINDS = list(parsing.SCORE_LABELS)
LABEL_VALUES = ", ".join(f"({k}, '{kind}', '{names[0]}', '{names[1]}', '{names[2]}')" for k, (kind, names) in enumerate(parsing.SCORE_LABELS.items()))
JUDGE = f"""
    labels(pos, kind, l1, l2, l3) AS (VALUES {LABEL_VALUES}),
    judge AS (
      SELECT doc_id, kind, l1, l2, l3,
             CASE doc_id % 11
               WHEN 0 THEN l1 || ': ' || (doc_id % 5 + 1) || chr(10) || l2 || ': 9' || chr(10) || l3 || ': 3'
               WHEN 1 THEN l1 || ': ' || (doc_id % 5 + 1) || chr(10) || l2 || ': 4.5' || chr(10) || l3 || ': 3'
               WHEN 2 THEN l1 || ': 4' || chr(10) || l1 || ': 4' || chr(10) || l2 || ': 2' || chr(10) || l3 || ': 3'
               WHEN 3 THEN l1 || ': 4' || chr(10) || l2 || ': 2'
               WHEN 4 THEN l1 || ': 4' || chr(10) || 'Extra Label: 2' || chr(10) || l2 || ': 2' || chr(10) || l3 || ': 3'
               ELSE 'Brief reasoning here.' || chr(10) || l1 || ': ' || (doc_id % 5 + 1) || chr(10) || l2 || ': ' || (doc_id % 4 + 1) || '/5.' || chr(10) || l3 || ': ' || (doc_id % 3 + 1) END AS answer
      FROM documents JOIN labels ON pos = doc_id % {len(KINDS)})
"""
GOOD = "doc_id % 11 > 4"
AVERAGE = "CAST((doc_id % 5 + 1) + (doc_id % 4 + 1) + (doc_id % 3 + 1) AS DOUBLE) / 3e0"


def judge_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges' answers made from document numbers, with malformed ones among them."""
    d = a.table(spark, sf_dir, "documents").select("doc_id")
    at = (F.col("doc_id") % len(KINDS) + 1).cast("int")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), at)
    labels = F.element_at(F.array(*(F.array(*map(F.lit, v)) for v in parsing.SCORE_LABELS.values())), at)
    d = d.withColumn("kind", kind).withColumn("labels", labels)
    l1, l2, l3 = (F.col("labels")[k] for k in range(3))
    num = lambda m: (F.col("doc_id") % m + 1).cast("string")
    line = lambda label, value: F.concat(label, F.lit(": "), value if not isinstance(value, str) else F.lit(value))
    rows = lambda *x: F.concat_ws("\n", *x)
    r = F.col("doc_id") % 11
    answer = (
        F.when(r == 0, rows(line(l1, num(5)), line(l2, "9"), line(l3, "3")))
        .when(r == 1, rows(line(l1, num(5)), line(l2, "4.5"), line(l3, "3")))
        .when(r == 2, rows(line(l1, "4"), line(l1, "4"), line(l2, "2"), line(l3, "3")))
        .when(r == 3, rows(line(l1, "4"), line(l2, "2")))
        .when(r == 4, rows(line(l1, "4"), F.lit("Extra Label: 2"), line(l2, "2"), line(l3, "3")))
        .otherwise(rows(F.lit("Brief reasoning here."), line(l1, num(5)), F.concat(line(l2, num(4)), F.lit("/5.")), line(l3, num(3))))
    )
    return d.select("doc_id", "kind", answer.alias("answer"))


@query(f"""
    WITH {JUDGE} SELECT doc_id, kind, CASE doc_id % 11 WHEN 0 THEN 'out_of_range' WHEN 1 THEN 'not_integer' WHEN 2 THEN 'duplicate_label' WHEN 3 THEN 'missing_label' WHEN 4 THEN 'unexpected_label' END AS error,
      CASE WHEN {GOOD} THEN {r6(AVERAGE)} END AS average FROM judge
""")
def imgedit_strict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = judge_answers(spark, sf_dir).withColumn("p", parsing.strict_scores(F.col("answer"), F.col("kind")))
    return parsed.select("doc_id", "kind", F.col("p.error").alias("error"), s.round6(F.col("p.average")).alias("average"))


@query(f"""
    WITH {JUDGE}, lines AS (SELECT doc_id, unnest(string_split(answer, chr(10))) AS line FROM judge),
    n AS (SELECT doc_id, CAST(string_split(trim(line), ': ')[2] AS DOUBLE) AS v FROM lines WHERE len(string_split(trim(line), ': ')) = 2 AND regexp_full_match(string_split(trim(line), ': ')[2], '[0-9]+'))
    SELECT j.doc_id, floor(avg(v) * 1e2 + 5e-1) / 1e2 AS average FROM judge j LEFT JOIN n ON n.doc_id = j.doc_id GROUP BY 1
""")
def imgedit_legacy_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_answers(spark, sf_dir).select("doc_id", parsing.legacy_average(F.col("answer")).alias("average"))


@query(f"WITH {JUDGE} SELECT kind, {r6(f'avg({AVERAGE})')} AS mean, CAST(count(*) AS BIGINT) AS n FROM judge WHERE {GOOD} GROUP BY GROUPING SETS ((kind), ())")
def imgedit_type_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = judge_answers(spark, sf_dir).withColumn("p", parsing.strict_scores(F.col("answer"), F.col("kind"))).filter("p.error IS NULL").withColumn("average", F.col("p.average"))
    return evals.type_means(good, "kind", "average").select("kind", s.round6(F.col("mean")).alias("mean"), "n")


@query(f"WITH {JUDGE} SELECT doc_id, kind FROM judge WHERE NOT ({GOOD})")
def invalid_judge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = judge_answers(spark, sf_dir).withColumn("p", parsing.strict_scores(F.col("answer"), F.col("kind")))
    return parsed.filter("p.average IS NULL").select("doc_id", "kind")


@query(f"""
    WITH g AS (SELECT event_id, user_id AS prompt, event_type AS tag, value < 1e1 AS correct FROM events),
    p AS (SELECT avg(CAST(any_ok AS DOUBLE)) AS prompt_rate FROM (SELECT prompt, bool_or(correct)::INT AS any_ok FROM g GROUP BY 1)),
    t AS (SELECT avg(rate) AS macro_rate FROM (SELECT tag, avg(correct::INT) AS rate FROM g GROUP BY 1))
    SELECT {r6("avg(correct::INT)")} AS image_rate, CAST(count(*) AS BIGINT) AS n, {r6("any_value(prompt_rate)")} AS prompt_rate, {r6("any_value(macro_rate)")} AS macro_rate FROM g, p, t
""")
def geneval_rates_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.table(spark, sf_dir, "events").select(F.col("user_id").alias("prompt"), F.col("event_type").alias("tag"), (F.col("value") < 10.0).alias("correct"))
    out = evals.image_rates(rows, "prompt", "tag", "correct")
    return out.select(s.round6(F.col("image_rate")).alias("image_rate"), "n", s.round6(F.col("prompt_rate")).alias("prompt_rate"), s.round6(F.col("macro_rate")).alias("macro_rate"))


RUNS = """
    runs AS (SELECT conv_id * 1000 + turn AS key, turn % 8 + 1 AS level, list_transform(range(8), lambda r: CAST((length(text) + r * 3) % 11 AS DOUBLE)) AS align,
                    CAST(length(text) % 7 AS DOUBLE) + 3e0 AS perception, length(text) AS chars FROM conversations),
    means AS (SELECT *, list_sum(align) / 8e0 AS instruction FROM runs)
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = a.table(spark, sf_dir, "conversations")
    size = F.length("text")
    align = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: ((size + r * 3) % 11).cast("double"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), (F.col("turn") % 8 + 1).alias("level"), align.alias("align"), (size % 7 + 3.0).alias("perception"), size.alias("chars"))


@query(f"WITH {RUNS} SELECT key, {r6('instruction')} AS mean, abs(instruction - CASE WHEN key % 10 = 0 THEN instruction + 1e-3 ELSE instruction END) <= 1e-9 AS agrees FROM means")
def complex_edit_runs_reaggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = F.aggregate("align", F.lit(0.0), lambda x, r: x + r) / 8.0
    claimed = runs(spark, sf_dir).withColumn("claimed", F.when(F.col("key") % 10 == 0, mean + 0.001).otherwise(mean))
    return evals.reaggregated(claimed, "key", "align", "claimed").select("key", s.round6(F.col("mean")).alias("mean"), "agrees")


@query(f"""
    WITH {RUNS}, l AS (SELECT level, avg(instruction) AS instruction, avg(perception) AS perception, count(*) AS n FROM means GROUP BY 1),
    u AS (SELECT * FROM l UNION ALL SELECT NULL, avg(instruction), avg(perception), sum(n) FROM l)
    SELECT CAST(level AS BIGINT) AS level, {r6("instruction", 4)} AS instruction, {r6("perception", 4)} AS perception, CAST(n AS BIGINT) AS n FROM u
""")
def complex_edit_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir).withColumn("instruction", F.aggregate("align", F.lit(0.0), lambda x, r: x + r) / 8.0)
    out = evals.macro_over(rows, "level", ["instruction", "perception"])
    return out.select(F.col("level").cast("long").alias("level"), s.round6(F.col("instruction"), 4).alias("instruction"), s.round6(F.col("perception"), 4).alias("perception"), "n")


@query(f"""
    WITH {RUNS}, al AS (SELECT key, instruction, list_max(align) AS identity FROM means WHERE key % 17 <> 0), qu AS (SELECT key, perception FROM means WHERE key % 19 <> 0)
    SELECT al.key, {r6("(instruction + identity + perception) / 3e0")} AS overall FROM al JOIN qu ON al.key = qu.key
""")
def keyed_join_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir)
    align = rows.filter("key % 17 <> 0").select("key", (F.aggregate("align", F.lit(0.0), lambda x, r: x + r) / 8.0).alias("instruction"), F.array_max("align").alias("identity"))
    quality = rows.filter("key % 19 <> 0").select("key", "perception")
    return evals.keyed_overall(align, quality, "key").select("key", s.round6(F.col("overall")).alias("overall"))


@query("""
    SELECT role, CAST(sum(length(text)) AS BIGINT) AS prompt_tokens, CAST(sum(length(text) // 4) AS BIGINT) AS completion_tokens,
           array_to_string(list_sort(list_distinct(list('model-' || conv_id % 3))), ',') AS models, CAST(min(conv_id * 60 + turn) AS BIGINT) AS first_created, CAST(max(conv_id * 60 + turn) AS BIGINT) AS last_created,
           count(DISTINCT conv_id * 1000 + turn) = count(conv_id * 1000 + turn) AS unique_ids FROM conversations GROUP BY 1
""")
def provider_usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = a.table(spark, sf_dir, "conversations")
    rows = c.select(
        "role",
        F.length("text").alias("prompt_tokens"),
        F.floor(F.length("text") / 4).alias("completion_tokens"),
        F.concat(F.lit("model-"), (F.col("conv_id") % 3).cast("string")).alias("model"),
        (F.col("conv_id") * 60 + F.col("turn")).alias("created"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("response"),
    )
    return evals.usage(rows, ["role"], ["prompt_tokens", "completion_tokens"], "model", "created", "response")


@query("""
    WITH h AS (SELECT conv_id AS path, 'L1' AS section, 'entity' AS item, CAST(conv_id % 100 AS DOUBLE) AS value, turn FROM conversations WHERE turn = 0
               UNION ALL SELECT conv_id, 'L2', 'color', CAST(conv_id % 50 AS DOUBLE) + 5e-1, turn FROM conversations WHERE turn = 0)
    SELECT path, section, item, value FROM h
""")
def report_section_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with two sections, one text each, read line by line."""
    first = a.table(spark, sf_dir, "conversations").filter("turn = 0").select(F.col("conv_id").alias("path"))
    text = F.concat(
        F.lit("Image score: see below\n9.5: stray\nL1 category scores:\n  entity: "), (F.col("path") % 100).cast("string"),
        F.lit("\n\nL2 category scores:\n  color: "), (F.col("path") % 50 + 0.5).cast("string"), F.lit("\n"),
    )
    lines = first.select("path", F.posexplode(F.split(text, "\n")).alias("line", "text"))
    return evals.report_sections(lines, "path", "line", "text")


@query("""
    SELECT key, CAST(request AS BIGINT) AS request, CAST(least(5, 8 - request * 5) AS BIGINT) AS choices FROM (SELECT conv_id * 1000 + turn AS key, unnest(range(2)) AS request FROM conversations)
""")
def sampling_plan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.sampling_plan(runs(spark, sf_dir), "key", 8, 5)


@query("""
    WITH j AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '```json' || chr(10) || '{"score": [' || doc_id % 11 || ', ' || doc_id % 7 || '], "reasoning": "ok"}' || chr(10) || '```'
                 WHEN 1 THEN '{"score": [8, 7], "reasoning": "fine"}' WHEN 2 THEN '{"score": [12], "reasoning": "too high"}' ELSE 'no answer' END AS t FROM documents)
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CAST(least(doc_id % 11, doc_id % 7) AS DOUBLE) WHEN 1 THEN 7e0 END AS score FROM j
""")
def provider_answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = a.table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id")
    text = (
        F.when(i % 4 == 0, F.format_string('```json\n{"score": [%d, %d], "reasoning": "ok"}\n```', i % 11, i % 7))
        .when(i % 4 == 1, F.lit('{"score": [8, 7], "reasoning": "fine"}'))
        .when(i % 4 == 2, F.lit('{"score": [12], "reasoning": "too high"}'))
        .otherwise(F.lit("no answer"))
    )
    return d.select("doc_id", parsing.answer_score(text).alias("score"))


@query("""
    SELECT doc_id, CAST(k AS INT) AS candidate, CASE WHEN k = 1 THEN CAST(doc_id % 10 AS DOUBLE) / 1e1 ELSE 25e-2 END AS correctness, CASE WHEN k = 1 THEN 5e-1 ELSE 0e0 END AS preservation, k = 1 AS reliable
    FROM (SELECT doc_id, unnest([1, 2]) AS k FROM documents)
""")
def judge_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = a.table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id")
    text = F.concat(
        F.lit('Here: {"candidates": [{"index": "candidate 1", "target_correctness": 0.'), (i % 10).cast("string"),
        F.lit(', "preservation": 0.5, "reliable": true}, {"candidate": "#2", "edit_success": 0.25}]} end'),
    )
    rows = d.select("doc_id", F.explode(parsing.judge_rows(text)).alias("c"))
    return rows.select("doc_id", F.col("c.index").alias("candidate"), "c.correctness", "c.preservation", "c.reliable")


@query("""
    WITH m AS (SELECT user_id AS model, event_id, CASE event_id % 3 WHEN 0 THEN 'nan' WHEN 1 THEN '' ELSE CAST(event_id % 10 AS VARCHAR) END AS a, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 7 AS VARCHAR) ELSE 'x' END AS b FROM events)
    SELECT event_id, coalesce(CASE WHEN event_id % 3 = 2 THEN CAST(event_id % 10 AS DOUBLE) END, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 7 AS DOUBLE) END) AS metric FROM m
""")
def first_numeric_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    left = F.when(i % 3 == 0, "nan").when(i % 3 == 1, "").otherwise((i % 10).cast("string"))
    right = F.when(i % 2 == 0, (i % 7).cast("string")).otherwise("x")
    return a.table(spark, sf_dir, "events").select("event_id", F.coalesce(parsing.number_or_null(left), parsing.number_or_null(right)).alias("metric"))
