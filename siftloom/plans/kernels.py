"""Queries that call the scalar and array kernels one by one, on the candidates and the vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.functions import arrays, parsing
from siftloom.functions import scoring as s
from siftloom.functions import text as t
from siftloom.operators import evals, gates, payloads, weights
from siftloom.plans import adapters as a
from siftloom.plans.arrays import PAIRED, paired
from siftloom.plans.registry import query, r6


def c01(x: str) -> str:
    return f"least(greatest({x}, 0e0), 1e0)"


def sig(x: str) -> str:
    return f"(1e0 / (1e0 + exp(-({x}))))"


def ln(x: str) -> str:
    return f"ln(greatest(least({x}, 1e0), 1e-6))"


def gm(*xs: str) -> str:
    return f"exp(({' + '.join(ln(x) for x in xs)}) / {len(xs)}e0)"


def rounded(**columns) -> list:
    return [s.round6(x, 5).alias(n) for n, x in columns.items()]


@query(f"""
    WITH {a.CANDIDATES}, e AS (SELECT *, CASE WHEN l_partkey % 5 = 0 THEN 'NaN'::DOUBLE WHEN l_partkey % 5 = 1 THEN NULL ELSE taxonomy END AS part, CASE WHEN l_partkey % 2 = 0 THEN 'local' ELSE 'global' END AS scope FROM candidates)
    SELECT group_id, candidate_index, {r6("7e-1 * specificity + 3e-1 * (5e-1 * taxonomy + 5e-1 * validity)", 5)} AS stat,
           {r6("CASE WHEN scope = 'local' THEN 25e-2 * specificity + 25e-2 * taxonomy + 3e-1 * preservation + 2e-1 * validity ELSE 35e-2 * specificity + 25e-2 * taxonomy + 25e-2 * preservation + 15e-2 * validity END", 5)} AS spatial,
           {r6("4e-1 * specificity + 3e-1 * taxonomy + 3e-1 * validity", 5)} AS cycle, {r6("specificity * " + gm("taxonomy", "preservation", "validity"), 5)} AS checked,
           {r6("CASE WHEN taxonomy <> 0 THEN 1e2 * (specificity - taxonomy) / taxonomy END", 5)} AS improvement,
           {r6("CASE WHEN l_partkey % 5 IN (0, 1) THEN judge_score ELSE part END", 5)} AS first_finite, {r6("CASE l_partkey % 5 WHEN 0 THEN 25e-2 WHEN 1 THEN judge_score ELSE part END", 5)} AS first_present,
           {r6("CASE WHEN judge_supported THEN 65e-2 * " + c01("5e-1 + 5e-1 * (specificity - taxonomy) / 5e-2") + " + 35e-2 * preservation ELSE 5e-1 END", 5)} AS feature
    FROM e
""")
def scalar_blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    part = F.when(c("l_partkey") % 5 == 0, float("nan")).when(c("l_partkey") % 5 == 1, None).otherwise(c("taxonomy"))
    scope = F.when(c("l_partkey") % 2 == 0, "local").otherwise("global")
    blends = rounded(
        stat=s.stat_total("specificity", "taxonomy", "validity"),
        spatial=s.spatial_score(scope, c("specificity"), c("taxonomy"), c("preservation"), c("validity")),
        cycle=s.cycle_score(c("specificity"), c("taxonomy"), c("validity")),
        checked=s.checked_reward(c("specificity"), c("taxonomy"), c("preservation"), c("validity")),
        improvement=s.improvement_percent(c("taxonomy"), c("specificity")),
        first_finite=s.first_finite([part, c("judge_score")]),
        first_present=s.first_present([part, c("judge_score")], 0.25),
        feature=s.feature_score(c("taxonomy"), c("specificity"), c("preservation"), c("judge_supported")),
    )
    return a.candidates(spark, sf_dir).select("group_id", "candidate_index", *blends)


REQUIRED_SQL = "sqrt(" + sig("specificity / 5e-2") + " * " + sig("(taxonomy - 5e-1) / 1e-1") + ")", "sqrt(" + sig("(taxonomy - 5e-1) / 5e-2") + " * " + sig("(validity - 5e-1) / 1e-1") + ")"
ABSENT_SQL = "sqrt(" + sig("greatest(-(specificity - 5e-1), preservation - taxonomy) / 5e-2") + " * " + sig("(5e-1 - taxonomy) / 1e-1") + ")"
MAIN_SQL = "((specificity - 5e-1) + (taxonomy - 5e-1)) / 2e0"


@query(f"""
    WITH {a.CANDIDATES}, x AS (SELECT *, {MAIN_SQL} AS main, l_suppkey % 4 AS k, least(least(least(greatest(validity, 0e0), 1e0), 1e0) * 3e-1 + taxonomy * 7e-1, 1e0) AS told FROM candidates)
    SELECT group_id, candidate_index,
           {r6("CASE WHEN k = 0 THEN taxonomy ELSE 7e-1 * specificity + 3e-1 * taxonomy END", 5)} AS instruction, {r6("CASE WHEN k = 1 THEN 0e0 WHEN k = 0 THEN taxonomy ELSE 7e-1 * specificity + 3e-1 * taxonomy END", 5)} AS instruction_needed,
           {r6("55e-2 * validity + 45e-2 * CASE WHEN k = 2 THEN specificity ELSE preservation END", 5)} AS kept_gate,
           {r6("CASE WHEN k = 3 THEN 1e0 ELSE " + gm(sig("(specificity - 5e-1) / 1e-1"), sig("(taxonomy - 5e-1) / 1e-1")) + " END", 5)} AS grounding,
           {r6("CASE WHEN k = 3 THEN 1e0 ELSE " + gm(*REQUIRED_SQL) + " END", 5)} AS required, {r6("CASE WHEN k = 3 THEN 1e0 ELSE " + gm(ABSENT_SQL) + " END", 5)} AS absent,
           {r6("CASE WHEN k = 3 THEN 1e0 ELSE " + gm("exp(-(1e0 - preservation) / 1e-1)", "exp(-(1e0 - validity) / 1e-1)") + " END", 5)} AS kept,
           {r6("CASE WHEN k = 0 THEN 1e0 WHEN k = 1 THEN " + gm(sig("main / 5e-2"), sig("(validity - 5e-1) / 5e-2"), sig("(main - greatest(preservation - 5e-1, validity - 6e-1)) / 5e-2"), sig("(preservation - 7e-1) / 5e-2")) + " ELSE " + gm(sig("main / 5e-2"), sig("main / 5e-2"), "1e0") + " END", 5)} AS taxonomy_score,
           {r6("CASE WHEN k IN (0, 1) THEN " + gm(gm("specificity", "judge_score", "validity", "taxonomy"), gm("preservation", "validity", "taxonomy")) + " ELSE " + gm(gm("specificity", "validity"), gm("preservation", "validity", "taxonomy")) + " END", 5)} AS reward
    FROM x
""")
def check_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col, F.col("l_suppkey") % 4
    none = F.array().cast("array<double>")
    told = F.when(k == 3, none)
    both = lambda x, y: told.otherwise(F.array(x, y))
    instruction, kept_gate = s.gate_scores(c("specificity"), c("taxonomy"), F.when(k == 0, 0.0), F.when(k != 1, 1.0), c("validity"), F.when(k != 2, c("preservation")), c("specificity"))
    needed, _ = s.gate_scores(c("specificity"), c("taxonomy"), F.when(k == 0, 0.0), F.when(k != 1, 1.0), c("validity"), c("preservation"), c("specificity"), told_needed=True)
    main = F.array(c("specificity") - 0.5, c("taxonomy") - 0.5)
    only = lambda x: F.when(k == 1, x).otherwise(none)
    taxonomy = s.taxonomy_score(main, only(F.array(c("validity") - 0.5)), only(F.array(c("preservation") - 0.7)), only(F.array(c("preservation") - 0.5, c("validity") - 0.6)), k != 0)
    scores = rounded(
        instruction=instruction,
        instruction_needed=needed,
        kept_gate=kept_gate,
        grounding=s.grounding_score(both(c("specificity"), c("taxonomy"))),
        required=s.required_score(both(c("specificity"), c("taxonomy") - 0.5), both(c("taxonomy"), c("validity"))),
        absent=s.absence_score(told.otherwise(F.array(c("specificity") - 0.5)), told.otherwise(F.array("preservation")), told.otherwise(F.array("taxonomy"))),
        kept=s.kept_score(both(c("preservation"), c("validity"))),
        taxonomy_score=taxonomy,
        reward=s.combined_reward(c("specificity"), c("judge_score"), k < 2, c("validity"), c("taxonomy"), k < 2, [c("preservation"), c("validity"), c("taxonomy")]),
    )
    return a.candidates(spark, sf_dir).select("group_id", "candidate_index", *scores)


FORBIDDEN_SQL = """CASE WHEN edit_type IN ('object_removal', 'object_replacement') THEN supported > 0 AND taxonomy >= 55e-2
    ELSE taxonomy >= 4e-1 OR supported <= 0 OR edit_type IN ('color_change', 'style_transfer') AND specificity >= 5e-1 AND preservation >= 6e-1 AND validity >= 5e-1 END"""


@query(f"""
    WITH {a.CANDIDATES}, e AS (SELECT *, CASE WHEN l_suppkey % 3 = 0 THEN 0e0 ELSE 1e0 END AS supported FROM candidates) SELECT group_id, candidate_index, {FORBIDDEN_SQL} AS passed FROM e
""")
def forbidden_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.candidates(spark, sf_dir).select("group_id", "candidate_index", forbidden().alias("passed"))


def forbidden():
    c = F.col
    supported = F.when(c("l_suppkey") % 3 == 0, 0.0).otherwise(1.0)
    return s.forbidden_gate(c("edit_type"), c("taxonomy"), supported, 0.4, (("object_removal", "object_replacement"), 0.55), ("color_change", "style_transfer"), [(c("specificity"), 0.5), (c("preservation"), 0.6), (c("validity"), 0.5)])


@query(f"""
    WITH {a.CANDIDATES}, e AS (SELECT *, CASE WHEN l_suppkey % 3 = 0 THEN 0e0 ELSE 1e0 END AS supported FROM scored), g AS (SELECT *, {FORBIDDEN_SQL} AS forbidden FROM e)
    SELECT group_id, candidate_index, CASE WHEN NOT specificity > 5e-2 THEN 'raw_true_prompt_gain' WHEN NOT taxonomy - 2e-2 > 0 THEN 'raw_true_over_distractor_margin' WHEN NOT edit > 1e-1 THEN 'raw_required_after_gain'
        WHEN edit_type = 'object_removal' AND NOT judge_score > 5e-2 THEN 'raw_old_state_suppression' WHEN NOT specificity >= 1e-1 THEN 'source_grounded' WHEN NOT taxonomy >= 1e-1 THEN 'required_after' WHEN NOT forbidden THEN 'forbidden_gate'
        WHEN l_suppkey % 7 <> 0 AND NOT judge_score >= 5e-1 THEN 'object_detector_contract' WHEN l_partkey % 7 <> 0 AND NOT validity >= 5e-1 THEN 'conservative_region' WHEN NOT preservation >= 55e-2 THEN 'check_preservation'
        WHEN NOT specificity >= 3e-1 THEN 'edit_specificity' WHEN NOT taxonomy >= 35e-2 AND l_partkey % 2 = 0 THEN 'taxonomy' WHEN NOT preservation >= 65e-2 THEN 'preservation' WHEN NOT validity >= 45e-2 THEN 'validity' WHEN NOT raw_reward >= 6e-1 THEN 'reward' END AS reason FROM g
""")
def full_gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fifteen gates of a candidate; the first that fails."""
    c = F.col
    rows = a.rated(spark, sf_dir)
    raw = gates.raw_gates(c("specificity") - 0.05, c("taxonomy") - 0.02, c("edit") - 0.1, c("judge_score") - 0.05, c("edit_type") == "object_removal")
    floors = {"source": 0.1, "required": 0.1, "kept": 0.55, "specificity": 0.3, "taxonomy": 0.35, "preservation": 0.65, "validity": 0.45, "reward": 0.6}
    full = gates.full_gates(
        raw, c("specificity"), c("taxonomy"), forbidden(), F.when(c("l_suppkey") % 7 != 0, c("judge_score")), F.when(c("l_partkey") % 7 != 0, c("validity")), c("preservation"), c("specificity"), c("taxonomy"), c("l_partkey") % 2 == 0,
        c("preservation"), c("validity"), c("raw_reward"), floors,
    )
    return rows.select("group_id", "candidate_index", full.reason().alias("reason"))


@query(f"""
    WITH {a.CANDIDATES} SELECT edit_type, {r6("sum(raw_reward * 8e-1)", 3)} AS weight, {r6("sum(5e-1)", 3)} AS uniform, {r6("avg(greatest(2e-1, least(7e-1, raw_reward)))", 5)} AS clipped FROM scored WHERE raw_reward > 0 GROUP BY 1
""")
def accepted_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.rated(spark, sf_dir).filter("raw_reward > 0")
    own = rows.withColumn("w", s.accepted_weight(F.col("raw_reward"), "reward", 0.8)).withColumn("u", s.accepted_weight(F.col("raw_reward"), "uniform", 0.5))
    return own.groupBy("edit_type").agg(s.round6(F.sum("w"), 3).alias("weight"), s.round6(F.sum("u"), 3).alias("uniform"), s.round6(weights.clipped_mean(F.col("raw_reward"), 0.2, 0.7), 5).alias("clipped"))


@query("""
    WITH r AS (SELECT doc_id, doc_id % 37 + 1 AS batches, doc_id % 5 + 1 AS acc, doc_id % 3 + 1 AS epochs, CASE WHEN doc_id % 2 = 0 THEN doc_id % 91 + 1 END AS steps, doc_id % 113 AS at_step FROM documents),
    u AS (SELECT *, (batches + acc - 1) // acc AS updates FROM r)
    SELECT doc_id, CAST(updates AS BIGINT) AS updates, CAST(coalesce(steps, epochs * updates) AS BIGINT) AS steps, CAST(CASE WHEN steps IS NULL THEN epochs ELSE (steps + updates - 1) // updates END AS BIGINT) AS epochs,
           CAST(at_step // updates AS BIGINT) AS epoch, CAST(least((at_step % updates) * acc, batches) AS BIGINT) AS skip FROM u
""")
def training_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    batches, accumulate = i % 37 + 1, i % 5 + 1
    plan = s.schedule(batches, accumulate, i % 3 + 1, F.when(i % 2 == 0, i % 91 + 1))
    position = s.resume_position(i % 113, batches, accumulate)
    d = a.table(spark, sf_dir, "documents").select("doc_id", plan.alias("p"), position.alias("r"))
    return d.select("doc_id", F.col("p.updates_per_epoch").alias("updates"), "p.steps", "p.epochs", "r.epoch", "r.skip")


@query(f"""
    WITH {a.CANDIDATES} SELECT group_id, candidate_index, CASE WHEN judge_score < 2e-1 THEN 'judge' WHEN validity IS NULL OR validity < 5e-1 THEN 'validity' WHEN taxonomy < 35e-2 THEN 'taxonomy' END AS floor,
           status = 'rejected' AND feasible AND rnk > 0 AND starts_with(coalesce(reject_reason, 'accepted'), 'accepted') AS rank_only FROM judged
""")
def floors_and_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    floor = gates.first_floor([("judge", c("judge_score"), 0.2), ("validity", c("validity"), 0.5), ("taxonomy", c("taxonomy"), 0.35)])
    return a.judged(spark, sf_dir).select("group_id", "candidate_index", floor.alias("floor"), gates.rank_only_reject().alias("rank_only"))


@query(f"""
    WITH {a.CANDIDATES}, e AS (SELECT *, CASE WHEN l_suppkey % 9 = 0 THEN 'TimeoutError' END AS error, CASE WHEN l_partkey % 6 <> 0 THEN family END AS fam FROM rated)
    SELECT CASE WHEN l_partkey % 8 = 0 THEN '' ELSE CAST(group_id AS VARCHAR) END AS gid, CASE WHEN l_partkey % 10 = 0 THEN -1 ELSE candidate_index END AS idx, {r6("CASE WHEN error IS NULL THEN raw_reward ELSE 0e0 END")} AS raw_reward,
           feasible AND error IS NULL AS feasible, CASE WHEN error IS NULL THEN reject_reason ELSE 'error_' || error END AS reject_reason, coalesce(fam, 'unknown') || '::' || edit_type AS axis FROM e
""")
def keys_and_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of payloads, rows whose scoring failed, and the axis that balances them."""
    c = F.col
    rows = a.rated(spark, sf_dir).withColumn("error", F.when(c("l_suppkey") % 9 == 0, "TimeoutError")).withColumn("family", F.when(c("l_partkey") % 6 != 0, c("family")))
    out = payloads.defaulted(rows, ["raw_reward"])
    group, index = payloads.key_of(F.when(c("l_partkey") % 8 != 0, c("group_id")), F.when(c("l_partkey") % 10 == 0, "x").otherwise(c("candidate_index").cast("string")))
    return out.select(group.alias("gid"), index.alias("idx"), s.round6(c("raw_reward")).alias("raw_reward"), "feasible", "reject_reason", payloads.balance_axis(out, "family_edit_type").alias("axis"))


@query(f"""
    WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'n/a' WHEN 1 THEN CAST(doc_id AS VARCHAR) END AS a, CAST(doc_id % 50 AS VARCHAR) AS b, CASE WHEN doc_id % 4 <> 0 THEN doc_id / 8e0 END AS x, CASE WHEN doc_id % 6 = 1 THEN doc_id / 4e0 END AS y FROM documents)
    SELECT doc_id, {r6("CAST(coalesce(TRY_CAST(a AS DOUBLE), CAST(b AS DOUBLE)) AS DOUBLE)")} AS first, {r6("CASE WHEN x IS NULL THEN y WHEN y IS NULL THEN x ELSE (x + y) / 2e0 END")} AS mean FROM d
""")
def metric_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    first = evals.first_numeric([F.when(i % 3 == 0, "n/a").when(i % 3 == 1, i.cast("string")), (i % 50).cast("string")])
    mean = evals.available_mean([F.when(i % 4 != 0, i / 8.0), F.when(i % 6 == 1, i / 4.0)])
    return a.table(spark, sf_dir, "documents").select("doc_id", s.round6(first).alias("first"), s.round6(mean).alias("mean"))


REASONS = ("the cup is still visible", "It remains clearly present here", "all gone", "was not removed", "has not been removed yet", "the object is there; fine", "nothing is seen", "still there")
ITEMS = "sky; Tree;sky ; ;none;a  b;TREE;c;d;e;f;g;h;i"


@query(f"""
    WITH d AS (SELECT doc_id, ({[*REASONS]})[CAST(doc_id % 8 + 1 AS BIGINT)] AS reason, CASE WHEN doc_id % 3 = 0 THEN '/abs/' || lang ELSE lang || '/x.png' END AS p FROM documents)
    SELECT doc_id, regexp_matches(lower(reason), '\\b(?:still|remains?|is) (?:clearly |partially )?(?:visible|present|there)\\b|\\bnot (?:been )?removed\\b') AS visible,
           CASE WHEN starts_with(p, '/') THEN p ELSE '/data/' || p END AS path, 'sky | Tree | a b | c | d | e | f | g' AS items FROM d
""")
def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    reason = F.element_at(F.array(*map(F.lit, REASONS)), (i % 8 + 1).cast("int"))
    path = F.when(i % 3 == 0, F.concat(F.lit("/abs/"), "lang")).otherwise(F.concat("lang", F.lit("/x.png")))
    return a.table(spark, sf_dir, "documents").select("doc_id", parsing.still_visible(reason).alias("visible"), t.record_path(path, "/data/").alias("path"), F.array_join(t.clean_list(F.lit(ITEMS)), " | ").alias("items"))


# ---- arrays

UNIT = "u AS (SELECT vec_id, list_transform(a, lambda x: least(greatest(x / 4e0 + 5e-1, 0e0), 1e0)) AS a, list_transform(b, lambda x: least(greatest(x / 4e0 + 5e-1, 0e0), 1e0)) AS b FROM p)"
IN = "vec_id % 3 + i % 5 < 3"


def unit(x):
    return F.transform(x, lambda v: F.least(F.greatest(v.cast("double") / 4.0 + 0.5, F.lit(0.0)), F.lit(1.0)))


@query(f"""
    WITH {PAIRED}, {UNIT}, e AS (SELECT vec_id, unnest(a) AS x, unnest(b) AS y, unnest(range(len(a))) AS i FROM u), d AS (SELECT vec_id, i, abs(x - y) AS d, {IN} AS t, abs(x - y) > 18e0 / 255e0 AS h FROM e),
    g AS (SELECT vec_id, count(*) AS n, count(*) FILTER (t) AS nt, avg(d) FILTER (t) AS tc, avg(d * d) FILTER (t) AS tm, avg(h::INT) FILTER (t) AS tf, count(*) FILTER (t AND h) AS th, count(*) FILTER (NOT t) AS no,
                 coalesce(avg(d) FILTER (NOT t), avg(d)) AS oc, coalesce(avg(d * d) FILTER (NOT t), avg(d * d)) AS om, coalesce(avg(h::INT) FILTER (NOT t), avg(h::INT)) AS of_, count(*) FILTER (NOT t AND h) AS oh FROM d GROUP BY 1)
    SELECT vec_id, {r6("nt / n::DOUBLE", 5)} AS target_area, {r6("no / n::DOUBLE", 5)} AS outside_area, {r6("(th + oh) / n::DOUBLE", 5)} AS changed_fraction, {r6("coalesce(tc, 0e0)", 5)} AS target_change, {r6("oc", 5)} AS outside_change,
           {r6("coalesce(tf, 0e0)", 5)} AS target_changed_fraction, {r6("of_", 5)} AS outside_changed_fraction, {r6("th / n::DOUBLE", 5)} AS target_changed_pixels, {r6("oh / n::DOUBLE", 5)} AS outside_changed_pixels,
           {r6("CASE WHEN th + oh > 0 THEN th / (th + oh)::DOUBLE ELSE 1e0 END", 5)} AS localization, {r6("coalesce(tm, 0e0)", 5)} AS target_mse, {r6("om", 5)} AS outside_mse,
           {r6("CASE WHEN coalesce(tm, 0e0) <= 1e-12 THEN 6e1 ELSE least(6e1, -1e1 * log10(tm)) END", 4)} AS target_psnr, {r6("CASE WHEN om <= 1e-12 THEN 6e1 ELSE least(6e1, -1e1 * log10(om)) END", 4)} AS outside_psnr FROM g
""")
def masked_region_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paired(spark, sf_dir).select("vec_id", unit(F.col("a")).alias("a"), unit(F.col("b")).alias("b"))
    mask = F.transform("a", lambda _, i: F.col("vec_id") % 3 + i % 5 < 3)
    out = rows.withColumn("m", mask).withColumn("s", arrays.masked_statistics(F.col("a"), F.col("b"), F.col("m")))
    names = out.schema["s"].dataType.names
    return out.select("vec_id", *(s.round6(F.col(f"s.{n}"), 4 if n.endswith("psnr") else 5).alias(n) for n in names))


@query(f"""
    WITH {PAIRED}, {UNIT}, e AS (SELECT vec_id, unnest(a) AS x, unnest(b) AS y, unnest(range(len(a))) AS i FROM u), d AS (SELECT vec_id, i, abs(x - y) AS d, abs(x - y) > 3e-1 AS h FROM e),
    g AS (SELECT vec_id, count(*) AS n, count(*) FILTER (h) AS k, coalesce(avg(d) FILTER (h), 0e0) AS ins, coalesce(avg(d) FILTER (NOT h), avg(d) FILTER (h), 0e0) AS outs, avg(d) AS total,
                 (max(i % 8) FILTER (h) - min(i % 8) FILTER (h) + 1) * (max(i // 8) FILTER (h) - min(i // 8) FILTER (h) + 1) AS box FROM d GROUP BY 1)
    SELECT vec_id, {r6("k / n::DOUBLE", 5)} AS changed_fraction, {r6("ins", 5)} AS inside, {r6("outs", 5)} AS outside, {r6("total", 5)} AS total, {r6("coalesce(k / box::DOUBLE, 0e0)", 5)} AS compactness, {r6("ins / greatest(ins + outs, 1e-6)", 5)} AS precision FROM g
""")
def difference_region_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paired(spark, sf_dir).withColumn("s", arrays.difference_statistics(unit(F.col("a")), unit(F.col("b")), 8, 0.3))
    return out.select("vec_id", *(s.round6(F.col(f"s.{n}"), 5).alias(n) for n in out.schema["s"].dataType.names))


@query(f"""
    WITH {PAIRED}, e AS (SELECT vec_id, unnest(a) AS x, unnest(b) AS y FROM p), d AS (SELECT vec_id, abs(x - y) / greatest(5e-1 * (abs(x) + abs(y)), 1e-4) AS d FROM e),
    m AS (SELECT vec_id, avg(d) AS mean, greatest(2e-2, avg(d) + stddev_pop(d)) AS lim FROM d GROUP BY 1),
    g AS (SELECT d.vec_id, any_value(mean) AS mean, coalesce(avg(d) FILTER (d <= lim), any_value(mean)) AS outs, avg((d > lim)::INT) AS share FROM d JOIN m USING (vec_id) GROUP BY 1)
    SELECT vec_id, {r6("exp(-outs / 25e-2)", 5)} AS preservation,
           {r6("sqrt(greatest(CASE WHEN share < 5e-2 THEN " + c01("share / 5e-2") + " WHEN share > 2e-1 THEN " + c01("1e0 - (share - 2e-1) / 8e-1") + " ELSE 1e0 END * exp(-greatest(0e0, mean - 35e-2) / 2e-1), 0e0))", 5)} AS validity FROM g
""")
def latent_locality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paired(spark, sf_dir).withColumn("s", arrays.latent_scores(F.col("a"), F.col("b"), F.lit(0.05), F.lit(0.2)))
    return out.select("vec_id", s.round6(F.col("s.preservation"), 5).alias("preservation"), s.round6(F.col("s.validity"), 5).alias("validity"))


@query(f"""
    WITH {PAIRED}, e AS (SELECT vec_id, unnest(a) AS x, unnest(b) AS y, unnest(range(len(a))) AS i FROM p),
    v AS (SELECT *, abs(x - y) AS d, lead(x) OVER (PARTITION BY vec_id ORDER BY i) - x AS step FROM e),
    m AS (SELECT vec_id, avg(d) AS mean, stddev_pop(d) AS dev, avg(d * d) AS mse, sum(abs(step)) AS steps FROM v GROUP BY 1),
    k AS (SELECT v.vec_id, any_value(mse) AS mse, any_value(steps) AS steps, count(*) FILTER (d > mean + dev) AS adaptive, coalesce(avg(d) FILTER (d > mean + dev), 0e0) AS ins, coalesce(avg(d) FILTER (d <= mean + dev), 0e0) AS outs FROM v JOIN m USING (vec_id) GROUP BY 1),
    b AS (SELECT vec_id, unnest(range(64)) AS c FROM p), x AS (SELECT vec_id, c % 8 AS cx, c // 8 AS cy, c % 8 >= vec_id % 4 AND c % 8 < vec_id % 4 + 3 AND c // 8 >= vec_id % 5 AND c // 8 < vec_id % 5 + 2 AS hit FROM b),
    w AS (SELECT vec_id, count(*) FILTER (hit) AS box, count(*) FILTER (EXISTS (SELECT 1 FROM range(1))) AS cells FROM x GROUP BY 1),
    y AS (SELECT vec_id, (least(vec_id % 4 + 3 + 1, 8) - greatest(vec_id % 4 - 1, 0)) * (least(vec_id % 5 + 2 + 1, 8) - greatest(vec_id % 5 - 1, 0)) AS grown FROM p)
    SELECT vec_id, CAST(adaptive AS BIGINT) AS adaptive, {r6("steps", 4)} AS gradient, {r6("least(6e1, 1e1 * log10(65025e0 / greatest(mse, 1e-12)))", 4)} AS peak, {r6("exp(-outs / greatest(ins, 1e-6) / 5e-1)", 5)} AS locality, CAST(box AS BIGINT) AS box, CAST(grown AS BIGINT) AS grown
    FROM k JOIN w USING (vec_id) JOIN y USING (vec_id)
""")
def array_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    rows = paired(spark, sf_dir).withColumn("d", arrays.difference(F.col("a"), F.col("b")))
    rows = rows.withColumn("m", arrays.adaptive_mask(F.col("d"), 1.0)).withColumn("boxed", arrays.box_mask(8, i % 4, i % 5, i % 4 + 3, i % 5 + 2))
    count = lambda m: F.size(F.filter(m, lambda v: v)).cast("long")
    inside, outside = F.coalesce(arrays.mean(arrays.masked(F.col("d"), F.col("m"))), F.lit(0.0)), F.coalesce(arrays.mean(arrays.masked(F.col("d"), F.transform("m", lambda v: ~v))), F.lit(0.0))
    mse = arrays.mean(F.transform("d", lambda v: v * v))
    return rows.select(
        "vec_id",
        count(F.col("m")).alias("adaptive"),
        s.round6(arrays.total(F.transform(arrays.gradient(F.col("a")), lambda v: F.abs(v))), 4).alias("gradient"),
        s.round6(arrays.peak_ratio(mse), 4).alias("peak"),
        s.round6(arrays.locality(inside, outside, 0.5), 5).alias("locality"),
        count(F.col("boxed")).alias("box"),
        count(arrays.dilate(F.col("boxed"), 8)).alias("grown"),
    )


@query(f"""
    WITH {PAIRED}, k AS (SELECT vec_id, a[1:4] AS a, b[1:4] AS b, t[1:4] AS t, vec_id % 2 = 0 AS m1, vec_id % 3 = 0 AS m2, vec_id % 5 <> 0 AS m3 FROM p), n AS (SELECT *, m1::INT + m2::INT + m3::INT AS n FROM k)
    SELECT vec_id, {", ".join(r6(f"(CASE WHEN m1 THEN a[{j}] ELSE 0e0 END + CASE WHEN m2 THEN b[{j}] ELSE 0e0 END + CASE WHEN m3 THEN t[{j}] ELSE 0e0 END) / nullif(n, 0)", 5) + f" AS v{j}" for j in (1, 2, 3, 4))} FROM n
""")
def masked_mean_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    states = F.array(*(F.slice(F.transform(x, lambda v: v.cast("double")), 1, 4) for x in ("a", "b", "t")))
    pooled = paired(spark, sf_dir).select("vec_id", arrays.masked_mean_pool(states, F.array(i % 2 == 0, i % 3 == 0, i % 5 != 0), 4).alias("v"))
    return pooled.select("vec_id", *(s.round6(F.col("v")[j - 1], 5).alias(f"v{j}") for j in (1, 2, 3, 4)))
