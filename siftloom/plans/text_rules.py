"""Queries that read instructions and structured edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.functions import text as t
from siftloom.plans import adapters as a
from siftloom.plans.registry import query

FORMS = (
    "Replace the {n} with a {r}", "Remove the {n} from the scene and brighten it", "Add a new {n} near the {r}", "Move the {n} to the left", "Make the {n} jump over the {r}", "Isolate the {n} from the {r}",
    "Change it to a red {n}", "Give the {n} a wood look", "A calmer {n}", "Delete the {n} behind the {r}.", "Change the color of the {n} to blue", "Make the very {n} green, while keeping the {r}",
    "Change the {n} to look like glass", "Sharpen the {n} on the table without noise", "Enhance the details and tone of the {n}; keep the rest", "Turn the {n} into a {r}, preserving the sky", "Insert a {n}",
    "Relocate the {n} beside the {r}", "Raise the {n}'s left arm", "Make the {n} in the {r} brighter", "Change the {n} material to wooden boards", "Erase the {n} labeled 'x' completely", "Change the material of object to steel",
    "Remove the background around the {n}", "Increase contrast of the {n}", "Change the {n} to a shiny metallic surface", "Erase the {n} and adjust the exposure",
)
FORM_SQL = "[" + ", ".join("'" + f.replace("'", "''") + "'" for f in FORMS) + "]"
INSTRUCTIONS = f"""
    ins AS (SELECT p_partkey * 100 + r_regionkey AS id, replace(replace(({FORM_SQL})[CAST((p_partkey * 5 + r_regionkey) % {len(FORMS)} + 1 AS BIGINT)], '{{n}}', p_name), '{{r}}', lower(r_name)) AS instruction,
                   ['style', 'background', 'local', 'tone', 'detail'][CAST(p_partkey % 5 + 1 AS BIGINT)] AS family FROM part, region)
"""


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An instruction for every part and region (five rows), from the forms."""
    p, r = a.table(spark, sf_dir, "part").select("p_partkey", "p_name"), a.table(spark, sf_dir, "region")
    both = p.join(F.broadcast(r))
    form = F.element_at(F.array(*map(F.lit, FORMS)), ((F.col("p_partkey") * 5 + F.col("r_regionkey")) % len(FORMS) + 1).cast("int"))
    text = F.replace(F.replace(form, F.lit("{n}"), F.col("p_name")), F.lit("{r}"), F.lower("r_name"))
    family = F.element_at(F.array(*map(F.lit, ("style", "background", "local", "tone", "detail"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = both.select((F.col("p_partkey") * 100 + F.col("r_regionkey")).alias("id"), text.alias("instruction"), family.alias("family"))
    # a small file is one task, and a row costs many patterns: short rows are dealt out
    return rows.repartition(spark.sparkContext.defaultParallelism)


KIND_SQL = r"""CASE WHEN lower(family) IN ('exposure', 'contrast', 'color', 'tone') THEN 'global_adjustment'
      WHEN regexp_matches(lower(instruction), '\b(?:remove|delete|erase)\b.*\b(?:and|then|,)\b.*\b(?:increase|decrease|adjust|brighten|darken|saturat|contrast|warmer|cooler|blur|sharpen|brightness|exposure)\b') THEN 'compose'
      WHEN regexp_matches(lower(instruction), '\bmake\s+(?:the\s+)?.+?\b(?:turn|raise|lift|bend|lean|tilt|wave|jump|run|walk|sit|stand|look|reach|kneel|crouch|stretch|nod|point|hold|grab|push|pull|step|dance|throw|catch|climb)\b') THEN 'action_change'
      WHEN regexp_matches(lower(instruction), 'extract |isolate |cut out |remove the background') THEN 'subject_extraction'
      WHEN regexp_matches(lower(instruction), 'replace |change the object|turn the|make the person into') THEN 'object_replacement'
      WHEN regexp_matches(lower(instruction), 'remove |delete |erase ') THEN 'object_removal'
      WHEN regexp_matches(lower(instruction), 'add |insert |place a new') THEN 'object_addition'
      WHEN regexp_matches(lower(instruction), 'move |relocate |to the left|to the right|higher|lower') THEN 'spatial_move'
      WHEN regexp_matches(lower(instruction), 'color|colour|red|blue|green|yellow|black|white') THEN 'color_change'
      WHEN regexp_matches(lower(instruction), 'metal|wood|glass|plastic|denim|leather') THEN 'material_change'
      WHEN lower(family) = 'style' THEN 'style_transfer' WHEN lower(family) = 'background' THEN 'background_change' ELSE 'local_enhancement' END"""


@query(f"""
    WITH {INSTRUCTIONS} SELECT id, {KIND_SQL} AS edit_type FROM ins
""")
def edit_type_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instructions(spark, sf_dir).select("id", t.infer_edit_type(F.col("instruction"), F.col("family")).alias("edit_type"))


NAMES = (
    "replace", "replacement", "remove", "delete", "add", "insert", "move", "relocate", "color", "colour_change", "material", "style", "background", "global", "local", "extract", "extraction", "isolate",
    "isolation", "cutout", "cut_out", "compound", "compound_edit", "multi_edit", "composite", "action", "pose", "pose_change", "motion", "attribute_change", "color_change", "material_change",
    "object_replacement", "object_removal", "object_addition", "spatial_move", "style_transfer", "background_change", "global_adjustment", "local_enhancement", "subject_extraction", "compose",
    "action_change", "Cut-Out", "POSE change", "nothing", "unknown", "  Style ",
)
NAMED = f"n AS (SELECT doc_id, ([{', '.join(repr(n) for n in NAMES)}])[CAST(doc_id % {len(NAMES)} + 1 AS BIGINT)] AS name FROM documents)"


@query(f"""
    WITH {NAMED}, c AS (SELECT doc_id, replace(replace(lower(trim(name)), ' ', '_'), '-', '_') AS k FROM n),
    m AS (SELECT doc_id, CASE WHEN k IN ('replace', 'replacement') THEN 'object_replacement' WHEN k IN ('remove', 'delete') THEN 'object_removal' WHEN k IN ('add', 'insert') THEN 'object_addition'
                 WHEN k IN ('move', 'relocate') THEN 'spatial_move' WHEN k IN ('color', 'colour_change') THEN 'color_change' WHEN k = 'material' THEN 'material_change' WHEN k = 'style' THEN 'style_transfer'
                 WHEN k = 'background' THEN 'background_change' WHEN k = 'global' THEN 'global_adjustment' WHEN k = 'local' THEN 'local_enhancement'
                 WHEN k IN ('extract', 'extraction', 'isolate', 'isolation', 'cutout', 'cut_out') THEN 'subject_extraction'
                 WHEN k IN ('compound', 'compound_edit', 'multi_edit', 'composite') THEN 'compose' WHEN k IN ('action', 'pose', 'pose_change', 'motion') THEN 'action_change' ELSE k END AS v FROM c)
    SELECT doc_id, CASE WHEN v IN ('attribute_change', 'color_change', 'material_change', 'object_replacement', 'object_removal', 'object_addition', 'spatial_move', 'style_transfer', 'background_change',
        'global_adjustment', 'local_enhancement', 'subject_extraction', 'compose', 'action_change') THEN v ELSE 'local_enhancement' END AS edit_type FROM m
""")
def edit_type_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % len(NAMES) + 1).cast("int"))
    return a.table(spark, sf_dir, "documents").select("doc_id", t.edit_type(name).alias("edit_type"))


@query("""
    WITH r AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN ' N/A ' WHEN 1 THEN 'none' WHEN 2 THEN '' ELSE '  ' || text || '  ' END AS x FROM documents),
    c AS (SELECT doc_id, regexp_replace(x, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS t FROM r)
    SELECT doc_id, CASE WHEN lower(t) IN ('', 'none', 'null', 'n/a', 'na', 'not applicable', 'unknown') THEN NULL ELSE left(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), 160) END AS cleaned FROM c
""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    raw = F.when(i % 6 == 0, " N/A ").when(i % 6 == 1, "none").when(i % 6 == 2, "").otherwise(F.concat(F.lit("  "), F.col("text"), F.lit("  ")))
    return a.table(spark, sf_dir, "documents").select("doc_id", t.clean_text(raw).alias("cleaned"))


STOP = "'the', 'and', 'with', 'from', 'into', 'that', 'this', 'for', 'are', 'was', 'its', 'all', 'any', 'new', 'while', 'keep', 'make'"
TOKENS = f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({{0}}), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({STOP})), lambda w: CASE WHEN length(w) > 3 AND suffix(w, 's') AND NOT suffix(w, 'ss') THEN left(w, length(w) - 1) ELSE w END))"


@query(f"""
    WITH b AS (SELECT item_id, text FROM benchmark), d AS (SELECT doc_id, text FROM documents)
    SELECT doc_id, CAST(len({TOKENS.format("d.text")}) AS BIGINT) AS n_tokens, CAST(len(list_intersect({TOKENS.format("d.text")}, {TOKENS.format("b.text")})) AS BIGINT) AS shared
    FROM d JOIN b ON b.item_id = d.doc_id % 40
""")
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = a.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("a"))
    b = a.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("b"))
    both = d.join(b, F.col("doc_id") % 40 == F.col("item_id"))
    x, y = t.tokens(F.col("a")), t.tokens(F.col("b"))
    return both.select("doc_id", F.size(x).cast("long").alias("n_tokens"), F.size(F.array_intersect(x, y)).cast("long").alias("shared"))


BANK = ["red car", "wooden chair", "small dog", "glass vase", "paper lamp"]
BANK_SQL = "[" + ", ".join(repr(b) for b in BANK) + "]"


@query(f"""
    SELECT doc_id, ({BANK_SQL})[CAST((list_sum(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c))) + 42 + {sum(map(ord, "source"))}) % 5 + 1 AS BIGINT)] AS source,
           CASE doc_id % 3 WHEN 0 THEN 'Remove the ' || source_lang WHEN 1 THEN 'Erase the ' || source_lang || ' completely' ELSE 'Take the ' || source_lang || ' out' END AS instruction
    FROM (SELECT doc_id, lang AS source_lang FROM documents)
""")
def template_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, lang = F.col("doc_id").cast("string"), F.col("lang")
    forms = [F.concat(F.lit("Remove the "), lang), F.concat(F.lit("Erase the "), lang, F.lit(" completely")), F.concat(F.lit("Take the "), lang, F.lit(" out"))]
    return a.table(spark, sf_dir, "documents").select("doc_id", t.choice(key, 42, "source", BANK).alias("source"), t.variant(F.col("doc_id"), forms).alias("instruction"))


@query(f"""
    WITH {a.CANDIDATES} SELECT role, role = 'policy' OR starts_with(role, 'policy:') AS exact, starts_with(role, 'ref') AS glob, role = 'reference' OR starts_with(role, 'reference:') AS namespace, CAST(count(*) AS BIGINT) AS n
    FROM candidates GROUP BY 1
""")
def role_pattern_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("role")
    out = a.candidates(spark, sf_dir).groupBy("role").agg(F.count("*").alias("n"))
    return out.select("role", t.role_matches(r, ["policy"]).alias("exact"), t.role_matches(r, ["ref*"]).alias("glob"), t.role_matches(r, ["reference"]).alias("namespace"), "n")
