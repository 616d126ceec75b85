"""Queries over structured edits: slots told by instructions, checks made for them, eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.functions import scoring as s
from siftloom.functions import text as t
from siftloom.operators import contract, edits
from siftloom.plans import adapters as a
from siftloom.plans.registry import query
from siftloom.plans.text_rules import INSTRUCTIONS, KIND_SQL, instructions

# ---- slots told by an instruction

COLORS_SQL = "red|blue|green|yellow|orange|purple|pink|brown|black|white|gray|grey|gold|silver|cyan|magenta"
SUBSTANCES_SQL = "metal|metallic|wood|wooden|glass|plastic|leather|fabric|stone|marble|ceramic|rubber|paper|cardboard|clay|porcelain|steel|iron|copper|bronze|gold|silver"
VERBS_SQL = "turn|raise|lift|extend|bend|lean|tilt|wave|jump|run|walk|sit|stand|look|reach|kneel|crouch|stretch|nod|point|hold|grab|push|pull|step|dance|throw|catch|climb"
RELATIONS_SQL = "on|in|at|under|beneath|below|above|beside|near|next to|left of|right of|in front of|behind|between|attached to|held by|worn by|around"
CLAUSE_SQL = r"(?:[.;]|,\s*(?:while|preserv(?:e|ing)|keep(?:ing)?|without|but)\b|$)"


def clean(x: str) -> str:
    return rf"nullif(regexp_replace(trim({x}), '\s+', ' ', 'g'), '')"


def article(x: str) -> str:
    return rf"nullif(trim(regexp_replace({clean(x)}, '^(?:only\s+)?(?:a|an|the|any|new)\s+', '', 'i')), '')"


def end(x: str) -> str:
    return rf"nullif(trim(regexp_replace({clean(x)}, '\s*[.;,]\s*$', '')), '')"


def tail(x: str) -> str:
    """An object's name without what an instruction adds after it."""
    y = rf"regexp_replace({end(article(x))}, '\s+(?:reading|labeled|labelled|saying|with\s+text(?:\s+reading)?)\s+[''\"].*$', '', 'i')"
    for pattern in (
        r"\s+[''\"].*$", r"\s+(?:completely|fully|entirely)\s+(?:and\s+)?(?:fill|inpaint|replace|remove|erase)\b.*$", r"\s+(?:and|then)\s+(?:fill|inpaint|replace|preserve|keep)\b.*$",
        r"\s+(?:while|but|without)\s+.*$", r"\s+(?:completely|fully|entirely)$", r"\s+(?:from|in)\s+(?:the\s+)?(?:image|scene|photo|picture)$",
    ):
        y = f"trim(regexp_replace({y}, '{pattern}', '', 'i'))"
    return f"nullif({y}, '')"


def split_sql(name: str, of: str, x: str) -> str:
    """CTEs: the object before a relation and the region from there on."""
    pattern = rf"^(.*?)\s+({RELATIONS_SQL})\s+(.+)$"
    return f"""
    {name}1 AS (SELECT *, {tail(x)} AS cut FROM {of}),
    {name}2 AS (SELECT *, trim(regexp_extract(cut, '{pattern}', 1, 'i')) AS own, trim(regexp_extract(cut, '{pattern}', 2, 'i')) AS rel, trim(regexp_extract(cut, '{pattern}', 3, 'i')) AS anchor FROM {name}1),
    {name} AS (SELECT * EXCLUDE (own, rel, anchor), CASE WHEN own <> '' AND anchor <> '' AND len(regexp_split_to_array(own, '\\s+')) <= 8 THEN own ELSE cut END AS obj,
                CASE WHEN own <> '' AND anchor <> '' AND len(regexp_split_to_array(own, '\\s+')) <= 8 THEN rel || ' ' || anchor END AS place FROM {name}2)"""


ONE_SOURCE = {
    "color_change": (r"\bchange\s+(?:the\s+)?(?:color|colour)\s+of\s+(.+?)\s+(?:to|into|from)\b", rf"\bchange\s+(.+?)\s+(?:to|into)\s+(?:{COLORS_SQL})\b", rf"\bmake\s+(.+?)\s+(?:{COLORS_SQL})\b"),
    "material_change": (
        r"\bchange\s+(?:the\s+)?(?:material|texture)\s+of\s+(.+?)\s+(?:to|into)\b", r"\bchange\s+(.+?)\s+material\s+(?:to|into)\b",
        rf"\bchange\s+(?:the\s+)?(.+?)\s+to\s+(?:look|appear)\s+(?:like\s+|as\s+|made\s+of\s+|made\s+from\s+)?(?:{SUBSTANCES_SQL})\b",
        r"\bchange\s+(?:the\s+)?(.+?)\s+to\s+(?:a\s+|an\s+|the\s+)?(?:shiny\s+|matte\s+|glossy\s+|rough\s+|smooth\s+|polished\s+|brushed\s+|woven\s+|transparent\s+|metallic\s+)*(?:metallic\s+|wooden\s+|glass\s+|plastic\s+|leather\s+|fabric\s+|stone\s+|marble\s+|ceramic\s+|rubber\s+|paper\s+|cardboard\s+|clay\s+|porcelain\s+|steel\s+|iron\s+|copper\s+|bronze\s+|gold\s+|silver\s+)?(?:material|texture|surface|finish)\b",
        r"\bchange\s+(?:the\s+)?(.+?)\s+to\s+(?:look|appear)\s+(?:like|as)\b", r"\bmake\s+(.+?)\s+(?:look|appear)\s+(?:like\s+)?(?:metal|metallic|wood|wooden|glass|plastic|leather|fabric|stone|marble|ceramic|rubber)\b",
        r"\bmake\s+(.+?)\s+(?:look|appear)\s+(?:like\s+|as\s+|made\s+of\s+|made\s+from\s+)?(?:paper|cardboard|clay|porcelain|steel|iron|copper|bronze|gold|silver)\b",
    ),
    "local_enhancement": (
        r"\benhance\s+(?:the\s+)?(?:detail|details|clarity|texture|textures|sharpness|color|colour|appearance)(?:\s+and\s+\w+)*\s+of\s+(.+?)(?:[.;,]|$|\s+while\b|\s+without\b)",
        r"\bsharpen\s+(?:the\s+)?(.+?)(?:[.;,]|$|\s+while\b|\s+without\b)", r"\benhance\s+(?:the\s+)?(.+?)(?:[.;,]|$|\s+while\b|\s+without\b)",
    ),
    "spatial_move": (
        r"\bmove\s+(?:the\s+)?(.+?)\s+(?:slightly|a\s+bit|somewhat|to|toward|towards|left|right|forward|backward|up|down|higher|lower|closer|farther|further|onto|into|on|in|along|from)\b",
        r"\brelocate\s+(?:the\s+)?(.+?)\s+(?:to|toward|towards|onto|into|on|in|near|beside|left|right|above|below)\b",
    ),
    "subject_extraction": (
        r"\b(?:extract|isolate|cut out|separate)\s+(?:the\s+)?(.+?)\s+(?:from|and|onto|on|with|while|$)", r"\bremove\s+(?:the\s+)?background\s+(?:around|behind)\s+(?:the\s+)?(.+?)(?:[.;,]|$|\s+while\b)",
        r"\bmake\s+(?:the\s+)?(.+?)\s+(?:isolated|stand alone|standalone)(?:[.;,]|$|\s+while\b)",
    ),
}
REPLACED = tuple(rf"\b{verb}\s+(.+?)\s+{word}\s+(.+?){CLAUSE_SQL}" for verb, word in (("replace", "with"), ("change", "(?:into|to)"), ("turn", "into")))
ADDED = rf"\b(?:add|insert|place|put)\s+(.+?)(?:\s+(next to|left of|right of|in front of|behind|above|below|under|beneath|near|beside|onto|on|into|in|to)\s+(.+?))?{CLAUSE_SQL}"
ACTED = (rf"\b(?:make|have)\s+(?:the\s+)?(.+?)\s+(?:{VERBS_SQL})\b", r"^\s*(?:raise|lift|extend|bend|move|turn|tilt)\s+(?:the\s+)?(.+?)(?:''s|’s)\s+(?:(?:left|right)\s+)?(?:arm|hand|leg|head)\b")
REMOVED = r"\b(?:remove|delete|erase|get rid of|take out)\s+(.+)$"
COMPOSED = r"\b(?:remove|delete|erase)\s+(?:the\s+)?(.+?)\s*(?:,?\s+and\b|,|\.|$)"
TEMPLATE_ROWS = ", ".join(f"('{kind}', {k}, '{p}')" for kind, patterns in ONE_SOURCE.items() for k, p in enumerate(patterns))
GENERIC_SQL = "['area', 'background', 'color', 'colour', 'detail', 'image', 'material', 'object', 'part', 'region', 'scene', 'section', 'thing', 'texture']"


def got(pattern: str, group: int = 1) -> str:
    return f"nullif(trim(regexp_extract(trim(instruction), '{pattern}', {group}, 'i')), '')"


SLOTS = rf"""
    {INSTRUCTIONS}, knd AS (SELECT *, {KIND_SQL} AS kind FROM ins), tpl(kind, ord, pattern) AS (VALUES {TEMPLATE_ROWS}),
    one AS (SELECT id, ord, nullif(trim(regexp_extract(trim(instruction), pattern, 1, 'i')), '') AS raw FROM knd JOIN tpl USING (kind)),
    bare AS (SELECT id, ord, trim(regexp_replace(trim(regexp_replace({end("raw")}, '^(?:the\s+)?(?:color|colour|material|texture|textures|appearance|detail|details|clarity|sharpness)\s+of\s+', '', 'i')),
               '\s+(?:while|without|but|so that|and\s+(?:keep|preserve|maintain))\b.*$', '', 'i')) AS raw FROM one WHERE raw IS NOT NULL),
    {split_sql("spl", "bare", "raw")},
    nam AS (SELECT id, ord, place, {end("regexp_replace(" + article("obj") + r", '\b(?:slightly|somewhat|more|less|very|extra)\b', ' ', 'ig')")} AS name FROM spl),
    val AS (SELECT * FROM nam WHERE len(regexp_extract_all(lower(name), '[a-z0-9]+')) BETWEEN 1 AND 8 AND len(list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda w: NOT list_contains({GENERIC_SQL}, w))) > 0),
    fst AS (SELECT id, arg_min(name, ord) AS name, min(ord) AS ord FROM val GROUP BY id),
    fit AS (SELECT fst.id, fst.name, val.place FROM fst JOIN val ON fst.id = val.id AND fst.ord = val.ord),
    rem AS (SELECT id, {end(got(REMOVED))} AS told FROM knd WHERE kind = 'object_removal'),
    rms AS (SELECT id, regexp_replace(told, '\s+from\s+(.+)$', '', 'i') AS raw, {clean(r"regexp_extract(told, '\s+from\s+(.+)$', 1, 'i')")} AS rest FROM rem),
    {split_sql("rsp", "rms", "raw")},
    rnm AS (SELECT id, nullif({clean("regexp_replace(" + tail("obj") + r", '\b(?:cleanly|naturally|visible|unchanged|removed|filled|surrounding)\b', ' ', 'ig')")}, '') AS name, coalesce({tail("coalesce(rest, place)")}, rest, place) AS place FROM rsp),
    two AS (SELECT id, CASE {" ".join(f"WHEN {got(p)} IS NOT NULL THEN {article(got(p))}" for p in REPLACED)} END AS src, CASE {" ".join(f"WHEN {got(p)} IS NOT NULL THEN {article(got(p, 2))}" for p in REPLACED)} END AS tgt FROM knd WHERE kind = 'object_replacement'),
    adn AS (SELECT id, {end(article(got(ADDED)))} AS tgt, {got(ADDED, 2)} || ' ' || {end(got(ADDED, 3))} AS place FROM knd WHERE kind = 'object_addition'),
    act AS (SELECT id, CASE {" ".join(f"WHEN {got(p)} IS NOT NULL THEN {article(got(p))}" for p in ACTED)} END AS src FROM knd WHERE kind = 'action_change'),
    cmp AS (SELECT id, {article(end(got(COMPOSED)))} AS src FROM knd WHERE kind = 'compose'),
    slo AS (SELECT knd.id, knd.instruction, knd.kind AS edit_type, coalesce(fit.name, CASE WHEN rnm.name IS NOT NULL AND NOT regexp_matches(lower(rnm.name), 'fill the area|area naturally|surrounding|unchanged') THEN rnm.name END, two.src, act.src, cmp.src) AS source_object,
               coalesce(two.tgt, adn.tgt) AS target_object, coalesce(fit.place, rnm.place, adn.place, act.src) AS target_region
            FROM knd LEFT JOIN fit USING (id) LEFT JOIN rnm USING (id) LEFT JOIN two USING (id) LEFT JOIN adn USING (id) LEFT JOIN act USING (id) LEFT JOIN cmp USING (id))"""


@query(f"WITH {SLOTS} SELECT id, edit_type, source_object, target_object, target_region FROM slo")
def instruction_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.slots(instructions(spark, sf_dir), "instruction", "family").select("id", "edit_type", "source_object", "target_object", "target_region")


PHRASE_SQL = r"""CASE WHEN lower(r) = 'main visible target' THEN 'in the target region'
    WHEN regexp_matches(lower(r), '^(?:on|above|below|under|beneath|beside|near|next to|left of|right of|in front of|behind|between|attached to|held by|worn by|around|at|in) ') THEN r ELSE 'at ' || r END"""
MENTION_SQL = "list_filter(regexp_extract_all(lower(s), '[a-z0-9]+'), lambda w: NOT list_contains(['a', 'an', 'the', 'any', 'new', 'old', 'original'], w))"
ANCHOR_SQL = "regexp_matches(' ' || lower(r0) || ' ', ' (?:on|above|below|under|beneath|beside|near|next to|left of|right of|in front of|behind|between|attached to|held by|worn by|around|at the|in the) ')"


@query(rf"""
    WITH {SLOTS},
    owned AS (SELECT id, edit_type AS kind, target_object AS t, target_region AS told, regexp_replace(source_object, '(?:''s|’s)$', '') AS s, instruction FROM slo),
    -- a second look at a removal's object and place, which the slots have cleaned already, changes nothing in these rows
    gone AS (SELECT *, coalesce(told, CASE WHEN kind = 'subject_extraction' THEN s END, 'main visible target') AS r0 FROM owned),
    region AS (SELECT *, CASE WHEN kind IN ('object_replacement', 'object_removal') AND s IS NOT NULL AND len({MENTION_SQL}) > 0 AND list_has_all(regexp_extract_all(lower(r0), '[a-z0-9]+'), {MENTION_SQL}) AND NOT {ANCHOR_SQL}
                 THEN coalesce(told, CASE WHEN kind = 'object_removal' THEN 'the original location' ELSE 'the same location' END) ELSE r0 END AS r FROM gone),
    said AS (SELECT *, {PHRASE_SQL} AS att, coalesce(s, r) AS loc, coalesce(s, 'the main subject') AS actor,
               CASE WHEN kind = 'subject_extraction' AND s IS NOT NULL THEN 'Keep only the ' || s || '; remove the original surrounding scene and place the ' || s || ' centered on a clean plain white background while preserving its shape, identity, viewpoint, and boundary details.' ELSE instruction END AS i FROM region),
    checks AS (SELECT *, CASE kind
        WHEN 'object_replacement' THEN [t || ' is visible ' || att] WHEN 'object_addition' THEN [t || ' has been added ' || att] WHEN 'object_removal' THEN ['the area ' || att || ' is cleanly filled after removing ' || s]
        WHEN 'subject_extraction' THEN ['only ' || s || ' remains visible', s || ' is centered on a clean plain white or neutral background']
        WHEN 'action_change' THEN [actor || ' is performing the new pose or action described in the instruction'] WHEN 'compose' THEN ['all requested changes are applied: ' || left(i, 160)]
        WHEN 'global_adjustment' THEN [CASE WHEN contains(lower(i), 'saturation') THEN CASE WHEN regexp_matches(lower(i), 'reduce|decrease|lower|less') THEN 'image has reduced color saturation' ELSE 'image has stronger color saturation' END
            WHEN contains(lower(i), 'contrast') THEN CASE WHEN regexp_matches(lower(i), 'soften|reduce|decrease|lower|less') THEN 'image has softer contrast' ELSE 'image has stronger contrast' END
            WHEN regexp_matches(lower(i), 'brighter|brighten') THEN 'image is brighter' WHEN regexp_matches(lower(i), 'darker|darken') THEN 'image is darker' WHEN contains(lower(i), 'warmer') THEN 'image has a warmer tone' WHEN contains(lower(i), 'cooler') THEN 'image has a cooler tone' END]
        ELSE [] END AS req, CASE kind
        WHEN 'object_replacement' THEN [s || ' remains visible ' || att, 'a separate ' || s || ' remains visible ' || att] WHEN 'object_removal' THEN [s || ' remains visible ' || att] WHEN 'object_addition' THEN [t || ' is absent ' || att]
        WHEN 'subject_extraction' THEN ['the original surrounding scene remains around ' || s, 'other original scene objects remain around ' || s, s || ' is cropped away, deformed, or missing boundary parts']
        WHEN 'background_change' THEN ['the original background remains unchanged'] WHEN 'local_enhancement' THEN [loc || CASE WHEN suffix(lower(loc), 's') THEN ' remain' ELSE ' remains' END || ' blurry or unchanged']
        WHEN 'style_transfer' THEN ['the image remains in the original visual style'] WHEN 'action_change' THEN [actor || CASE WHEN suffix(lower(actor), 's') THEN ' remain' ELSE ' remains' END || ' in the original pose with no action change']
        WHEN 'compose' THEN ['the image is unchanged or only one of the requested changes is applied'] ELSE [] END AS forb FROM said)
    SELECT id, kind AS edit_type, s AS source_object, t AS target_object, r AS target_region, array_to_string(list_filter(req, lambda x: x IS NOT NULL), ' | ') AS required_after, array_to_string(list_filter(forb, lambda x: x IS NOT NULL), ' | ') AS forbidden_after,
           CASE kind WHEN 'subject_extraction' THEN 'subject boundary detail | ' || coalesce(s, 'subject') || ' pose and shape | ' || coalesce(s, 'subject') || ' identity | camera viewpoint | lighting consistency'
                ELSE 'background | scene layout | camera viewpoint | lighting consistency | unrelated objects' END AS preserve
    FROM checks
""")
def structured_edit_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edits.normalized(instructions(spark, sf_dir), "instruction", "family")
    return out.select("id", "edit_type", "source_object", "target_object", "target_region", *(F.array_join(n, " | ").alias(n) for n in ("required_after", "forbidden_after", "preserve")))


@query()
def proposal_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edits.definitions(edits.normalized(instructions(spark, sf_dir), "instruction", "family"))
    return out.select("id", "operation_id", "scope", s.round6(F.col("lo")).alias("lo"), s.round6(F.col("hi")).alias("hi"))


# ---- eligibility, over edits put together from lists

CHOICES = {
    "edit_type": (53, ("attribute_change", "color_change", "material_change", "object_replacement", "object_removal", "object_addition", "spatial_move", "style_transfer", "background_change", "global_adjustment", "local_enhancement", "subject_extraction", "compose", "action_change")),
    "source_object": (61, ("", "small cup", "the wall", "wooden floor", "old dog", "toy car", "woman face", "price tag", "red chair", "''stop'' cup", "bench", "thing", "cup that we remove ", "one two three four five six seven eight nine")),
    "target_object": (67, ("", "green cup", "bench", "park bench", "lamp beside", "dog", "mug", "a vase", "item")),
    "target_region": (71, ("", "on the bench", "main visible target", "the whole image", "background behind the cup", "near the tree", "upper left corner", "table", "on the cup", "Fill the area naturally", "whole scene", "image contrast zone")),
    "instruction": (73, ("Change the color to red", "Replace the cup with a mug", "Replace the background with a beach", "Transfer the wood to the cup", "Make it metal", "Apply a watercolor style to the whole image", "Remove the sofa from the room", "Say “hi” there", "Set the mood", "Boost the overall contrast", "It is the dog''s bed")),
    "source_attribute": (79, ("", "red", "wooden", "closed", "original glassy material")),
    "target_attribute": (83, ("", "different", "blue", "open", "wood", "glass", "another shade")),
    "source_material": (89, ("", "wood", "glassy", "steel")),
    "target_material": (101, ("", "the wooden texture", "glass", "rubber")),
    "forbidden": (103, ("no cup", "the cup is absent", "dog remains", "green cup is missing", "lamp is ''off''", "old background remains", "no other objects", "original")),
    "required": (107, ("cup is there", "background changed", "made of glass", "green cup on the bench")),
    "kept": (109, ("main subject", "")),
}
EDITS = "edits AS (SELECT id, " + ", ".join(f"([{', '.join(chr(39) + v + chr(39) for v in values)}])[CAST((id * {p}) // 97 % {len(values)} + 1 AS BIGINT)] AS {name}" for name, (p, values) in CHOICES.items()) + " FROM (SELECT p_partkey * 5 + r_regionkey AS id FROM part, region))"


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = a.table(spark, sf_dir, "part").select("p_partkey").join(F.broadcast(a.table(spark, sf_dir, "region").select("r_regionkey")))
    ids = ids.select((F.col("p_partkey") * 5 + F.col("r_regionkey")).alias("id")).repartition(spark.sparkContext.defaultParallelism)

    def chosen(p: int, values: tuple[str, ...]) -> Column:
        return F.element_at(F.array(*(F.lit(v.replace("''", "'")) for v in values)), (F.expr(f"id * {p} div 97") % len(values) + 1).cast("int"))

    out = ids.select("id", *(chosen(p, values).alias(name) for name, (p, values) in CHOICES.items()))
    lists = {n: F.array(F.col(c)) for n, c in (("forbidden_after", "forbidden"), ("required_after", "required"))}
    return out.withColumns(lists | {"preserve": F.filter(F.array("kept"), lambda x: x != "")})


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def head_sql(x: str, modifiers: str) -> str:
    return f"coalesce(list_filter({tokens_sql(x)}, lambda w: NOT list_contains([{modifiers}], w))[-1], '')"


def state_sql(x: str) -> str:
    plain = "CASE w WHEN 'glassy' THEN 'glass' WHEN 'metallic' THEN 'metal' WHEN 'rubbery' THEN 'rubber' WHEN 'wooden' THEN 'wood' ELSE w END"
    stop = "['a', 'an', 'and', 'appearance', 'current', 'existing', 'material', 'original', 'state', 'the', 'texture']"
    return f"list_sort(list_distinct(list_transform(list_filter({tokens_sql(x)}, lambda w: NOT list_contains({stop}, w)), lambda w: {plain})))"


def overlap_sql(x: str, y: str) -> str:
    a_, b_ = (f"regexp_extract_all(lower({v}), '[a-z0-9]{{3,}}')" for v in (x, y))
    return f"(len({a_}) > 0 AND len({b_}) > 0 AND (list_has_any({a_}, {b_}) OR contains(lower({x}), lower({y})) OR contains(lower({y}), lower({x}))))"


MODIFIERS_SQL = "'a', 'an', 'the', 'this', 'that', 'these', 'those', 'small', 'large', 'big', 'tiny', 'main', 'visible', 'wooden', 'metal', 'stone', 'glass', 'left', 'right', 'upper', 'lower', 'top', 'bottom', 'center', 'centre', 'middle'"
HEADS_SQL = "'background', 'foreground', 'sky', 'wall', 'floor', 'ceiling', 'ground', 'road', 'street', 'sidewalk', 'pavement', 'grass', 'lawn', 'water', 'ocean', 'sea', 'room', 'scene', 'image', 'photo', 'picture', 'landscape', 'porch', 'deck', 'patio', 'driveway', 'path', 'hallway', 'corridor', 'facade', 'exterior', 'interior'"
TEXTS_SQL = "['text', 'texts', 'word', 'words', 'letter', 'letters', 'writing', 'caption', 'captions', 'character', 'characters', 'label', 'labels', 'tag', 'tags', 'sticker', 'stickers', 'barcode', 'barcodes', 'logo', 'logos', 'poster', 'posters', 'sign', 'signs', 'cover', 'covers', 'book', 'books', 'comic', 'comics', 'price']"
HUMANS_SQL = "['person', 'people', 'human', 'man', 'woman', 'girl', 'boy', 'child', 'children', 'baby', 'face', 'head', 'body', 'skier', 'rider', 'cyclist', 'driver', 'player', 'worker', 'athlete', 'surfer', 'dancer']"
BEASTS_SQL = "['dog', 'cat', 'animal', 'bird', 'horse', 'cow', 'sheep', 'rabbit', 'fish', 'vehicle', 'car', 'truck', 'bus', 'motorcycle', 'bicycle', 'bike']"
TOYS_SQL = "['toy', 'model', 'miniature', 'figurine', 'plush', 'stuffed', 'doll']"
QUOTE_SQL = "[\"“”‘’]|(?:^|\\s)''|''(?:$|\\s)"
GLOBAL_SQL = "entire image|whole image|overall image|full image|global image"
ADJUST_SQL = "overall contrast|image contrast|global contrast|overall brightness|image brightness|global brightness|overall exposure|image exposure|global exposure|overall saturation|image saturation|global saturation"
ANCHORED_SQL = "regexp_matches(' ' || lower({0}) || ' ', ' (?:on|above|below|under|beneath|beside|near|next to|left of|right of|in front of|behind|between|attached to|held by|worn by|around|at|in) |upper |lower |top |bottom |left |right |center|centre|middle|corner|edge|foreground|background')"
VAGUE_SQL = r"(ta = '' OR regexp_matches(lower(ta), '^(?:another|different|new|other) ') OR lower(ta) IN ('altered', 'alternative', 'changed', 'different', 'enhanced', 'improved', 'new', 'other', 'something else'))"


def reason_sql(strict: bool) -> str:
    x = "true" if strict else "false"
    return rf"""CASE
        WHEN regexp_matches(forb, '^\s*(?:no|not|without)\b', 'i') THEN 'proposal_forbidden_after_negative_sentence'
        WHEN regexp_matches(i, '{QUOTE_SQL}') OR regexp_matches(s, '{QUOTE_SQL}') OR regexp_matches(t, '{QUOTE_SQL}') OR regexp_matches(r, '{QUOTE_SQL}') OR regexp_matches(req, '{QUOTE_SQL}') OR regexp_matches(forb, '{QUOTE_SQL}') THEN 'proposal_contains_quoted_visible_text'
        WHEN list_has_any({tokens_sql("s")}, {TEXTS_SQL}) THEN 'proposal_source_object_is_text_like'
        WHEN k = 'attribute_change' AND {x} AND sa = '' THEN 'proposal_attribute_source_state_missing'
        WHEN k = 'attribute_change' AND {x} AND ta = '' THEN 'proposal_attribute_target_state_missing'
        WHEN k = 'attribute_change' AND {x} AND {VAGUE_SQL} THEN 'proposal_attribute_target_state_vague'
        WHEN k = 'attribute_change' AND {x} AND len({state_sql("sa")}) > 0 AND {state_sql("sa")} = {state_sql("ta")} THEN 'proposal_attribute_state_unchanged'
        WHEN k = 'attribute_change' AND regexp_matches(lower(CASE WHEN sa <> '' AND ta <> '' THEN sa || ' ' || ta ELSE i || ' ' || ta END), '\b(?:black|blue|brown|color|colour|cyan|gray|green|grey|magenta|orange|pink|purple|red|white|yellow)\b') THEN 'proposal_attribute_change_is_color_edit'
        WHEN k = 'color_change' AND {x} AND sa = '' THEN 'proposal_color_source_state_missing'
        WHEN k = 'color_change' AND {x} AND ta = '' THEN 'proposal_color_target_state_missing'
        WHEN k = 'color_change' AND {x} AND len({state_sql("sa")}) > 0 AND {state_sql("sa")} = {state_sql("ta")} THEN 'proposal_color_state_unchanged'
        WHEN k IN ('attribute_change', 'color_change', 'material_change', 'object_replacement', 'object_removal', 'object_addition', 'spatial_move', 'local_enhancement') AND regexp_matches(lower(i || ' ' || r), '{GLOBAL_SQL}|{ADJUST_SQL}') THEN 'proposal_local_edit_is_global_adjustment'
        WHEN k = 'background_change' AND NOT regexp_matches(lower(i || ' ' || r || ' ' || req), 'background|backdrop|environment|surroundings|surrounding scene|scene behind|behind the') THEN 'proposal_background_change_missing_background_target'
        WHEN k = 'background_change' AND r <> '' AND NOT regexp_matches(lower(r), 'background|backdrop|environment|surroundings|surrounding scene|scene behind|behind the') THEN 'proposal_background_change_target_region_not_background'
        WHEN k = 'background_change' AND regexp_matches(i, '\b(?:replace|remove|add)\s+(?:the\s+|a\s+|an\s+)?(.+?)(?:\s+with\b|\s+from\b|\s+to\b|[.;,]|$)', 'i')
             AND NOT regexp_matches(lower(regexp_extract(i, '\b(?:replace|remove|add)\s+(?:the\s+|a\s+|an\s+)?(.+?)(?:\s+with\b|\s+from\b|\s+to\b|[.;,]|$)', 1, 'i')), 'background|backdrop|environment|surroundings|surrounding scene|scene behind|behind the') THEN 'proposal_background_change_is_object_edit'
        WHEN k = 'background_change' AND kept = '' THEN 'proposal_background_change_missing_preserve_list'
        WHEN k = 'style_transfer' AND r <> '' AND NOT regexp_matches(lower(r), '{GLOBAL_SQL}|whole scene|full scene|scene layout') THEN 'proposal_style_transfer_target_region_not_global'
        WHEN k = 'style_transfer' AND regexp_matches(i, '\btransfer\s+the\s+.+\s+to\s+(?:the\s+)?\w+', 'i') THEN 'proposal_style_transfer_object_to_object_texture'
        WHEN k = 'style_transfer' AND NOT regexp_matches(lower(i || ' ' || r || ' ' || req), '{GLOBAL_SQL}|whole scene|full scene|scene layout|style|stylized|filter') THEN 'proposal_style_transfer_missing_style_contract'
        WHEN k = 'style_transfer' AND kept = '' THEN 'proposal_style_transfer_missing_preserve_list'
        WHEN bounded AND s = '' THEN 'proposal_local_target_missing_source_object'
        WHEN bounded AND broad THEN 'proposal_local_target_broad_head:' || head
        WHEN k = 'material_change' AND {x} AND sm = '' THEN 'proposal_material_source_state_missing'
        WHEN k = 'material_change' AND {x} AND tm = '' THEN 'proposal_material_target_state_missing'
        WHEN k = 'material_change' AND {x} AND len({state_sql("sm")}) > 0 AND {state_sql("sm")} = {state_sql("tm")} THEN 'proposal_material_state_unchanged'
        WHEN k = 'material_change' AND NOT material AND regexp_matches(told, '\b(?:black|blue|brown|color|colour|cyan|gold|gray|green|grey|magenta|orange|pink|purple|red|silver|white|yellow)\b') THEN 'proposal_material_change_is_color_edit'
        WHEN k = 'material_change' AND NOT material THEN 'proposal_material_change_missing_material'
        WHEN k = 'spatial_move' AND s = '' THEN 'proposal_spatial_source_object_missing'
        WHEN k = 'spatial_move' AND broad THEN 'proposal_spatial_target_broad_head:' || head
        WHEN k = 'spatial_move' AND (list_has_any({tokens_sql("s")}, {HUMANS_SQL}) OR list_has_any({tokens_sql("s")}, {BEASTS_SQL}) AND NOT list_has_any({tokens_sql("s")}, {TOYS_SQL})) THEN 'proposal_spatial_target_fragile_or_main_subject'
        WHEN k = 'action_change' AND s = '' THEN 'proposal_action_source_object_missing'
        WHEN k IN ('object_removal', 'object_replacement') AND s = '' THEN 'proposal_source_object_missing'
        WHEN k = 'object_addition' AND t = '' THEN 'proposal_target_object_missing'
        WHEN k = 'object_addition' AND regexp_matches(lower(t), '\b(next|left|right|above|below|under|beneath|near|beside|behind)$') THEN 'proposal_target_object_contains_relation_tail'
        WHEN k = 'object_addition' AND len(regexp_extract_all(lower(t), '[a-z0-9]{{3,}}')) > 0 AND len(list_filter(regexp_extract_all(lower(t), '[a-z0-9]{{3,}}'), lambda w: contains(lower(forb), w))) = 0 THEN 'proposal_addition_forbidden_missing_target_object'
        WHEN k = 'object_addition' AND NOT regexp_matches(lower(forb), 'absent|missing|not present|not visible|does not appear|fails to appear|duplicat|implausib|occlud|wrong location|wrong region') THEN 'proposal_addition_forbidden_not_failure_state'
        WHEN k = 'object_replacement' AND regexp_matches(lower(s || ' ' || r), 'background|backdrop|environment|surroundings|surrounding scene|scenery') THEN 'proposal_replacement_targets_background'
        WHEN k = 'object_replacement' AND t = '' THEN 'proposal_target_object_missing'
        WHEN k = 'object_replacement' AND lower(t) = lower(s) THEN 'proposal_replacement_same_as_source'
        WHEN k = 'object_replacement' AND {overlap_sql("t", "s")} THEN 'proposal_replacement_overlaps_source'
        WHEN k = 'object_replacement' AND {x} AND own <> '' AND list_contains(regexp_extract_all(lower(r), '\b(?:on|inside|in|under|beneath|above|below)\s+(?:the\s+|a\s+|an\s+)?([a-z0-9]+)\b', 1), own) THEN 'proposal_replacement_region_uses_source_as_anchor'
        WHEN k IN ('object_removal', 'object_replacement', 'object_addition') AND (s = '' OR broad) AND lower(r) IN ('', 'main visible target', 'original location', 'the original location', 'same location', 'the same location', 'target region', 'the target region') THEN 'proposal_target_region_generic'
        WHEN k IN ('object_removal', 'object_replacement', 'object_addition') AND (s = '' OR broad) AND NOT {ANCHORED_SQL.format("r")} THEN 'proposal_target_region_missing_anchor' END"""


NAMED = rf"""{EDITS}, e AS (SELECT *, edit_type AS k, trim(source_object) AS s, target_object AS t, target_region AS r, instruction AS i, source_attribute AS sa, target_attribute AS ta, source_material AS sm, target_material AS tm, forbidden AS forb, required AS req FROM edits),
    h AS (SELECT *, k IN ('attribute_change', 'color_change', 'material_change', 'local_enhancement') AS bounded, {head_sql("s", MODIFIERS_SQL)} AS head, {head_sql("s", "'a', 'an', 'the', 'small', 'large', 'big', 'tiny', 'white', 'black', 'red', 'green', 'blue', 'round', 'square'")} AS own, lower(i || ' ' || req || ' ' || tm) AS told FROM e),
    b AS (SELECT *, head IN ({HEADS_SQL}) AS broad, regexp_matches(told, '\b(?:bronze|cardboard|ceramic|clay|concrete|copper|cotton|fabric|fur|glass|gold|iron|leather|marble|metal|metallic|paper|plastic|porcelain|rubber|silk|silver|stone|steel|wool|wood|wooden)\b') AS material FROM h)"""


@query(f"WITH {NAMED} SELECT id, edit_type, {reason_sql(False)} AS reason, {reason_sql(True)} AS strict_reason FROM b")
def proposal_contract_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligibility of each edit, without and with the demand for explicit states."""
    e = structured(spark, sf_dir)
    return e.select("id", "edit_type", contract.eligibility_reason(e.columns).alias("reason"), contract.eligibility_reason(e.columns, explicit_states=True).alias("strict_reason"))


def slot_sql(x: str, field: str, guard: str = "true") -> str:
    return rf"""
        WHEN {guard} AND {x} = '' THEN 'contract_{field}_missing'
        WHEN {guard} AND lower({x}) IN ('object', 'item', 'thing', 'area', 'region', 'target', 'main visible target', 'original location', 'same location', 'mug') THEN 'contract_{field}_generic'
        WHEN {guard} AND regexp_matches({x}, '{QUOTE_SQL}') THEN 'contract_{field}_contains_quoted_text'
        WHEN {guard} AND regexp_matches(lower({x}), 'fill the area|area naturally|cleanly filled|after removing|remains visible|remain visible|still visible|remove |delete |erase |replace |inpaint|preserve |unchanged|surrounding') THEN 'contract_{field}_action_phrase'
        WHEN {guard} AND len(regexp_extract_all({x}, '[\w-]+')) > 8 THEN 'contract_{field}_too_long'"""


@query(f"""
    WITH {NAMED} SELECT id, CASE WHEN k IN ('object_removal', 'object_replacement') THEN CASE {slot_sql("s", "source_object")} {slot_sql("t", "target_object", "k = 'object_replacement'")}
        WHEN k = 'object_replacement' AND lower(s) = lower(t) THEN 'contract_replacement_same_as_source'
        WHEN k = 'object_replacement' AND {overlap_sql("t", "s")} THEN 'contract_replacement_overlaps_source'
        WHEN regexp_matches(lower(r), 'fill the area|area naturally') THEN 'contract_target_region_action_phrase'
        WHEN k = 'object_removal' AND r <> '' AND NOT {ANCHORED_SQL.format("r")} THEN 'contract_target_region_missing_anchor'
        WHEN r = '' THEN 'contract_target_region_missing' END END AS reason FROM b
""")
def object_contract_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of removals and replacements that do not teach."""
    e = structured(spark, sf_dir)
    reason = contract.object_reason(e.columns, generic=("mug",), region_needed=True, anchor_needed={"object_removal": True, "object_replacement": False})
    return e.select("id", reason.alias("reason"))


CONTENT_SQL = "list_distinct(list_transform(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: NOT list_contains(['a', 'an', 'the', 'no', 'not', 'without', 'any', 'other', 'than', 'is', 'are', 'has', 'have', 'had', 'be', 'been', 'being', 'in', 'on', 'at', 'to', 'of', 'for', 'with', 'from', 'near', 'visible', 'remains', 'remain', 'still', 'added', 'add', 'new', 'small', 'large'], w)), lambda w: CASE WHEN length(w) > 3 AND suffix(w, 's') THEN left(w, length(w) - 1) ELSE w END))"


@query(rf"""
    WITH {EDITS}, x AS (SELECT id, edit_type, forbidden AS f, required || ' ' || target_object AS wanted FROM edits)
    SELECT id, regexp_matches(lower(f), 'no other|not other|any other|other objects|other background|unrelated objects|extra objects|additional objects') AS generic, regexp_matches(f, '^\s*(?:no|not|without)\b', 'i') AS negative,
           NOT regexp_matches(lower(f), 'no other|not other|any other|other objects|other background|unrelated objects|extra objects|additional objects')
             AND (regexp_matches(lower(f), '(?:original|old|previous|source|unchanged) (?:background|backdrop)|(?:original|old|previous|source) scene') OR regexp_matches(lower(f), 'background|backdrop|scenery|scene behind') AND regexp_matches(lower(f), 'remain|still|unchanged|same|visible')) AS background,
           lower(trim(f)) IN ('', 'old', 'original', 'current', 'previous', 'existing', 'source', 'old color', 'original color', 'current color', 'previous color', 'existing color', 'source color', 'old appearance', 'original appearance', 'current appearance', 'previous appearance', 'existing appearance') AS placeholder,
           edit_type IN ('object_addition', 'attribute_change', 'color_change', 'material_change', 'style_transfer', 'background_change') AND regexp_matches(lower(f), 'no |not |without |absent|missing') AND list_has_any({CONTENT_SQL.format("f")}, {CONTENT_SQL.format("wanted")}) AS contradictory
    FROM x
""")
def forbidden_text_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("forbidden")
    wanted = F.array("required", "target_object")
    return structured(spark, sf_dir).select("id", t.generic_forbidden(f).alias("generic"), t.negative_sentence(f).alias("negative"), t.background_failure(f).alias("background"), t.placeholder(f).alias("placeholder"), t.contradictory(f, F.col("edit_type"), wanted).alias("contradictory"))
