"""Text functions for instructions and structured edits, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must be as they are for equal results.
NULL_WORDS = ("none", "null", "n/a", "na", "not applicable", "unknown")
EDIT_TYPES = (
    "attribute_change", "color_change", "material_change", "object_replacement", "object_removal", "object_addition", "spatial_move",
    "style_transfer", "background_change", "global_adjustment", "local_enhancement", "subject_extraction", "compose", "action_change",
)
EDIT_ALIASES = {
    "replace": "object_replacement", "replacement": "object_replacement", "remove": "object_removal", "delete": "object_removal",
    "add": "object_addition", "insert": "object_addition", "move": "spatial_move", "relocate": "spatial_move", "color": "color_change",
    "colour_change": "color_change", "material": "material_change", "style": "style_transfer", "background": "background_change",
    "global": "global_adjustment", "local": "local_enhancement", "extract": "subject_extraction", "extraction": "subject_extraction",
    "isolate": "subject_extraction", "isolation": "subject_extraction", "cutout": "subject_extraction", "cut_out": "subject_extraction",
    "compound": "compose", "compound_edit": "compose", "multi_edit": "compose", "composite": "compose", "action": "action_change",
    "pose": "action_change", "pose_change": "action_change", "motion": "action_change",
}
RELATIONS = ("on", "in", "at", "under", "beneath", "below", "above", "beside", "near", "next to", "left of", "right of", "in front of", "behind", "between", "attached to", "held by", "worn by", "around")
ADJUSTMENTS = "increase|decrease|adjust|brighten|darken|saturat|contrast|warmer|cooler|blur|sharpen|brightness|exposure"
ACTIONS = "turn|raise|lift|bend|lean|tilt|wave|jump|run|walk|sit|stand|look|reach|kneel|crouch|stretch|nod|point|hold|grab|push|pull|step|dance|throw|catch|climb"
INSTRUCTION_WORDS = (
    (("extract ", "isolate ", "cut out ", "remove the background"), "subject_extraction"),
    (("replace ", "change the object", "turn the", "make the person into"), "object_replacement"),
    (("remove ", "delete ", "erase "), "object_removal"),
    (("add ", "insert ", "place a new"), "object_addition"),
    (("move ", "relocate ", "to the left", "to the right", "higher", "lower"), "spatial_move"),
    (("color", "colour", "red", "blue", "green", "yellow", "black", "white"), "color_change"),
    (("metal", "wood", "glass", "plastic", "denim", "leather"), "material_change"),
)
GENERIC_FORBIDDEN = ("no other", "not other", "any other", "other objects", "other background", "unrelated objects", "extra objects", "additional objects")
BACKGROUND_LEFT = (
    "original background", "old background", "previous background", "source background", "unchanged background", "original backdrop", "old backdrop", "previous backdrop", "source backdrop",
    "unchanged backdrop", "original scene", "old scene", "previous scene", "source scene", "original scenery", "old scenery",
)
BACKGROUND_NAMES, STAYS = ("background", "backdrop", "scenery", "scene behind"), ("remain", "still", "unchanged", "same", "visible")
PLACEHOLDERS = (
    "old", "original", "current", "previous", "existing", "source", "old color", "original color", "current color", "previous color", "existing color", "source color",
    "old appearance", "original appearance", "current appearance", "previous appearance", "existing appearance",
)
CONTENT_STOPWORDS = (
    "a", "an", "the", "no", "not", "without", "any", "other", "than", "is", "are", "has", "have", "had", "be", "been", "being", "in", "on", "at", "to", "of", "for", "with", "from", "near",
    "visible", "remains", "remain", "still", "added", "add", "new", "small", "large",
)
ABSENCE = ("no ", "not ", "without ", "absent", "missing")
CONTRADICTED_TYPES = ("object_addition", "attribute_change", "color_change", "material_change", "style_transfer", "background_change")
LEADING_ARTICLE = r"(?i)^(?:only\s+)?(?:a|an|the|any|new)\s+"
TERMINAL_PUNCTUATION = r"\s*[.;,]\s*$"
TEXT_LABEL = r"(?i)\s+(?:reading|labeled|labelled|saying|with\s+text(?:\s+reading)?)\s+['\"].*$"
QUOTED_TAIL = r"\s+['\"].*$"
OBJECT_TAILS = (
    r"(?i)\s+(?:completely|fully|entirely)\s+(?:and\s+)?(?:fill|inpaint|replace|remove|erase)\b.*$",
    r"(?i)\s+(?:and|then)\s+(?:fill|inpaint|replace|preserve|keep)\b.*$",
    r"(?i)\s+(?:while|but|without)\s+.*$",
    r"(?i)\s+(?:completely|fully|entirely)$",
    r"(?i)\s+(?:from|in)\s+(?:the\s+)?(?:image|scene|photo|picture)$",
)
STOPWORDS = ("the", "and", "with", "from", "into", "that", "this", "for", "are", "was", "its", "all", "any", "new", "while", "keep", "make")


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x evaluated once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def clean_text(x: Column, most: int = 160) -> Column:
    """Trimmed, runs of white space as one space, null words as null, cut at ``most`` characters."""
    trimmed, nothing = F.regexp_replace(x, r"^\s+|\s+$", ""), f"(?i)^(?:|{'|'.join(NULL_WORDS)})$"
    return let(trimmed, lambda t: F.when(~t.rlike(nothing), F.left(F.regexp_replace(t, r"\s+", " "), F.lit(most))))


def clean_items(items: Column, most: int = 8, length: int = 160) -> Column:
    """Items of a list: clean, without case-insensitive repeats, the first ``most``."""
    kept = F.filter(F.transform(items, lambda i: clean_text(i, length)), lambda i: i.isNotNull() & (i != ""))

    def step(acc: Column, i: Column) -> Column:
        return F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(i)), acc).otherwise(F.concat(acc, F.array(i)))

    return F.slice(F.aggregate(F.coalesce(kept, F.array().cast("array<string>")), F.array().cast("array<string>"), step), 1, most)


def clean_list(x: Column, most: int = 8, length: int = 160) -> Column:
    """Items of a text divided by ; or line ends, as ``clean_items``."""
    return clean_items(F.split(x, r"[;\n]"), most, length)


def strip_article(x: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(clean_text(x), LEADING_ARTICLE, "")), F.lit(""))


def strip_end(x: Column) -> Column:
    """Without punctuation at the end."""
    return F.nullif(F.trim(F.regexp_replace(clean_text(x), TERMINAL_PUNCTUATION, "")), F.lit(""))


def strip_label(x: Column) -> Column:
    """Without a quoted text that something is said to show."""
    t = F.regexp_replace(clean_text(x), TEXT_LABEL, "")
    return F.nullif(F.trim(F.regexp_replace(t, QUOTED_TAIL, "")), F.lit(""))


def trim_tail(x: Column) -> Column:
    """An object's name without what an instruction adds after it."""
    t = let(strip_article(x), lambda v: F.coalesce(strip_end(v), v))
    t = let(t, lambda v: F.coalesce(strip_label(v), v))
    for pattern in OBJECT_TAILS:
        t = F.trim(F.regexp_replace(t, pattern, ""))
    return F.nullif(t, F.lit(""))


def split_relation(x: Column, most_words: int = 8) -> Column:
    """struct(object, region): the text before a spatial relation, and the relation with its anchor."""
    pattern = rf"(?i)^(.*?)\s+({'|'.join(RELATIONS)})\s+(.+)$"

    def parts(t: Column) -> Column:
        found = F.struct(*(F.trim(F.regexp_extract(t, pattern, k)).alias(n) for k, n in ((1, "own"), (2, "relation"), (3, "anchor"))))
        good = lambda p: (p["own"] != "") & (p["anchor"] != "") & (F.size(F.split(p["own"], r"\s+")) <= most_words)
        return let(found, lambda p: F.struct(F.when(good(p), p["own"]).otherwise(t).alias("object"), F.when(good(p), F.concat_ws(" ", p["relation"], p["anchor"])).alias("region")))

    return let(trim_tail(x), parts)


def edit_type(x: Column, fallback: str | Column = "local_enhancement") -> Column:
    """The edit type that a name or an alias stands for."""
    t = F.translate(F.lower(clean_text(x, 64)), " -", "__")
    aliases = F.create_map(*(F.lit(v) for pair in EDIT_ALIASES.items() for v in pair))
    return let(t, lambda k: let(F.coalesce(F.try_element_at(aliases, k), k), lambda named: F.when(named.isin(*EDIT_TYPES), named).otherwise(fallback)))


def infer_edit_type(instruction: Column, family: Column) -> Column:
    """The edit type that an instruction seems to ask for; the first rule that fits."""
    return let(F.lower(instruction), lambda t: _infer(t, F.lower(F.coalesce(family, F.lit("")))))


def _infer(t: Column, f: Column) -> Column:
    out = F.when(f.isin("exposure", "contrast", "color", "tone"), "global_adjustment")
    out = out.when(t.rlike(rf"\b(?:remove|delete|erase)\b.*\b(?:and|then|,)\b.*\b(?:{ADJUSTMENTS})\b"), "compose")
    out = out.when(t.rlike(rf"\bmake\s+(?:the\s+)?.+?\b(?:{ACTIONS})\b"), "action_change")
    for words, kind in INSTRUCTION_WORDS:
        out = out.when(contains_any(t, words), kind)
    return out.when(f == "style", "style_transfer").when(f == "background", "background_change").otherwise("local_enhancement")


def contains_any(x: Column, words: tuple[str, ...]) -> Column:
    """Some of the words is in x; one pattern, since a long chain of conditions is slow to plan."""
    return x.rlike("|".join(rf"\Q{w}\E" for w in words))


def generic_forbidden(x: Column) -> Column:
    return contains_any(F.lower(x), GENERIC_FORBIDDEN)


def negative_sentence(x: Column) -> Column:
    return x.rlike(r"(?i)^\s*(?:no|not|without)\b")


def tokens(x: Column) -> Column:
    """Distinct words of more than two letters, without stop words, a plural s dropped."""
    words = F.filter(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))
    return F.array_distinct(F.transform(words, lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.left(w, F.length(w) - 1)).otherwise(w)))


def overlap(a: Column, b: Column) -> Column:
    return F.arrays_overlap(tokens(a), tokens(b))


def subset_of(a: Column, b: Column) -> Column:
    """All tokens of a are tokens of b."""
    return F.size(F.array_except(tokens(a), tokens(b))) == 0


def background_failure(x: Column) -> Column:
    """A failure of a change of background: it says that the old one is still there."""
    low = F.lower(x)
    told = contains_any(low, BACKGROUND_LEFT) | (contains_any(low, BACKGROUND_NAMES) & contains_any(low, STAYS))
    return ~generic_forbidden(x) & told


def placeholder(x: Column) -> Column:
    """A source descriptor that describes nothing."""
    low = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    return (low == "") | low.isin(*PLACEHOLDERS)


def content_words(x: Column) -> Column:
    """Words that tell something, a plural s dropped."""
    words = F.array_except(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), F.array(*map(F.lit, CONTENT_STOPWORDS)))
    return F.array_distinct(F.transform(words, lambda w: F.when((F.length(w) > 3) & w.endswith("s"), F.left(w, F.length(w) - 1)).otherwise(w)))


def contradictory(x: Column, kind: Column, wanted: Column) -> Column:
    """A failure text that denies what the edit wants: it tells of an absence, and shares a word with the wanted texts."""
    denies = kind.isin(*CONTRADICTED_TYPES) & contains_any(F.lower(x), ABSENCE)
    return denies & F.arrays_overlap(content_words(x), content_words(F.array_join(wanted, " ")))


def choice(key: Column, seed: int, salt: str, bank: list[str]) -> Column:
    """An element by (sum of the key's code points + seed + sum of the salt's) mod the bank's size."""
    points = F.aggregate(F.transform(F.split(key, ""), lambda c: F.ascii(c)), F.lit(0), lambda a, x: a + x)
    at = F.pmod(points + F.lit(seed + sum(map(ord, salt))), F.lit(len(bank)))
    return F.element_at(F.array(*map(F.lit, bank)), (at + 1).cast("int"))


def variant(index: Column, forms: list[Column]) -> Column:
    return F.element_at(F.array(*forms), (F.pmod(index, F.lit(len(forms))) + 1).cast("int"))


def failure_tags(floors: list[tuple[str, Column, float]], default: str = "hard_near_miss") -> Column:
    """Names of the scores below their floor, in order; the default if there are none."""
    named = F.array_distinct(F.array_compact(F.array(*(F.when(c < floor, name) for name, c, floor in floors))))
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.lit(default)))


def role_matches(role: Column, patterns: list[str]) -> Column:
    """Equal to a pattern, in its namespace (pattern:...), or starting with pattern*; no pattern, no match."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | (role.startswith(p.rstrip("*")) if p.endswith("*") else (role == p) | role.startswith(f"{p}:"))
    return hit


def record_path(path: Column, base: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))


def detector_phrase(x: Column) -> Column:
    """The words a detector is asked for: no article, nothing after a relation, no leading size or colour word."""
    cut = F.regexp_replace(strip_article(F.lower(x)), rf"\s+(?:{'|'.join(RELATIONS)}|with|of)\s+.*$", "")
    return F.nullif(F.trim(F.regexp_replace(cut, r"^(?:(?:small|large|big|tiny|old|young|red|blue|green|black|white)\s+)+(?=\S)", "")), F.lit(""))


def check_prompts(required: Column, forbidden: Column, scope: Column, most: int = 3) -> Column:
    """The first texts to score, each in its scope, without case-insensitive repeats."""
    both = F.concat(F.coalesce(required, F.array().cast("array<string>")), F.coalesce(forbidden, F.array().cast("array<string>")))
    scoped = F.transform(both, lambda t: F.when(F.contains(F.lower(t), F.lower(scope)), t).otherwise(F.concat(t, F.lit(" in "), scope)))

    def step(acc: Column, t: Column) -> Column:
        return F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(t)), acc).otherwise(F.concat(acc, F.array(t)))

    return F.slice(F.aggregate(scoped, F.array().cast("array<string>"), step), 1, most)


def caption_objects(caption: Column, nouns: tuple[str, ...], modifiers: int = 3, most: int = 5) -> Column:
    """Nouns of a caption with up to three words before them that are no stop words, in order, distinct."""
    words = F.regexp_extract_all(F.lower(caption), F.lit("[a-z0-9]+"), F.lit(0))
    stops = ("a", "an", "in", "on", "at", "of", "is", *STOPWORDS)

    def phrase(w: Column, i: Column) -> Column:
        before = F.slice(words, F.greatest(i - modifiers, F.lit(0)) + 1, F.least(i, F.lit(modifiers)))
        kept = F.aggregate(before, F.array().cast("array<string>"), lambda acc, x: F.when(x.isin(*stops) | x.isin(*nouns), F.array().cast("array<string>")).otherwise(F.concat(acc, F.array(x))))
        return F.when(w.isin(*nouns), F.concat_ws(" ", F.array_join(F.concat(kept, F.array(w)), " ")))

    return F.slice(F.array_distinct(F.array_compact(F.transform(words, phrase))), 1, most)


def number_map(x: Column) -> Column:
    """Text of the form ``name:number, name=number`` or a JSON object as a map; what is no number is left out."""
    pairs = F.transform(F.split(x, r"\s*[,;]\s*"), lambda p: F.split(p, r"\s*[:=]\s*"))
    good = F.filter(pairs, lambda p: (F.size(p) == 2) & (F.get(p, F.lit(0)) != "") & F.get(p, F.lit(1)).try_cast("double").isNotNull())
    plain = F.map_from_entries(F.transform(good, lambda p: F.struct(F.trim(F.get(p, F.lit(0))), F.get(p, F.lit(1)).try_cast("double"))))
    return F.when(F.trim(x).startswith("{"), F.from_json(x, "map<string,double>")).otherwise(plain)
