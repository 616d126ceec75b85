"""License scans by ordered signature rules (DataFrame functions only).

Each rule has a keyword; only the rules whose keyword a text holds run their regex on it.
A detection is a rule's match with its interval of characters. Detections are resolved
by containment: one that lies inside the interval of another with the same or a higher
priority goes; of detections with one interval the rule of the highest priority stays,
then the first in order. Detections of the base phrases always stay: all their places
are counted.

A row is scanned on its own: there is no shuffle, and a hot source, copies or a common
line make no large task. Detections are swept in order of their start with the furthest
end so far of each priority, so a text with many detections takes n log n comparisons,
and its lists are built in pieces.

Defined results: a null text is empty and has no words, labels or places; its score is
0. Repeated rows are each scanned; an empty table gives an empty result; further
columns are ignored. first_word and last_word are null without a base phrase.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.llm.license_rules import PRIORITY, STEMS, WEIGHT, rules

WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
LEVELS = sorted(set(PRIORITY.values()))
#: Results collected at once; see swept.
PIECE = 256
DETECTION = "struct<start:int,stop:int,priority:int,rule:int,label:string,kind:string>"


def swept(items: Column, zero: Column, advance: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """emit(state, item) of each item in order, where advance(state, item) is the state for the next one.

    Results are collected in pieces of PIECE items, each from the state before it; an
    array that grew item by item would be copied as often as it has items.
    """

    def step(acc: Column, x: Column) -> Column:
        return F.struct(advance(acc["state"], x).alias("state"), F.concat(acc["out"], F.array(emit(acc["state"], x))).alias("out"))

    def piece(k: Column) -> Column:
        before = F.aggregate(F.slice(items, F.lit(1), k * PIECE), zero, advance)
        return F.aggregate(F.slice(items, k * PIECE + 1, F.lit(PIECE)), F.struct(before.alias("state"), F.array().cast(f"array<{kind}>").alias("out")), step, lambda acc: acc["out"])

    pieces = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / PIECE).cast("int"))
    return F.when(F.size(items) > 0, F.flatten(F.transform(pieces, piece))).otherwise(F.array().cast(f"array<{kind}>"))


def places(r: Column, matches: Column, between: Column) -> Column:
    """The detections of one rule: its matches with their start and end, from the texts between them."""
    lengths = F.zip_with(matches, F.slice(between, 1, F.size(matches)), lambda m, b: F.struct(F.length(b).alias("before"), F.length(m).alias("own")))

    def found(at: Column, x: Column) -> Column:
        start = at + x["before"]
        return F.struct(start.alias("start"), (start + x["own"]).alias("stop"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label"), r["kind"].alias("kind"))

    return F.get(F.transform(F.array(lengths), lambda l: swept(l, F.lit(0), lambda at, x: at + x["before"] + x["own"], found, DETECTION)), F.lit(0))


def detections(text: Column, keywords: Column) -> Column:
    """All matches of the rules whose keyword is in ``keywords``.

    Each rule's regex is a constant of its own, compiled once a task; a regex taken from a
    column would be compiled for each row and rule.
    """
    by_word: dict[str, list] = {}
    for rule in rules():
        by_word.setdefault(rule[2], []).append(rule)

    def run(k: int, label: str, kind: str, regex: str) -> Column:
        told = F.struct(F.lit(k).alias("rule"), F.lit(label).alias("label"), F.lit(kind).alias("kind"), F.lit(PRIORITY[kind]).alias("priority"), F.lit(regex).alias("regex"))
        return F.struct(told.alias("r"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("m"))

    gated = (F.when(F.array_contains(keywords, word), F.array(*(run(k, label, kind, regex) for k, label, _, kind, regex in group))) for word, group in by_word.items())
    found = F.filter(F.flatten(F.array_compact(F.array(*gated))), lambda x: F.size(x["m"]) > 0)
    hit = F.transform(found, lambda x: F.struct(x["r"].alias("r"), x["m"].alias("m"), F.split(text, x["r"]["regex"], -1).alias("b")))
    return F.flatten(F.transform(hit, lambda x: places(x["r"], x["m"], x["b"])))


def resolved(found: Column) -> Column:
    """The detections that no other contains; see the module."""

    def order(d: Column) -> Column:
        return F.struct(d["start"].alias("start"), (-d["stop"]).alias("back"), (-d["priority"]).alias("weak"), d["rule"].alias("rule"), d.alias("d"))

    def stays(ends: Column, x: Column) -> Column:
        d, covered = x["d"], F.lit(False)
        for p in LEVELS:
            covered = covered | ((d["priority"] <= p) & (ends[f"end{p}"] >= d["stop"]))
        return F.when((d["kind"] == "base") | ~covered, d)

    def advance(ends: Column, x: Column) -> Column:
        d = x["d"]
        return F.struct(*(F.when(d["priority"] == p, F.greatest(ends[f"end{p}"], d["stop"])).otherwise(ends[f"end{p}"]).alias(f"end{p}") for p in LEVELS))

    nothing = F.struct(*(F.lit(-1).alias(f"end{p}") for p in LEVELS))
    ordered = F.array_sort(F.transform(found, order))
    return F.array_compact(F.get(F.transform(F.array(ordered), lambda o: swept(o, nothing, advance, stays, DETECTION)), F.lit(0)))


def keywords_in(small: Column) -> Column:
    """The rules' keywords that a text in lower case holds.

    A text without any of the few stems, one of which is in every keyword, needs no look
    at the keywords themselves.
    """
    words = sorted({r[2] for r in rules()})
    stem = F.lit(False)
    for s in STEMS:
        stem = stem | F.contains(small, F.lit(s))
    held = F.array_compact(F.array(*(F.when(F.contains(small, F.lit(w)), w) for w in words)))
    return F.when(stem, held).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_words and the resolved detections (start, stop, priority, rule, label, kind) of each row."""
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    small = text.withColumn("small", F.lower("text"))
    gated = small.select("doc_id", "text", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), keywords_in(F.col("small")).alias("keywords"))
    none = F.array().cast(f"array<{DETECTION}>")
    found = gated.withColumn("found", F.when(F.size("keywords") > 0, detections(F.col("text"), F.col("keywords"))).otherwise(none))
    return found.select("doc_id", "text", "n_words", F.when(F.size("found") > 0, resolved(F.col("found"))).otherwise(none).alias("detections"))


def license_summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: words, places of the base phrases, labels and score."""
    rows = scan(docs, id_col, text_col).withColumn("base", F.filter("detections", lambda d: d["kind"] == "base"))
    starts = F.transform("base", lambda d: d["start"])

    def index(at: Column) -> Column:
        return F.regexp_count(F.substring("text", F.lit(1), at), F.lit(WORD)).cast("long")

    some = F.size("base") > 0
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda d: d["label"]))), ",")
    weight = F.create_map(*(x for k, w in WEIGHT.items() for x in (F.lit(k), F.lit(w))))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.when(some, index(F.array_min(starts))).alias("first_word"),
        F.when(some, index(F.array_max(starts))).alias("last_word"),
        labels(F.col("base")).alias("base_labels"),
        labels(F.col("detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: F.element_at(weight, d["kind"]))), F.lit(0.0)).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )
