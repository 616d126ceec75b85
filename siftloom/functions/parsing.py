"""Judges' answers and reports, parsed by column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The three labels of each family, exactly as judges must write them (fixed values).
SCORE_LABELS = {
    "replace": ("Prompt Compliance", "Visual Naturalness", "Physical & Detail Integrity"),
    "add": ("Prompt Compliance", "Visual Naturalness", "Physical & Detail Coherence"),
    "adjust": ("Prompt Compliance", "Visual Seamlessness", "Physical & Detail Fidelity"),
    "remove": ("Prompt Compliance", "Visual Naturalness", "Physical & Detail Integrity"),
    "style": ("Style Fidelity", "Content Preservation", "Rendering Quality"),
    "action": ("Action Fidelity", "Identity Preservation", "Visual & Anatomical Coherence"),
    "extract": ("Object Identity", "Mask Precision", "Visual Quality"),
    "background": ("Instruction Compliance", "Visual Seamlessness", "Physical Consistency"),
    "compose": ("Instruction Compliance", "Visual Naturalness", "Physical Consistency & Fine Detail"),
}
SCORE_LINE = r"^\s*([^:]+?)\s*:\s*([+-]?[0-9]+(?:\.[0-9]+)?)\s*(?:/\s*5)?\s*\.?\s*$"


def strict_scores(entry: Column, family: Column) -> Column:
    """struct(error, average) of an answer with exactly three labelled whole scores from 1 to 5.

    error is null for a good answer, else the first of: not_text, unknown_family,
    unexpected_label, duplicate_label, not_integer, out_of_range, missing_label.
    """
    labels = F.create_map(*(v for k, names in SCORE_LABELS.items() for v in (F.lit(k), F.array(*map(F.lit, names)))))
    wanted = F.try_element_at(labels, family)
    lines = F.filter(F.split(entry, r"\r\n|\n|\r"), lambda x: x.rlike(SCORE_LINE))
    found = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, SCORE_LINE, 1).alias("label"), F.regexp_extract(x, SCORE_LINE, 2).alias("score")))
    names = F.transform(found, lambda x: x["label"])
    raw = F.transform(found, lambda x: x["score"])
    whole = F.transform(raw, lambda x: x.try_cast("int"))
    error = (
        F.when(entry.isNull(), "not_text")
        .when(wanted.isNull(), "unknown_family")
        .when(F.size(F.array_except(names, wanted)) > 0, "unexpected_label")
        .when(F.size(F.array_distinct(names)) < F.size(names), "duplicate_label")
        .when(F.exists(raw, lambda x: ~x.rlike("^[0-9]+$")), "not_integer")
        .when(F.exists(whole, lambda x: x.isNull() | (x < 1) | (x > 5)), "out_of_range")
        .when(F.size(F.array_except(wanted, names)) > 0, "missing_label")
    )
    average = F.when(error.isNull(), F.aggregate(whole, F.lit(0), lambda a, x: a + x) / 3.0)
    return F.struct(error.alias("error"), average.alias("average"))


def legacy_average(entry: Column) -> Column:
    """Mean, to two places, of the lines ``x: digits``; null without one."""
    parts = F.transform(F.split(entry, r"\r\n|\n|\r"), lambda x: F.split(F.trim(x), ": ", -1))
    numbers = F.transform(F.filter(parts, lambda p: (F.size(p) == 2) & F.get(p, F.lit(1)).rlike("^[0-9]+$")), lambda p: F.get(p, F.lit(1)).cast("double"))
    total = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(numbers) > 0, F.floor(total / F.size(numbers) * 100.0 + 0.5) / 100.0)


def json_span(text: Column) -> Column:
    """From the first { to the last }."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


@F.pandas_udf(T.StringType())
def balanced_json(texts: pd.Series) -> pd.Series:
    """The first balanced {...} of each text; a scanner's job, not a regular expression's."""

    def first(text: str | None) -> str | None:
        depth, start = 0, None
        for i, c in enumerate(text or ""):
            if c == "{":
                start = i if start is None else start
                depth += 1
            elif c == "}" and depth:
                depth -= 1
                if not depth:
                    return text[start : i + 1]
        return None

    return texts.map(first)


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON with sorted keys and no spaces, other letters as they are; null where it does not parse or holds NaN."""

    def refuse(token: str) -> None:
        raise ValueError(token)

    def canonical(text: str | None) -> str | None:
        try:
            return json.dumps(json.loads(text, parse_constant=refuse), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return texts.map(canonical)


def answer_score(text: Column) -> Column:
    """The lowest score of an answer {"score": [..], "reasoning": ..}, maybe fenced; null unless all are in [0, 10]."""
    bare = F.regexp_replace(F.trim(text), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1")
    found = F.from_json(bare, "score array<double>, reasoning string")
    scores = found["score"]
    good = found["reasoning"].isNotNull() & (F.size(scores) > 0) & F.forall(scores, lambda s: s.isNotNull() & (s >= 0) & (s <= 10))
    return F.when(good, F.array_min(scores))


def judge_rows(text: Column) -> Column:
    """Candidates of a judge's JSON answer: array of struct(index, correctness, preservation, reliable)."""
    item = "struct<index:string,candidate:string,target_object_visible_after:double,target_correctness:double,edit_success:double,preservation:double,reliable:boolean>"
    found = F.from_json(json_span(text), f"struct<candidates:array<{item}>>")["candidates"]
    return F.transform(
        F.coalesce(found, F.array().cast(f"array<{item}>")),
        lambda c: F.struct(
            F.regexp_extract(F.coalesce(c["index"], c["candidate"], F.lit("")), "([0-9]+)", 1).try_cast("int").alias("index"),
            F.coalesce(c["target_object_visible_after"], c["target_correctness"], c["edit_success"], F.lit(0.0)).alias("correctness"),
            F.coalesce(c["preservation"], F.lit(0.0)).alias("preservation"),
            F.coalesce(c["reliable"], F.lit(False)).alias("reliable"),
        ),
    )


def still_visible(reason: Column) -> Column:
    return F.lower(reason).rlike(r"\b(?:still|remains?|is) (?:clearly |partially )?(?:visible|present|there)\b|\bnot (?:been )?removed\b")


def grounding_number(text: Column) -> Column:
    """The first number of a text; above 1 it is read as a percentage."""
    n = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return F.when(n > 1, F.least(n / 100.0, F.lit(1.0))).otherwise(n)


def pixel_box(text: Column, width: Column, height: Column, frame: float = 1000.0) -> Column:
    """A box [x0, y0, x1, y1] of a frame as whole pixels, ordered and within the picture."""
    v = F.from_json(F.regexp_extract(text, r"(\[[^\[\]]*\])", 1), "array<double>")
    x0, y0, x1, y1 = (F.get(v, F.lit(k)) for k in range(4))
    at = lambda a, side: F.least(F.greatest(F.floor(a / frame * side), F.lit(0)), side.cast("long")).cast("int")
    box = F.array(at(F.least(x0, x1), width), at(F.least(y0, y1), height), at(F.greatest(x0, x1), width), at(F.greatest(y0, y1), height))
    return F.when(F.size(v) == 4, box)


def sha256_shaped(x: Column) -> Column:
    return F.coalesce(x.rlike("^[0-9a-f]{64}$"), F.lit(False))


def number_or_null(x: Column) -> Column:
    """'' and nan as null, else the number, else null."""
    n = F.when(~F.lower(F.trim(x)).isin("", "nan"), x).try_cast("double")
    return F.when(~F.isnan(n), n)
