import json
import math

import pytest
from pyspark.sql import functions as F

from siftloom.functions import arrays, parsing
from siftloom.functions import scoring as s
from siftloom.functions import text as t


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalars_of_the_fixtures(spark):
    lit = F.lit
    assert value(spark, s.geometric_mean([lit(0.9), lit(0.4)])) == pytest.approx(0.6)
    assert value(spark, s.raw_reward(0.6, 0.7)) == pytest.approx(0.648074, abs=1e-6)
    assert value(spark, s.range_score(0.2, 0.35, 1.0)) == pytest.approx(0.571429, abs=1e-6)
    assert value(spark, s.range_score(0.5, 0.35, 1.0)) == 1.0
    for given, want in ((73, 0.73), (8, 0.8), (3, 0.5), (0.4, 0.4)):
        assert value(spark, s.judge_unit(lit(given))) == pytest.approx(want)


def test_missing_numbers(spark):
    nan, none, text = F.lit(float("nan")), F.lit(None).cast("double"), F.lit("0.5")
    assert value(spark, s.finite(nan)) is None
    assert value(spark, s.finite(nan, 0.0)) == 0.0
    assert value(spark, s.finite_text(text)) == 0.5
    assert value(spark, s.first_finite([nan, F.lit(0.3)])) == 0.3
    assert value(spark, s.first_present([nan, F.lit(0.3)], 0.1)) == 0.1
    assert value(spark, s.first_truthy([F.lit(0.0), F.lit(0.3)])) == 0.3
    assert value(spark, s.clamp(none)) is None
    assert value(spark, s.geometric_mean([none, F.lit(0.25)])) == pytest.approx(0.25)
    assert value(spark, s.geometric_mean([none], default=0.5)) == 0.5


@pytest.mark.parametrize("reward", [None, 0.0, -0.1, 1.1, math.nan, math.inf])
def test_accepted_weight_refuses(spark, reward):
    with pytest.raises(Exception, match="reward outside"):
        spark.createDataFrame([(reward,)], "r double").select(s.accepted_weight(F.col("r"))).collect()


def test_accepted_weight_uniform(spark):
    assert value(spark, s.accepted_weight(F.lit(None).cast("double"), "uniform", 0.5)) == 0.5


def test_edit_type_names(spark):
    for given, want in (("cut-out", "subject_extraction"), ("pose", "action_change"), ("foo", "local_enhancement"), ("Object Removal", "object_removal"), (None, "local_enhancement")):
        assert value(spark, t.edit_type(F.lit(given).cast("string"))) == want


def test_roles(spark):
    role = F.lit("policy:v2")
    assert value(spark, t.role_matches(role, ["policy"])) and value(spark, t.role_matches(role, ["pol*"]))
    assert not value(spark, t.role_matches(role, ["pol"])) and not value(spark, t.role_matches(role, []))


def test_text(spark):
    assert value(spark, t.clean_text(F.lit("  a \n b\t"))) == "a b"
    assert value(spark, t.clean_text(F.lit(" N/A "))) is None
    assert value(spark, t.clean_list(F.lit("A; b;a;;c\nB"))) == ["A", "b", "c"]
    assert value(spark, t.strip_article(F.lit("only the red car"))) == "red car"
    assert value(spark, t.trim_tail(F.lit("the car from the image"))) == "car"
    got = value(spark, t.split_relation(F.lit("the cup on the table")))
    assert (got["object"], got["region"]) == ("cup", "on the table")
    assert value(spark, t.tokens(F.lit("The cars and glass BOXES 12"))) == ["car", "glass", "boxe"]
    assert value(spark, t.negative_sentence(F.lit(" No cars remain")))


def test_judge_answers(spark):
    good = "Prompt Compliance: 4\nVisual Naturalness: 5/5.\nPhysical & Detail Integrity: 3"
    assert value(spark, parsing.strict_scores(F.lit(good), F.lit("replace")))["average"] == 4.0
    for line, error in (
        ("Mood: 3", "unexpected_label"), ("Prompt Compliance: 4", "duplicate_label"),
    ):
        assert value(spark, parsing.strict_scores(F.lit(good + "\n" + line), F.lit("replace")))["error"] == error
    for score, error in (("4.5", "not_integer"), ("0", "out_of_range"), ("6", "out_of_range")):
        assert value(spark, parsing.strict_scores(F.lit(good.replace(": 4", f": {score}")), F.lit("replace")))["error"] == error
    assert value(spark, parsing.strict_scores(F.lit("Prompt Compliance: 4"), F.lit("replace")))["error"] == "missing_label"
    assert value(spark, parsing.strict_scores(F.lit(None).cast("string"), F.lit("replace")))["error"] == "not_text"
    assert value(spark, parsing.answer_score(F.lit('```json\n{"score":[8,7],"reasoning":"x"}\n```'))) == 7
    assert value(spark, parsing.answer_score(F.lit('{"score":[11],"reasoning":"x"}'))) is None


def test_json_udfs(spark):
    df = spark.createDataFrame([('see {"a": {"b": 1}} and {"c": 2}',), ("none",), (None,)], "x string")
    assert [r[0] for r in df.select(parsing.balanced_json("x")).collect()] == ['{"a": {"b": 1}}', None, None]
    df = spark.createDataFrame([(json.dumps({"b": "é", "a": [1, 2]}),), ('{"a": NaN}',)], "x string")
    assert [r[0] for r in df.select(parsing.canonical_json("x")).collect()] == ['{"a":[1,2],"b":"é"}', None]


def test_boxes_and_numbers(spark):
    assert value(spark, parsing.pixel_box(F.lit("at [500, 0, 250, 1000]"), F.lit(100), F.lit(50))) == [25, 0, 50, 50]
    assert value(spark, parsing.grounding_number(F.lit("about 85%"))) == pytest.approx(0.85)


def test_grids(spark):
    mask = value(spark, arrays.box_mask(4, F.lit(1), F.lit(1), F.lit(3), F.lit(2)))
    assert [i for i, m in enumerate(mask) if m] == [5, 6]
    grown = value(spark, arrays.dilate(F.array(*(F.lit(m) for m in mask)), 4))
    assert [i for i, m in enumerate(grown) if m] == list(range(12))
    edge = value(spark, arrays.dilate(F.array(*(F.lit(i == 3) for i in range(16))), 4))
    assert [i for i, m in enumerate(edge) if m] == [2, 3, 6, 7]
    pooled = value(spark, arrays.masked_mean_pool(F.array(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(9.0), F.lit(9.0)), F.array(F.lit(3.0), F.lit(5.0))), F.array(F.lit(True), F.lit(False), F.lit(True)), 2))
    assert pooled == [2.0, 4.0]
