import pytest
from pyspark.sql import functions as F

from siftloom.operators import audit, contract, edits, gates, logs, pairs, planner, rank, weights


def test_planner_admission_by_feasible_count(spark):
    rows = [(f, i, "policy", i < f, f > 0 and i == 0, 0.8 if i < f else 0.0, 0.8, 0.8, 0.8, 0.8, 0.8, False, 0.0) for f in range(5) for i in range(4)]
    df = spark.createDataFrame(rows, "group_id int, candidate_index int, role string, feasible boolean, accepted boolean, total double, raw_reward double, edit double, specificity double, preservation double, validity double, judge_supported boolean, judge_score double")
    p = planner.Planner()
    got = {r["group_id"]: r for r in planner.admission(planner.group_metrics(df, F.col("role").startswith("reference"), p), p).collect()}
    want = {0: (0.135335, 0.186947, False), 1: (0.606531, 0.722612, True), 2: (1.0, 0.88, True), 3: (0.606531, 0.722612, True), 4: (0.135335, 0.400601, False)}
    for f, (band, reward, use) in want.items():
        assert got[f]["feasibility_rate"] == f / 4
        assert got[f]["band"] == pytest.approx(band, abs=1e-6)
        assert got[f]["reward"] == pytest.approx(reward, abs=1e-6)
        assert got[f]["use_for_sft"] is use


def test_admission_modes(spark):
    rows = [("accepted", 0.8), ("rejected", 0.8)]
    df = spark.createDataFrame(rows, "status string, total double").selectExpr("*", "'stat' verifier", "'f' family", "'x' edit_type", "'i.png' edited_image", "'policy' role", "false feasible", "0L rnk", "0.8D edit", "0.8D raw_reward", "0.8D preservation", "0.8D validity", "0.8D taxonomy")
    got = {r["status"]: (r["weight"], r["reason"]) for r in gates.admit(df, gates.Admission()).collect()}
    assert got == {"accepted": (0.8, "accepted"), "rejected": (0.0, "rejected_disabled")}


def test_mean_one(spark):
    df = spark.createDataFrame([(0.8,), (0.4,), (0.5,)], "weight double")
    got = [r["sample_weight"] for r in weights.mean_one(df).orderBy(F.desc("weight")).collect()]
    assert got == pytest.approx([1.411765, 0.882353, 0.705882], abs=1e-6)
    base = spark.createDataFrame([(1, 0.8, "src.png", "edit.png")], "id int, weight double, image string, edited_image string")
    both = weights.mean_one(weights.with_replay(base, 0.5, 0.5, [F.asc("id")])).orderBy(F.desc("weight")).collect()
    assert [r["sample_weight"] for r in both] == pytest.approx([1.230769, 0.769231], abs=1e-6)
    assert (both[1]["kind"], both[1]["image"]) == ("reconstruction_replay", "edit.png")


@pytest.mark.parametrize("bad", [[0.0, 0.0], [-1.0, 1.0], [float("inf"), 1.0], [float("nan"), 1.0]])
def test_mean_one_refuses(spark, bad):
    df = spark.createDataFrame([(w,) for w in bad], "weight double")
    with pytest.raises(Exception, match="weights must be finite"):
        weights.mean_one(df).collect()


@pytest.mark.parametrize("bounds", [(0, 1), (1, 0.5), (0.25, float("inf"))])
def test_clipped_mean_refuses(spark, bounds):
    with pytest.raises(ValueError):
        weights.clipped_mean(F.lit(1.0), *bounds)


def test_log_rules(spark):
    log = spark.createDataFrame([("g", 0, 1, "generated"), ("g", 0, 2, "accepted"), ("h", 0, 1, "rejected"), ("h", 0, 2, "accepted")], "group_id string, candidate_index int, seq int, status string")
    assert {(r["group_id"], r["status"]) for r in logs.last_wins(log).collect()} == {("g", "accepted"), ("h", "accepted")}
    assert logs.first_accepted(log).count() == 0
    done = spark.createDataFrame([("g", i, s) for i, s in enumerate(("accepted", "rejected", "generated"))], "group_id string, candidate_index int, status string")
    assert logs.completed_groups(done, 2).count() == 1
    assert logs.completed_groups(done, 3).count() == 0


def test_selection_order_and_deficit(spark):
    for order in (["a", "b", "c"], ["c", "b", "a"]):
        df = spark.createDataFrame([("add", "en", k) for k in order], "task string, language string, key string")
        got = rank.stratified(df, ["task", "language"], "key", 42, 2)
        assert {r["key"]: (r["place"], r["digest"][:12]) for r in got.collect()} == {"b": (1, "00c4b4ef7d0c"), "a": (2, "21a64b5c3357"), "c": (3, "9ae0908b0009")}
        assert rank.deficits(df, ["task", "language"], 4).collect()[0]["found"] == 3


def test_apportionment(spark):
    def quotas(weights_, count):
        df = spark.createDataFrame([(i, w[0], float(w[1])) for i, w in enumerate(weights_)], "pos int, label string, weight double")
        return {r["label"]: r["quota"] for r in rank.apportion(df, count).collect()}

    assert quotas([("object", 5), ("background", 3), ("style", 1)], 7) == {"object": 4, "background": 2, "style": 1}
    assert quotas([("a", 1), ("b", 1), ("c", 1)], 5) == {"a": 2, "b": 2, "c": 1}
    assert quotas([("a", 0), ("b", 0)], 3) == {"a": 2, "b": 1}


def test_difficulty(spark):
    df = spark.createDataFrame([(1, 0.8), (2, 0.9), (3, 0.1)], "round int, rate double")
    assert [r["level"] for r in rank.fold_difficulty(df, "round", "rate").orderBy("round").collect()] == [3, 3, 2]


def test_rank_ties_keep_candidate_order(spark):
    df = spark.createDataFrame([(1, i, True, 0.5) for i in (2, 0, 1)], "group_id int, candidate_index int, feasible boolean, reward double")
    got = {r["candidate_index"]: (r["rnk"], r["accepted"]) for r in rank.best_of_n(df).collect()}
    assert got == {0: (1, True), 1: (2, False), 2: (3, False)}


def test_dominant_takes_first_seen(spark):
    df = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "a"), (1, 3, "b")], "group_id int, candidate_index int, kind string")
    assert planner.dominant(df, ["group_id"], "kind", "candidate_index").first()["kind"] == "b"


def test_hard_negative_order_matches_a_greedy_loop(spark):
    rows = [(g, i, ((i * 7 + g) % 5) / 5, 0.1 * i, [t for k, t in enumerate(("x", "y", "z")) if (i + g) % (k + 2) == 0] or ["hard_near_miss"]) for g in range(6) for i in range(7)]
    df = spark.createDataFrame(rows, "group_id int, candidate_index long, reward double, raw_reward double, failure_tags array<string>")
    got = {}
    for r in pairs.hard_negative_order(df, ["z", "x", "y"]).collect():
        got.setdefault(r["group_id"], {})[r["place"]] = r["candidate_index"]
    for g in range(6):
        left = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], -r[3], r[1]))
        out = []
        for tag in ("z", "x", "y"):
            hit = next((r for r in left if tag in r[4]), None)
            if hit:
                out.append(hit)
                left.remove(hit)
        assert [got[g][k] for k in range(7)] == [r[1] for r in out + left]


def test_audit(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    b = spark.createDataFrame([(2,), (4,)], "k int")
    assert {(r["k"], r["state"]) for r in audit.reconcile(a, b, "k").collect()} == {(1, "missing"), (3, "missing"), (4, "unexpected")}
    empty = a.limit(0)
    assert audit.reconcile(empty, empty, "k").count() == 0
    docs = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "id int, text string")
    assert audit.duplicate_content(docs, "id", "text").first()["keys"] == [1, 3]


def test_reapplied_gates_keep_a_told_reason(spark):
    df = spark.createDataFrame([(True, "accepted rank", 0.5, 1.0), (False, "old reason", 0.0, 1.0), (True, None, 0.5, 0.0)], "feasible boolean, reject_reason string, reward double, x double")
    got = gates.reapply(df, gates.Gates(("hard", F.col("x") < 0.5))).collect()
    assert [(r["feasible"], r["reject_reason"], r["reward"]) for r in got] == [(False, "hard", 0.0), (False, "old reason", 0.0), (True, None, 0.5)]


def test_structured_edits(spark):
    given = [("Remove the cup on the table from the image", "detail"), ("Replace the old car with a red bus, while keeping the road", "detail"), ("Add a small dog near the tree.", "detail"), ("Isolate the lamp from the room", "detail")]
    out = edits.normalized(spark.createDataFrame(given, "instruction string, family string"), "instruction", "family").collect()
    by = {r["edit_type"]: r for r in out}
    assert by["object_removal"]["source_object"] == "cup"
    assert (by["object_replacement"]["source_object"], by["object_replacement"]["target_object"]) == ("old car", "red bus")
    assert by["object_replacement"]["forbidden_after"] == ["old car remains visible in the target region", "a separate old car remains visible in the target region"]
    assert (by["object_addition"]["target_object"], by["object_addition"]["target_region"]) == ("small dog", "near the tree")
    assert by["subject_extraction"]["source_object"] == "lamp"
    assert by["subject_extraction"]["preserve"][:3] == ["subject boundary detail", "lamp pose and shape", "lamp identity"]


def test_structured_edits_of_payloads(spark):
    """Slots given under any of their names come before those that the instruction tells."""
    rows = [
        ("Remove the cup", "replace", "old mug's", "glass", "on the shelf", ["mug remains visible on the shelf", "no mug"], "sky; sky;Tree", None, None),
        ("Move it", "move", "lamp", None, None, None, None, "at the left", "beside the sofa"),
        ("Change it", "background change", None, None, "behind the dog", ["the dog is missing", "old backdrop is still there"], None, None, None),
        ("Drop it", "delete", "red cup near the door", None, None, ["red cup remains", "other objects remain near the red cup"], None, None, None),
        ("Make it", "bogus type", "none", None, "N/A", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "instruction string, type string, object string, replacement_object string, region string, must_not_have_after array<string>, preserve string, source_location string, relation string").withColumn("family", F.lit("detail"))
    r = edits.normalized(df, "instruction", "family", ("type", "object", "replacement_object", "region", "must_not_have_after", "preserve", "source_location", "relation")).collect()
    assert (r[0]["edit_type"], r[0]["source_object"], r[0]["target_object"], r[0]["preserve"]) == ("object_replacement", "old mug", "glass", ["sky", "Tree", "background"])
    assert r[0]["required_after"] == ["glass is visible on the shelf"]
    assert r[0]["forbidden_after"] == ["mug remains visible on the shelf", "old mug remains visible on the shelf", "a separate old mug remains visible on the shelf"]
    assert (r[1]["required_after"], r[1]["forbidden_after"]) == (["lamp is beside the sofa"], ["lamp remains at the left"])
    assert (r[2]["edit_type"], r[2]["forbidden_after"], r[2]["target_region"]) == ("background_change", ["old backdrop is still there"], "behind the dog")
    assert (r[3]["source_object"], r[3]["target_region"], r[3]["forbidden_after"]) == ("red cup", "near the door", ["red cup remains"])
    assert r[3]["required_after"] == ["the area near the door is cleanly filled after removing red cup"]
    assert (r[4]["edit_type"], r[4]["source_object"], r[4]["target_region"]) == ("local_enhancement", None, "main visible target")
    assert r[4]["forbidden_after"] == ["main visible target remains blurry or unchanged"]


def test_acceptors(spark):
    from siftloom.operators import judging

    flags = dict.fromkeys("detector_supported source_detected target_present required_pass forbidden_pass region_pass region_reward_pass outside_preservation_pass outside_change_pass kept_pass preservation_pass validity_pass removal_pass judge_reliable judge_pass reward_pass is_best".split(), True)
    scores = dict.fromkeys("localization outside_preservation outside_unchanged judge_score judge_semantic judge_absence judge_fill judge_preservation judge_artifact_free judge_target judge_target_visible judge_source_before judge_edit judge_instruction judge_overall required_score pre_raw_reward".split(), 0.95)
    base = {"edit_type": "object_removal", "feasible": False, "reject_reason": "object_detector_contract", "reward": 0.0, "raw_reward": 0.6, "source_absent": False, "judge_missing": False, "hard_fail": False, "source_before": 0.8, "source_after": 0.2, "judge_visible_after": 0.1, **flags, **scores}
    cases = [
        (base, "accepted_vlm_removal_structured_absence_fallback"),
        (base | {"judge_visible_after": 0.9}, "accepted_vlm_removal_judge_fallback"),
        (base | {"judge_visible_after": 0.9, "outside_unchanged": 0.1}, "accepted_vlm_removal_detector_fallback"),
        (base | {"hard_fail": True}, "accepted_vlm_removal_structured_absence_fallback"),
        (base | {"hard_fail": True, "judge_visible_after": None}, "internal_vlm_judge_hard_fail"),
        (base | {"is_best": False}, "object_detector_contract"),
        (base | {"edit_type": "object_replacement"}, "accepted_vlm_replacement_detector_fallback"),
        (base | {"edit_type": "object_replacement", "source_after": 0.77}, "object_detector_contract"),
        (base | {"edit_type": "object_replacement", "target_present": None}, "object_detector_contract"),
        (base | {"edit_type": "subject_extraction", "reject_reason": "validity", "is_best": False}, "accepted_vlm_subject_extraction_fallback"),
        (base | {"edit_type": "compose", "reject_reason": "taxonomy", "judge_edit": 0.3}, "accepted_vlm_action_compose_fallback"),
        (base | {"edit_type": "color_change", "feasible": True, "reject_reason": "accepted", "reward_pass": False}, "internal_vlm_judge_reward"),
    ]
    kinds = {bool: "boolean", str: "string", float: "double"}
    df = spark.createDataFrame([tuple(r.values()) for r, _ in cases], ", ".join(f"{n} {kinds[type(v)]}" for n, v in base.items()))
    got = judging.readmit(df).collect()
    assert [r["reject_reason"] for r in got] == [want for _, want in cases]
    assert [r["reward"] for r in got] == [0.6 if want.startswith("accepted") else 0.0 for _, want in cases]
    late = judging.readmit(df.filter("edit_type = 'object_replacement'"), override=True).collect()
    assert [r["feasible"] for r in late] == [True, True, False]


@pytest.mark.parametrize("feasible, admitted", [(0, False), (1, True), (2, True), (3, True), (4, False)])
def test_planner_admission(spark, feasible, admitted):
    """All candidates' gates count, not which one was chosen; missing evidence and blank instructions keep a group out."""
    schema = "group_id string, candidate_index int, feasible boolean, told boolean, accepted boolean, total double, raw_reward double, edit double, specificity double, preservation double, validity double, judge_supported boolean, judge_score double, instruction string"
    rows = [(g, i, i < feasible, g != "mixed" or i > 0, i == 0 and feasible > 0, 0.8 if i < feasible else 0.0, 0.8, 0.8, 0.0, 0.8, 0.8, False, None, "" if g == "blank" else "Extract the cup.") for g in ("one", "mixed", "blank") for i in range(4)]
    m = planner.group_metrics(spark.createDataFrame(rows, schema), F.lit(False), planner.Planner(), F.col("told"), F.col("instruction"))
    got = {r["group_id"]: r for r in planner.admission(m, planner.Planner()).collect()}
    assert got["one"]["use_for_sft"] is admitted and got["one"]["feasibility_rate"] == feasible / 4
    assert not got["mixed"]["use_for_sft"] and not got["blank"]["use_for_sft"]
    assert got["mixed"]["feasibility_source"] == "explicit_feasible_group_missing_fail_closed"


def test_plugins(spark):
    from siftloom.functions import plugins
    from siftloom.session import ship

    ship(spark)
    plugins.register("group", "centre", lambda: lambda rows: rows.assign(x=rows.x - rows.x.mean()))
    plugins.register("generator", "twice", lambda: lambda r: [r, {**r, "x": -r["x"]}])
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0)], "g long, x double")
    assert sorted(r["x"] for r in plugins.group(df, "centre", ["g"], "g long, x double").collect()) == [-1.0, 0.0, 1.0]
    assert plugins.generate(df, "twice", "g long, x double").count() == 6
    with pytest.raises(ValueError):
        plugins.backend("scalar", "nothing")


def test_numbers_over_a_total_order(spark):
    from siftloom.operators.ordinal import numbered

    df = spark.range(0, 500, numPartitions=7).select((F.col("id") * 7919 % 500).alias("x"))
    assert [(r["x"], r["ordinal"]) for r in numbered(df, [F.desc("x")]).orderBy("ordinal").collect()] == [(499 - k, k + 1) for k in range(500)]
    assert numbered(df.limit(0), [F.asc("x")]).count() == 0


def test_eligibility_reasons(spark):
    base = {"edit_type": "object_addition", "instruction": "Add a dog near the tree", "source_object": None, "target_object": "dog", "target_region": "near the tree", "required_after": ["dog is there"], "forbidden_after": ["dog is absent near the tree"], "preserve": ["x"], "source_attribute": None, "target_attribute": None}
    cases = [
        (base, None),
        (base | {"target_object": None}, "proposal_target_object_missing"),
        (base | {"target_object": "dog beside"}, "proposal_target_object_contains_relation_tail"),
        (base | {"target_region": "the target region"}, "proposal_target_region_generic"),
        (base | {"target_region": "tree"}, "proposal_target_region_missing_anchor"),
        (base | {"forbidden_after": ["no dog"]}, "proposal_forbidden_after_negative_sentence"),
        (base | {"forbidden_after": ["cat is absent"]}, "proposal_addition_forbidden_missing_target_object"),
        (base | {"edit_type": "object_replacement", "source_object": "Dog"}, "proposal_replacement_same_as_source"),
        (base | {"edit_type": "object_replacement", "source_object": "old dog", "target_object": "dog toy"}, "proposal_replacement_overlaps_source"),
        (base | {"edit_type": "object_replacement", "source_object": "white bench", "target_region": "under the bench"}, "proposal_replacement_region_uses_source_as_anchor"),
        (base | {"edit_type": "spatial_move", "source_object": "young woman"}, "proposal_spatial_target_fragile_or_main_subject"),
        (base | {"edit_type": "spatial_move", "source_object": "toy dog"}, None),
        (base | {"edit_type": "color_change", "source_object": "the left wall", "source_attribute": "red", "target_attribute": "blue"}, "proposal_local_target_broad_head:wall"),
        (base | {"edit_type": "material_change", "source_object": "cup", "instruction": "make the cup red"}, "proposal_material_source_state_missing"),
        (base | {"edit_type": "color_change", "source_object": "cup", "source_attribute": "the red state", "target_attribute": "red"}, "proposal_color_state_unchanged"),
        (base | {"edit_type": "background_change", "instruction": "Remove the sofa, background", "target_region": None}, "proposal_background_change_is_object_edit"),
        (base | {"source_object": "the 'stop' cup"}, "proposal_contains_quoted_visible_text"),
        (base | {"source_object": "the dog's sign"}, "proposal_source_object_is_text_like"),
    ]
    schema = "edit_type string, instruction string, source_object string, target_object string, target_region string, required_after array<string>, forbidden_after array<string>, preserve array<string>, source_attribute string, target_attribute string"
    df = spark.createDataFrame([tuple(c.values()) for c, _ in cases], schema)
    got = [r["r"] for r in df.select(contract.eligibility_reason(df.columns, explicit_states=True).alias("r")).collect()]
    assert got == [want for _, want in cases]
