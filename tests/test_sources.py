import json
import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siftloom.sources import readers, sinks
from siftloom.streaming import upsert


def write(path, lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_manifest(spark, tmp_path):
    path = write(tmp_path / "m.jsonl", ['{"key": 2, "image": "a.png", "metadata": {"x": {"y": 1}}}', "", '{"key": "b", "image": "b.png", "caption": "c"}'])
    rows = readers.records(spark, "jsonl", path).collect()
    assert [(r["key"], r["image"], r["caption"]) for r in rows] == [("2", "a.png", None), ("b", "b.png", "c")]
    assert readers.manifest(spark, path).select(F.try_variant_get("metadata", "$.x.y", "int")).first()[0] == 1
    with pytest.raises(ValueError):
        readers.records(spark, "other", path)
    bad = write(tmp_path / "bad.jsonl", ['{"key": "a"}'])
    with pytest.raises(Exception, match="has no image"):
        readers.manifest(spark, bad).collect()


def test_sidecar_last_wins(spark, tmp_path):
    path = write(tmp_path / "s.jsonl", ['{"key": "a", "v": 1}', '{"key": "a", "v": 2}'])
    assert readers.sidecar(spark, path, "key string, v int").collect()[0]["v"] == 2


def test_torn_log(spark, tmp_path):
    path = write(tmp_path / "l.jsonl", ['{"a": 1}', '{"a":'])
    assert [r["a"] for r in readers.append_log(spark, path, "a int").collect()] == [1]
    path = write(tmp_path / "f.jsonl", ['{"a":', '{"a": 1}'])
    with pytest.raises(ValueError, match="line 1"):
        readers.append_log(spark, path, "a int")


def test_keyed_specs(spark, tmp_path):
    path = write(tmp_path / "k.json", ['{"x": {"id": "1"}, "y": {"id": "2"}}'])
    assert {(r["identity"], r["id"]) for r in readers.keyed_specs(spark, path, "struct<id:string>").collect()} == {("x", "1"), ("y", "2")}
    twice = write(tmp_path / "d.json", ['{"x": {"id": "1"}, "x": {"id": "2"}}'])
    with pytest.raises(Exception):
        readers.keyed_specs(spark, twice, "struct<id:string>").collect()


def test_compound_manifest(spark, tmp_path):
    row = lambda i, **k: json.dumps({"idx": i, "key": f"{i:04d}", "image": f"{i:04d}.png", "compound": ["do"] * 8, "sequence": ["do"]} | k)
    _, faults = readers.compound_manifest(spark, write(tmp_path / "c.jsonl", [row(0), row(1)]), rows=2)
    assert faults.count() == 0
    _, faults = readers.compound_manifest(spark, write(tmp_path / "e.jsonl", [row(0), row(3), row(2, compound=["x"]), row(3, extra=1)]), rows=2)
    assert {(r["rule"], r["line"]) for r in faults.collect()} == {("idx", 2), ("key", 2), ("compound", 3), ("keys", 4), ("row_count", 4)}


def test_directory_and_digests(spark, tmp_path):
    (tmp_path / "d/sub").mkdir(parents=True)
    for name in ("b.PNG", "sub/a.jpg", "note.txt"):
        (tmp_path / "d" / name).write_bytes(b"x")
    rows = readers.directory(spark, str(tmp_path / "d")).collect()
    assert [r["key"] for r in rows] == ["b", "sub__a"]
    assert readers.fingerprints(spark, str(tmp_path / "d")).select("sha256").distinct().count() == 1
    assert readers.latest_file(spark, str(tmp_path / "d"), "*.jpg").first()["path"].endswith("sub/a.jpg")
    assert readers.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "d")]) == str(tmp_path / "d")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    path = str(tmp_path / "t")
    assert sinks.write_or_validate(df, path) == "written"
    assert sinks.write_or_validate(df.orderBy(F.desc("k")), path) == "validated"
    with pytest.raises(ValueError, match="other rows"):
        sinks.write_or_validate(df.limit(1), path)
    sinks.publish(df, str(tmp_path / "p"))
    with pytest.raises(ValueError):
        sinks.publish(df, str(tmp_path / "p"))
    log = spark.createDataFrame([("g", 1, 5, "a"), ("g", 0, 1, "b"), ("g", 0, 2, "c")], "group_id string, candidate_index int, seq int, status string")
    for _ in range(2):  # compaction of a compacted log changes nothing
        sinks.compact(log, str(tmp_path / "log"))
        log = spark.createDataFrame(spark.read.parquet(str(tmp_path / "log")).collect(), log.schema)
        assert [(r["candidate_index"], r["status"]) for r in log.collect()] == [(0, "c"), (1, "a")]
    sinks.save_json({"a": 1}, str(tmp_path / "x/s.json"))
    with sinks.Claim(str(tmp_path / "claim")), pytest.raises(FileExistsError), sinks.Claim(str(tmp_path / "claim")):
        pass


def test_stream_upsert(spark, tmp_path):
    schema = "group_id string, candidate_index int, seq int, status string"
    for k, rows in enumerate(([("g", 0, 1, "planned"), ("h", 0, 2, "generated")], [("g", 0, 3, "accepted")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    got = upsert.latest_states(spark, str(tmp_path / "log"), lambda df: df)
    assert {(r["group_id"], r["status"]) for r in got.collect()} == {("g", "accepted"), ("h", "generated")}


def test_windowed_counts_of_unordered_files(spark, tmp_path, monkeypatch):
    """A replay counts every row, whatever batch an old one comes in."""
    from siftloom.plans.logs import stream_windowed_counts

    monkeypatch.setattr(upsert.file_stream, "__defaults__", (1,))  # a batch for each file
    for k, day in enumerate([9, 8, 1, 5, 1, 9]):
        rows = [(k, f"2024-01-0{day} 0{h}:10:00", "a") for h in (1, 2)]
        spark.createDataFrame(rows, "event_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = stream_windowed_counts(spark, str(tmp_path)).collect()
    assert sorted(r["n"] for r in got) == [1, 1, 1, 1, 2, 2, 2, 2]


def test_stream_completions(spark, tmp_path):
    schema = "group_id string, candidate_index long, status string"
    spark.createDataFrame([("g", 0, "accepted"), ("g", 1, "rejected"), ("h", 0, "accepted"), ("h", 1, "generated")], schema).write.parquet(str(tmp_path / "log"))
    done = upsert.completions(upsert.file_stream(spark, str(tmp_path / "log")), 2)
    q = done.writeStream.outputMode("append").format("memory").queryName("done").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["group_id"], r["n"]) for r in spark.sql("SELECT * FROM done").collect()] == [("g", 2)]


def test_completions_of_many_groups(spark, tmp_path):
    """Each group once over restarts, with the n of a loop; nulls count for nothing; groups share states."""
    log, out, rng = str(tmp_path / "log"), str(tmp_path / "out"), random.Random(3)
    seen, told, want = defaultdict(set), set(), []
    for _ in range(3):
        rows = [(None if rng.random() < 0.02 else f"g{rng.randrange(2000)}", rng.choice([None, 0, 1, 2, 3, -9]), rng.choice(["accepted", "rejected", "generated"])) for _ in range(4000)]
        rows += [("hot", k % 5, "accepted") for k in range(500)]
        spark.createDataFrame(rows, "group_id string, candidate_index long, status string").coalesce(1).write.mode("append").parquet(log)
        for group, index, status in rows:
            if index is not None and status != "generated":
                seen[group].add(index)
        new = {g for g in seen if len(seen[g]) >= 3} - told
        want += [(g, len(seen[g])) for g in new]
        told |= new
        q = upsert.completions(upsert.file_stream(spark, log), 3).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = [(r["group_id"], r["n"]) for r in spark.read.parquet(out).collect()]
    assert ("hot", 5) in got and len(told) > 500 and sorted(got, key=str) == sorted(want, key=str)
    assert len(seen) > 1500 and q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1024


def test_progress_of_streams(spark, tmp_path):
    """A row a batch, with the rows that it read."""
    spark.range(20).repartition(2).write.parquet(str(tmp_path / "in"))
    heard = upsert.Progress()
    spark.streams.addListener(heard)
    try:
        rows = upsert.file_stream(spark, str(tmp_path / "in"), files_a_batch=1)
        query = rows.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(50):
            if sum(r[2] for r in heard.seen) == 20:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(heard)
    told = heard.rows(spark).collect()
    assert sum(r["rows"] for r in told) == 20 and len(told) >= 2


def test_cluster_without_a_shared_folder_is_an_error(spark):
    from siftloom import session

    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
