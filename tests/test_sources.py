import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netquarry.sources import logs, sinks


def _write(path, lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_log_with_both_spellings_and_bad_lines(spark, tmp_path):
    path = _write(tmp_path / "a.log", [
        '{"ts": 1.5, "uid": "C1", "id.orig_h": "10.0.0.1", "id.resp_p": 0, "proto": "tcp"}',
        "{broken", '{"ts": 2.0, "uid": "C2", "id_orig_h": "10.0.0.2", "id_resp_p": 443}', '{"ts": 3.0, "proto": "udp"}',
    ])
    rows = {r.uid: r for r in logs.read_log(spark, path, logs.CONN).collect()}
    assert set(rows) == {"C1", "C2"}
    assert rows["C1"].id_orig_h == "10.0.0.1" and rows["C1"].id_resp_p == 0  # port 0 is not missing
    assert rows["C2"].id_resp_p == 443 and rows["C2"].duration is None and rows["C2"].source_pcap == "a.log"
    at = logs.with_time(logs.read_log(spark, path, logs.CONN, "x.pcap")).where("uid = 'C1'").first()
    assert at.source_pcap == "x.pcap" and at.ts_date.microsecond == 500000


def test_loaded_sources_are_skipped(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "source_pcap string, n int")
    loaded = spark.createDataFrame([("a",)], "source_pcap string")
    assert [r.n for r in logs.new_sources(rows, loaded).collect()] == [2]


def test_truth_csv(spark, tmp_path):
    path = _write(tmp_path / "t.csv", [
        "﻿Dst Port , Protocol,Timestamp,Flow Duration,Tot Fwd Pkts,Tot Bwd Pkts, Label",
        "80,6,01/03/2018 08:17:11,1500000,2,3,Benign", "x,99,01/03/2018 08:17:11.250,oops,,1,Attack", "1,17,bad,1,1,1,Benign",
    ])
    rows = logs.read_truth(spark, path).collect()
    assert [(r.dst_port, r.proto, r.packets) for r in rows] == [(80, "tcp", 5), (-1, "unknown", 1), (1, "udp", 2)]
    assert rows[0].ts == 1519892231 + 43200 and rows[1].ts == rows[0].ts + 0.25 and rows[2].ts is None
    assert rows[0].duration == 1.5 and rows[1].duration is None


def test_datasets_by_extension(spark, tmp_path):
    _write(tmp_path / "a.jsonl", ['{"x": 1}', '{"x": 2}'])
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1}, {"x": 2}, {"x": 3}]))
    _write(tmp_path / "a.csv", ["x", "1"])
    spark.range(4).write.parquet(str(tmp_path / "a.parquet"))
    _write(tmp_path / "a.txt", ["l"])
    _write(tmp_path / "a.xml", ["<rows><row><x>1</x></row><row><x>2</x></row></rows>"])
    counts = {k: logs.read_dataset(spark, str(tmp_path / f"a.{k}")).count() for k in ("jsonl", "json", "csv", "parquet", "txt", "xml")}
    assert counts == {"jsonl": 2, "json": 3, "csv": 1, "parquet": 4, "txt": 1, "xml": 2}
    with pytest.raises(ValueError):
        logs.read_dataset(spark, "a.doc")
    with pytest.raises(ValueError, match="y"):
        logs.require_columns(spark.range(1), ["id", "y"])


def test_flatten(spark):
    df = spark.createDataFrame([(1, (2, (3,)))], "a int, b struct<c:int, d:struct<e:int>>")
    assert logs.flatten(df, "/").first().asDict() == {"a": 1, "b/c": 2, "b/d/e": 3}


def test_append_ignores_known_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v string")
    sinks.append_new(spark, rows((1, "a"), (1, "b"), (2, "c")), path, "k")
    sinks.append_new(spark, rows((2, "z"), (3, "d")), path, "k")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_tasks_are_nested_in_order(spark, tmp_path):
    flows = spark.createDataFrame([("C1", 5), ("C2", 6)], "uid string, n int")
    packets = spark.createDataFrame([("C1", 2, "b"), ("C1", 1, "a")], "uid string, seq int, payload string")
    path = str(tmp_path / "tasks")
    sinks.write_tasks(flows, packets, "uid", ["seq"], path)
    rows = {r.data.uid: r.data for r in spark.read.json(path).collect()}
    assert [p.payload for p in rows["C1"].packets] == ["a", "b"] and rows["C2"].packets is None


def test_dataset_catalogue(spark):
    d = sinks.Datasets(spark)
    d.register("demo", spark.range(3), "train")
    d.register("demo", spark.range(2), "test")
    assert d.exists("demo") and d.splits("demo") == ["test", "train"] and "demo" in d.names()
    assert d.load("demo", "test").count() == 2
    d.register("demo", spark.range(5), "test")
    assert d.load("demo", "test").count() == 5
    d.remove("demo", "test")
    assert d.splits("demo") == ["train"]
    d.remove("demo")
    assert not d.exists("demo")
    with pytest.raises(ValueError):
        d.register("a b; drop", spark.range(1))


def test_underscored_reset_and_sorted_files(spark, tmp_path):
    df = spark.createDataFrame([(3, 1)], "`id.resp_p` int, rag_score int")
    assert sinks.reset(sinks.underscored(df), "rag_score").columns == ["id_resp_p"]
    sinks.sort_for_lookup(spark.range(100).withColumn("k", F.col("id") % 7), str(tmp_path / "s"), "k")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 100


def test_listing_named_datasets_and_failures(spark, tmp_path):
    (tmp_path / "train").mkdir()
    _write(tmp_path / "train" / "math.json", ['[{"q": "1+1", "a": 2}, {"q": "x", "a": null}]'])
    _write(tmp_path / "a.log", ['{"uid": "C1", "n": 1}', "{broken", '{"uid": "C2"}'])
    listed = logs.list_files(spark, str(tmp_path), "*.log").collect()
    assert [(r.name, r.length) for r in listed] == [("a.log", (tmp_path / "a.log").stat().st_size)]
    assert sorted((r.q, r.a) for r in logs.read_named(spark, str(tmp_path), "TRAIN", "Math").collect()) == [("1+1", 2), ("x", None)]
    good, failed = logs.read_with_failures(spark, str(tmp_path / "a.log"), T.StructType.fromDDL("uid string, n long"))
    assert sorted(r.uid for r in good.collect()) == ["C1", "C2"]
    assert [tuple(r) for r in failed.collect()] == [("a.log", 1, "{broken")]


def test_appended_lines_episodes_and_serialised_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", True, [1, 2]), (1, "b", None, None), (2, "c", False, [])], "training_step int, episode_id string, is_correct boolean, trajectories array<int>")
    for _ in range(2):
        sinks.append_lines(rows, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 6
    got = {r.training_step: tuple(r)[1:] for r in sinks.write_episodes(rows, str(tmp_path / "e")).collect()}
    assert got == {1: (2, 1, 1, 0.5, 1.0), 2: (1, 0, 1, 0.0, 0.0)}
    assert sorted((r.training_step, r.episode_id) for r in spark.read.json(str(tmp_path / "e/episodes")).collect()) == [(1, "a"), (1, "b"), (2, "c")]
    assert spark.read.json(str(tmp_path / "e/summaries")).count() == 2
    text = sinks.serialised(rows.where("episode_id = 'b'")).first().json
    assert json.loads(text) == {"training_step": 1, "episode_id": "b", "is_correct": None, "trajectories": None}
