"""Files by suffix and in archives, checked shapes and indexes, evaluation errors."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from netquarry.operators import evaluation
from netquarry.sources import files, logs


def test_files_of_all_kinds(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain é")
    (tmp_path / "g.txt").write_bytes("中文".encode("gbk"))
    (tmp_path / "l.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "j.json").write_text('﻿{"a": [1, 2]}')
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "t.csv").write_text("﻿name|n\n'x'|1\ny|2\n")
    (tmp_path / "x.xml").write_text("<r k='1'><i>a</i><i>b</i><o>t</o></r>")
    (tmp_path / "e.xml").write_text('<!DOCTYPE r [<!ENTITY a "b">]><r>&a;</r>')
    (tmp_path / "o.docx").write_bytes(b"x")
    (tmp_path / "bad.zip").write_bytes(b"not a zip")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/one.txt", "in a zip")
        z.writestr("two.csv", "a\tb\n1\t2\n")
        z.writestr("in/", "")
    rows = {(r.path.rsplit("/", 1)[-1], r.part): r for r in files.read_files(spark, str(tmp_path), max_chars=60).collect()}
    said = {k: r.content for k, r in rows.items() if r.error is None}
    assert said["a.txt", None] == "plain é" and said["g.txt", None] == "中文" and said["z.zip", "in/one.txt"] == "in a zip"
    assert json.loads(said["j.json", None]) == {"a": [1, 2]} and json.loads(said["l.jsonl", None]) == [{"a": 1}, {"a": 2}]
    assert json.loads(said["t.csv", None]) == [{"name": "'x'", "n": "1"}, {"name": "y", "n": "2"}]
    assert json.loads(said["z.zip", "two.csv"]) == [{"a": "1", "b": "2"}]
    assert said["x.xml", None].endswith("chars)")  # its JSON is longer than 60
    assert {k for k, r in rows.items() if r.error} == {("b.json", None), ("e.xml", None), ("o.docx", None), ("bad.zip", None)}
    assert "docx" in rows["o.docx", None].error and rows["l.txt", None].content == "ÿþú" and len(rows) == 13
    xml = json.loads(files.content("xml", b"<r k='1'><i>a</i><i>b</i><o>t</o></r>", 1000))
    assert xml == {"root_tag": "r", "content": {"@attributes": {"k": "1"}, "i": [{"#text": "a"}, {"#text": "b"}], "o": {"#text": "t"}}}


def test_shapes_and_indexes_that_do_not_fit(spark, tmp_path):
    df = spark.createDataFrame([("1", "a"), ("x", "b"), (None, "c")], "n string, s string")
    with pytest.raises(Exception, match="wrong shape: n"):
        logs.checked(df, "n int, s string").collect()
    assert [r.n for r in logs.checked(df.where("s <> 'b'"), "n int").collect()] == [1, None]
    with pytest.raises(ValueError, match="z"):
        logs.checked(df, "z int")
    spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, vec array<double>").write.parquet(str(tmp_path / "v"))
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string").write.json(str(tmp_path / "c"))
    spark.createDataFrame([(1, "a")], "id long, text string").write.json(str(tmp_path / "d"))
    got = logs.read_index(spark, str(tmp_path / "v"), str(tmp_path / "c")).collect()
    assert sorted((r.id, r.text, r.vec) for r in got) == [(1, "a", [1.0]), (2, "b", [2.0])]
    with pytest.raises(Exception, match="fit at 2"):
        logs.read_index(spark, str(tmp_path / "v"), str(tmp_path / "d")).collect()


def test_evaluation_errors(spark):
    scores = spark.createDataFrame([("f", "q1", 1), ("f", "q2", 0), ("g", "q1", None)], "file string, q string, score int")
    with pytest.raises(Exception, match="different questions"):
        evaluation.folder_pass(scores, "file", "q", "score").collect()
    row = evaluation.folder_pass(scores.where("q = 'q1'"), "file", "q", "score").first()
    assert (row.samples, row.correct, row.k, row.pass_k) == (1, 1, 2, 1.0)
    assert [tuple(r) for r in evaluation.file_pass(scores, "file", "score").orderBy("file").collect()] == [("f", 2, 1, 0.5), ("g", 1, 0, 0.0)]
    assert evaluation.folder_pass(scores.limit(0), "file", "q", "score").first().pass_k == 0.0
    assert evaluation.judge_metrics(spark.createDataFrame([], "c boolean, r int, t string"), "c", "r", "t").count() == 0
    names = spark.createDataFrame([("12AB",)], "p string").select(evaluation.contest_of(F.col("p")).alias("c"))
    assert names.first().c == 12
    for bad in ("A1", "12", "", None):
        with pytest.raises(Exception, match="not a problem"):
            spark.createDataFrame([(bad,)], "p string").select(evaluation.contest_of(F.col("p"))).collect()
    pairs = lambda a, b: spark.createDataFrame([(a, b)], "a array<int>, b array<int>").select(evaluation.strict_zip(F.col("a"), F.col("b")).alias("z")).first().z
    assert [tuple(p) for p in pairs([1, 2], [3, 4])] == [(1, 3), (2, 4)]
    with pytest.raises(Exception, match="different lengths"):
        pairs([1], [2, 3])
