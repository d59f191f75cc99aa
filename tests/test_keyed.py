"""The keyed table: only touched buckets are rewritten, and a killed upsert changes nothing."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_streaming import _stream

from netquarry.operators.keyed import KeyedTable

SCHEMA = "k string, v string, seq int"


def _rows(t):
    return sorted(map(tuple, t.read().collect()), key=str)


def test_upserts_rewrite_what_they_touch(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "k", "seq", 8)
    assert t.version() is None and _rows(t) == []
    t.upsert(make(*[(f"k{i}", "a", i) for i in range(40)], (None, "n", 1)))
    t.upsert(make(("k1", "b", 0), ("k1", "c", 5), (None, "m", 0)))
    want = sorted([(f"k{i}", "a", i) for i in range(40) if i != 1] + [("k1", "c", 5), (None, "m", 0)], key=str)
    assert _rows(t) == want and len(list(Path(tmp_path / "t/rows/version=1").glob("bucket=*"))) <= 2
    assert t.read(0).count() == 41
    assert t.upsert(make()) == 2 and _rows(t) == want
    assert KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "k", "seq").buckets == 8  # fixed at the first write


def test_a_killed_upsert_leaves_the_last_version(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "k", "seq", 4)
    t.upsert(spark.createDataFrame([("a", "1", 1)], SCHEMA))
    bad = spark.createDataFrame([("a", "2", 2), ("b", "2", 2)], SCHEMA).withColumn("v", F.when(F.col("k") == "b", F.raise_error(F.lit("killed"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="killed"):
        t.upsert(bad)
    assert _rows(t) == [("a", "1", 1)] and t.version() == 0
    assert t.upsert(spark.createDataFrame([("a", "2", 2)], SCHEMA)) == 1 and _rows(t) == [("a", "2", 2)]


def test_a_stream_retries_and_starts_again(spark, tmp_path):
    schema = "k string, v string, seq int, sessions array<string>"
    frames = [[("a", "1", 1, ["s"])], [("a", "2", 2, ["s"]), ("b", "1", 2, ["t"])], [("c", "1", 3, ["s"])]]
    df = _stream(spark, str(tmp_path / "in"), frames, schema)
    t, failures = KeyedTable(spark, str(tmp_path / "t"), schema, "k", "seq", 4), {1: 2, 2: 3}
    plain = t._latest

    def merge(old, new):
        number = (t.version() if t.version() is not None else -1) + 1
        if failures.get(number, 0):
            failures[number] -= 1
            raise OSError("away")
        return plain(old, new)

    start = lambda: t.stream(df, str(tmp_path / "ck"), merge=merge, required="sessions").awaitTermination()
    with pytest.raises(Exception, match="away"):  # the third batch fails three times
        start()
    assert sorted((r.k, r.v) for r in t.read().collect()) == [("a", "2"), ("b", "1")]
    start()
    assert sorted((r.k, r.v) for r in t.read().collect()) == [("a", "2"), ("b", "1"), ("c", "1")] and t.version() == 2


def test_rows_that_could_not_be_found_again_are_an_error(spark, tmp_path):
    schema = "k string, v string, seq int, sessions array<string>"
    df = _stream(spark, str(tmp_path / "in"), [[("a", "1", 1, None)]], schema)
    t = KeyedTable(spark, str(tmp_path / "t"), schema, "k", "seq", 4)
    with pytest.raises(Exception, match="missing sessions: a"):
        t.stream(df, str(tmp_path / "ck"), required="sessions").awaitTermination()
    assert t.version() is None
