import pytest
from pyspark.sql import functions as F

from netquarry.functions import text
from netquarry.functions.rewards import value_of
from netquarry.operators import tools

PACKETS = "frame long, t double, src string, dst string, len long, payload_hex string"


@pytest.fixture
def packets(spark):
    rows = [(i, 30.0 * i, "a", "b", 60, "160301ff") for i in range(6)] + [(10 + i, 1.0 + i / 10, "b", "a", 1400, "00") for i in range(40)]
    return spark.createDataFrame(rows, PACKETS)


def test_tools_by_name(packets):
    assert tools.run("heartbeat", packets).first().period == 30
    assert tools.run("conversations", packets).first().asDict()["frames_ba"] == 40
    assert {r.ip: r.frames for r in tools.run("endpoints", packets).collect()} == {"a": 46, "b": 46}
    assert tools.run("byte_pattern", packets, {"pattern": "0301"}).count() == 6
    assert tools.run("byte_pattern", packets, {"pattern": "6030"}).count() == 0  # not on a byte border
    assert tools.run("list_packets", packets, {"src": "$host", "n": 3}, {"host": "b"}).count() == 3
    assert tools.run("list_packets", packets, {"src": "$nobody"}).count() == 0
    assert tools.run("capture_info", packets).first().n == 46
    assert {r.bucket: r.n for r in tools.run("size_buckets", packets).collect()} == {"40-79": 6, "1280-2559": 40}
    assert tuple(tools.run("session_span", packets, {"long": 100}).first()) == (150.0, True)
    ratio = tools.run("direction_ratio", packets, {"a": "a", "b": "$peer"}, {"peer": "b"}).first()
    assert (ratio.ab, ratio.ba, ratio.suspect) == (360.0, 56000.0, True)
    stacks = packets.withColumn("protocols", F.when(F.col("len") > 100, "eth:ip:udp").otherwise("eth:ip:tcp:tls"))
    assert {r.path: (r.frames, r.bytes) for r in tools.run("protocol_hierarchy", stacks).collect()}["eth:ip"] == (46, 56360)
    two = packets.withColumn("file", F.lit("x")).unionByName(packets.withColumn("file", F.lit("y")))
    assert {(r.file, r.period) for r in tools.run("heartbeat", two).collect()} == {("x", 30), ("y", 30)}
    assert tools.run("client_hellos", packets).count() == 0 and tools.run("quic", packets).count() == 0
    with pytest.raises(ValueError):
        tools.run("none", packets)


def test_rules_and_names(spark):
    rows = [("[1, 5]", 3.0, True), ("[1,5]", 6.0, False), ("≈ 10", 12.5, True), ("≈10", 14.0, False), ("> 3", 3.5, True), ("> 3", None, False), ("few", 1.0, False), (None, 1.0, False)]
    df = spark.createDataFrame(rows, "rule string, x double, ok boolean")
    assert df.where(text.expected(F.col("rule"), F.col("x")) != F.col("ok")).isEmpty()
    names = spark.createDataFrame([(["a.example.com"], False), (["a.example.com", "b.org"], True), ([], False), (None, False)], "n array<string>, odd boolean")
    assert names.where(text.foreign_names(F.col("n"), ["example"]) != F.col("odd")).isEmpty()


def test_equations_are_read_not_run():
    assert value_of("(1 + 2) * 3 / -2") == -4.5
    assert [value_of(x) for x in ("__import__('os')", "2 ** 9", "1 / 0", "1 +", "a", "1.5", "(" * 999)] == [None] * 7
