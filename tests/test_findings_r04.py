"""Faults of round 4 that showed on larger tables only."""

import pyarrow as pa
import pytest

from netquarry.sources import captures
from tests.test_captures import ETHER, TCP, _file, _ipv4
from tests.test_findings_r03 import USERS, _events, _same_as_sql


@pytest.fixture
def many(tmp_path):
    """Eight captures of 50 packets, to be cut into small stretches."""
    for k in range(8):
        _file(tmp_path / f"{k}.pcap", [(10 + n, 0.25, ETHER + b"\x08\x00" + _ipv4(6, TCP), 99) for n in range(50)], b"\xd4\xc3\xb2\xa1")
    return str(tmp_path)


def test_stretches_of_captures_are_many_tasks_work(spark, many):
    """the list of stretches is a few bytes, so adaptive execution gave all of them to one task."""
    made = captures.read_captures(spark, many, split=1 << 10).selectExpr("file", "frame", "spark_partition_id() AS task").collect()
    assert sorted((r.file, r.frame) for r in made) == [(f"{k}.pcap", n) for k in range(8) for n in range(1, 51)]
    assert len({r.task for r in made}) > 4


def test_flows_parse_each_packet_once(spark, many):
    """sums, payloads and begins of files each parsed all captures again, and payloads were broadcast by the driver where
    Spark took a few MB for hundreds."""
    flows = captures.capture_flows(captures.read_captures(spark, many, split=1 << 10))
    assert "MapInArrow" not in flows._jdf.queryExecution().optimizedPlan().toString()
    got = flows.collect()
    assert len(got) == 8 and {(r.orig_pkts, r.resp_pkts, r.ts, r.duration, r.stream_payload_decoded) for r in got} == {(50, 0, 0.0, 49.0, "hello" * 5)}
    plan = flows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") <= 1  # begins of files only


def test_conversations_over_many_captures(spark, tmp_path):
    events = _events(USERS)
    events["event_id"] = pa.array([500 * k for k in range(len(USERS))], pa.int64())
    _same_as_sql(spark, tmp_path, "capture_conversations", events=events)
