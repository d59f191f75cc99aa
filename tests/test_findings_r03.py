"""Faults that showed on larger tables and odd rows only, each against the query's SQL or a plain version."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import netquarry.plans  # noqa: F401
from netquarry.plans import registry
from tests.test_queries import _rows


def _same_as_sql(spark, tmp_path, name, **tables):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t, columns in tables.items():
        pq.write_table(pa.table(columns), tmp_path / f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    found = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = _rows(names, found.fetchall())
    assert want and _rows(df.columns, df.collect()) == want


def _events(users):
    n = len(users)
    return {
        "event_id": pa.array(range(n), pa.int64()),
        "ts": pa.array([i * 1_234_567 for i in range(n)], pa.timestamp("us")),
        "user_id": pa.array(users, pa.int64()),
        "event_type": [("click", "view", "error")[i % 3] for i in range(n)],
        "value": pa.array([float(i % 17) for i in range(n)], pa.float64()),
        "props": ["{}"] * n,
    }


#: Over a byte, and with ports over 16 bits.
USERS = [7, 30, 255, 256, 258, 300, 1010, 25_535, 25_536, 25_600, 90_000] * 4


@pytest.mark.parametrize("name", ["capture_packets", "capture_conversations"])
def test_captures_of_users_with_large_numbers(spark, tmp_path, name):
    _same_as_sql(spark, tmp_path, name, events=_events(USERS))


def test_capture_subset_of_users_with_large_numbers(spark, tmp_path):
    _same_as_sql(spark, tmp_path, "capture_subset", events=_events([2, 9, 253, 254, 256, 261, 1010, 30_004, 70_002, 3] * 4))


def test_hellos_with_reserved_ciphers(spark, tmp_path):
    keys = [6682, 10794, 14906, 43690, 2570, 17, 49_999, 52_570]
    orders = {"o_orderkey": pa.array(range(len(keys)), pa.int64()), "o_custkey": pa.array(keys, pa.int64())}
    _same_as_sql(spark, tmp_path, "hello_scan", orders=orders)


def test_bytes_inside_a_record_begin_none():
    from netquarry.functions.tls import last_record_start

    record = b"\x16\x03\x01\x00\x30\x01" + b"\x00" * 10 + b"\x16\x03\x03" + b"\x07" * 34
    assert len(record) == 53
    assert last_record_start(b"\xff" * 4 + record, 24) == 4
    assert last_record_start(b"\xff" * 4 + record + record[:20], 60) == 57  # the second one is cut off
    assert last_record_start(record[:30], 20) == 16  # of a record that isn't whole the end isn't known


def test_percentiles_of_totals_that_end_in_a_half(spark, tmp_path):
    """Of each total's doubles one order of adding gives .5, another one a bit less; the exact sums are equal."""
    r, groups = random.Random(5), []

    def plain(cents):
        total = 0.0
        for c in cents:
            total += c / 100
        return int(total + 0.5)

    for _ in range(2000):
        cents = [r.randint(100_191, 49_999_318) for _ in range(9)]
        cents.append(100_000 + (50 - sum(cents)) % 100)
        if plain(sorted(cents)) != plain(sorted(cents, reverse=True)):
            groups += [sorted(cents), sorted(cents, reverse=True)]
    assert len(groups) > 20
    rows = [(k, c / 100) for k, g in enumerate(groups) for c in g]
    pq.write_table(pa.table({"o_custkey": pa.array([k for k, _ in rows], pa.int64()), "o_totalprice": [p for _, p in rows]}), tmp_path / "orders.parquet")
    got = {x.o_custkey: x.pct for x in registry.QUERIES["percentile_rank"](spark, str(tmp_path)).collect()}
    totals = [(sum(round(p * 100) for p in [c / 100 for c in g]) + 50) // 100 for g in groups]
    assert got == {k: round(100 * sum(x < t for x in totals) / len(totals), 1) for k, t in enumerate(totals)}


def test_plain_hex_stays_out_of_python(spark):
    """Of whole texts only what Spark can't decode may reach a Python worker."""
    from netquarry.functions import text

    values = ["6869", "c3a9", "ff41", "abc", "6", "", "68 69", "edA080", "zz", "f09f9880", None]

    def plain(v):
        try:
            return None if v is None else bytes.fromhex(v).decode("utf-8", "backslashreplace")
        except ValueError:
            return f"<DECODE_ERROR: {v}>"

    rows = spark.createDataFrame([(v,) for v in values], "h string")
    assert [r.x for r in rows.select(text.hex_to_text(rows.h).alias("x")).collect()] == [plain(v) for v in values]
    plan = rows.select(text.hex_to_text(rows.h).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    udf = plan[plan.index("_escaped_hex(") :]
    assert udf.startswith("_escaped_hex(CASE WHEN") or "is_valid_utf8" in plan


def test_bm25_in_rounds_makes_no_postings(spark, monkeypatch):
    """Many query tokens are met in rounds of queries: the same rows, and no (query, document) pair is joined by token."""
    from netquarry.operators import retrieval

    r = random.Random(4)
    rows = [(i, r.choices([f"w{j}" for j in range(40)], k=r.randint(1, 12))) for i in range(150)]
    docs = spark.createDataFrame(rows, "d long, ts array<string>")
    found = lambda: retrieval.bm25(docs, docs, "d", "d", "ts", 3, itself=False)
    once = sorted(map(tuple, found().collect()))
    monkeypatch.setattr(retrieval, "MOST_TERMS", 1)
    monkeypatch.setattr(retrieval, "PIECE", 16)
    monkeypatch.setattr(retrieval, "LEAST_ROUND", 60)
    again = found()
    assert sorted(map(tuple, again.collect())) == once
    plan = again._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3 and "sum((w" not in plan


def test_word_overlap_gives_every_pair(spark, tmp_path):
    documents = {"doc_id": pa.array([0, 1, 40], pa.int64()), "text": ["red blue", "net", None]}
    benchmark = {"item_id": pa.array([0, 40, 80, 1], pa.int64()), "text": ["blue key", "red blue", "", "port"]}
    _same_as_sql(spark, tmp_path, "word_overlap", documents=documents, benchmark=benchmark)
    got = {(r.doc_id, r.item_id): (r.overlap, r.equal) for r in registry.QUERIES["word_overlap"](spark, str(tmp_path)).collect()}
    assert len(got) == 7 and got[0, 40] == (2, True) and got[0, 0] == (1, False)


def test_best_scores_sort_no_pairs_and_put_missing_ones_last(spark, tmp_path):
    """pairs were sorted for their least (score, uid), which spilled; a missing score came before any other."""
    tables = {"events": _events([1, 11, 21, 31, 2, 12] * 20)}
    tables["events"]["value"] = pa.array([None if i % 7 == 0 else float(i % 3) for i in range(120)], pa.float64())
    tables["events"]["ts"] = pa.array([i // 12 * 200_000_000 for i in range(120)], pa.timestamp("us"))
    _same_as_sql(spark, tmp_path, "anchor_match", **tables)
    plan = registry.QUERIES["anchor_match"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_profiles_of_batches_in_any_order_with_nulls(spark, monkeypatch):
    """46 aggregates with seven exact medians fell back to sorting, row by row; profiles are now made in arrays."""
    from statistics import median, pstdev

    from netquarry.operators import packets

    r = random.Random(13)
    monkeypatch.setattr(packets, "_CHUNK", 64)
    some = lambda x: None if r.random() < 0.1 else x
    names = [*packets.MEASURES, "resp_p", "orig_p", "orig_h", "resp_h", "proto"]
    rows = [
        (None if b == 7 else b, *[some(float(r.randint(0, 9))) for _ in range(5)], some(str(r.choice([53, 22, 1024, 60000]))), some(r.randint(0, 70000)), some(r.choice("ab")), some(r.choice("xyz")), some(r.choice(["TCP", "udp", "icmp"])))
        for b in range(12) for _ in range(r.choice([1, 2, 30, 31, 100]))
    ]
    r.shuffle(rows)
    schema = "batch long, " + ", ".join(f"{c} {'double' if c in packets.MEASURES else 'int' if c == 'orig_p' else 'string'}" for c in names)
    made = packets.batch_profile(spark.createDataFrame(rows, schema), "batch")
    got = {g.batch: g.v for g in made.collect()}
    assert len(got) == 12 == made.count()
    for b in got:
        own = [x[1:] for x in rows if x[0] == b]
        n = len(own)
        column = {c: [x[k] for x in own] for k, c in enumerate(names)}
        for c in names[:7]:
            column[c] = [int(x or 0) if c.endswith("_p") else x or 0.0 for x in column[c]]
        ports = [column["resp_p"], column["orig_p"]]
        v = [y for c in names[:7] for x in [column[c]] for y in (max(x), min(x), median(x), pstdev(x))]
        for p in ports:
            v += [sum(lo <= x <= hi for x in p) / n for lo, hi in packets.PORT_BINS] + [sum(x in packets.RISK_PORTS for x in p) / n]
        v += [len({x or "" for x in column[c]}) / n for c in ("orig_h", "resp_h")]
        sent, back = sum(column["orig_bytes"]), sum(column["resp_bytes"])
        v += [sent / (sent + back + 1)] + [sum((x or "").lower() == k for x in column["proto"]) / n for k in ("tcp", "udp")]
        v += [len(set(p)) / n for p in ports] + [max(map(p.count, p)) / n for p in ports] + [sum(x == 53 for x in ports[0]) / n]
        norm = sum(x * x for x in v) ** 0.5
        assert got[b] == pytest.approx([x / norm if norm else x for x in v], abs=1e-12)
    assert "Aggregate" not in made._jdf.queryExecution().executedPlan().toString()


def test_windows_inside_a_range_need_no_shuffle(spark):
    from pyspark.sql import functions as F

    from netquarry.operators import ordering

    inside, across = ordering.count_windows(spark.range(1000).withColumn("k", F.col("id") * 7 % 1000), F.lit(0), ["k"], 30)
    assert inside._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1  # the counts of the ranges
    a, b = ([(x.batch, x.k) for x in df.select("batch", "k").collect()] for df in (inside, across))
    assert sorted(a + b) == [(k // 30, k) for k in range(1000)]
    assert len(a) > len(b) and not {x for x, _ in a} & {x for x, _ in b} and all(len([1 for y, _ in a if y == x]) == 30 for x, _ in a)
