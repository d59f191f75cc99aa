"""Merged training sequences and masked addresses against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from netquarry.operators import joins, masking, ordering
from netquarry.operators import sequences as sq

STEPS = "t string, s int, p array<int>, r array<int>, l array<double>, a double"


def _plain(steps):
    out, held = [], None
    for _, _, p, r, logp, a in steps:
        p, r, logp = p or [], r or [], logp or []
        if held is None or p[: len(held[0])] != held[0]:
            if held is not None:
                out.append(held)
            held = ([], [], [], [], [0])
        delta = p[len(held[0]) :]
        held[0].extend(delta + r)
        held[1].extend([0.0] * len(delta) + logp)
        held[2].extend([0.0] * len(delta) + [a] * len(r))
        held[3].extend([0] * len(delta) + [1] * len(r))
        held[4][0] += 1
    return out + [held] if held is not None else out


def _steps(seed=5):
    rng, rows = random.Random(seed), []
    for t in range(12):
        so_far = []
        for s in range(rng.randint(1, 6)):
            p = so_far + [rng.randint(0, 9) for _ in range(rng.randint(0, 3))] if rng.random() < 0.7 else [rng.randint(0, 9) for _ in range(rng.randint(0, 5))]
            r = [rng.randint(0, 9) for _ in range(rng.randint(0, 3))]
            rows.append((f"t{t}", s, p, r, [rng.random() for _ in r], float(t)))
            so_far = p + r
    return [*rows, (None, 0, None, None, None, None)]


def test_merge_equals_a_fold(spark):
    rows = _steps()
    got = {}
    for r in sq.merged(spark.createDataFrame(rows, STEPS), "t", "s", "p", "r", "l", "a").collect():
        got.setdefault(r.t, []).append((r.sequence, (r.tokens, r.logprobs, r.advantages, r["mask"], [r.steps])))
    for t in {r[0] for r in rows}:
        assert [x for _, x in sorted(got[t])] == _plain([r for r in rows if r[0] == t])


def test_shift_and_errors(spark):
    df = spark.createDataFrame([("a", 0, [1, 2], [3, 4], [-0.5, -0.25], 2.0), ("b", 0, [], [], [], 1.0)], STEPS)
    rows = {r.t: r for r in sq.shifted(sq.merged(df, "t", "s", "p", "r", "l", "a")).collect()}
    a = rows["a"]
    assert (a.input_tokens, a.target_tokens, a["mask"], a.logprobs, a.advantages) == ([1, 2, 3], [2, 3, 4], [0, 1, 1], [0.0, -0.5, -0.25], [0.0, 2.0, 2.0])
    assert rows["b"].input_tokens == rows["b"].target_tokens == []
    for bad in ([0.5], [None, 0.1]):
        df = spark.createDataFrame([("a", 0, [1], [3, 4], bad, 2.0)], STEPS)
        with pytest.raises(Exception, match="log-probabilities"):
            sq.merged(df, "t", "s", "p", "r", "l", "a").collect()


def test_padding(spark):
    a, b = F.array(*map(F.lit, [1, 2, 3])), F.array(F.lit(7))
    mask = sq.attention(b, a, 3, 2)
    row = spark.range(1).select(
        sq.pad_left(a, 5, 0).alias("l5"), sq.pad_left(a, 2, 0).alias("l2"), sq.pad_right(a, 5, 0).alias("r5"), sq.pad_right(a, 2, 0).alias("r2"),
        mask.alias("mask"), sq.positions(mask).alias("at"), sq.at_last(a, 4, F.lit(0.5)).alias("reward"), sq.at_last(a, 2, F.lit(0.5)).alias("cut"),
    ).first()
    assert (row.l5, row.l2, row.r5, row.r2) == ([0, 0, 1, 2, 3], [2, 3], [1, 2, 3, 0, 0], [1, 2])
    assert (row["mask"], row["at"]) == ([0, 0, 1, 1, 1], [0, 0, 0, 1, 2])
    assert (row.reward, row.cut) == ([0.0, 0.0, 0.5, 0.0], [0.0, 0.0])


FLOWS = [
    (3, "10.0.0.1", "10.0.0.2", "GET 10.0.0.10:8080 from 10.0.0.1, not 1.2.3.4.5 or 300.1.1.1:90"),
    (1, "10.0.0.2", None, "10.0.0.10"), (2, "", "10.0.0.1", None), (4, "host", "10.0.0.1", ""), (5, None, None, "no address :123456 :22"),
    (6, "10.0.0.1", "10.0.0.10", "10.0.0.1,10.0.0.1 a:80b end 255.255.255.255"),
]


def test_masked_addresses(spark):
    df = spark.createDataFrame([(*r, "clash") for r in FLOWS], "ts int, src string, dst string, load string, pseudonym string")
    out, names = masking.mask_addresses(df, ["ts"], ["src", "dst"], ["load"])
    known, want = {}, {}

    def name(a):
        return known.setdefault(a, f"Masked_IP_{len(known) + 1}")

    for ts, src, dst, load in sorted(FLOWS):
        src, dst = (name(x) if x else x for x in (src, dst))
        if load is not None:
            pieces, found = re.split(masking.ADDRESS, load), re.findall(masking.ADDRESS, load)
            masked = [re.sub(r":\d{2,5}\b", ":[PORT]", p) for p in pieces]
            load = "".join(p + (name(found[i]) if i < len(found) else "") for i, p in enumerate(masked))
        want[ts] = (src, dst, load)
    assert {r.ts: (r.src, r.dst, r.load) for r in out.collect()} == want
    assert {r.address: r.pseudonym for r in names.collect()} == known and out.columns == df.columns
    empty, none = masking.mask_addresses(df.limit(0), ["ts"], ["src"], ["load"])
    assert empty.count() == 0 and none.count() == 0


def test_positions_of_one_bucket_are_many_tasks(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1009).alias("v"))
    rows = ordering.global_index(df, F.lit(0), ["v"]).collect()
    assert [r.rn for r in sorted(rows, key=lambda r: r.v)] == list(range(1, 1001))


def test_as_of_across_ranges_nulls_and_ties(spark):
    rng = random.Random(2)
    left = [(i, rng.choice(["a", "b", None]), float(rng.randint(0, 300))) for i in range(200)] + [(999, "a", None)]
    right = [(i, rng.choice(["a", "a", "b"]), float(rng.randint(0, 300))) for i in range(60)]
    lhs, rhs = spark.createDataFrame(left, "id int, k string, t double"), spark.createDataFrame(right, "id int, k string, t double")
    got = {r.id: (r.r_id, r.r_t) for r in joins.nearest(lhs, rhs, ["k"], F.col("t"), F.col("t"), 5, [F.desc("r_id")]).collect()}
    want = {}
    for i, k, t in left:
        near = sorted((abs(u - t), u > t, -j, u) for j, q, u in right if q == k and t is not None and abs(u - t) <= 5)
        if near and k is not None:
            want[i] = (-near[0][2], near[0][3])
    assert got == want
    got = {r.id: r.r_t for r in joins.latest_before(lhs.where("t is not null"), rhs, ["k"], "t", "t", ["id"]).collect()}
    assert got == {i: max((u for _, q, u in right if q == k and u < t), default=None) for i, k, t in left if t is not None}
