import math
import random

from pyspark.sql import functions as F

from netquarry.functions import hashing, text, tls, vectors
from netquarry.operators import state


def _one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_hex_text_never_fails(spark):
    rows = spark.createDataFrame([("6869",), ("ff41",), ("abc",), (None,)], "h string")
    assert [r.x for r in rows.select(text.hex_to_text("h").alias("x")).collect()] == ["hi", "\\xffA", "<DECODE_ERROR: abc>", None]


def test_boxed_answers_balance_braces(spark):
    rows = spark.createDataFrame([(r"\boxed{1} \boxed{\frac{1}{2}}",), (r"\boxed{1",), ("none",)], "s string")
    assert [r.x for r in rows.select(text.last_boxed("s").alias("x")).collect()] == [r"\frac{1}{2}", None, None]


def test_community_id_known_value(spark):
    """The published example: 128.232.110.120:34855 to 66.35.250.204:80 over TCP."""
    args = lambda a, b, p, q: [F.lit(x) for x in (a, b, p, q, 6)]
    there = hashing.community_id(*args("128.232.110.120", "66.35.250.204", 34855, 80))
    back = hashing.community_id(*args("66.35.250.204", "128.232.110.120", 80, 34855))
    row = spark.range(1).select(there.alias("a"), back.alias("b")).first()
    assert row.a == row.b == "1:LQU9qZlK+B5F3KDmev6m5PMibrg="


def test_cosine_guards(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x]) if x else F.array().cast("array<double>")
    row = spark.range(1).select(
        vectors.cosine(v(1, 0), v(1, 0)).alias("a"), vectors.cosine(v(), v()).alias("b"),
        vectors.cosine(v(1), v(1, 2)).alias("c"), vectors.cosine(v(0, 0), v(1, 2)).alias("d"),
    ).first()
    assert tuple(row) == (1.0, 0.0, 0.0, 0.0)


def test_token_f1_special_answers(spark):
    f1 = lambda p, g: _one(spark, text.token_f1(F.col("p"), F.col("g")), p=p, g=g)
    assert f1("a b b", "b b c") == 2 * 2 / 6 and f1("yes", "yes it is") == 0.0 and f1("yes", "yes") == 1.0 and f1("x", "y") == 0.0


def _hello(kind, sid=b"\x01\x02", name=b"a.example"):
    sni = b"\x00\x00" + (len(name) + 5).to_bytes(2, "big") + (len(name) + 3).to_bytes(2, "big") + b"\x00" + len(name).to_bytes(2, "big") + name
    rest = b"\x00\x02\x13\x01\x01\x00" + len(sni).to_bytes(2, "big") + sni if kind == 1 else b"\x13\x01\x00"
    body = b"\x03\x03" + bytes(32) + bytes([len(sid)]) + sid + rest
    message = bytes([kind]) + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + len(message).to_bytes(2, "big") + message


def test_hello_records(spark):
    stream = _hello(1) + _hello(2) + b"\x17\x03\x03\x00\x01x"
    assert [(k, n) for k, _, _, _, n in tls.hellos(stream)] == [("client_hello", "a.example"), ("server_hello", "")]
    assert list(tls.hellos(stream[:20])) == [] and list(tls.hellos(b"")) == []
    assert tls.last_record_start(b"junk" + stream, 4 + len(_hello(1)) + 3) == 4 + len(_hello(1))
    assert tls.last_record_start(b"junk", 4) == -1
    tls.register(spark)
    rows = spark.sql(f"SELECT * FROM hello_records('{stream.hex()}')").collect()
    assert [(r.kind, r.session_id) for r in rows] == [("client_hello", "0102"), ("server_hello", "0102")]
    assert spark.sql("SELECT * FROM hello_records('zz')").count() == 0


def _cursor(flags, size=30, back=5):
    out, skip, window = [], 0, 0
    while skip < len(flags):
        part = flags[skip : skip + size]
        if True in part:
            a = part.index(True)
            b = next((k for k in range(a, len(part)) if not part[k]), len(part)) - 1
            out.append((window, skip, a + 1, b - a + 1))
            skip += b + 1
        else:
            out.append((window, skip, -1, -1))
            skip += size - back
        window += 1
    return out


def test_cursor_equals_a_loop(spark):
    r = random.Random(1)
    sets = {d: [r.random() < p for _ in range(n)] for d, p, n in (("a", 0.02, 400), ("b", 0.5, 100), ("c", 0.0, 61), ("d", 1.0, 45))}
    rows = [(d, i, f) for d, flags in sets.items() for i, f in enumerate(flags)]
    got = state.cursor_windows(spark.createDataFrame(rows, "d string, i int, f boolean"), "d", "i", "f").collect()
    for d, flags in sets.items():
        assert sorted(tuple(x)[1:] for x in got if x.d == d) == _cursor(flags)


def test_cursor_gathers_no_runs(spark):
    """Runs go on over the cuts of parts, and no row of the plan holds a dataset's runs."""
    r = random.Random(2)
    flags = [x for _ in range(60) for x in [r.random() < 0.3] * r.randint(1, 45)]
    rows = spark.createDataFrame([("a", f"{i:06d}", f) for i, f in enumerate(flags)], "d string, i string, f boolean")
    df = state.cursor_windows(rows, "d", "i", "f")
    assert sorted(tuple(x)[1:] for x in df.collect()) == _cursor(flags)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "_part" in plan


def _interval(spark, **row):
    from netquarry.functions import rewards

    base = {"susp": True, "s": 5, "dur": 3, "ts": 5, "te": 7, "labels": [0] * 10} | row
    df = spark.createDataFrame([tuple(base.values())], "susp boolean, s int, dur int, ts int, te int, labels array<int>")
    c = [F.col(x) for x in ("s", "dur", "ts", "te", "labels")]
    new = rewards.interval_reward(F.col("susp"), *c)
    old = rewards.interval_reward_by_end(c[0], c[0] + c[1] - 1, *c[2:])
    return tuple(round(x, 6) for x in df.select(new, old).first())


def test_interval_reward_of_each_branch(spark):
    assert _interval(spark) == (1.0, 1.0)
    assert _interval(spark, s=1, dur=2) == (round(-0.5 + 0.4 * math.exp(-0.6), 6),) * 2
    assert _interval(spark, s=9, dur=1) == (round(-0.9 + 0.4 * math.exp(-0.4), 6),) * 2
    assert _interval(spark, s=4, dur=5, labels=[0, 0, 0, 1, 0, 0, 0, 0]) == (round(0.5 + 0.4 * math.exp(-0.2 * 1.2), 6),) * 2
    assert _interval(spark, s=6, dur=1) == (round(0.1 + 0.4 * math.exp(-0.3 * 1.2), 6),) * 2
    assert _interval(spark, s=6, dur=4) == (round(0.8 * 2 / 5, 6), round(-0.1 + 0.2 * 2 / 5, 6))
    assert _interval(spark, susp=False) == (-1.0, 1.0)
    assert _interval(spark, s=None) == (-1.0, -1.0)
    assert _interval(spark, s=0) == (-1.0, -1.0)
    assert _interval(spark, ts=None, te=None) == (-1.0, -1.0)
    assert _interval(spark, ts=None, te=None, susp=False, s=None) == (1.0, 1.0)
    assert _interval(spark, ts=None, te=None, susp=None, s=None) == (-1.0, 1.0)


def test_discounted_return_of_a_long_trajectory(spark):
    from netquarry.operators import metrics

    steps = spark.range(9000).select(F.lit(1).alias("t"), F.col("id").alias("turn"), F.lit(1.0).alias("r"))
    got = metrics.discounted_return(steps, "t", "turn", "r", 0.9).where("turn in (0, 8999)").orderBy("turn").collect()
    assert [round(g.ret, 6) for g in got] == [10.0, 1.0]


def test_pass_at_k_counts_all_problems(spark):
    from netquarry.operators import metrics

    rows = [("a", 1, 0), ("a", 2, 1), ("b", 1, 1), ("c", 1, 0)]
    got = metrics.pass_at_k(spark.createDataFrame(rows, "p string, i int, ok int"), "p", ["i"], F.col("ok") == 1).orderBy("k").collect()
    assert [(g.k, g.n, round(g.pass_1, 4), round(g.pass_k, 4)) for g in got] == [(1, 3, 0.3333, 0.3333), (2, 1, 1.0, 0.6667)]


def test_verdict_and_heartbeat(spark):
    from netquarry.operators import packets

    rows = [(1, "x", 1, True, False, False, False), (1, "y", 2, False, True, False, False), (1, "z", 3, True, True, False, False), (2, "q", 1, True, False, False, False), (2, "p", 2, True, False, False, False)]
    df = spark.createDataFrame(rows, "case int, skill string, step int, passed boolean, hard boolean, specific boolean, aborts boolean")
    got = {g.case: (g.skill, g.confidence) for g in packets.verdict(df, "case", "skill", "step").collect()}
    assert got == {1: ("z", 1.0), 2: ("q", 0.8)}  # a hard step that fails is no hit; the first of equals wins
    beat = lambda *at: packets.heartbeat(spark.createDataFrame([(1, x) for x in at], "h int, s int"), "h", F.col("s")).collect()
    assert [(g.period, g.times) for g in beat(0, 30, 60, 61)] == [(30, 2)]
    assert beat(0, 1, 2, 3, 33, 63) == []  # the commonest gap is 1
    assert beat(0, 30) == [] and beat(0, 30, 35, 60) == []


def test_thought_confidence_bytes_and_hex(spark):
    from netquarry.functions import text

    df = spark.createDataFrame([("<think>open", "置信度 0.4", "00ff41"), (" \n", "【置信度】: .5", "zz"), ("a <think> b </think>", "0.9", "")], "t string, c string, h string")
    got = df.select(text.think_text(F.col("t")), text.confidence(F.col("c")), text.printable(F.col("h")), text.byte_position(F.try_to_binary("h", F.lit("hex")), b"\xff")).collect()
    assert [tuple(g) for g in got] == [("<think>open", 0.4, "..A", 2), ("", 0.5, "?", None), ("b", -1.0, "", 0)]


def test_expressions_of_any_length_and_depth():
    from fractions import Fraction

    from netquarry.functions.rewards import value_of

    assert value_of("+".join(["1"] * 5000)) == 5000 and value_of("(" * 3000 + "7" + ")" * 3000) == 7
    assert value_of("2 - 3 - 4 * -(5 + 1) / 8") == 2 and value_of("--3*-2") == -6 and value_of("1/3") == Fraction(1, 3)
    for bad in ("", "()", "1 +", "2 3", "(1", "1)", "07", "1/0", "2**3", "+3", "a", "1.5", "3(4)"):
        assert value_of(bad) is None
