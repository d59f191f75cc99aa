"""Answer rules, conversations, rule order and ratings against values worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from netquarry.functions import rewards, text
from netquarry.operators import metrics, packets, payload


def _all(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, s string").select("i", f(F.col("s")).alias("x"))
    return [r.x for r in rows.orderBy("i").collect()]


def test_extraction_takes_the_first_rule_that_finds(spark):
    cases = {
        r"\boxed{\frac{1}{2}} **bold** 1999": r"\frac{1}{2}",
        r"\boxed{open **bold words**": "bold words",
        "<think>**no**</think> *one two*": "one two",
        "** ! ** then 3/14/2015 or 1999": "3/14/2015",
        "in june 2001": "june 2001",
        "in February 2001": "2001",
        "New York is where Ada Byron lived, 12 years": "Ada Byron",
        "New York has 12 of 8,400,000 people": "8,400,000",
        "about 3.5 of them": "3.5",
        "the correct answer is: green! no": "green",
        "<think>all</think>": "",
        "": "",
    }
    assert _all(spark, rewards.extracted, list(cases)) == list(cases.values())
    assert _all(spark, rewards.extracted, [None, "abc. defghi. kl", "x" * 5 + "."]) == [None, "defghi", "xxxxx."]


def test_sentence_with_most_points_wins(spark):
    long = " ".join(["word"] * 20)
    assert _all(spark, rewards.extracted, [f"{long}. twenty words below. another one below"]) == ["twenty words below"]
    assert _all(spark, rewards.extracted, [long + ". " + long]) == [long]


@pytest.mark.parametrize(
    "value, kind",
    [("YES", "yesno"), (" no ", "yesno"), ("True", "bool"), ("-12", "math"), (".5", "math"), ("3/4", "math"), (r"\boxed{x}", "math"), ("$x$", "math"),
     ("1e-5", "math"), ("2.5E10", "math"), ("a < b", "math"), ("x ^ 2", "math"), ("well-known", "math"), ("a blue car", "text"), ("yes sir", "text"), ("", "text")],
)
def test_kind_of_answer(spark, value, kind):
    assert _all(spark, text.answer_kind, [value]) == [kind]


def test_search_words(spark):
    got = _all(spark, text.search_words, ["Café_1 端口x scan!", " .!", "", None])
    assert got == [["café_1", "端", "口", "x", "scan"], ["__empty__"], ["__empty__"], ["__empty__"]]


def test_conversation_shows_text_or_hex(spark):
    at = datetime.datetime(2024, 1, 1, 10, 0, 0, 1500)
    rows = [(at + datetime.timedelta(seconds=1), 2, False, 3, "", "6a" * 40), (at, 1, True, 2, "hi", "6869")]
    df = spark.createDataFrame([(rows,)], "p array<struct<ts timestamp, nth int, forward boolean, length int, decoded string, hex string>>")
    head = {k: F.lit(v) for k, v in {"uid": "C1", "proto": "tcp", "service": "ssl", "src": "a", "sport": 1, "dst": "b", "dport": 2}.items()}
    got = df.select(payload.conversation(head, F.col("p")).alias("x")).first().x.split("\n")
    assert got[:4] == ["Session UID: C1", "Protocol: tcp | Service: ssl", "a:1  -->  b:2", "=" * 50]
    assert got[4:8] == ["", "[10:00:00.001] a --> (2 bytes):", "hi", "-" * 20]
    assert got[8:] == ["", "[10:00:01.001] b <-- (3 bytes):", "[HEX ONLY]: " + "6a" * 25 + "...", "-" * 20]


def test_skill_order_breaks_ties_by_place(spark):
    df = spark.createDataFrame([(1, 5, [443], True), (0, 5, [80], False), (0, 0, [], False)], "u int, t int, p array<int>, s boolean")
    got = df.select(packets.skill_order(F.col("u"), F.col("t"), F.col("p"), F.col("s"), ["tcp", "wss", "quic", "ws", "other"]).alias("x")).collect()
    assert [[(s.skill, s.score) for s in r.x] for r in got] == [
        [("quic", 100), ("wss", 95), ("tcp", 60), ("ws", 20), ("other", 1)],
        [("ws", 85), ("tcp", 60), ("wss", 25), ("quic", 5), ("other", 1)],
        [("wss", 25), ("ws", 20), ("tcp", 5), ("quic", 5), ("other", 1)],
    ]


def test_contest_rating_by_plain_search(spark):
    people = [(1, 1000 + 37 * i, 1000 - 10 * i, i) for i in range(60)]
    tries = [(1, 1, 500, 0, False), (1, 1, 500, 1, True), (1, 2, None, 0, False), (1, 2, None, 1, False), (1, 2, None, 2, True), (1, 3, 100, 3, True), (1, 4, 90, 0, False)]
    a = spark.createDataFrame(tries, "contest int, problem int, points int, nth int, right boolean")
    b = spark.createDataFrame(people, "contest int, r int, points int, late int")
    got = metrics.contest_ratings(a, b, 3).first()
    score, penalty = 450 + 1, 20
    rank = next(i for i, p in enumerate(people) if p[2] < score or (p[2] == score and p[3] > penalty))
    place = lambda m: 1 + sum(1 / (1 + 10 ** ((m - p[1]) / 400)) for p in people)
    rating = max([0] + [m for m in range(1, people[-1][1] + 100) if place(m) >= rank])
    below = sum(p[1] < rating for p in people)
    assert (got.score, got.penalty, got["rank"], got.rating, got.percentile) == (score, penalty, rank, rating, round(below / 60 * 100, 1))


def test_features_without_packets_use_the_flow(spark):
    flows = spark.createDataFrame([("x", "a", "b", 1, 3, 10, 30, 2.0), ("y", "b", "c", 0, 0, 0, 0, 0.0)], "uid string, src string, dst string, orig_pkts int, resp_pkts int, orig_bytes int, resp_bytes int, duration double")
    lengths = spark.createDataFrame([("y", 1, 3, 2.0)], "uid string, lo int, hi int, mean double")
    got = {r.uid: [round(2.718281828459045**v - 1, 6) for v in r[1:]] for r in packets.flow_features(flows, lengths).collect()}
    assert got["x"] == [1, 1, 10, 0, 0, 0, 1, 0, 0, 1, 3, 30, 4, 2, 40, 0, 0, 10]
    assert got["y"] == [1, 0, 0, 1, 3, 30, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1, 3, 2]
