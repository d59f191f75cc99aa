"""Queries on agent trajectories: returns, advantages, success at k, rewards, metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from netquarry.functions import rewards
from netquarry.operators import metrics, ordering, sequences
from netquarry.plans.registry import register, table

_S = "(SELECT conv_id, turn, role, length(text) % 11 / 10.0 AS reward, length(text) AS n FROM conversations)"


def _steps(spark, sf):
    n = F.length("text").cast("long")
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", (n % 11 / F.lit(10.0)).alias("reward"), n.alias("n"))


@register("discounted_return", f"""
SELECT a.conv_id, a.turn, round(sum(b.reward * power(0.9, b.turn - a.turn)), 6) AS ret FROM {_S} a JOIN {_S} b ON a.conv_id = b.conv_id AND b.turn >= a.turn GROUP BY 1, 2""")
def discounted_return(spark, sf):
    """Discounted sum of the rewards from each step on."""
    return metrics.discounted_return(_steps(spark, sf), "conv_id", "turn", "reward", 0.9).select("conv_id", "turn", F.round("ret", 6).alias("ret"))


@register("reward_shaping", f"""
SELECT conv_id, turn, round(reward + 0.5 * (reward - lag(reward, 1, reward) OVER w), 6) + 0.0 AS shaped, turn = max(turn) OVER (PARTITION BY conv_id) AS is_last,
       count(*) OVER (PARTITION BY conv_id) AS steps FROM {_S} WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")  # fmt: skip
def reward_shaping(spark, sf):
    """Reward plus a share of its rise, last-step flag and step count."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    r = F.col("reward")
    whole = Window.partitionBy("conv_id")
    shaped = r + 0.5 * (r - F.coalesce(F.lag("reward").over(w), r))
    return _steps(spark, sf).select("conv_id", "turn", (F.round(shaped, 6) + F.lit(0.0)).alias("shaped"), (F.col("turn") == F.max("turn").over(whole)).alias("is_last"), F.count(F.lit(1)).over(whole).alias("steps"))


@register("group_advantage", f"""
SELECT conv_id, turn, round(CASE WHEN count(*) OVER w = 1 THEN reward WHEN stddev_pop(reward) OVER w <= 1e-8 THEN reward - avg(reward) OVER w
       ELSE (reward - avg(reward) OVER w) / stddev_pop(reward) OVER w END, 5) AS advantage, reward AS reinforce FROM {_S} WINDOW w AS (PARTITION BY conv_id)""")  # fmt: skip
def group_advantage(spark, sf):
    """Group-centred advantages."""
    return metrics.group_advantage(_steps(spark, sf), "conv_id", "reward").select("conv_id", "turn", F.round("advantage", 5).alias("advantage"), F.col("reward").alias("reinforce"))


@register("constant_group_filter", f"""
SELECT conv_id, turn FROM {_S} WHERE conv_id IN (SELECT conv_id FROM {_S} GROUP BY 1 HAVING max(reward) > min(reward))""")
def constant_group_filter(spark, sf):
    """Groups whose rewards don't all agree."""
    return metrics.varied_groups(_steps(spark, sf), "conv_id", "reward").select("conv_id", "turn")


@register("pass_at_k", f"""
WITH r AS (SELECT conv_id % 20 AS p, row_number() OVER (PARTITION BY conv_id % 20 ORDER BY conv_id, turn) AS k, CAST(reward >= 0.8 AS INT) AS ok FROM {_S}),
f AS (SELECT p, min(k) FILTER (ok = 1) AS first FROM r GROUP BY 1)
SELECT k, count(*) AS n, round(avg(ok), 6) AS pass_1, round((SELECT count(*) FROM f WHERE first <= r.k) / (SELECT count(*) FROM f), 6) AS pass_k FROM r GROUP BY 1""")  # fmt: skip
def pass_at_k(spark, sf):
    """pass@1 of each round and pass@k."""
    rows = _steps(spark, sf).withColumn("p", F.col("conv_id") % 20)
    out = metrics.pass_at_k(rows, "p", ["conv_id", "turn"], F.col("reward") >= 0.8)
    return out.select("k", "n", F.round("pass_1", 6).alias("pass_1"), F.round("pass_k", 6).alias("pass_k"))


@register("micro_pass", f"""
WITH p AS (SELECT conv_id % 20 AS p, sum(CAST(reward >= 0.8 AS INT)) AS ok, count(*) AS n FROM {_S} GROUP BY 1)
SELECT round(sum(ok) / sum(n), 6) AS pass_1, round(avg(CAST(ok > 0 AS INT)), 6) AS pass_k, max(n) AS k FROM p""")
def micro_pass(spark, sf):
    """All right attempts by all attempts, and problems with a right one."""
    per = _steps(spark, sf).groupBy((F.col("conv_id") % 20).alias("p")).agg(F.count_if(F.col("reward") >= 0.8).alias("ok"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.round(F.sum("ok") / F.sum("n"), 6).alias("pass_1"), F.round(F.avg((F.col("ok") > 0).cast("int")), 6).alias("pass_k"), F.max("n").alias("k"))


@register("reward_stats", f"""
SELECT role, round(avg(reward), 6) AS mean, round(stddev_pop(reward), 6) AS std, round(var_pop(reward), 6) AS var, min(reward) AS lo, max(reward) AS hi, count(*) FILTER (reward = 0) AS zeros FROM {_S} GROUP BY 1""")
def reward_stats(spark, sf):
    """Mean, population deviation and variance, range (A23, A51, 1.4 item 18)."""
    r = "reward"
    return _steps(spark, sf).groupBy("role").agg(
        F.round(F.avg(r), 6).alias("mean"), F.round(F.stddev_pop(r), 6).alias("std"), F.round(F.var_pop(r), 6).alias("var"),
        F.min(r).alias("lo"), F.max(r).alias("hi"), F.count_if(F.col(r) == 0).alias("zeros"),
    )


@register("env_metrics", f"""
WITH t AS (SELECT conv_id, sum(reward) AS r, sum(n) AS n, count(*) AS steps FROM {_S} GROUP BY 1),
g AS (SELECT conv_id % 10 AS g, count(DISTINCT round(r, 6)) AS kinds, max(r) AS hi FROM t GROUP BY 1)
SELECT (SELECT round(avg(r), 6) FROM t) AS mean_return, (SELECT CAST(sum(n) AS BIGINT) FROM t) AS tokens, (SELECT round(avg(steps), 6) FROM t) AS mean_steps,
       round(count(*) FILTER (kinds = 1 AND hi > 0) / count(*), 6) AS all_good, round(count(*) FILTER (kinds = 1 AND hi <= 0) / count(*), 6) AS all_bad, round(count(*) FILTER (kinds > 1) / count(*), 6) AS mixed FROM g""")  # fmt: skip
def env_metrics(spark, sf):
    """Trajectory totals, and shares of groups that agree."""
    t = _steps(spark, sf).groupBy("conv_id").agg(F.sum("reward").alias("r"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("steps")).withColumn("one", F.lit(1))
    totals = t.groupBy("one").agg(F.round(F.avg("r"), 6).alias("mean_return"), F.sum("n").alias("tokens"), F.round(F.avg("steps"), 6).alias("mean_steps"))
    g = t.groupBy((F.col("conv_id") % 10).alias("g")).agg(F.countDistinct(F.round("r", 6)).alias("kinds"), F.max("r").alias("hi")).withColumn("one", F.lit(1))
    share = lambda c: F.round(F.count_if(c) / F.count(F.lit(1)), 6)
    one = F.col("kinds") == 1
    shares = g.groupBy("one").agg(share(one & (F.col("hi") > 0)).alias("all_good"), share(one & (F.col("hi") <= 0)).alias("all_bad"), share(~one).alias("mixed"))
    return totals.join(shares, "one").drop("one")


@register("token_metrics", f"""
WITH x AS (SELECT conv_id, turn, unnest(range(1, n % 5 + 2)) AS i, n FROM {_S}),
y AS (SELECT conv_id, turn, -1.0 / i AS old, -1.0 / (i + 1) AS new, i % 3 <> 0 AS mask FROM x)
SELECT round(avg(old - new), 6) AS kl1, round(avg(0.5 * (old - new) ** 2), 6) AS kl2, round(-avg(old), 6) AS entropy, round(exp(-avg(old)), 6) AS perplexity FROM y WHERE mask""")  # fmt: skip
def token_metrics(spark, sf):
    """Divergence, entropy and perplexity over masked token arrays."""
    i = F.sequence(F.lit(1).cast("long"), F.col("n") % 5 + 1)
    old = F.transform(i, lambda x: -1.0 / x)
    new = F.transform(i, lambda x: -1.0 / (x + 1))
    rows = _steps(spark, sf).select(F.explode(F.arrays_zip(old.alias("old"), new.alias("new"), F.transform(i, lambda x: x % 3 != 0).alias("mask"))).alias("t")).select("t.*").where("mask")
    d = F.col("old") - F.col("new")
    return rows.agg(F.round(F.avg(d), 6).alias("kl1"), F.round(F.avg(0.5 * d * d), 6).alias("kl2"), F.round(-F.avg("old"), 6).alias("entropy"), F.round(F.exp(-F.avg("old")), 6).alias("perplexity"))


@register("metric_means", """
SELECT key, count(*) AS n, round(avg(v), 6) AS mean FROM (
  SELECT 'k' AS key, CAST(json_extract(props, '$.k') AS DOUBLE) AS v FROM events UNION ALL SELECT 'value', value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_type, 1.0 * user_id FROM events) GROUP BY 1""")  # fmt: skip
def metric_means(spark, sf):
    """Mean of every key of a metric map, absent keys left out."""
    k = F.get_json_object("props", "$.k").cast("double")
    value = F.when(F.col("event_id") % 2 == 0, F.col("value"))
    m = F.create_map(F.lit("k"), k, F.lit("value"), value, F.col("event_type"), F.col("user_id").cast("double"))
    rows = table(spark, sf, "events").select(F.explode(m).alias("key", "v")).where("v is not null")
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@register("rank_sample", f"""
WITH r AS (SELECT conv_id, turn, reward, row_number() OVER (PARTITION BY conv_id ORDER BY reward, turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM {_S})
SELECT conv_id, turn FROM r WHERE n <= 4 OR k IN (0, (n - 1) // 3, 2 * (n - 1) // 3, n - 1)""")  # fmt: skip
def rank_sample(spark, sf):
    """At most four rows of each group, evenly spread over the ranks of reward."""
    rows = _steps(spark, sf).withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("reward", "turn")) - 1)
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    last = F.col("n") - 1
    spread = F.array(F.lit(0).cast("long"), F.floor(last / 3), F.floor(2 * last / 3), last)
    return rows.where((F.col("n") <= 4) | F.array_contains(spread, F.col("k").cast("long"))).select("conv_id", "turn")


@register("prefix_check", """
WITH s AS (SELECT conv_id, turn, string_split(text, ' ') AS cur FROM conversations),
p AS (SELECT *, lag(cur) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM s)
SELECT conv_id, turn, coalesce(prev IS NOT NULL AND cur[1:len(prev)] = prev, FALSE) AS is_prefix FROM p""")
def prefix_check(spark, sf):
    """Whether the step before is a prefix of this one, word by word to the end."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.split("text", " ").alias("cur"))
    rows = rows.withColumn("prev", F.lag("cur").over(Window.partitionBy("conv_id").orderBy("turn")))
    same = F.slice("cur", F.lit(1), F.size("prev")) == F.col("prev")
    return rows.select("conv_id", "turn", (F.col("prev").isNotNull() & F.coalesce(same, F.lit(False))).alias("is_prefix"))


def _merged(spark, sf, cur):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", cur.alias("cur"))
    fresh = F.coalesce(~F.startswith(F.col("cur"), F.lag("cur").over(w)), F.lit(True))
    rows = rows.withColumn("fresh", fresh.cast("int")).withColumn("seq", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("conv_id", "seq").agg(F.count(F.lit(1)).alias("steps"), F.max_by("cur", "turn").alias("merged"))


@register("prefix_merge", """
WITH p AS (SELECT conv_id, turn, text AS cur, coalesce(NOT starts_with(text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn)), TRUE) AS fresh FROM conversations),
g AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM p)
SELECT conv_id, CAST(seq AS BIGINT) AS seq, count(*) AS steps, arg_max(cur, turn) AS merged FROM g GROUP BY 1, 2""")  # fmt: skip
def prefix_merge(spark, sf):
    """Steps merged into one sequence while each whole text goes on from the one before."""
    return _merged(spark, sf, F.col("text"))


@register("task_order", """
SELECT role, min((conv_id, turn))[1] AS first_conv, row_number() OVER (ORDER BY min((conv_id, turn))) AS pos FROM conversations GROUP BY 1""")
def task_order(spark, sf):
    """Tasks in order of first appearance."""
    first = table(spark, sf, "conversations").groupBy("role").agg(F.min(F.struct("conv_id", "turn")).alias("f"))
    rows = ordering.global_index(first.select("role", "f.conv_id", "f.turn"), F.col("conv_id"), ["turn", "role"], "pos")
    return rows.select("role", F.col("conv_id").alias("first_conv"), "pos")


@register("interval_reward", """
WITH y AS (SELECT doc_id, doc_id % 11 <> 0 AS susp, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN 0 ELSE doc_id % 30 + 1 END AS s, n_chars % 9 + 1 AS dur,
             CASE WHEN doc_id % 7 <> 0 THEN doc_id * 7 % 30 + 1 END AS ts, doc_id * 7 % 30 + 1 + n_chars % 13 AS te FROM documents),
x AS (SELECT *, s + dur - 1 AS e FROM y),
p AS (SELECT *, list_sum(list_transform(range(s, e + 1), lambda i: CASE WHEN i BETWEEN ts AND te THEN 0.0 WHEN i BETWEEN 1 AND 40 AND (i * 3 + doc_id) % 4 = 0 THEN 0.2 ELSE 1.0 END)) AS pen FROM x),
q AS (SELECT *, CASE WHEN s = ts AND e = te THEN 1.0 WHEN e < ts THEN -0.5 + 0.4 * exp(-0.2 * (ts - e)) WHEN s > te THEN -0.9 + 0.4 * exp(-0.2 * (s - te))
  WHEN s <= ts AND e >= te THEN 0.5 + 0.4 * exp(-0.2 * pen) WHEN s >= ts AND e <= te THEN 0.1 + 0.4 * exp(-0.3 * ((s - ts) + 0.2 * (te - e))) END AS score,
  (least(e, te) - greatest(s, ts) + 1) / (greatest(e, te) - least(s, ts) + 1) AS iou FROM p)
SELECT doc_id, round(CASE WHEN ts IS NULL THEN CASE WHEN susp THEN -1.0 ELSE 1.0 END WHEN NOT susp OR s IS NULL OR s < 1 THEN -1.0 ELSE coalesce(score, 0.8 * iou) END, 6) AS reward,
  round(CASE WHEN s IS NULL THEN CASE WHEN ts IS NULL THEN 1.0 ELSE -1.0 END WHEN s < 1 OR ts IS NULL THEN -1.0 ELSE coalesce(score, -0.1 + 0.2 * iou) END, 6) AS by_end FROM q""")  # fmt: skip
def interval_reward(spark, sf):
    """Reward of a reported interval by its overlap with the true one: by duration, and the older form by end."""
    d, n = F.col("doc_id"), F.col("n_chars")
    labels = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: ((i * 3 + d) % 4 == 0).cast("int"))
    s = F.when(d % 13 == 0, F.lit(None)).when(d % 17 == 0, 0).otherwise(d % 30 + 1)
    rows = table(spark, sf, "documents").select(
        "doc_id", (d % 11 != 0).alias("susp"), s.alias("s"), (n % 9 + 1).alias("dur"), F.when(d % 7 != 0, d * 7 % 30 + 1).alias("ts"),
        F.when(d % 7 != 0, d * 7 % 30 + 1 + n % 13).alias("te"), labels.alias("labels"),
    )
    s, dur, ts, te = (F.col(c) for c in ("s", "dur", "ts", "te"))
    reward = rewards.interval_reward(F.col("susp"), s, dur, ts, te, F.col("labels"))
    by_end = rewards.interval_reward_by_end(s, s + dur - 1, ts, te, F.col("labels"))
    return rows.select("doc_id", F.round(reward, 6).alias("reward"), F.round(by_end, 6).alias("by_end"))


@register("percentile_rank", """
SELECT o_custkey, round(100.0 * (rank() OVER (ORDER BY total) - 1) / count(*) OVER (), 1) AS pct FROM (SELECT o_custkey, CAST(round(sum(o_totalprice)) AS BIGINT) AS total FROM orders GROUP BY 1)""")
def percentile_rank(spark, sf):
    """Share of smaller values, from counts of distinct values (A30). Totals are summed as decimals: a sum of doubles that ends
    in a half is rounded up or down by the order of its rows."""
    exact = F.sum(F.col("o_totalprice").cast("decimal(28,8)"))
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.round(exact).cast("long").alias("total"))
    counts = rows.groupBy("total").agg(F.count(F.lit(1)).alias("n"))
    coarse = F.floor(F.col("total") / 100_000)
    before = Window.partitionBy("c").orderBy("total").rowsBetween(Window.unboundedPreceding, -1)
    tops = counts.groupBy(coarse.alias("c")).agg(F.sum("n").alias("n"))
    tops = tops.select("c", F.coalesce(F.sum("n").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"), F.sum("n").over(Window.partitionBy()).alias("all"))
    ranks = counts.withColumn("c", coarse).withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0))).join(tops, "c")
    pct = F.round(100.0 * (F.col("below") + F.col("inside")) / F.col("all"), 1)
    return rows.join(ranks.select("total", pct.alias("pct")), "total").select("o_custkey", "pct")


@register("contest_rating", """
WITH c AS (SELECT o_custkey AS h, o_custkey % 5 AS contest, 800 + o_custkey % 2000 AS r, 30000 * count(*) AS points, sum(o_orderkey % 60) AS late FROM orders GROUP BY 1),
a AS (SELECT o_custkey AS h, o_orderstatus = 'F' AS ok, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders), p AS (SELECT h, min(i) AS i FROM a WHERE ok AND i < 16 GROUP BY 1),
s AS (SELECT contest, coalesce(sum(CASE WHEN i IS NULL THEN 0 WHEN h % 3 = 0 THEN 1 ELSE greatest(0, 500 * (1 + h % 4) - 50 * i) END), 0) AS score, coalesce(sum(CASE WHEN h % 3 = 0 THEN 10 * i END), 0) AS penalty FROM c LEFT JOIN p USING (h) GROUP BY 1),
k AS (SELECT contest, score, penalty, count(*) FILTER (NOT (c.points < score OR c.points = score AND c.late > penalty)) AS rank, max(r) AS most FROM c JOIN s USING (contest) GROUP BY 1, 2, 3),
g AS (SELECT contest, rank, unnest(range(1, most + 100)) AS m FROM k), e AS (SELECT contest, rank, m, 1 + sum(1 / (1 + power(10, (m - r) / 400.0))) AS seed FROM g JOIN c USING (contest) GROUP BY 1, 2, 3),
b AS (SELECT contest, max(CASE WHEN seed >= rank THEN m ELSE 0 END) AS rating FROM e GROUP BY 1)
SELECT contest, CAST(score AS BIGINT) AS score, CAST(penalty AS BIGINT) AS penalty, rank, rating, round((SELECT count(*) FILTER (r < rating) FROM c) / (SELECT count(*) FROM c) * 100, 1) AS percentile FROM k JOIN b USING (contest)""")  # fmt: skip
def contest_rating(spark, sf):
    """Score with attempts taken off, place in the standings, and the rating whose expected place is that one."""
    o = table(spark, sf, "orders")
    people = o.groupBy("o_custkey").agg((F.count(F.lit(1)) * 30000).alias("points"), F.sum(F.col("o_orderkey") % 60).alias("late"))
    people = people.select((F.col("o_custkey") % 5).alias("contest"), (F.col("o_custkey") % 2000 + 800).alias("r"), "points", "late")
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    h = F.col("o_custkey")
    worth = F.when(h % 3 != 0, 500 * (h % 4 + 1))  # some problems have no points
    tries = o.select((h % 5).alias("contest"), h.alias("problem"), worth.alias("points"), nth.alias("nth"), (F.col("o_orderstatus") == "F").alias("right"))
    return metrics.contest_ratings(tries, people, 16)


@register("difficulty_mean", """
SELECT conv_id, round(avg(TRY_CAST(CASE WHEN turn % 3 = 2 THEN 'n/a' ELSE CAST(turn + 1 AS VARCHAR) END AS DOUBLE)), 6) AS difficulty, count(*) AS asked FROM conversations GROUP BY 1""")
def difficulty_mean(spark, sf):
    """Mean of the scores that can be read."""
    raw = F.when(F.col("turn") % 3 == 2, "n/a").otherwise((F.col("turn") + 1).cast("string"))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.round(F.avg(raw.try_cast("double")), 6).alias("difficulty"), F.count(F.lit(1)).alias("asked"))


@register("class_equivalence", """
SELECT round(avg(CAST(replace(l_returnflag, 'R', 'A') = CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'N' END AS INT)), 6) AS accuracy, count(*) AS n FROM lineitem""")
def class_equivalence(spark, sf):
    """Accuracy with two classes taken for one."""
    truth = F.when(F.col("l_returnflag") == "R", "A").otherwise(F.col("l_returnflag"))
    guess = F.when(F.col("l_linenumber") % 2 == 0, "A").otherwise("N")
    return table(spark, sf, "lineitem").agg(F.round(F.avg((truth == guess).cast("int")), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@register("paired_cases", """
SELECT o_custkey, string_agg(o_orderkey || '>' || o_orderstatus, ' ' ORDER BY o_orderkey) AS cases FROM orders GROUP BY 1""")
def paired_cases(spark, sf):
    """Two parallel arrays as an array of pairs."""
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("x"))
    pairs = F.zip_with(F.col("x.o_orderkey"), F.col("x.o_orderstatus"), lambda a, b: F.concat(a.cast("string"), F.lit(">"), b))
    return rows.select("o_custkey", F.array_join(pairs, " ").alias("cases"))


_TURN_TOKENS = """
WITH w AS (SELECT conv_id, turn, role, list_transform(string_split(coalesce(text, ''), ' '), lambda x: CAST(length(x) AS INT)) AS r FROM conversations),
b AS (SELECT conv_id, turn, role, r, coalesce(flatten(list(r) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), []) AS h FROM w),
s AS (SELECT conv_id, turn, r, CASE WHEN conv_id % 3 = 0 AND turn % 3 = 2 THEN h[2:] ELSE h END AS p FROM b WHERE role = 'assistant')"""


@register("masked_sequences", _TURN_TOKENS + """,
l AS (SELECT *, lag(p || r) OVER (PARTITION BY conv_id ORDER BY turn) AS f FROM s),
x AS (SELECT *, CASE WHEN f IS NOT NULL AND p[:len(f)] = f THEN len(f) ELSE 0 END AS skip, CASE WHEN f IS NOT NULL AND p[:len(f)] = f THEN 0 ELSE 1 END AS fresh FROM l),
q AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS sequence, len(p) - skip AS m FROM x),
g AS (SELECT conv_id, sequence, count(*) AS steps, flatten(list(p[skip + 1:] || r ORDER BY turn)) AS t, flatten(list(list_transform(range(m), lambda i: 0) || list_transform(r, lambda i: 1) ORDER BY turn)) AS k,
             sum(list_sum(list_transform(r, lambda i: -i / 16.0))) AS logp, sum(len(r) * (turn + 1)) AS adv FROM q GROUP BY 1, 2)
SELECT conv_id, sequence, steps, len(t) - 1 AS n, array_to_string(t[:-2], ' ') AS inputs, array_to_string(t[2:], ' ') AS targets, array_to_string(k[2:], '') AS mask, round(logp, 6) AS logp, CAST(adv AS DOUBLE) AS adv FROM g""")  # fmt: skip
def masked_sequences(spark, sf):
    """Steps merged where a prompt goes on from all tokens before it, with masks, log-probabilities and advantages, shifted to
    inputs and targets (W16, C4). Steps are the assistant's turns, their prompts all turns before; a turn's tokens are the lengths
    of its words, and some prompts lose their first token."""
    turns = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    own = F.transform(F.split(F.coalesce("text", F.lit("")), " ", -1), lambda x: F.char_length(x))
    rows = turns.select("conv_id", "turn", "role", own.alias("r")).withColumn("h", F.flatten(F.collect_list("r").over(w)))
    cut = (F.col("conv_id") % 3 == 0) & (F.col("turn") % 3 == 2)
    held = F.when(cut, F.slice("h", F.lit(2), F.greatest(F.size("h"), F.lit(1)))).otherwise(F.col("h"))
    rows = rows.withColumn("p", held).where("role = 'assistant'")
    rows = rows.withColumns({"l": F.transform("r", lambda x: -x / F.lit(16.0)), "a": F.col("turn") + 1})
    got = sequences.shifted(sequences.merged(rows, "conv_id", "turn", "p", "r", "l", "a"))
    text_of = lambda c, sep: F.array_join(F.transform(c, lambda x: x.cast("string")), sep)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return got.select(
        "conv_id", "sequence", F.col("steps").cast("long").alias("steps"), F.size("target_tokens").cast("long").alias("n"), text_of("input_tokens", " ").alias("inputs"),
        text_of("target_tokens", " ").alias("targets"), text_of("mask", "").alias("mask"), F.round(total("logprobs"), 6).alias("logp"), total("advantages").alias("adv"),
    )
