"""Queries on answers, rewards and the remaining predicates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from netquarry.functions import rewards, text
from netquarry.operators import packets, payload
from netquarry.plans.registry import register, table


@register("countdown_reward", """
WITH x AS (SELECT o_orderkey, o_orderkey % 8 AS k, o_custkey % 9 + 2 AS a, o_orderkey % 7 + 11 AS b FROM orders)
SELECT o_orderkey, CAST(CASE WHEN k IN (0, 4) THEN 1.0 WHEN k = 3 THEN 0.0 WHEN k = 5 AND b - a = a + b THEN 1.0 WHEN k = 6 AND (a + b) % 1 = 0 AND a * b = a + b THEN 1.0 ELSE 0.1 END AS DOUBLE) AS reward FROM x""")
def countdown_reward(spark, sf):
    """Answers that must use each number once and give the target: right, too few or repeated numbers, a wrong result, no
    arithmetic, no answer (F23)."""
    k = F.col("o_orderkey") % 8
    a, b = (F.col("o_custkey") % 9 + 2).cast("string"), (F.col("o_orderkey") % 7 + 11).cast("string")
    tagged = lambda *x: F.concat(F.lit("so <answer> "), *[F.lit(y) if isinstance(y, str) else y for y in x], F.lit(" </answer>"))
    made = F.when(k == 0, tagged("(", a, " + ", b, ") * 1")).when(k == 1, tagged(a, " + ", b)).when(k == 2, tagged(a, " + ", b, " + 1 - 1"))
    made = made.when(k == 3, F.concat(a, F.lit(" + "), b)).when(k == 4, F.concat(F.lit("<answer>1</answer> Assistant: "), tagged("0"), tagged(a, " / 1 + ", b)))
    made = made.when(k == 5, tagged(b, " - ", a, " * 1")).when(k == 6, tagged(a, " * (", b, " / 1)")).otherwise(tagged("import ", a, b, " 1"))
    nums = F.array(a.cast("long"), b.cast("long"), F.lit(1).cast("long"))
    goal = a.cast("long") + b.cast("long")
    return table(spark, sf, "orders").select("o_orderkey", rewards.countdown_reward(rewards.countdown_equation(made), nums, goal).alias("reward"))


@register("answer_cascade", r"""
WITH x AS (SELECT doc_id, doc_id % 12 AS k, n_chars AS n, lang, CAST(n_chars % 900 + 1 AS VARCHAR) AS few, CAST(1900 + n_chars % 100 AS VARCHAR) AS y FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN 'f{' || n || '}' WHEN 1 THEN lang || 'x' WHEN 2 THEN 'then' WHEN 3 THEN 'March ' || (n % 28 + 1) || ', ' || y WHEN 4 THEN y WHEN 5 THEN 'Mary Ann Lee'
  WHEN 6 THEN few WHEN 7 THEN few WHEN 8 THEN 'blue ' || lang WHEN 9 THEN 'we go' WHEN 10 THEN 'no hint here at all' ELSE 'tiny' END AS answer FROM x""")  # fmt: skip
def answer_cascade(spark, sf):
    """The first extraction rule that finds an answer: each of the nine with a text that later rules would read otherwise."""
    n, lang = F.col("n_chars"), F.col("lang")
    few, year = (n % 900 + 1).cast("string"), (1900 + n % 100).cast("string")
    texts = [
        F.concat(F.lit("<think>**no**</think> \\boxed{f{"), n.cast("string"), F.lit("}} **x yz** 1999")),
        F.concat(F.lit("it is **"), lang, F.lit("x** or *other* in 1999")), F.lit("** a ** **!!** then *word*"),
        F.concat(F.lit("on March "), (n % 28 + 1).cast("string"), F.lit(", "), year, F.lit(" or 1/2/2003")),
        F.concat(F.lit("around february "), year), F.lit("we saw United States and Mary Ann Lee, 7"),
        F.concat(F.lit("all 1,234 of "), few, F.lit(" people")), F.concat(F.lit("got "), few, F.lit(" of them")),
        F.concat(F.lit("so: the answer is: blue "), lang, F.lit("! ok")), F.lit("therefore, we go. fine"), F.lit("short. no hint here at all. x"), F.lit("tiny"),
    ]
    s = F.get(F.array(*texts), (F.col("doc_id") % len(texts)).cast("int"))
    return table(spark, sf, "documents").select("doc_id", rewards.extracted(s).alias("answer"))


@register("reward_dispatch", """
WITH x AS (SELECT doc_id, doc_id % 8 AS k, n_chars AS n FROM documents),
r AS (SELECT doc_id, k, CASE k WHEN 0 THEN CAST(n % 2 = 0 AS INT) WHEN 1 THEN 1 WHEN 2 THEN CAST(n % 3 = 0 AS INT) WHEN 3 THEN 0 WHEN 4 THEN 0.5 WHEN 5 THEN 1 WHEN 6 THEN CAST(n % 2 = 0 AS INT) ELSE CAST(n % 7 = 3 AS INT) END AS reward FROM x)
SELECT doc_id, CASE k WHEN 0 THEN 'yesno' WHEN 3 THEN 'bool' WHEN 4 THEN 'text' ELSE 'math' END AS kind, CAST(reward AS DOUBLE) AS reward, CASE k WHEN 4 THEN reward >= 0.3 ELSE reward = 1 END AS "right" FROM r""")  # fmt: skip
def reward_dispatch(spark, sf):
    """Rewards by the kind of the true answer."""
    n = F.col("n_chars")
    s = n.cast("string")
    cases = [
        (F.when(n % 2 == 0, "Yes, it is.").otherwise("no"), F.lit(" yes")), (F.concat(F.lit(" "), s, F.lit(".50 %")), F.concat(s, F.lit(".5"))),
        (F.when(n % 3 == 0, "\\dfrac{1}{2} \\text{cm}").otherwise("\\frac{1}{3}"), F.lit("\\frac{1}{2}")), (F.lit("maybe"), F.lit("True")),
        (F.lit("the red car"), F.lit("a blue car")), (F.concat(F.lit("1e"), s), F.concat(F.lit("1e"), s)),
        (F.when(n % 2 == 0, "x ^2").otherwise("x^3"), F.lit("x^2")), ((n % 7).cast("string"), F.lit("$3$")),
    ]
    pick = lambda i: F.get(F.array(*[c[i] for c in cases]), (F.col("doc_id") % len(cases)).cast("int"))
    rows = table(spark, sf, "documents").select("doc_id", rewards.reward(pick(0), pick(1)).alias("r"))
    return rows.select("doc_id", "r.kind", F.round("r.reward", 6).alias("reward"), "r.right")


@register("conversation_text", """
WITH p AS (SELECT *, '10.0.0.' || user_id AS src, coalesce(props, '') AS raw FROM events)
SELECT user_id AS host, 'Session UID: ' || user_id || chr(10) || 'Protocol: tcp | Service: none' || chr(10) || min(src) || ':4000  -->  10.1.0.1:443' || chr(10) || repeat('=', 50) || chr(10) ||
  string_agg(chr(10) || '[' || strftime(ts, '%H:%M:%S.%g') || '] ' || CASE event_type WHEN 'error' THEN '10.1.0.1 <-- (' ELSE src || ' --> (' END || length(raw) || ' bytes):' || chr(10) ||
    CASE event_type WHEN 'view' THEN '[HEX ONLY]: ' || substr(hex(raw), 1, 50) || '...' ELSE raw END || chr(10) || repeat('-', 20), chr(10) ORDER BY ts, event_id) AS txt
FROM p GROUP BY 1""")  # fmt: skip
def conversation_text(spark, sf):
    """A flow with its header and its packets in order: times, senders, arrows, bytes, text or hex."""
    return _conversations(table(spark, sf, "events"))


def _conversations(events):
    raw = F.coalesce("props", F.lit(""))
    shown = F.when(F.col("event_type") == "view", "").otherwise(raw)
    packet = F.struct(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("nth"), (F.col("event_type") != "error").alias("forward"),
        F.length(raw).alias("length"), shown.alias("decoded"), F.hex(F.encode(raw, "UTF-8")).alias("hex"),
    )
    rows = events.groupBy(F.col("user_id").alias("host")).agg(F.collect_list(packet).alias("packets"))
    head = {"uid": F.col("host"), "proto": F.lit("tcp"), "service": F.lit(None).cast("string"), "src": F.concat(F.lit("10.0.0."), F.col("host").cast("string"))}
    head |= {"sport": F.lit(4000), "dst": F.lit("10.1.0.1"), "dport": F.lit(443)}
    return rows.select("host", payload.conversation(head, F.col("packets")).alias("txt"))


@register("label_from_name", """
SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 'urgent' WHEN o_orderpriority LIKE '%HIGH%' THEN 'high' WHEN regexp_matches(o_orderpriority, '^[345]') THEN 'rest' END AS label FROM orders""")
def label_from_name(spark, sf):
    """A label by ordered rules on a name."""
    p = F.col("o_orderpriority")
    label = F.when(p.rlike("URGENT"), "urgent").when(p.rlike("HIGH"), "high").when(p.rlike("^[345]"), "rest")
    return table(spark, sf, "orders").select("o_orderkey", label.alias("label"))


@register("validity_filter", """
SELECT o_orderkey, abs(l_quantity - 25) AS d FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus IS NOT NULL AND abs(l_quantity - 25) <= 3 AND l_shipdate >= o_orderdate""")
def validity_filter(spark, sf):
    """Matches whose difference is small enough."""
    d = F.abs(F.col("l_quantity") - 25)
    rows = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.where(F.col("o_orderstatus").isNotNull() & (d <= 3) & (F.col("l_shipdate") >= F.col("o_orderdate"))).select("o_orderkey", d.alias("d"))


@register("compact_filter", """
SELECT conv_id, max(turn) + 1 AS steps, max(turn) NOT IN (0, 7) AS is_valid FROM conversations GROUP BY 1 HAVING count(*) > 0""")
def compact_filter(spark, sf):
    """Trajectories marked by how they ended."""
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("steps"), F.max("turn").alias("last"))
    return rows.withColumn("is_valid", ~F.col("last").isin(0, 7)).drop("last")


@register("skill_order", """
WITH f AS (SELECT l_orderkey AS k, count(*) FILTER (l_returnflag = 'R') AS udp, count(*) FILTER (l_returnflag <> 'R') AS tcp, list([443, 80, 7003, 22, 8080, 9000][1 + l_partkey % 6]) AS ports, bool_or(l_linestatus = 'O') AS tls FROM lineitem GROUP BY 1),
q AS (SELECT *, list_has_any(ports, [443, 7003, 8443, 4433]) AS quic, list_has_any(ports, [80, 8080, 7004]) AS web, list_contains(ports, 443) AS std FROM f),
s AS (SELECT k, unnest([{'i': 0, 'skill': 'tcp', 'score': CASE WHEN tcp > 0 THEN 60 ELSE 5 END}, {'i': 1, 'skill': 'tcp_tls', 'score': CASE WHEN tcp > 0 AND tls AND NOT std THEN 75 ELSE 30 END},
  {'i': 2, 'skill': 'ws', 'score': CASE WHEN tcp > 0 AND web AND NOT tls THEN 85 ELSE 20 END}, {'i': 3, 'skill': 'wss', 'score': CASE WHEN tcp > 0 AND std AND tls THEN 95 ELSE 25 END},
  {'i': 4, 'skill': 'kcp', 'score': CASE WHEN udp > 0 AND NOT quic THEN 90 WHEN udp > 0 THEN 40 ELSE 10 END}, {'i': 5, 'skill': 'quic', 'score': CASE WHEN udp > 0 AND quic THEN 100 WHEN udp > 0 THEN 50 ELSE 5 END}]) AS x FROM q)
SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY x.score DESC, x.i) AS INT) AS pos, x.skill AS skill, x.score AS score FROM s""")  # fmt: skip
def skill_order(spark, sf):
    """Rules in a stable order by how well a capture's transport, ports and encryption fit them."""
    port = F.get(F.array(*map(F.lit, [443, 80, 7003, 22, 8080, 9000])), (F.col("l_partkey") % 6).cast("int"))
    flows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("udp"), F.count_if(F.col("l_returnflag") != "R").alias("tcp"),
        F.collect_set(port).alias("ports"), F.bool_or(F.col("l_linestatus") == "O").alias("tls"),
    )
    order = packets.skill_order(F.col("udp"), F.col("tcp"), F.col("ports"), F.col("tls"), ["tcp", "tcp_tls", "ws", "wss", "kcp", "quic"])
    rows = flows.select("k", F.posexplode(order).alias("pos", "x"))
    return rows.select("k", (F.col("pos") + 1).alias("pos"), "x.skill", "x.score")


@register("trace_query", """
SELECT event_id, user_id, event_type FROM events WHERE user_id = 8 AND event_type <> 'view' AND ts >= TIMESTAMP '2024-01-05' ORDER BY ts DESC, event_id LIMIT 20""")
def trace_query(spark, sf):
    """The latest traces of a session by type and time."""
    rows = table(spark, sf, "events").where("user_id = 8 and event_type <> 'view' and ts >= timestamp_ntz '2024-01-05 00:00:00'")
    return rows.orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", "user_id", "event_type")


@register("common_handles", """
SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'""")
def common_handles(spark, sf):
    """Handles that are in both lists."""
    o = table(spark, sf, "orders")
    return o.where("o_orderstatus = 'P'").select("o_custkey").intersect(o.where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@register("context_lookup", """
SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN '' ELSE 'plain' END AS value FROM supplier""")
def context_lookup(spark, sf):
    """Placeholders resolved from a context map."""
    k = F.col("s_suppkey") % 3
    v = F.when(k == 0, "$host").when(k == 1, "$unknown").otherwise("plain")
    ctx = F.create_map(F.lit("host"), F.col("s_name"))
    return table(spark, sf, "supplier").select("s_suppkey", text.resolved(v, ctx).alias("value"))


@register("knowledge_pick", """
WITH f AS (SELECT l_orderkey AS kb, l_partkey AS uid, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2)
SELECT kb, count(*) AS n, string_agg(CAST(uid AS VARCHAR), ',' ORDER BY pos, uid) AS uids FROM f GROUP BY 1""")
def knowledge_pick(spark, sf):
    """Nested elements of documents, distinct in order of first appearance."""
    return _picked(table(spark, sf, "lineitem"))


def _picked(lines):
    rows = lines.groupBy(F.col("l_orderkey").alias("kb"), F.col("l_partkey").alias("uid")).agg(F.min("l_linenumber").alias("pos"))
    got = rows.groupBy("kb").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("pos", "uid"))).alias("x"))
    return got.select("kb", "n", F.array_join(F.transform("x", lambda p: p["uid"].cast("string")), ",").alias("uids"))


@register("thought_blocks", r"""
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'idea ' || turn WHEN 1 THEN '<think> open ' || text WHEN 2 THEN CASE WHEN regexp_full_match(text, '\s*') THEN '' ELSE text END ELSE '' END AS thought,
  CASE turn % 4 WHEN 0 THEN role WHEN 1 THEN trim(regexp_replace('<think> open ' || text, '\s+', ' ', 'g')) WHEN 2 THEN trim(regexp_replace(text, '\s+', ' ', 'g')) ELSE '' END AS response FROM conversations""")  # fmt: skip
def thought_blocks(spark, sf):
    """Thought and response apart: a closed block, an open one, none, and a blank text."""
    k = F.col("turn") % 4
    s = F.when(k == 0, F.concat(F.lit("<think> idea "), F.col("turn").cast("string"), F.lit(" </think>\n "), F.col("role")))
    s = s.when(k == 1, F.concat(F.lit("<think> open "), F.col("text"))).when(k == 2, F.col("text")).otherwise(" \n")
    return table(spark, sf, "conversations").select("conv_id", "turn", text.think_text(s).alias("thought"), text.strip_think(s).alias("response"))
