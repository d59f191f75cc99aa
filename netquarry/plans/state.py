"""Queries on state: cursors, upserts, sessions, incremental search, time windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from netquarry.durable import delete, shared_folder
from netquarry.operators import state
from netquarry.operators.keyed import KeyedTable, edges_merged
from netquarry.operators.queue import DetectionCursor, WorkQueue
from netquarry.operators.vector_search import nearest_rows
from netquarry.plans.registry import register, table

_CURSOR = """
WITH RECURSIVE r AS (SELECT user_id % 4 AS d, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS rn, event_type = 'error' AND event_id % 3 = 0 AS bad FROM events),
n AS (SELECT d, count(*) AS n FROM r GROUP BY 1), b AS (SELECT d, rn, bad FROM r),
nxt AS (SELECT d, rn, min(CASE WHEN bad THEN rn END) OVER (PARTITION BY d ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a,
               min(CASE WHEN NOT bad THEN rn END) OVER (PARTITION BY d ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z FROM b),
step AS (SELECT x.d, x.rn AS skip, CASE WHEN x.a < least(x.rn + 30, n.n) THEN x.a END AS a, least(coalesce(y.z, n.n), x.rn + 30, n.n) - 1 AS b
         FROM nxt x JOIN n USING (d) LEFT JOIN nxt y ON y.d = x.d AND y.rn = x.a),
w AS (SELECT d, 0::BIGINT AS win, skip, a, b FROM step WHERE skip = 0
      UNION ALL SELECT s.d, w.win + 1, s.skip, s.a, s.b FROM w JOIN step s ON s.d = w.d AND s.skip = CASE WHEN w.a IS NOT NULL THEN w.b + 1 ELSE w.skip + 25 END)
SELECT d AS dataset, win AS "window", skip, coalesce(a - skip + 1, -1) AS start, CASE WHEN a IS NULL THEN -1 ELSE b - a + 1 END AS duration FROM w"""


@register("cursor_fold", _CURSOR)
def cursor_fold(spark, sf):
    """Windows whose next start depends on the result before (X1, K6); detection_queue is the durable form."""
    bad = (F.col("event_type") == "error") & (F.col("event_id") % 3 == 0)
    rows = table(spark, sf, "events").select((F.col("user_id") % 4).alias("dataset"), "event_id", bad.alias("bad"))
    return state.cursor_windows(rows, "dataset", "event_id", "bad")


def _first_bad_run(window):
    """The first run of flagged rows; windows that begin at some identifiers are poisoned."""
    if window["event_id"].iloc[0] % 7 == 3:
        raise ValueError(f"no answer for {window['event_id'].iloc[0]}")
    bad = window["bad"].tolist()
    if True not in bad:
        return None
    a = bad.index(True)
    return a + 1, (bad[a:] + [False]).index(False)


@register("detection_queue", """
WITH RECURSIVE r AS (SELECT user_id % 4 AS d, event_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS rn, event_type = 'error' AND event_id % 3 = 0 AS bad FROM events),
n AS (SELECT d, count(*) AS n FROM r GROUP BY 1),
nxt AS (SELECT d, rn, event_id, min(CASE WHEN bad THEN rn END) OVER (PARTITION BY d ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a,
               min(CASE WHEN NOT bad THEN rn END) OVER (PARTITION BY d ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z FROM r),
step AS (SELECT x.d, x.rn AS skip, x.event_id, x.event_id % 7 = 3 AS poison, least(30, n.n - x.rn) AS rows,
                CASE WHEN x.a < least(x.rn + 30, n.n) AND x.event_id % 7 <> 3 THEN x.a END AS a, least(coalesce(y.z, n.n), x.rn + 30, n.n) - 1 AS b
         FROM nxt x JOIN n USING (d) LEFT JOIN nxt y ON y.d = x.d AND y.rn = x.a),
w AS (SELECT 0::BIGINT AS win, * FROM step WHERE skip = 0
      UNION ALL SELECT w.win + 1, s.* FROM w JOIN step s ON s.d = w.d AND s.skip = CASE WHEN w.a IS NOT NULL THEN w.b + 1 ELSE w.skip + 25 END)
SELECT d AS dataset, win AS "window", skip, rows, coalesce(a - skip + 1, -1) AS start, CASE WHEN a IS NULL THEN -1 ELSE b - a + 1 END AS duration,
       CASE WHEN poison THEN 'failed' ELSE 'processed' END AS status, CASE WHEN poison THEN 'ValueError: no answer for ' || event_id END AS error FROM w""")  # fmt: skip
def detection_queue(spark, sf):
    """A cursor that is stopped after five windows of each dataset, goes on from its log, and passes over windows whose
    judge raises (X2, X3, K6)."""
    bad = (F.col("event_type") == "error") & (F.col("event_id") % 3 == 0)
    rows = table(spark, sf, "events").select((F.col("user_id") % 4).alias("dataset"), "event_id", bad.alias("bad"))
    folder = shared_folder(spark)
    state.numbered(rows, "dataset", "event_id").write.parquet(f"{folder}/rows")  # numbered once for all rounds
    rows = spark.read.parquet(f"{folder}/rows")
    DetectionCursor(spark, folder, "dataset", "place").run(rows, _first_bad_run, budget=5)
    found = DetectionCursor(spark, folder, "dataset", "place").run_all(rows, _first_bad_run)
    delete(spark, f"{folder}/rows")
    return found.drop("round", "next")


def _doubled(row: dict) -> int:
    """Some rows fail at their first attempt, some at every one."""
    if row["n_chars"] % 11 == 0 and (row["attempt"] == 0 or row["n_chars"] % 3 == 0):
        raise ValueError(f"{row['n_chars']} characters")
    return 2 * row["n_chars"]


@register("work_queue", """
WITH o AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS p FROM documents),
f AS (SELECT *, CASE WHEN p <= 600 THEN 1 ELSE 0 END AS tried, n_chars % 11 = 0 AS bad FROM o),
t AS (SELECT *, row_number() OVER (PARTITION BY tried = 0 OR bad ORDER BY doc_id) AS again FROM f),
a AS (SELECT doc_id, n_chars, bad, tried + CASE WHEN (tried = 0 OR bad) AND again <= 50 THEN 1 ELSE 0 END AS attempt FROM t)
SELECT doc_id, attempt, CASE WHEN attempt = 0 THEN NULL WHEN bad AND (attempt = 1 OR n_chars % 3 = 0) THEN 'failed' ELSE 'processed' END AS status,
       CASE WHEN attempt > 0 AND bad AND (attempt = 1 OR n_chars % 3 = 0) THEN 'ValueError: ' || n_chars || ' characters' END AS error,
       CASE WHEN attempt > 0 AND NOT (bad AND (attempt = 1 OR n_chars % 3 = 0)) THEN CAST(2 * n_chars AS VARCHAR) END AS result FROM a""")  # fmt: skip
def work_queue(spark, sf):
    """Three pulls of the next 200 unprocessed documents and one of 50 that tries failed ones again; every document with its
    mark (X4, X6)."""
    docs, folder = table(spark, sf, "documents").select("doc_id", "n_chars"), shared_folder(spark)
    for _ in range(3):
        WorkQueue(spark, folder, "doc_id", "doc_id").run(docs, _doubled, 200)
    queue = WorkQueue(spark, folder, "doc_id", "doc_id")
    queue.run(docs, _doubled, 50, retry=True)
    marks = queue.marks().select("doc_id", "status", "error", "result", "attempt")
    return docs.drop("n_chars").join(marks, "doc_id", "left").withColumn("attempt", F.coalesce("attempt", F.lit(0).cast("long")))


@register("kb_upsert", """
SELECT k, arg_max(v, (fresh, seq)) AS v, arg_max(seq, (fresh, seq)) AS seq FROM (
  SELECT o_custkey AS k, o_orderstatus AS v, o_orderkey AS seq, 0 AS fresh FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_custkey, o_orderpriority, o_orderkey, 1 FROM orders WHERE o_orderkey % 5 = 1) GROUP BY 1""")  # fmt: skip
def kb_upsert(spark, sf):
    """Insert or replace by key (K2, K3, K4)."""
    o = table(spark, sf, "orders").withColumnsRenamed({"o_custkey": "k", "o_orderkey": "seq"})
    old = o.where("seq % 2 = 0").select("k", F.col("o_orderstatus").alias("v"), "seq")
    new = o.where("seq % 5 = 1").select("k", F.col("o_orderpriority").alias("v"), "seq")
    return state.upsert(old, new, "k", "seq")


@register("bucketed_upsert", """
WITH p AS (SELECT o_custkey AS k, o_orderpriority AS v, o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN 0 WHEN o_orderkey % 10 = 1 THEN 1 ELSE 2 END AS fresh FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 10 IN (1, 3)),
b AS (SELECT k, arg_max(v, (fresh, seq)) AS v, arg_max(seq, (fresh, seq)) AS seq FROM p GROUP BY 1)
SELECT k, v, seq, 3 AS versions, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderkey % 2 = 0) AS at_first FROM b""")  # fmt: skip
def bucketed_upsert(spark, sf):
    """Three upserts that rewrite touched buckets only, and the first version read again (K3, K4)."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"), F.col("o_orderkey").alias("seq"))
    t = KeyedTable(spark, shared_folder(spark), "k long, v string, seq long", "k", "seq", 16)
    for part in ("seq % 2 = 0", "seq % 10 = 1", "seq % 10 = 3"):
        t.upsert(o.where(part))
    first = t.read(0).count()
    return t.read().withColumns({"versions": F.lit(t.version() + 1), "at_first": F.lit(first).cast("long")})


@register("graph_upsert", """
SELECT l_partkey % 40 || '>' || l_suppkey % 40 AS edge, count(*) AS flows, CAST(sum(l_quantity) AS BIGINT) AS packets,
  array_to_string(list(CAST(l_orderkey AS VARCHAR) ORDER BY l_orderkey, l_linenumber)[-3:], ',') AS last3 FROM lineitem GROUP BY 1""")
def graph_upsert(spark, sf):
    """Edges of a snapshot and of two later batches: counts add up, the last three records stay."""
    li = table(spark, sf, "lineitem")
    edge = F.concat((F.col("l_partkey") % 40).cast("string"), F.lit(">"), (F.col("l_suppkey") % 40).cast("string"))
    rows = li.select(edge.alias("edge"), F.lit(1).cast("long").alias("flows"), F.col("l_quantity").cast("long").alias("packets"), F.array(F.struct(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("int").alias("n"))).alias("last"))
    t = KeyedTable(spark, shared_folder(spark), "edge string, flows long, packets long, last array<struct<o:long,n:int>>", "edge", "flows", 8)
    for k in range(3):
        t.upsert(rows.where(F.col("last")[0]["o"] % 3 == k), edges_merged("edge", ["flows", "packets"], "last"))
    last3 = F.array_join(F.transform("last", lambda x: x["o"].cast("string")), ",")
    return t.read().select("edge", "flows", "packets", last3.alias("last3"))


@register("trace_upsert", """
SELECT k, min(made) AS created_at, max(made) AS updated_at, arg_max(v, (fresh, made)) AS v FROM (
  SELECT user_id AS k, event_id AS made, event_type AS v, 0 AS fresh FROM events WHERE event_id % 2 = 0
  UNION ALL SELECT user_id, event_id, event_type, 1 FROM events WHERE event_id % 2 = 1) GROUP BY 1""")  # fmt: skip
def trace_upsert(spark, sf):
    """Replace by key, but keep when it was first made."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("created_at"), F.col("event_id").alias("updated_at"), F.col("event_type").alias("v"))
    old, new = e.where("created_at % 2 = 0"), e.where("created_at % 2 = 1")
    rows = state.upsert_keeping(old, new, "k", "created_at", "created_at")
    last = e.groupBy("k").agg(F.max("updated_at").alias("_last"))
    return rows.join(last, "k").select("k", "created_at", F.col("_last").alias("updated_at"), "v")


@register("session_traces", """
WITH j AS (SELECT event_id, user_id, unnest(['run', 'run/' || (user_id % 5), 'run/' || (user_id % 5) || '/' || event_type]) AS session FROM events),
b AS (SELECT session, count(DISTINCT event_id) AS n, min(event_id) AS first, max(event_id) AS last FROM j WHERE event_id >= 100 GROUP BY 1)
SELECT s.session, coalesce(n, 0) AS n, first, last FROM (SELECT DISTINCT session FROM j UNION SELECT 'empty') s LEFT JOIN b USING (session)""")  # fmt: skip
def session_traces(spark, sf):
    """Traces of every ancestor session since a time; sessions without any are kept."""
    e = table(spark, sf, "events")
    low = F.concat(F.lit("run/"), (F.col("user_id") % 5).cast("string"))
    chain = F.array(F.lit("run"), low, F.concat(low, F.lit("/"), F.col("event_type")))
    j = e.select("event_id", F.explode(chain).alias("session"))
    all_ = j.select("session").unionByName(spark.createDataFrame([("empty",)], "session string")).distinct()
    found = j.where("event_id >= 100").groupBy("session").agg(F.countDistinct("event_id").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    return all_.join(found, "session", "left").select("session", F.coalesce("n", F.lit(0)).alias("n"), "first", "last")


@register("incremental_search", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
p AS (SELECT a.vec_id AS q, b.vec_id AS c, round(list_dot_product(a.e, b.e), 7) AS score FROM v a JOIN v b ON b.vec_id < a.vec_id WHERE a.vec_id % 50 = 0)
SELECT q, arg_max(c, (score, -c)) AS best, count(*) AS seen FROM p GROUP BY 1""")  # fmt: skip
def incremental_search(spark, sf):
    """A stated query set searches all rows before each by the whole vector."""
    e = table(spark, sf, "embeddings")
    found = nearest_rows(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 1, digits=7, unit=False, before=True)
    return found.select("q", F.col("c").alias("best"), F.col("met").alias("seen"))


@register("attempt_ids", """
WITH i AS (SELECT (user_id % 20) || ':' || (event_id % 3) || ':' || (event_id % 2) AS id FROM events)
SELECT string_split(id, ':')[1] AS task, CAST(string_split(id, ':')[2] AS INT) AS rollout, max(CAST(string_split(id, ':')[3] AS INT)) AS last_attempt, count(*) AS n FROM i GROUP BY 1, 2""")
def attempt_ids(spark, sf):
    """Task, rollout and attempt in one key."""
    i = F.split(F.concat_ws(":", (F.col("user_id") % 20).cast("string"), (F.col("event_id") % 3).cast("string"), (F.col("event_id") % 2).cast("string")), ":")
    rows = table(spark, sf, "events").select(i[0].alias("task"), i[1].cast("int").alias("rollout"), i[2].cast("int").alias("attempt"))
    return rows.groupBy("task", "rollout").agg(F.max("attempt").alias("last_attempt"), F.count(F.lit(1)).alias("n"))


@register("ordered_fallback", """
SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'inline' WHEN length(lang) = 2 AND doc_id % 2 = 0 THEN 'late' WHEN n_chars > 0 THEN 'split' END AS method,
       CASE WHEN n_chars % 3 = 0 THEN n_chars WHEN length(lang) = 2 AND doc_id % 2 = 0 THEN doc_id WHEN n_chars > 0 THEN -n_chars END AS v FROM documents""")  # fmt: skip
def ordered_fallback(spark, sf):
    """The first of three candidates that holds (X10, J-4)."""
    n, d = F.col("n_chars"), F.col("doc_id")
    cases = [("inline", F.when(n % 3 == 0, n)), ("late", F.when((F.length("lang") == 2) & (d % 2 == 0), d)), ("split", F.when(n > 0, -n))]
    method, v = state.first_valid(cases, lambda c: c.isNotNull())
    return table(spark, sf, "documents").select("doc_id", method.alias("method"), v.alias("v"))


@register("tumbling_windows", """
SELECT epoch_us(time_bucket(INTERVAL '6 hours', ts)) // 1000000 AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_windows(spark, sf):
    """Tumbling event-time windows (streaming twin: streaming.windows)."""
    w = F.window(F.col("ts").cast("timestamp"), "6 hours")
    rows = table(spark, sf, "events").groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.unix_seconds("w.start").alias("start"), "event_type", "n", "total")


@register("session_windows", """
WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 7200000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, t, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(t) // 1000 AS start_ms, count(*) AS n FROM s GROUP BY user_id, s""")  # fmt: skip
def session_windows(spark, sf):
    """Sessions of events less than two hours apart."""
    w = F.session_window(F.col("ts").cast("timestamp"), "2 hours")
    rows = table(spark, sf, "events").groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.unix_millis("w.start").alias("start_ms"), "n")


@register("sliding_windows", """
SELECT (b + k) * 43200 AS start, count(*) AS n, round(avg(value), 9) AS mean FROM (SELECT epoch_us(ts) // 43200000000 AS b, value FROM events), (SELECT unnest([-1, 0]) AS k) GROUP BY 1""")
def sliding_windows(spark, sf):
    """Windows of a day that begin every twelve hours."""
    w = F.window(F.col("ts").cast("timestamp"), "1 day", "12 hours")
    rows = table(spark, sf, "events").groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 9).alias("mean"))
    return rows.select(F.unix_seconds("w.start").alias("start"), "n", "mean")
