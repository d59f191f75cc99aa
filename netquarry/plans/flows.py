"""Queries on flows: export, paging, labelling joins, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from netquarry.operators import joins, metrics, ordering, packets, payload
from netquarry.plans.registry import register, table

PACKET_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_SECONDS = "unix_micros(cast(ts as timestamp)) / 1e6"


def _events(spark, sf):
    """events as flows: uid, ts (epoch seconds), host, kind, bytes."""
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("uid"), F.expr(_SECONDS).alias("ts"), F.col("user_id").alias("host"), F.col("event_type").alias("kind"), F.col("value").alias("bytes"))


_E = "(SELECT event_id AS uid, epoch_us(ts) / 1e6 AS ts, user_id AS host, event_type AS kind, value AS bytes FROM events)"


def _by_day(flows):
    return ordering.global_index(flows, F.floor(F.col("ts") / 86400), ["ts", "uid"])


@register("flow_export", r"""
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
                  concat_ws(':', l_returnflag, l_linestatus, CAST(l_partkey AS VARCHAR), ' ') AS txt FROM lineitem),
q AS (SELECT *, coalesce(sum(length(txt)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sofar FROM p),
g AS (SELECT l_orderkey, count(*) AS packets,
             string_agg(txt, '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) FILTER (sofar < 40) AS s FROM q GROUP BY 1)
SELECT o_orderkey AS uid, o_custkey AS host, coalesce(packets, 0) AS packets,
       coalesce(CASE WHEN length(s) > 40 THEN substr(s, 1, 40) || '...[TRUNCATED]' ELSE s END, '') AS payload
FROM orders LEFT JOIN g ON o_orderkey = l_orderkey""")  # fmt: skip
def flow_export(spark, sf):
    """Flows left-joined with their ordered payload, cut at a running length."""
    text = F.concat_ws(":", "l_returnflag", "l_linestatus", F.col("l_partkey").cast("string"), F.lit(" "))
    packets = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "uid")
    got = payload.flow_payload(packets, "uid", PACKET_ORDER, text, 40)
    flows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_custkey").alias("host"))
    out = flows.join(got, "uid", "left")
    return out.select("uid", "host", F.coalesce("packets", F.lit(0)).alias("packets"), F.coalesce("payload", F.lit("")).alias("payload"))


@register("stream_directions", r"""
SELECT l_orderkey AS uid,
  coalesce(string_agg(CAST(l_partkey AS VARCHAR), '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) FILTER (l_returnflag = 'N'), '') AS out,
  coalesce(string_agg(CAST(l_partkey AS VARCHAR), '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) FILTER (l_returnflag <> 'N'), '') AS back
FROM lineitem GROUP BY 1""")  # fmt: skip
def stream_directions(spark, sf):
    """Both directions of each flow put together in order."""
    rows = table(spark, sf, "lineitem").withColumn("uid", F.col("l_orderkey")).withColumn("part", F.col("l_partkey").cast("string"))
    return payload.directions(rows, "uid", PACKET_ORDER, "part", F.col("l_returnflag") == "N")


@register("nested_lookup", r"""
SELECT c_custkey AS host, count(o_orderkey) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey), '') AS flows
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")  # fmt: skip
def nested_lookup(spark, sf):
    """Left outer lookup with a nested array of matches."""
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("found"))
    rows = table(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    keys = F.transform("found", lambda x: x["o_orderkey"].cast("string"))
    return rows.select(F.col("c_custkey").alias("host"), F.when(F.col("found").isNull(), 0).otherwise(F.size("found")).cast("long").alias("n"), F.coalesce(F.array_join(keys, ","), F.lit("")).alias("flows"))


@register("last_payload", r"""
SELECT o_orderkey AS uid, arg_max(l_partkey, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS part
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")  # fmt: skip
def last_payload(spark, sf):
    """The last packet of each flow wins."""
    last = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct(*PACKET_ORDER)).alias("part"))
    return table(spark, sf, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("uid"), "part")


@register("page_window", f"""
SELECT uid, ts, rn, rn - 60 AS batch_index FROM (SELECT uid, ts, row_number() OVER (ORDER BY ts, uid) AS rn FROM {_E}) WHERE rn BETWEEN 61 AND 90""")
def page_window(spark, sf):
    """Sorted page with a 1-based index in the batch."""
    return ordering.page(_by_day(_events(spark, sf)).select("uid", "ts", "rn"), 60, 30)


@register("overlap_windows", f"""
WITH r AS (SELECT uid, bytes, row_number() OVER (ORDER BY ts, uid) AS rn FROM {_E})
SELECT w AS window_id, count(*) AS n, min(uid) AS first_uid, round(sum(bytes), 4) AS bytes
FROM r, range(0, 1000000) AS t(w) WHERE w <= (SELECT (max(rn) - 1) // 25 FROM r) AND rn - 1 >= w * 25 AND rn - 1 < w * 25 + 30 GROUP BY 1""")  # fmt: skip
def overlap_windows(spark, sf):
    """Windows of 30 rows that begin every 25 rows."""
    rows = ordering.overlapping_windows(_by_day(_events(spark, sf)))
    return rows.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("first_uid"), F.round(F.sum("bytes"), 4).alias("bytes"))


@register("ne_missing", "SELECT doc_id, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS DISTINCT FROM 1")
def ne_missing(spark, sf):
    """Not equal, rows without the field included."""
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return rows.where(~F.col("toxic").eqNullSafe(F.lit(1))).select("doc_id", "toxic")


@register("exists_filter", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def exists_filter(spark, sf):
    """Rows that have the field (P5)."""
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return rows.where(F.col("quality").isNotNull()).select("doc_id", "quality")


@register("predicate_lookup", f"""
SELECT uid, host, kind, bytes FROM {_E} WHERE kind IN ('view', 'click', 'error') AND bytes BETWEEN 5 AND 20 AND host <> 8 AND regexp_matches(kind, '[ve]')""")
def predicate_lookup(spark, sf):
    """Equality, membership, range and pattern predicates, pushed into the scan where Spark can."""
    rows = _events(spark, sf)
    ok = F.col("kind").isin("view", "click", "error") & F.col("bytes").between(5, 20) & (F.col("host") != 8) & F.col("kind").rlike("[ve]")
    return rows.where(ok).select("uid", "host", "kind", "bytes")


@register("element_match", """
SELECT o_custkey AS host, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 7) GROUP BY 1""")
def element_match(spark, sf):
    """Flows with an element that matches, in a nested array."""
    nested = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    hit = nested.where(F.exists("parts", lambda p: p == 7))
    rows = table(spark, sf, "orders").join(hit, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return rows.groupBy(F.col("o_custkey").alias("host")).agg(F.count(F.lit(1)).alias("n"))


@register("endpoint_pairs", """
SELECT least(l_partkey % 50, l_suppkey % 50) AS a, greatest(l_partkey % 50, l_suppkey % 50) AS b, count(*) AS n, CAST(round(sum(l_quantity)) AS BIGINT) AS bytes
FROM lineitem GROUP BY 1, 2""")  # fmt: skip
def endpoint_pairs(spark, sf):
    """Endpoint pairs whichever way round."""
    p, s = F.col("l_partkey") % 50, F.col("l_suppkey") % 50
    rows = table(spark, sf, "lineitem").groupBy(F.least(p, s).alias("a"), F.greatest(p, s).alias("b"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity")).cast("long").alias("bytes"))


@register("candidate_flows", """
SELECT o_orderkey AS uid, o_custkey % 10 = 3 AS by_port, l.k IS NOT NULL AS by_log FROM orders
LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_discount > 0.09) l ON o_orderkey = k WHERE o_custkey % 10 = 3 OR l.k IS NOT NULL""")  # fmt: skip
def candidate_flows(spark, sf):
    """Flows that a port or another log's row speaks for."""
    log = table(spark, sf, "lineitem").where("l_discount > 0.09").select(F.col("l_orderkey").alias("k")).distinct()
    rows = table(spark, sf, "orders").join(log, F.col("o_orderkey") == F.col("k"), "left")
    by_port, by_log = F.col("o_custkey") % 10 == 3, F.col("k").isNotNull()
    return rows.where(by_port | by_log).select(F.col("o_orderkey").alias("uid"), by_port.alias("by_port"), by_log.alias("by_log"))


@register("top_large_flows", """
SELECT l_orderkey AS uid, l_linenumber, greatest(l_extendedprice, l_quantity * 3000) AS size FROM lineitem
ORDER BY size DESC, l_orderkey, l_linenumber, l_partkey LIMIT 5""")  # fmt: skip
def top_large_flows(spark, sf):
    """The five largest by the larger of two measures."""
    size = F.greatest("l_extendedprice", F.col("l_quantity") * 3000)
    rows = table(spark, sf, "lineitem").withColumn("size", size)
    return rows.orderBy(F.desc("size"), "l_orderkey", "l_linenumber", "l_partkey").limit(5).select(F.col("l_orderkey").alias("uid"), "l_linenumber", "size")


@register("longest_texts", """
SELECT lang, doc_id, n_chars, rank FROM (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 15""")
def longest_texts(spark, sf):
    """The 15 longest of each group (T5)."""
    return ordering.top_k(table(spark, sf, "documents").select("lang", "doc_id", "n_chars"), ["lang"], [F.desc("n_chars"), F.col("doc_id")], 15)


@register("seeded_shuffle", "SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS pos FROM documents")
def seeded_shuffle(spark, sf):
    """A reproducible permutation."""
    return ordering.hash_rank(table(spark, sf, "documents").select("doc_id"), "doc_id", 42)


@register("hash_stages", """
SELECT doc_id, CASE WHEN pos < 50 THEN 'test' WHEN pos < 100 THEN 'stage1' WHEN pos < 150 THEN 'stage2' ELSE 'train' END AS stage
FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS pos FROM documents)""")  # fmt: skip
def hash_stages(spark, sf):
    """Disjoint random stages and a test split."""
    rows = ordering.hash_rank(table(spark, sf, "documents").select("doc_id"), "doc_id", 7)
    stage = F.when(F.col("pos") < 50, "test").when(F.col("pos") < 100, "stage1").when(F.col("pos") < 150, "stage2").otherwise("train")
    return rows.select("doc_id", stage.alias("stage"))


@register("repeat_rows", "SELECT item_id, rep, item_id * 3 + rep - 1 AS pos FROM benchmark, range(1, 4) AS t(rep)")
def repeat_rows(spark, sf):
    """Each row n times, adjacent."""
    rows = table(spark, sf, "benchmark").select("item_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("rep"))
    return rows.withColumn("pos", F.col("item_id") * 3 + F.col("rep") - 1)


@register("full_batches", f"""
WITH r AS (SELECT uid, bytes, row_number() OVER (ORDER BY ts, uid) AS rn FROM {_E})
SELECT (rn - 1) // 64 AS batch, count(*) AS n, round(avg(bytes), 9) AS mean_bytes FROM r GROUP BY 1 HAVING count(*) = 64""")  # fmt: skip
def full_batches(spark, sf):
    """Batches of a fixed size, the last one only if full."""
    rows = _by_day(_events(spark, sf)).withColumn("batch", F.floor((F.col("rn") - 1) / 64))
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("bytes"), 9).alias("mean_bytes")).where("n = 64")


@register("window_samples", f"""
WITH r AS (SELECT uid, row_number() OVER (ORDER BY ts, uid) AS rn FROM {_E}), n AS (SELECT count(*) AS n FROM {_E}),
s AS (SELECT k AS sample, CAST(('0x' || substr(md5('s' || k), 1, 7)) AS BIGINT) % (n - 30 + 1) AS start FROM range(0, 8) AS t(k), n)
SELECT sample, start, min(uid) AS first_uid, count(*) AS n FROM s JOIN r ON rn > start AND rn <= start + 30 GROUP BY 1, 2""")  # fmt: skip
def window_samples(spark, sf):
    """Eight windows of 30 rows at hashed places."""
    rows = _by_day(_events(spark, sf)).select("uid", "rn")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    h = F.conv(F.substring(F.md5(F.concat(F.lit("s"), F.col("sample").cast("string"))), 1, 7), 16, 10).cast("long")
    starts = spark.range(8).select(F.col("id").alias("sample"), F.lit(1).alias("one")).join(total.withColumn("one", F.lit(1)), "one")
    starts = starts.select("sample", (h % (F.col("total") - 30 + 1)).alias("start"))
    wanted = starts.withColumn("rn", F.explode(F.sequence(F.col("start") + 1, F.col("start") + 30)))
    return rows.join(F.broadcast(wanted), "rn").groupBy("sample", "start").agg(F.min("uid").alias("first_uid"), F.count(F.lit(1)).alias("n"))


@register("union_all", """
SELECT 'doc' AS origin, doc_id AS id, lang, length(text) AS n FROM documents UNION ALL SELECT 'item', item_id, NULL, length(text) FROM benchmark""")
def union_all(spark, sf):
    """Union by name with missing columns."""
    a = table(spark, sf, "documents").select(F.lit("doc").alias("origin"), F.col("doc_id").alias("id"), "lang", F.length("text").cast("long").alias("n"))
    b = table(spark, sf, "benchmark").select(F.lit("item").alias("origin"), F.col("item_id").alias("id"), F.length("text").cast("long").alias("n"))
    return a.unionByName(b, allowMissingColumns=True)


@register("endpoint_distinct", """
SELECT l_returnflag, count(DISTINCT x) AS endpoints FROM (SELECT l_returnflag, l_partkey AS x FROM lineitem UNION ALL SELECT l_returnflag, l_suppkey FROM lineitem) GROUP BY 1""")
def endpoint_distinct(spark, sf):
    """Distinct values of both endpoints together."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.explode(F.array("l_partkey", "l_suppkey")).alias("x"))
    return rows.distinct().groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("endpoints"))


@register("question_diff", """
SELECT coalesce(a.k, b.k) AS k, a.k IS NULL AS extra, b.k IS NULL AS missing FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 3 = 0) a
FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 3 = 1) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")  # fmt: skip
def question_diff(spark, sf):
    """Keys that only one of two sets has."""
    orders = table(spark, sf, "orders")
    a = orders.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("a")).distinct()
    b = orders.where("o_orderkey % 3 = 1").select(F.col("o_custkey").alias("b")).distinct()
    rows = a.join(b, F.col("a") == F.col("b"), "full").where("a is null or b is null")
    return rows.select(F.coalesce("a", "b").alias("k"), F.col("a").isNull().alias("extra"), F.col("b").isNull().alias("missing"))


# Labelling -----------------------------------------------------------------------------------------------------------


@register("anchor_match", f"""
WITH c AS (SELECT * FROM {_E} WHERE uid % 5 = 0), f AS (SELECT * FROM {_E} WHERE uid % 5 <> 0),
s AS (SELECT c.uid AS csv_uid, f.uid AS uid, 1000.0 * CAST(c.kind <> f.kind AS INT) + 10 * abs(c.bytes - f.bytes) + abs(c.ts - f.ts) AS score
      FROM c JOIN f ON c.host % 10 = f.host % 10 AND f.ts BETWEEN c.ts - 600 AND c.ts + 600)
SELECT csv_uid, uid, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY csv_uid ORDER BY round(score, 4), uid) AS n FROM s) WHERE n = 1""")  # fmt: skip
def anchor_match(spark, sf):
    """Interval join with the best score for each ground-truth row."""
    e = _events(spark, sf).withColumn("port", F.col("host") % 10)
    truth, flows = e.where("uid % 5 = 0"), e.where("uid % 5 <> 0")
    score = 1000.0 * (F.col("kind") != F.col("r_kind")).cast("int") + 10 * F.abs(F.col("bytes") - F.col("r_bytes")) + F.abs(F.col("ts") - F.col("r_ts"))
    best = joins.best_in_range(truth, flows, "uid", ["port"], "ts", ["kind", "bytes"], 600, 600, score, 4)
    return best.select(F.col("uid").alias("csv_uid"), F.col("r_uid").alias("uid"), "score")


@register("fragment_recovery", f"""
SELECT c.uid AS anchor_uid, f.uid AS uid FROM {_E} c JOIN {_E} f ON c.host = f.host AND c.kind = f.kind AND f.uid <> c.uid
AND f.ts BETWEEN c.ts - 3600 AND c.ts + 7200 WHERE c.bytes > 10""")
def fragment_recovery(spark, sf):
    """Other flows with the same keys in an interval round an anchor, which has more than 10 bytes."""
    e = _events(spark, sf)
    return _fragments(e.where("bytes > 10"), e)


def _fragments(anchors, e):
    pairs = joins.range_join(anchors, e, ["host", "kind"], F.col("ts"), F.col("ts"), 3600, 7200)
    return pairs.where("uid <> r_uid").select(F.col("uid").alias("anchor_uid"), F.col("r_uid").alias("uid"))


@register("asof_nearest", f"""
WITH c AS (SELECT * FROM {_E} WHERE uid % 3 = 0), f AS (SELECT * FROM {_E} WHERE uid % 3 <> 0)
SELECT uid, near_uid, gap FROM (
  SELECT c.uid, f.uid AS near_uid, round(f.ts - c.ts, 6) AS gap,
         row_number() OVER (PARTITION BY c.uid ORDER BY abs(f.ts - c.ts), CAST(f.ts > c.ts AS INT), f.uid DESC) AS n
  FROM c JOIN f ON c.kind = f.kind AND f.ts BETWEEN c.ts - 900 AND c.ts + 900) WHERE n = 1""")  # fmt: skip
def asof_nearest(spark, sf):
    """Nearest as-of join by key within a tolerance."""
    e = _events(spark, sf)
    got = joins.nearest(e.where("uid % 3 = 0"), e.where("uid % 3 <> 0"), ["kind"], F.col("ts"), F.col("ts"), 900, [F.desc("r_uid")])
    return got.select("uid", F.col("r_uid").alias("near_uid"), F.round(F.col("r_ts") - F.col("ts"), 6).alias("gap"))


@register("asof_backward", f"""
SELECT c.uid, f.uid AS before_uid FROM (SELECT * FROM {_E} WHERE kind = 'purchase') c
ASOF LEFT JOIN (SELECT * FROM {_E} WHERE kind IN ('view', 'click')) f ON c.host = f.host AND c.ts > f.ts""")  # fmt: skip
def asof_backward(spark, sf):
    """The last earlier row with the same key."""
    e = _events(spark, sf)
    got = joins.latest_before(e.where("kind = 'purchase'"), e.where("kind in ('view', 'click')"), ["host"], "ts", "ts", ["uid"])
    return got.select("uid", F.col("r_uid").alias("before_uid"))


@register("session_origin", f"""
WITH o AS (SELECT host, arg_max(uid, (ts, uid)) AS origin FROM {_E} WHERE kind = 'signup' GROUP BY 1)
SELECT e.uid, origin FROM {_E} e LEFT JOIN o USING (host) WHERE kind = 'error'""")
def session_origin(spark, sf):
    """The latest original row of the same session (J8; not bounded by time)."""
    e = _events(spark, sf)
    origin = e.where("kind = 'signup'").groupBy("host").agg(F.max_by("uid", F.struct("ts", "uid")).alias("origin"))
    return e.where("kind = 'error'").join(origin, "host", "left").select("uid", "origin")


@register("label_fallback", """
SELECT d.doc_id, coalesce(a.v, b.v) AS label FROM documents d
LEFT JOIN (SELECT doc_id, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS v FROM labels WHERE doc_id % 2 = 0) a ON a.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, CASE toxic WHEN 1 THEN 'attack' ELSE 'benign' END AS v FROM labels) b ON b.doc_id = d.doc_id""")  # fmt: skip
def label_fallback(spark, sf):
    """Labels of the first source, else of the second (J10, 1.4 item 7)."""
    l = table(spark, sf, "labels").withColumn("seq", F.lit(1))
    first = l.where("doc_id % 2 = 0").withColumn("label", F.when(F.col("quality") == 1, "good").otherwise("bad"))
    second = l.withColumn("label", F.when(F.col("toxic") == 1, "attack").otherwise("benign"))
    return joins.with_fallback(table(spark, sf, "documents").select("doc_id"), first, second, "doc_id", "label", "seq")


@register("alert_semi", """
SELECT o_orderkey AS uid FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)""")
def alert_semi(spark, sf):
    """Flows named in an alert's nested list."""
    alerts = table(spark, sf, "lineitem").where("l_quantity > 49").groupBy("l_shipdate").agg(F.collect_list("l_orderkey").alias("uids"))
    named = alerts.select(F.explode("uids").alias("uid"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("uid")).join(named, "uid", "left_semi")


@register("unlabelled_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_anti(spark, sf):
    """Rows without a label."""
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


_HOST_SQL = """
SELECT ip, CAST(sum(sent) AS BIGINT) AS sent, CAST(sum(got) AS BIGINT) AS got, CAST(round(sum(bytes)) AS BIGINT) AS bytes FROM (
  SELECT l_partkey % 100 AS ip, 1 AS sent, 0 AS got, l_quantity AS bytes FROM lineitem
  UNION ALL SELECT l_suppkey % 100, 0, 1, l_quantity FROM lineitem) GROUP BY 1"""


def _host_profile(spark, sf):
    side = lambda c, s, g: F.struct((F.col(c) % 100).alias("ip"), F.lit(s).alias("sent"), F.lit(g).alias("got"))
    rows = table(spark, sf, "lineitem").select("l_quantity", F.explode(F.array(side("l_partkey", 1, 0), side("l_suppkey", 0, 1))).alias("x"))
    return rows.groupBy("x.ip").agg(F.sum("x.sent").alias("sent"), F.sum("x.got").alias("got"), F.round(F.sum("l_quantity")).cast("long").alias("bytes"))


@register("host_profile", _HOST_SQL)
def host_profile(spark, sf):
    """Sent and received counts and bytes of each address, from one scan (A5)."""
    return _host_profile(spark, sf)


@register("host_lookup", f"""
WITH h AS ({_HOST_SQL}) SELECT o_orderkey AS uid, coalesce(a.sent, 0) AS src_sent, coalesce(b.got, 0) AS dst_got
FROM orders LEFT JOIN h a ON a.ip = o_custkey % 150 LEFT JOIN h b ON b.ip = o_orderkey % 150""")
def host_lookup(spark, sf):
    """Profiles of both ends of a flow, zero where unknown."""
    h = _host_profile(spark, sf)
    a = h.select((F.col("ip")).alias("a"), F.col("sent").alias("src_sent"))
    b = h.select((F.col("ip")).alias("b"), F.col("got").alias("dst_got"))
    rows = table(spark, sf, "orders").join(a, F.col("o_custkey") % 150 == F.col("a"), "left").join(b, F.col("o_orderkey") % 150 == F.col("b"), "left")
    return rows.select(F.col("o_orderkey").alias("uid"), F.coalesce("src_sent", F.lit(0)).alias("src_sent"), F.coalesce("dst_got", F.lit(0)).alias("dst_got"))


@register("offset_histogram", f"""
SELECT CAST(trunc(f.ts - c.ts) AS INT) AS gap, count(*) AS n FROM {_E} c JOIN {_E} f ON c.host = f.host AND c.kind = f.kind
WHERE f.ts - c.ts BETWEEN 36000 AND 50000 GROUP BY 1 ORDER BY n DESC, gap LIMIT 5""")  # fmt: skip
def offset_histogram(spark, sf):
    """The five commonest whole-second differences in an interval."""
    e = _events(spark, sf)
    pairs = joins.range_join(e, e, ["host", "kind"], F.col("ts") + 43000, F.col("ts"), 7000, 7000)
    gaps = pairs.where((F.col("r_ts") - F.col("ts")).between(36000, 50000)).groupBy((F.col("r_ts") - F.col("ts")).cast("int").alias("gap"))
    return gaps.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gap").limit(5)


@register("file_enrichment", """
SELECT s_suppkey, r_name AS intel FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def file_enrichment(spark, sf):
    """Enrichment over small key tables."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("intel"))


# Evaluation ----------------------------------------------------------------------------------------------------------


@register("label_coverage", """
SELECT count(*) AS n, count(quality) AS labelled, round(count(quality) / count(*), 6) AS coverage FROM documents LEFT JOIN labels USING (doc_id)""")
def label_coverage(spark, sf):
    """Labelled rows and their share (A1, A3)."""
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("labelled"), F.round(F.count("quality") / F.count(F.lit(1)), 6).alias("coverage"))


@register("label_distribution", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def label_distribution(spark, sf):
    """Counts by label."""
    return table(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@register("confusion_matrix", """
WITH x AS (SELECT toxic = 1 AS t, regexp_matches(lower(text), 'idiot|moron|scum|trash') AS p FROM documents JOIN labels USING (doc_id)),
c AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM x)
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision",
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")  # fmt: skip
def confusion_matrix(spark, sf):
    """Flow-level confusion matrix and its ratios."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    out = metrics.confusion(rows, F.col("toxic") == 1, F.lower("text").rlike("idiot|moron|scum|trash"))
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@register("batch_confusion", """
WITH x AS (SELECT doc_id // 30 AS b, max(toxic) = 1 AS t, avg(CAST(regexp_matches(lower(text), 'idiot|moron|scum|trash') AS INT)) >= 0.05 AS p
           FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM x""")  # fmt: skip
def batch_confusion(spark, sf):
    """The same by batch: any attack in it against a score threshold."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    hit = F.lower("text").rlike("idiot|moron|scum|trash").cast("int")
    batches = rows.groupBy(F.floor(F.col("doc_id") / 30).alias("b")).agg(F.max("toxic").alias("t"), F.avg(hit).alias("p"))
    return metrics.confusion(batches, F.col("t") == 1, F.col("p") >= 0.05).select("tp", "fp", "fn", "tn")


@register("class_report", """
WITH x AS (SELECT l_returnflag AS t, CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS p FROM lineitem),
c AS (SELECT DISTINCT t AS class FROM x UNION SELECT DISTINCT p FROM x),
s AS (SELECT class, count(*) FILTER (t = class) AS support, count(*) FILTER (p = class) AS n_predicted, count(*) FILTER (t = class AND p = class) AS n_right FROM c, x GROUP BY 1)
SELECT class, support, round(coalesce(n_right / nullif(n_predicted, 0), 0), 6) AS "precision", round(coalesce(n_right / nullif(support, 0), 0), 6) AS recall,
       round(coalesce(2 * n_right / nullif(support + n_predicted, 0), 0), 6) AS f1 FROM s""")  # fmt: skip
def class_report(spark, sf):
    """Precision, recall and f1 of each class."""
    n = F.col("l_linenumber") % 3
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("t"), F.when(n == 0, "A").when(n == 1, "N").otherwise("R").alias("p"))
    return metrics.class_report(rows, "t", "p").select("class", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@register("flow_summary", f"""
SELECT host, count(*) AS n, count(*) FILTER (kind = 'error') AS errors, count(DISTINCT kind) AS kinds, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kind_list,
       bool_or(bytes > 40) AS large FROM {_E} GROUP BY 1""")  # fmt: skip
def flow_summary(spark, sf):
    """Counts, sorted distinct values and flags of each host's flows."""
    return _events(spark, sf).groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "error").alias("errors"), F.countDistinct("kind").alias("kinds"),
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kind_list"), F.bool_or(F.col("bytes") > 40).alias("large"),
    )


# Windows -------------------------------------------------------------------------------------------------------------


@register("first_attack_run", f"""
WITH r AS (SELECT uid, kind = 'error' AS bad, row_number() OVER (ORDER BY ts, uid) - 1 AS rn FROM {_E}),
b AS (SELECT rn // 30 AS batch, rn % 30 + 1 AS pos, bad, sum(CAST(NOT bad AS INT)) OVER (PARTITION BY rn // 30 ORDER BY rn) AS island FROM r),
g AS (SELECT batch, island, min(pos) AS start, max(pos) AS stop, row_number() OVER (PARTITION BY batch ORDER BY island) AS n FROM b WHERE bad GROUP BY 1, 2)
SELECT batch, start, stop - start + 1 AS duration FROM g WHERE n = 1""")  # fmt: skip
def first_attack_run(spark, sf):
    """The first run of attacks in each batch of 30."""
    rows = _by_day(_events(spark, sf)).withColumn("batch", F.floor((F.col("rn") - 1) / 30)).withColumn("pos", (F.col("rn") - 1) % 30 + 1)
    bad = F.col("kind") == "error"
    w = Window.partitionBy("batch").orderBy("rn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = rows.withColumn("island", F.sum((~bad).cast("int")).over(w)).where(bad).groupBy("batch", "island")
    runs = runs.agg(F.min("pos").alias("start"), F.max("pos").alias("stop"))
    first = runs.groupBy("batch").agg(F.min(F.struct("island", "start", "stop")).alias("f"))
    return first.select("batch", F.col("f.start").alias("start"), (F.col("f.stop") - F.col("f.start") + 1).alias("duration"))


@register("anchor_flow", """
SELECT l_orderkey AS uid, arg_max(l_linenumber, (round(l_quantity + l_extendedprice / 1e5, 6), -l_linenumber, -l_partkey)) AS line FROM lineitem GROUP BY 1""")
def anchor_flow(spark, sf):
    """The row with the highest weighted score; the first wins ties."""
    score = F.round(F.col("l_quantity") + F.col("l_extendedprice") / 1e5, 6)
    best = F.max_by("l_linenumber", F.struct(score, -F.col("l_linenumber"), -F.col("l_partkey")))
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("uid")).agg(best.alias("line"))


@register("first_packets", """
SELECT l_suppkey AS uid, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS mean FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS n FROM lineitem) WHERE n <= 100 GROUP BY 1""")  # fmt: skip
def first_packets(spark, sf):
    """Length statistics of the first 100 packets of each flow."""
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")]
    rows = ordering.top_k(table(spark, sf, "lineitem"), ["l_suppkey"], order, 100)
    return rows.groupBy(F.col("l_suppkey").alias("uid")).agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@register("packet_tokens", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts, uid) - 1 AS j, ts - min(ts) OVER (PARTITION BY host) AS since FROM {_E})
SELECT uid, host, j, round(since, 3) AS since, CASE WHEN j = 0 THEN 0 WHEN since <= 0.01 THEN least(2 * j + 1, 199) ELSE least(2 * j, 199) END AS time_token,
       least(CAST(trunc(bytes * 10) AS INT), 1499) + CASE kind WHEN 'view' THEN 0 WHEN 'click' THEN 1500 ELSE 3000 END AS size_token
FROM r WHERE j < 100""")  # fmt: skip
def packet_tokens(spark, sf):
    """Position, time since the first packet (odd tokens up to 0.01 s) and size tokens of the first 100 packets of each host."""
    w = Window.partitionBy("host").orderBy("ts", "uid")
    rows = _events(spark, sf).withColumn("j", F.row_number().over(w) - 1)
    rows = rows.withColumn("since", F.col("ts") - F.min("ts").over(Window.partitionBy("host"))).where("j < 100")
    j = F.col("j")
    time = F.when(j == 0, 0).when(F.col("since") <= 0.01, F.least(2 * j + 1, F.lit(199))).otherwise(F.least(2 * j, F.lit(199)))
    offset = F.when(F.col("kind") == "view", 0).when(F.col("kind") == "click", 1500).otherwise(3000)
    size = F.least((F.col("bytes") * 10).cast("int"), F.lit(1499)) + offset
    return rows.select("uid", "host", "j", F.round("since", 3).alias("since"), time.alias("time_token"), size.alias("size_token"))


_FLOW_SQL = "SELECT o_orderkey AS uid, o_custkey % 150 AS src, o_orderkey % 150 AS dst, o_orderkey % 13 AS op, o_custkey % 11 AS rp, o_orderkey % 17 * 100 AS ob, CAST(round(o_totalprice) AS BIGINT) AS rb, o_orderkey % 600 / 10.0 AS dur FROM orders"
_ENDS = ["coalesce(a.sf, 0)", "coalesce(a.sp, 0)", "coalesce(a.sb, 0)", "coalesce(c.rf, 0)", "coalesce(c.rp, 0)", "coalesce(c.rb, 0)"]
_SOURCE, _TARGET = _ENDS, [x.replace("(a.", "(b.").replace("(c.", "(d.") for x in _ENDS]
_OWN = ["op + rp", "dur", "ob + rb", "coalesce(lo, 0)", "coalesce(hi, 0)", "coalesce(mean, CASE WHEN op + rp > 0 THEN (ob + rb) / (op + rp) ELSE 0 END)"]


@register("feature_vector", f"""
WITH f AS ({_FLOW_SQL}), s AS (SELECT src AS h, count(*) AS sf, sum(op) AS sp, sum(ob) AS sb FROM f GROUP BY 1), r AS (SELECT dst AS h, count(*) AS rf, sum(rp) AS rp, sum(rb) AS rb FROM f GROUP BY 1),
p AS (SELECT uid, min(l_quantity) AS lo, max(l_quantity) AS hi, avg(l_quantity) AS mean FROM (SELECT l_orderkey AS uid, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_quantity) AS n FROM lineitem) WHERE n <= 100 GROUP BY 1)
SELECT uid, {', '.join(f'round(ln(1 + {x}), 6) AS f{i}' for i, x in enumerate(_SOURCE + _TARGET + [y.replace("rp", "f.rp").replace("rb", "f.rb") for y in _OWN]))}
FROM f LEFT JOIN p USING (uid) LEFT JOIN s a ON a.h = src LEFT JOIN r c ON c.h = src LEFT JOIN s b ON b.h = dst LEFT JOIN r d ON d.h = dst""")  # fmt: skip
def feature_vector(spark, sf):
    """Twelve log counts of both hosts and six of the flow itself."""
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    flows = table(spark, sf, "orders").select(
        key.alias("uid"), (who % 150).alias("src"), (key % 150).alias("dst"), (key % 13).alias("orig_pkts"), (who % 11).alias("resp_pkts"),
        (key % 17 * 100).alias("orig_bytes"), F.round("o_totalprice").cast("long").alias("resp_bytes"), (key % 600 / 10).alias("duration"),
    )
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("uid"), "l_shipdate", "l_linenumber", "l_quantity")
    first = ordering.top_k(lines, ["uid"], [F.col(c) for c in ("l_shipdate", "l_linenumber", "l_quantity")], 100)
    lengths = first.groupBy("uid").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.avg("l_quantity").alias("mean"))
    rows = packets.flow_features(flows, lengths)
    return rows.select("uid", *[F.round(f"f{i}", 6).alias(f"f{i}") for i in range(18)])
