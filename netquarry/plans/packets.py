"""Queries on packet tables, rule verdicts and host graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from netquarry.functions import text, tls
from netquarry.operators import handshakes, ordering, packets, payload
from netquarry.plans.registry import register, table

_T = "epoch_us(l_shipdate) / 1e6"


def _packets(spark, sf):
    rows = table(spark, sf, "lineitem")
    return rows.withColumn("src", F.col("l_partkey") % 40).withColumn("dst", F.col("l_suppkey") % 40).withColumn("t", F.expr("unix_micros(cast(l_shipdate as timestamp)) / 1e6"))


@register("conversations", f"""
SELECT least(l_partkey % 40, l_suppkey % 40) AS a, greatest(l_partkey % 40, l_suppkey % 40) AS b,
  count(*) FILTER (l_partkey % 40 <= l_suppkey % 40) AS frames_ab, count(*) FILTER (l_partkey % 40 > l_suppkey % 40) AS frames_ba,
  coalesce(sum(l_quantity) FILTER (l_partkey % 40 <= l_suppkey % 40), 0) AS bytes_ab, coalesce(sum(l_quantity) FILTER (l_partkey % 40 > l_suppkey % 40), 0) AS bytes_ba,
  min({_T}) AS start, max({_T}) - min({_T}) AS duration FROM lineitem GROUP BY 1, 2""")  # fmt: skip
def conversations(spark, sf):
    """Frames and bytes each way, start and duration of each endpoint pair."""
    return packets.conversations(_packets(spark, sf), "src", "dst", F.col("l_quantity"), F.col("t"))


def _spread(c):
    return f"max({c}), min({c}), median({c}), stddev_pop({c})"


_RISK = "22, 23, 25, 53, 80, 135, 139, 443, 445, 993, 995, 1433, 1521, 3306, 3389, 4444, 5432, 5900, 6379, 8080, 8443, 8888, 9200"
_BINS = "count(*) FILTER ({0} BETWEEN 0 AND 1023) / count(*), count(*) FILTER ({0} BETWEEN 1024 AND 49151) / count(*), count(*) FILTER ({0} > 49151) / count(*), count(*) FILTER ({0} IN ({1})) / count(*)"


@register("batch_profile", f"""
WITH f AS (SELECT (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) // 30 AS batch, l_quantity AS m1, l_extendedprice AS m2,
  l_discount * 100000 AS m3, l_linenumber AS m4, l_tax AS m5, CASE WHEN l_partkey % 9 = 0 THEN 53 ELSE l_partkey * 37 % 65536 END AS rp, l_suppkey * 991 % 65536 AS op,
  l_suppkey AS oh, l_partkey % 10 AS rh, CASE l_returnflag WHEN 'A' THEN 'tcp' WHEN 'N' THEN 'udp' ELSE 'icmp' END AS pr FROM lineitem),
v AS (SELECT batch, list_transform([{', '.join(_spread(c) for c in ('m1', 'm2', 'm3', 'm4', 'm5', 'rp', 'op'))}, {_BINS.format('rp', _RISK)}, {_BINS.format('op', _RISK)},
  count(DISTINCT oh) / count(*), count(DISTINCT rh) / count(*), sum(m2) / (sum(m2) + sum(m3) + 1), count(*) FILTER (pr = 'tcp') / count(*), count(*) FILTER (pr = 'udp') / count(*),
  count(DISTINCT rp) / count(*), count(DISTINCT op) / count(*), max(rpn) / count(*), max(opn) / count(*), count(*) FILTER (rp = 53) / count(*)], lambda x: CAST(x AS DOUBLE)) AS v
  FROM (SELECT *, count(*) OVER (PARTITION BY batch, rp) AS rpn, count(*) OVER (PARTITION BY batch, op) AS opn FROM f) GROUP BY 1),
z AS (SELECT batch, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS s FROM v)
SELECT batch, CAST(i AS INT) AS pos, round(v[i + 1] / s, 7) AS x FROM (SELECT *, unnest(range(0, len(v))) AS i FROM z)""")  # fmt: skip
def batch_profile(spark, sf):
    """Statistical profile of each window of 30 flows: 46 numbers at norm 1 (A10, C5, 1.4 items 5 and 6)."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = table(spark, sf, "lineitem").select(*order, "l_quantity", "l_discount", "l_tax", "l_returnflag")
    proto = F.when(F.col("l_returnflag") == "A", "TCP").when(F.col("l_returnflag") == "N", "udp").otherwise("icmp")

    def profiles(rows, dealt):
        flows = rows.select(
            "batch", F.col("l_quantity").alias("duration"), F.col("l_extendedprice").alias("orig_bytes"), (F.col("l_discount") * 100000).alias("resp_bytes"),
            F.col("l_linenumber").alias("orig_pkts"), F.col("l_tax").alias("resp_pkts"), F.when(F.col("l_partkey") % 9 == 0, 53).otherwise(F.col("l_partkey") * 37 % 65536).alias("resp_p"),
            (F.col("l_suppkey") * 991 % 65536).alias("orig_p"), F.col("l_suppkey").cast("string").alias("orig_h"), (F.col("l_partkey") % 10).cast("string").alias("resp_h"), proto.alias("proto"),
        )
        return packets.batch_profile(flows, "batch", dealt)

    inside, across = ordering.count_windows(rows, F.floor(F.col("l_orderkey") / 4096), order, 30)
    made = profiles(inside, True).unionByName(profiles(across, False))
    return made.select("batch", F.posexplode("v").alias("pos", "x")).withColumn("x", F.round("x", 7))


@register("payload_summary", r"""
SELECT role, part, coalesce(substr(string_agg(DISTINCT h, chr(10) || '---' || chr(10) ORDER BY h) FILTER (h <> ''), 1, 1500), '') AS summary
FROM (SELECT role, conv_id % 40 AS part, substr(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), 1, 256) AS h FROM conversations) GROUP BY 1, 2""")
def payload_summary(spark, sf):
    """Distinct beginnings of 256 characters in order, cut at 1500."""
    rows = table(spark, sf, "conversations").select(F.struct("role", (F.col("conv_id") % 40).alias("part")).alias("k"), "text")
    return payload.summary(rows, "k", "text").select("k.*", "summary")


@register("heartbeat_gap", """
WITH s AS (SELECT user_id AS host, epoch_us(ts) // 60000000 AS s, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) <= 10),
g AS (SELECT host, s, s - lag(s) OVER (PARTITION BY host ORDER BY s) AS gap FROM s),
c AS (SELECT host, gap, count(*) AS n, min(s) AS f FROM g WHERE gap IS NOT NULL GROUP BY 1, 2),
b AS (SELECT host, arg_max(gap, (n, -f)) AS period, max(n) AS times, sum(n) + 1 AS slots FROM c GROUP BY 1)
SELECT host, period, times FROM b WHERE period >= 5 AND times >= 2 AND slots >= 3""")  # fmt: skip
def heartbeat_gap(spark, sf):
    """The commonest gap between quiet time slots."""
    rows = table(spark, sf, "events").withColumn("host", F.col("user_id"))
    return packets.heartbeat(rows, "host", F.floor(F.expr("unix_micros(cast(ts as timestamp))") / 60_000_000))


@register("size_buckets", """
WITH b AS (SELECT CASE WHEN n < 20 THEN '0-19' WHEN n < 40 THEN '20-39' WHEN n < 80 THEN '40-79' WHEN n < 160 THEN '80-159' WHEN n < 320 THEN '160-319'
  WHEN n < 640 THEN '320-639' WHEN n < 1280 THEN '640-1279' WHEN n < 2560 THEN '1280-2559' ELSE '2560_and_greater' END AS bucket, n AS size FROM (SELECT n_chars AS n FROM documents)),
c AS (SELECT bucket, count(*) AS n, round(avg(size), 6) AS avg FROM b GROUP BY 1)
SELECT bucket, n, avg, round(n * 100 / sum(n) OVER (), 6) AS percent, round(coalesce(sum(n) FILTER (bucket = '1280-2559') OVER (), 0) * 100 / sum(n) OVER (), 6) AS mtu_pct,
       round(coalesce(sum(n) FILTER (bucket IN ('0-19', '20-39', '40-79', '80-159')) OVER (), 0) * 100 / sum(n) OVER (), 6) AS small_pct FROM c""")  # fmt: skip
def size_buckets(spark, sf):
    """Packet-size histogram with shares."""
    rows = packets.size_buckets(table(spark, sf, "documents"), F.col("n_chars"))
    return rows.select("bucket", "n", *[F.round(c, 6).alias(c) for c in ("avg", "percent", "mtu_pct", "small_pct")])


@register("direction_ratio", """
WITH d AS (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS ab, sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE 0 END) AS ba FROM lineitem GROUP BY 1)
SELECT l_suppkey, ab, ba, round(coalesce(ba / nullif(ab, 0), 0), 4) AS ratio, coalesce(ba / nullif(ab, 0), 0) > 1.1 AS suspect FROM d""")  # fmt: skip
def direction_ratio(spark, sf):
    """Bytes each way and their ratio, guarded at zero (A38, D12, 1.4 item 13)."""
    rows = packets.direction_ratio(table(spark, sf, "lineitem"), ["l_suppkey"], F.col("l_quantity"), F.col("l_returnflag") == "N")
    return rows.withColumn("ratio", F.round("ratio", 4))


@register("session_span", """
SELECT user_id AS host, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 3) AS span, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 > 2500000 AS long FROM events GROUP BY 1""")
def session_span(spark, sf):
    """Span of each session, and whether it is long."""
    rows = table(spark, sf, "events").withColumn("host", F.col("user_id"))
    got = packets.session_span(rows, ["host"], F.expr("unix_micros(cast(ts as timestamp))") / 1e6, 2_500_000)
    return got.withColumn("span", F.round("span", 3))


@register("endpoint_totals", """
SELECT ip, count(*) AS frames, sum(q) AS bytes FROM (SELECT l_partkey % 40 AS ip, l_quantity AS q FROM lineitem UNION ALL SELECT l_suppkey % 40, l_quantity FROM lineitem) GROUP BY 1""")
def endpoint_totals(spark, sf):
    """Frames and bytes of each address."""
    return packets.endpoints(_packets(spark, sf), "src", "dst", "l_quantity")


@register("capture_info", """
SELECT count(*) AS n, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 3) AS duration, round(count(*) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6), 8) AS rate, round(avg(value), 9) AS mean_size FROM events""")
def capture_info(spark, sf):
    """Count, duration, rate and mean size of a capture."""
    t = F.expr("unix_micros(cast(ts as timestamp))")
    span = (F.max(t) - F.min(t)) / 1e6
    n = F.count(F.lit(1))
    return table(spark, sf, "events").agg(n.alias("n"), F.round(span, 3).alias("duration"), F.round(n / span, 8).alias("rate"), F.round(F.avg("value"), 9).alias("mean_size"))


@register("protocol_hierarchy", """
WITH p AS (SELECT string_split('eth:ip:' || lower(l_returnflag) || ':' || lower(l_linestatus) || (l_linenumber % 2), ':') AS p, l_quantity AS q FROM lineitem),
x AS (SELECT array_to_string(p[1:d], ':') AS path, d AS depth, q FROM p, range(1, 5) AS t(d))
SELECT path, depth, count(*) AS frames, sum(q) AS bytes FROM x GROUP BY 1, 2""")  # fmt: skip
def protocol_hierarchy(spark, sf):
    """Frames and bytes of every prefix of the protocol stack."""
    path = F.concat(F.lit("eth:ip:"), F.lower("l_returnflag"), F.lit(":"), F.lower("l_linestatus"), (F.col("l_linenumber") % 2).cast("string"))
    return packets.protocol_hierarchy(table(spark, sf, "lineitem"), path, F.col("l_quantity"))


@register("handshake_sets", """
SELECT l_suppkey, count(*) AS n, string_agg(DISTINCT l_linestatus || l_returnflag, ',' ORDER BY l_linestatus || l_returnflag) AS names, bool_or(l_linestatus = l_returnflag) AS self_signed,
  md5(string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), '-' ORDER BY CAST(l_linenumber AS VARCHAR))) AS fingerprint FROM lineitem GROUP BY 1""")  # fmt: skip
def handshake_sets(spark, sf):
    """Names, self-signed flags and fingerprints of handshakes."""
    both = F.concat("l_linestatus", "l_returnflag")
    joined = lambda c, sep: F.array_join(F.array_sort(F.collect_set(c)), sep)
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), joined(both, ",").alias("names"), F.bool_or(F.col("l_linestatus") == F.col("l_returnflag")).alias("self_signed"),
        F.md5(joined(F.col("l_linenumber").cast("string"), "-")).alias("fingerprint"),
    )


@register("byte_pattern", """
SELECT doc_id, instr(t, 'a t') AS at, CASE WHEN instr(t, 'a t') > 0 THEN strlen(substr(t, 1, CAST(instr(t, 'a t') AS INT) - 1)) + 1 ELSE 0 END AS byte_at, instr(t, 'a t') > 0 AS subset
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def byte_pattern(spark, sf):
    """Byte and text pattern search."""
    rows = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    byte_at = text.byte_position(F.encode("t", "UTF-8"), bytes.fromhex("612074"))
    return rows.select("doc_id", F.instr("t", "a t").cast("long").alias("at"), byte_at.alias("byte_at"), (byte_at > 0).alias("subset"))


_EVIDENCE = """SELECT user_id AS c, event_type AS skill, event_id AS step, event_id % 3 <> 0 AS passed, event_id % 97 = 5 AS hard, event_id % 5 = 0 AS specific, event_id % 41 = 0 AS aborts FROM events"""


@register("verdict_score", f"""
WITH e AS ({_EVIDENCE}),
m AS (SELECT *, coalesce(max(CAST((hard AND passed) OR (NOT passed AND aborts) AS INT)) OVER (PARTITION BY c, skill ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stop FROM e),
p AS (SELECT c, skill, count(*) FILTER (passed) AS n_pass, count(*) AS n, count(*) FILTER (hard AND passed) AS n_hard, coalesce(min(step) FILTER (hard AND passed), min(step)) AS f, count(*) FILTER (passed AND specific) AS n_specific FROM m WHERE stop = 0 GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN n_hard > 0 THEN 1e9 * n_hard ELSE n_pass + 3 * n_specific + 0.5 * (n_pass / n) END AS score, CASE WHEN n_hard > 0 THEN 1.0 ELSE 0.8 * (n_pass / n) END AS confidence FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY round(score, 6) DESC, f, skill) AS k FROM s)
SELECT c AS "case", skill, n_pass, round(confidence, 6) AS confidence, confidence > 0.5 AS attack FROM r WHERE k = 1""")  # fmt: skip
def verdict_score(spark, sf):
    """Evidence masked after hard hits and aborts, scored by skill."""
    e = table(spark, sf, "events")
    i = F.col("event_id")
    rows = e.select(F.col("user_id").alias("case"), F.col("event_type").alias("skill"), i.alias("step"), (i % 3 != 0).alias("passed"), (i % 97 == 5).alias("hard"), (i % 5 == 0).alias("specific"), (i % 41 == 0).alias("aborts"))
    return packets.verdict(rows, "case", "skill", "step").withColumn("confidence", F.round("confidence", 6))


@register("edge_aggregate", """
SELECT l_partkey % 40 AS src, l_suppkey % 40 AS dst, count(*) AS flows,
  array_to_string(list(CAST(l_orderkey AS VARCHAR) ORDER BY l_shipdate, l_orderkey, l_linenumber)[-3:], ',') AS last3 FROM lineitem GROUP BY 1, 2""")  # fmt: skip
def edge_aggregate(spark, sf):
    """Edges with counts and their last three records."""
    rows = _packets(spark, sf)
    w = Window.partitionBy("src", "dst").orderBy(F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"))
    last = rows.withColumn("k", F.row_number().over(w)).where("k <= 3").groupBy("src", "dst")
    last = last.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("k"), F.col("l_orderkey").cast("string").alias("o")))), lambda x: x["o"]), ",").alias("last3"))
    counts = rows.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("flows"))
    return counts.join(last, ["src", "dst"])


@register("graph_neighbours", """
WITH e AS (SELECT DISTINCT l_partkey % 40 AS src, l_suppkey % 300 AS dst FROM lineitem), h AS (SELECT unnest([3, 7, 21]) AS host)
SELECT host, 'out' AS way, dst AS other FROM h JOIN e ON src = host UNION SELECT host, 'in', src FROM h JOIN e ON dst = host""")  # fmt: skip
def graph_neighbours(spark, sf):
    """Outgoing and incoming neighbours of a set of hosts."""
    e = table(spark, sf, "lineitem").select((F.col("l_partkey") % 40).alias("src"), (F.col("l_suppkey") % 300).alias("dst"))
    return packets.neighbours(e, "src", "dst", [3, 7, 21])


@register("asset_service", """
WITH a AS (SELECT s_suppkey AS ip, [{'port': s_nationkey, 'service': 'svc' || s_nationkey}, {'port': 25, 'service': 'mail'}] AS s FROM supplier)
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(list_filter(s, lambda x: x.port = l_linenumber * 5)[1].service, 'unknown') AS service
FROM lineitem LEFT JOIN a ON l_suppkey = ip + 40""")  # fmt: skip
def asset_service(spark, sf):
    """Service of a port in a nested asset record, with a fallback."""
    s = F.array(F.struct(F.col("s_nationkey").alias("port"), F.concat(F.lit("svc"), F.col("s_nationkey").cast("string")).alias("service")), F.struct(F.lit(25).alias("port"), F.lit("mail").alias("service")))
    assets = table(spark, sf, "supplier").select((F.col("s_suppkey") + 40).alias("ip"), s.alias("s"))
    rows = table(spark, sf, "lineitem").join(assets, F.col("l_suppkey") == F.col("ip"), "left")
    found = F.get(F.filter("s", lambda x: x["port"] == F.col("l_linenumber") * 5), F.lit(0))["service"]
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(found, F.lit("unknown")).alias("service"))


@register("port_map", """
SELECT s_nationkey AS host, string_agg(s_suppkey || '=' || s_name, ';' ORDER BY s_suppkey) AS ports FROM supplier GROUP BY 1""")
def port_map(spark, sf):
    """One property per port on each host."""
    entries = F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name")))
    rows = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("host")).agg(F.map_from_entries(entries).alias("m"))
    parts = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"]))
    return rows.select("host", F.array_join(parts, ";").alias("ports"))


@register("expectation_rules", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN n_chars BETWEEN 100 AND 500 WHEN 1 THEN abs(n_chars - 400) <= 3 WHEN 2 THEN n_chars > 1000 ELSE FALSE END AS ok FROM documents""")
def expectation_rules(spark, sf):
    """Expectations in text: a range, about a number, a bound; unknown ones fail."""
    n = F.col("doc_id") % 4
    rule = F.when(n == 0, "[100, 500]").when(n == 1, "≈ 400").when(n == 2, "> 1000").otherwise("whatever")
    rows = table(spark, sf, "documents").withColumn("rule", rule)
    return rows.select("doc_id", text.expected(F.col("rule"), F.col("n_chars")).alias("ok"))


@register("allow_list", """
SELECT s_suppkey, len(list_filter(['name' || s_nationkey || '.example.com', 'x.org'], lambda n: NOT contains(n, 'example') AND NOT contains(n, 'name1'))) > 0 AS foreign_name FROM supplier""")
def allow_list(spark, sf):
    """Names that no allowed domain is a part of."""
    names = F.array(F.concat(F.lit("name"), F.col("s_nationkey").cast("string"), F.lit(".example.com")), F.lit("x.org"))
    return table(spark, sf, "supplier").select("s_suppkey", text.foreign_names(names, ["example", "name1"]).alias("foreign_name"))


@register("tls_fingerprint", """
WITH g AS (SELECT l_orderkey, '771,' || string_agg(CAST(l_partkey % 60000 AS VARCHAR), '-' ORDER BY l_linenumber, l_partkey, l_suppkey) || ',0-10-11,' ||
    string_agg(CAST(l_suppkey % 30 AS VARCHAR), '-' ORDER BY l_linenumber, l_partkey, l_suppkey) || ',' || string_agg(CAST(l_linenumber % 3 AS VARCHAR), '-' ORDER BY l_linenumber, l_partkey, l_suppkey) AS s FROM lineitem
    WHERE l_partkey % 60000 NOT IN (2570, 6682, 10794, 14906, 19018, 23130, 27242, 31354, 35466, 39578, 43690, 47802, 51914, 56026) GROUP BY 1),
k AS (SELECT md5(s) AS hash, 'order ' || min(l_orderkey) AS known_as FROM g WHERE l_orderkey % 100 = 0 GROUP BY 1)
SELECT l_orderkey, 'h' || l_orderkey || '.example.com' AS server_name, s AS ja3_string, md5(s) AS ja3, known_as FROM g LEFT JOIN k ON md5(s) = hash""")  # fmt: skip
def tls_fingerprint(spark, sf):
    """Client hellos read from the bytes of a record, their fingerprints, and the names of known ones (A43, A44, B1, B3). A hello's
    numbers are an order's lines; reserved values are mixed in."""
    lines = table(spark, sf, "lineitem").where(~(F.col("l_partkey") % 60000).isin([0x0A0A + 0x1010 * k for k in range(14)]))
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    g = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("x"))
    number = lambda n, size: F.lpad(F.hex(n), 2 * size, "0")
    joined = lambda f: F.array_join(F.transform("x", f), "")
    name = F.concat(F.lit("h"), F.col("l_orderkey").cast("string"), F.lit(".example.com"))
    n, size = F.char_length(name), F.size("x")
    ext = lambda kind, data: F.struct(F.lit(kind).alias("kind"), data.alias("data"))
    parts = F.array(
        ext(0x2A2A, F.lit("")), ext(0, F.concat(number(n + 3, 2), F.lit("00"), number(n, 2), F.hex(name))),
        ext(10, F.concat(number(2 * size, 2), joined(lambda r: number(r["l_suppkey"] % 30, 2)))), ext(11, F.concat(number(size, 1), joined(lambda r: number(r["l_linenumber"] % 3, 1)))),
    )
    ciphers = F.concat(F.array(F.lit(0x1A1A).cast("long")), F.transform("x", lambda r: r["l_partkey"] % 60000))
    once = F.md5(F.col("l_orderkey").cast("string"))
    stream = F.concat(F.lit("474554200A"), tls.hello_hex(F.lit(771), ciphers, parts, F.concat(once, once)))  # behind other bytes
    hellos = g.select("l_orderkey", tls.first_client_hello(stream).alias("h")).select("l_orderkey", "h.server_name", "h.ja3_string", "h.ja3")
    some = hellos.where("l_orderkey % 100 = 0").groupBy(F.col("ja3").alias("hash")).agg(F.min("l_orderkey").alias("k"))
    known = some.select("hash", F.concat(F.lit("order "), F.col("k").cast("string")).alias("name"))
    return tls.known_fingerprints(hellos, known)


@register("http_exchanges", """
WITH p AS (SELECT page_id, coalesce(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '') AS host, '/' || page_id AS uri, length(html) AS n FROM pages)
SELECT page_id, 0 AS nth, 'GET' AS method, uri, host, 'bot/' || (page_id % 7) AS user_agent, CASE WHEN page_id % 3 = 0 THEN 'websocket' ELSE '' END AS upgrade, CASE WHEN page_id % 3 = 0 THEN 'k' || page_id ELSE '' END AS websocket_key,
  200 AS status, 'OK' AS phrase, 'srv' || (page_id % 5) AS server, 'text/html; charset=utf-8' AS content_type, '' AS accept_key FROM p
UNION ALL SELECT page_id, 1, 'POST', uri || '?n=' || n, host, '', '', '', CASE WHEN page_id % 4 = 0 THEN NULL WHEN page_id % 3 = 0 THEN 101 ELSE 404 END,
  CASE WHEN page_id % 4 = 0 THEN NULL WHEN page_id % 3 = 0 THEN 'Switching Protocols' ELSE 'Not Found' END, CASE WHEN page_id % 4 > 0 THEN '' END, CASE WHEN page_id % 4 > 0 THEN '' END,
  CASE WHEN page_id % 4 = 0 THEN NULL WHEN page_id % 3 = 0 THEN 'a' || page_id ELSE '' END FROM p""")  # fmt: skip
def http_exchanges(spark, sf):
    """Requests and responses of each flow, paired in stream order, with their headers (A46). Streams carry whole pages."""
    p = table(spark, sf, "pages").withColumn("host", F.coalesce(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.lit("")))
    i = F.col("page_id")
    s, end = i.cast("string"), F.lit("\r\n")
    upgrade = F.when(i % 3 == 0, F.concat(F.lit("Upgrade: websocket\r\nSec-WebSocket-Key: k"), s, end)).otherwise("")
    client = F.concat(
        F.lit("GET /"), s, F.lit(" HTTP/1.1\r\nHost: "), F.col("host"), F.lit("\r\nUser-Agent:bot/"), (i % 7).cast("string"), end, upgrade, end,
        F.lit("POST /"), s, F.lit("?n="), F.length("html").cast("string"), F.lit(" HTTP/1.1\r\nhost:  "), F.col("host"), F.lit("\r\n\r\nuser-agent: body"),
    )
    second = F.when(i % 4 == 0, "").when(i % 3 == 0, F.concat(F.lit("HTTP/1.1 101 Switching Protocols\r\nSec-WebSocket-Accept: a"), s, F.lit("\r\n\r\n"))).otherwise("HTTP/1.1 404 Not Found\r\n\r\n")
    server = F.concat(F.lit("HTTP/1.1 200 OK\r\nServer: srv"), (i % 5).cast("string"), F.lit("\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), F.coalesce("html", F.lit("")), end, second)
    return handshakes.http_records(p.select("page_id", client.alias("client"), server.alias("server")), ["page_id"], "client", "server")


@register("quic_handshakes", """
WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN 1798521807 ELSE 0 END AS version, event_id % 4 AS kind, event_id % 5 = 0 AS short FROM events),
q AS (SELECT *, kind = CASE WHEN version = 1 THEN 0 ELSE 1 END AS initial FROM e WHERE version > 0 AND NOT short)
SELECT user_id, array_to_string(list_sort(list(DISTINCT version)), ' ') AS versions, count(*) FILTER (initial) AS initials, count(DISTINCT event_id % 1000) AS connections,
       bool_or(event_id % 11 = 0) AS has_token, string_agg(DISTINCT CASE WHEN event_id % 11 = 0 THEN 'frp' ELSE 'h3' END, ' ' ORDER BY CASE WHEN event_id % 11 = 0 THEN 'frp' ELSE 'h3' END) AS alpn FROM q GROUP BY 1""")  # fmt: skip
def quic_handshakes(spark, sf):
    """Long headers read from datagrams: versions, Initial packets, connections, protocol sets."""
    i = F.col("event_id")
    version = F.when(i % 3 == 0, "00000001").when(i % 3 == 1, "6b3343cf").otherwise("00000000")
    first = F.when(i % 5 == 0, F.hex(64 + i % 4)).otherwise(F.hex(192 + 16 * (i % 4)))
    datagram = F.concat(first, version, F.lit("04"), F.lpad(F.hex(i % 1000), 8, "0"), F.lit("02"), F.lpad(F.hex(i % 7), 4, "0"), F.lit("00ff"))
    rows = table(spark, sf, "events").select("user_id", datagram.alias("data"), F.when(i % 11 == 0, "frp").otherwise("h3").alias("alpn"))
    got = handshakes.quic_summary(handshakes.quic_headers(rows, "data"), ["user_id"], "alpn")
    text_of = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return got.select("user_id", text_of("versions").alias("versions"), "initials", "connections", "has_token", text_of("alpn").alias("alpn"))
