"""Queries on texts, hashes and retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from netquarry.durable import settle
from netquarry.functions import hashing, text, vectors
from netquarry.operators import masking, ordering, retrieval
from netquarry.operators.vector_index import VectorIndex
from netquarry.operators.vector_search import nearest_rows
from netquarry.plans.registry import register, table


def _turns(spark, sf):
    return table(spark, sf, "conversations")


@register("think_strip", r"""
WITH t AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '<think> ' || text || ' </think>' || text WHEN 1 THEN text ELSE '<think></think>' || text END AS s FROM conversations)
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(s, '(?s)<think>.*?</think>', '', 'g'), '\s+', ' ', 'g')) AS answer,
       CASE WHEN regexp_full_match(s, '\s*') THEN '' WHEN regexp_matches(s, '(?s)<think>(.*?)</think>') THEN regexp_replace(regexp_extract(s, '(?s)<think>(.*?)</think>', 1), '^\s+|\s+$', '', 'g') ELSE s END AS thought FROM t""")  # fmt: skip
def think_strip(spark, sf):
    """Thought blocks cut out and taken out, the whole text as thought and as answer."""
    s, n = F.col("text"), F.col("turn") % 3
    made = F.when(n == 0, F.concat(F.lit("<think> "), s, F.lit(" </think>"), s)).when(n == 1, s).otherwise(F.concat(F.lit("<think></think>"), s))
    rows = _turns(spark, sf).withColumn("s", made)
    return rows.select("conv_id", "turn", text.strip_think(F.col("s")).alias("answer"), text.think_text(F.col("s")).alias("thought"))


@register("confidence_score", r"""
WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'x 0.7 【置信度】：0.' || (doc_id % 10) WHEN 1 THEN '置信度 is about 0.' || (doc_id % 100) || ' sure' WHEN 2 THEN '【置信度】:  1' WHEN 3 THEN '【置信度】 .5' ELSE 'none 0.9' END AS s FROM documents)
SELECT doc_id, round(coalesce(TRY_CAST(nullif(regexp_extract(s, '【置信度】[：:]\s*([0-9]*\.?[0-9]+)', 1), '') AS DOUBLE),
       TRY_CAST(nullif(regexp_extract(s, '置信度.*?([0-9]*\.?[0-9]+)', 1), '') AS DOUBLE), -1.0), 6) AS score FROM t""")  # fmt: skip
def confidence_score(spark, sf):
    """A score after its tag in free text, with a looser pattern and a default behind it."""
    d, n = F.col("doc_id"), F.col("doc_id") % 5
    s = F.when(n == 0, F.concat(F.lit("x 0.7 【置信度】：0."), (d % 10).cast("string"))).when(n == 1, F.concat(F.lit("置信度 is about 0."), (d % 100).cast("string"), F.lit(" sure")))
    s = s.when(n == 2, "【置信度】:  1").when(n == 3, "【置信度】 .5")
    rows = table(spark, sf, "documents").withColumn("s", s.otherwise("none 0.9"))
    return rows.select("doc_id", F.round(text.confidence(F.col("s")), 6).alias("score"))


@register("code_block", r"""
WITH t AS (SELECT doc_id, '```python' || chr(10) || 'x``` ```' || chr(10) || text || '```' AS s FROM documents)
SELECT doc_id, regexp_extract_all(s, '(?s)```(?:\w+)?\n(.*?)```', 1)[-1] AS code FROM t""")
def code_block(spark, sf):
    """The last fenced code block, a whole text (F8)."""
    s = F.concat(F.lit("```python\nx``` ```\n"), F.col("text"), F.lit("```"))
    return table(spark, sf, "documents").select("doc_id", text.last_code_block(s).alias("code"))


_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"


_PAIR_SQL = f"""
SELECT d.doc_id, b.item_id, {_NORM.format("substr(d.text, 1, 80)")} AS p, {_NORM.format("substr(b.text, 1, 80)")} AS g
FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40 WHERE d.lang = 'en' AND regexp_matches(substr(d.text, 1, 80) || substr(b.text, 1, 80), '^[ -~\\s]*$')"""


def _answers(spark, sf):
    a, b = F.substring("text", 1, 80), F.substring("gold", 1, 80)
    gold = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("gold"))
    rows = table(spark, sf, "documents").where("lang = 'en'").join(gold, F.col("item_id") == F.col("doc_id") % 40)
    rows = rows.where(F.concat(a, b).rlike(r"^[ -~\s]*$"))
    return rows.select("doc_id", "item_id", text.normal_answer(a).alias("p"), text.normal_answer(b).alias("g"))


# A letter beyond ASCII is a word character, so it stands between underscores (none are left) while articles are cut.
_NORM_ALL = (
    r"trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({}, '')), '[!-/:-@\[-`{{-~]', '', 'g'), "
    r"'([\x{{aa}}\x{{b5}}\x{{ba}}\x{{c0}}-\x{{d6}}\x{{d8}}-\x{{f6}}\x{{f8}}-\x{{1fff}}\x{{2c00}}-\x{{2dff}}\x{{3040}}-\x{{d7ff}}])', '_\1_', 'g'), "
    r"'\b(a|an|the)\b', ' ', 'g'), '_', ''), '\s+', ' ', 'g'))"
)


@register("answer_norm", f"SELECT item_id, {_NORM_ALL.format('text')} AS answer FROM benchmark")
def answer_norm(spark, sf):
    """Normal form of answers in any alphabet."""
    return table(spark, sf, "benchmark").select("item_id", text.normal_answer(F.coalesce("text", F.lit(""))).alias("answer"))


_GOLD_SQL = f"""
WITH x AS MATERIALIZED (SELECT doc_id, item_id, p, g FROM (SELECT doc_id, {_NORM_ALL.format('text')} AS p FROM documents) JOIN
  (SELECT item_id, {_NORM_ALL.format('text')} AS g FROM benchmark) ON item_id % 40 = doc_id % 40)"""


def _all_answers(spark, sf):
    """Documents and items by whole text; a document's golds are all items with its number modulo 40."""
    normal = text.normal_answer(F.coalesce("text", F.lit("")))
    docs = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 40).alias("k"), normal.alias("p"))
    return docs, table(spark, sf, "benchmark").select("item_id", (F.col("item_id") % 40).alias("k"), normal.alias("g"))


@register("token_f1", _GOLD_SQL + """,
pt AS (SELECT doc_id, item_id, t, count(*) AS n FROM (SELECT doc_id, item_id, unnest(string_split(p, ' ')) AS t FROM x) WHERE t <> '' GROUP BY ALL),
gt AS (SELECT doc_id, item_id, t, count(*) AS n FROM (SELECT doc_id, item_id, unnest(string_split(g, ' ')) AS t FROM x) WHERE t <> '' GROUP BY ALL),
s AS (SELECT doc_id, item_id, sum(least(pt.n, gt.n)) AS n FROM pt JOIN gt USING (doc_id, item_id, t) GROUP BY ALL),
f AS (SELECT doc_id, p = g AS exact, CASE WHEN p <> g AND (p IN ('yes', 'no', 'noanswer') OR g IN ('yes', 'no', 'noanswer')) THEN 0 ELSE
  coalesce(2.0 * s.n / (len(list_filter(string_split(p, ' '), lambda y: y <> '')) + len(list_filter(string_split(g, ' '), lambda y: y <> ''))), 0) END AS f1 FROM x LEFT JOIN s USING (doc_id, item_id))
SELECT doc_id, round(max(f1), 6) AS f1, bool_or(exact) AS exact, bool_or(exact) OR max(f1) >= 0.3 AS good FROM f GROUP BY 1""")  # fmt: skip
def token_f1(spark, sf):
    """Best F1 and exact match of whole texts over a list of golds, and the decision by them."""
    docs, items = _all_answers(spark, sf)
    golds = items.groupBy("k").agg(F.collect_list("g").alias("golds"))
    rows = docs.join(golds, "k").select("doc_id", text.best_of_golds("p", "golds").alias("b"))
    return rows.select("doc_id", F.round("b.f1", 6).alias("f1"), "b.exact", (F.col("b.exact") | (F.col("b.f1") >= 0.3)).alias("good"))


@register("word_overlap", _GOLD_SQL + """,
s AS (SELECT doc_id, item_id, len(list_intersect(list_distinct(string_split(p, ' ')), list_distinct(string_split(g, ' ')))) AS n, p = g AS exact FROM x)
SELECT doc_id, item_id, n AS overlap, exact AS equal, max(n) OVER d AS n, first_value(item_id) OVER (PARTITION BY doc_id ORDER BY n DESC, item_id) AS best,
       bool_or(exact) OVER d AS exact, count(*) OVER d AS golds FROM s WINDOW d AS (PARTITION BY doc_id)""")
def word_overlap(spark, sf):
    """Set intersection of words and equality of each whole text with every gold, a row for each pair, beside the best gold of
    the text and whether any is equal (U6, F14, C3)."""
    docs, items = _all_answers(spark, sf)
    pairs = docs.join(items, "k")
    n = F.size(F.array_intersect(F.split("p", " "), F.split("g", " "))).cast("long")
    rows = pairs.select("doc_id", "item_id", n.alias("overlap"), (F.col("p") == F.col("g")).alias("equal"))
    w = Window.partitionBy("doc_id")
    best = F.max_by("item_id", F.struct("overlap", -F.col("item_id"))).over(w)
    return rows.select("*", F.max("overlap").over(w).alias("n"), best.alias("best"), F.bool_or("equal").over(w).alias("exact"), F.count(F.lit(1)).over(w).alias("golds"))


@register("tag_answer", r"""
WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a <answer> ' || n_chars || ' </answer>' WHEN 1 THEN '<answer>1</answer><answer>2</answer>' ELSE 'none' END AS s FROM documents),
a AS (SELECT doc_id, s, CASE WHEN len(regexp_extract_all(s, '(?s)<answer>(.*?)</answer>', 1)) = 1 THEN trim(regexp_extract_all(s, '(?s)<answer>(.*?)</answer>', 1)[1]) END AS answer FROM t)
SELECT doc_id, answer, CASE WHEN contains(s, '<answer>') THEN 1 ELSE -1 END AS format_reward,
  CASE WHEN regexp_matches(answer, '^[-+]?\d+$') THEN 'math' WHEN answer IS NOT NULL THEN 'text' END AS kind FROM a""")  # fmt: skip
def tag_answer(spark, sf):
    """The only tagged answer, its type, and the reward for having a tag."""
    n = F.col("doc_id") % 3
    s = F.when(n == 0, F.concat(F.lit("a <answer> "), F.col("n_chars").cast("string"), F.lit(" </answer>"))).when(n == 1, "<answer>1</answer><answer>2</answer>").otherwise("none")
    rows = table(spark, sf, "documents").withColumn("s", s).withColumn("answer", text.one_tag(F.col("s"), "answer"))
    kind = F.when(F.col("answer").isNotNull(), text.answer_kind(F.col("answer")))
    return rows.select("doc_id", "answer", F.when(F.contains("s", F.lit("<answer>")), 1).otherwise(-1).alias("format_reward"), kind.alias("kind"))


def _calls(events):
    s = F.concat(F.lit('<tool_call>{"name": "'), F.col("event_type"), F.lit('", "n": '), F.col("user_id").cast("string"), F.lit("}</tool_call><tool_call>{bad</tool_call>"))
    rows = events.select("event_id", F.explode(F.regexp_extract_all(s, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), 1)).alias("j"))
    call = F.from_json("j", "name string, n bigint", {"mode": "PERMISSIVE"})
    return rows.select("event_id", call.alias("c")).where("c.name is not null").select("event_id", "c.name", "c.n")


@register("tool_calls", r"""
WITH t AS (SELECT event_id, '<tool_call>{"name": "' || event_type || '", "n": ' || user_id || '}</tool_call><tool_call>{bad</tool_call>' AS s FROM events)
SELECT event_id, json_extract_string(j, '$.name') AS name, CAST(json_extract(j, '$.n') AS BIGINT) AS n
FROM (SELECT event_id, unnest(regexp_extract_all(s, '(?s)<tool_call>(.*?)</tool_call>', 1)) AS j FROM t) WHERE json_valid(j)""")  # fmt: skip
def tool_calls(spark, sf):
    """Calls of all events in tagged JSON; bad JSON is skipped (F24, J-1)."""
    return _calls(table(spark, sf, "events"))


@register("props_json", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def props_json(spark, sf):
    """A field of JSON in a string (J-1, J-2)."""
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


_CALLS = {  # a call in four forms; the numbers come from the row
    0: ("is_suspicious: True, suspicious_flows_start=", ", suspicious_flows_duration = -"),
    1: ('{"is_suspicious": false, "suspicious_flows_start": ', ', "suspicious_flows_duration": '),
    2: ("<is_suspicious>TRUE</is_suspicious><suspicious_flows_start>", "</suspicious_flows_start> duration="),
    3: ("is_suspicious maybe start=", ""),
}
_CALL_SQL = "CASE doc_id % 4 " + " ".join(f"WHEN {k} THEN '{a}' || (n_chars % 97) || '{b}' || (n_chars % 13)" for k, (a, b) in _CALLS.items()) + " END"


@register("report_arguments", rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') || ' ' || {_CALL_SQL} || ' ' || coalesce(text, '') AS s FROM documents)
SELECT doc_id, lower(regexp_extract(s, '(?i)is_suspicious["'']?(?:>|\s*[:=])\s*(true|false)', 1)) = 'true' AS flag,
       TRY_CAST(nullif(regexp_extract(s, 'suspicious_flows_start["'']?(?:>|\s*[:=])\s*(-?\d+)', 1), '') AS INT) AS start,
       TRY_CAST(nullif(regexp_extract(s, 'suspicious_flows_duration["'']?(?:>|\s*[:=])\s*(-?\d+)', 1), '') AS INT) AS duration FROM t""")  # fmt: skip
def report_arguments(spark, sf):
    """Arguments of a report call inside whole texts, in several forms."""
    call = F.lit(None).cast("string")
    for k, (a, b) in _CALLS.items():
        form = F.concat(F.lit(a), (F.col("n_chars") % 97).cast("string"), F.lit(b), (F.col("n_chars") % 13).cast("string"))
        call = F.when(F.col("doc_id") % 4 == k, form).otherwise(call)
    own = F.coalesce("text", F.lit(""))
    rows = table(spark, sf, "documents").select("doc_id", F.concat(own, F.lit(" "), call, F.lit(" "), own).alias("s"))
    return rows.select("doc_id", text.report_arguments(F.col("s")).alias("r")).select("doc_id", "r.*")


_BYTES_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\x{800}-\x{ffff}]', '...', 'g'), '[\x{10000}-\x{10ffff}]', '....', 'g'), '[\x{80}-\x{7ff}]', '..', 'g'), '[^\x20-\x7e]', '.', 'g')"


@register("printable_hex", f"""
SELECT doc_id, {_BYTES_SQL} AS ascii, CASE WHEN coalesce(text, '') = '' THEN -1 ELSE CAST('0x' || substr(hex(encode(text)), 1, 2) AS INT) END AS first_byte FROM documents""")
def printable_hex(spark, sf):
    """Hex payload as printable text, a dot for each other byte, and its first byte."""
    rows = table(spark, sf, "documents").withColumn("_hex", F.hex(F.coalesce("text", F.lit(""))))
    first = F.conv(F.substring("_hex", 1, 2), 16, 10).try_cast("int")
    return rows.select("doc_id", text.printable(F.col("_hex")).alias("ascii"), F.coalesce(F.when(F.col("_hex") != "", first), F.lit(-1)).alias("first_byte"))


@register("hex_text", "SELECT doc_id, text AS decoded FROM documents")
def hex_text(spark, sf):
    """Hex payload as UTF-8 (F1)."""
    return table(spark, sf, "documents").select("doc_id", text.hex_to_text(F.hex("text")).alias("decoded"))


@register("boxed_answer", "SELECT doc_id, '{' || n_chars || '}x' AS boxed FROM documents")
def boxed_answer(spark, sf):
    """The last boxed answer with balanced braces."""
    s = F.concat(F.lit("so \\boxed{1} and \\boxed{{"), F.col("n_chars").cast("string"), F.lit("}x} end"))
    return table(spark, sf, "documents").select("doc_id", text.last_boxed(s).alias("boxed"))


@register("community_id", """
WITH f AS (SELECT DISTINCT l_orderkey % 500 AS a, l_suppkey % 250 AS b, l_linenumber + 1000 AS sp, l_linenumber * 7 + 998 AS dp FROM lineitem),
x AS (SELECT a, b, sp, dp, printf('0A00%02X%02X', a // 256, a % 256) AS ha, printf('0A00%02X%02X', b // 256, b % 256) AS hb FROM f),
o AS (SELECT *, ha > hb OR (ha = hb AND sp > dp) AS swap FROM x)
SELECT a, b, sp, dp, '1:' || to_base64(unhex(sha1(unhex('0000' || CASE WHEN swap THEN hb || ha ELSE ha || hb END || '0600' ||
       CASE WHEN swap THEN printf('%04X%04X', dp, sp) ELSE printf('%04X%04X', sp, dp) END)))) AS cid FROM o""")  # fmt: skip
def community_id(spark, sf):
    """Community ID of flows, the same from either end (H1)."""
    f = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 500).alias("a"), (F.col("l_suppkey") % 250).alias("b"), (F.col("l_linenumber") + 1000).alias("sp"), (F.col("l_linenumber") * 7 + 998).alias("dp")).distinct()
    ip = lambda c: F.concat_ws(".", F.lit("10"), F.lit("0"), F.floor(F.col(c) / 256).cast("string"), (F.col(c) % 256).cast("string"))
    return f.withColumn("cid", hashing.community_id(ip("a"), ip("b"), F.col("sp"), F.col("dp"), F.lit(6)))


@register("flow_uid", "SELECT o_orderkey, 'C' || substr(md5(concat_ws('-', o_custkey, o_orderkey, o_orderpriority)), 1, 12) AS uid FROM orders")
def flow_uid(spark, sf):
    """Identifiers from the flow's key (H2, H3)."""
    return table(spark, sf, "orders").select("o_orderkey", hashing.flow_uid(F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderpriority")).alias("uid"))


_ADDRESS_SQL = masking.ADDRESS


@register("text_masking", rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_ADDRESS_SQL}') AS ips FROM documents),
f AS (SELECT doc_id, unnest(ips) AS ip, unnest(range(len(ips))) AS place FROM d),
p AS (SELECT ip, 'Masked_IP_' || row_number() OVER (ORDER BY min((doc_id, place))) AS name FROM f GROUP BY 1),
n AS (SELECT doc_id, list(name ORDER BY place) AS names FROM f JOIN p USING (ip) GROUP BY 1),
s AS (SELECT doc_id, coalesce(names, []) AS names, string_split_regex(regexp_replace(t, '{_ADDRESS_SQL}', chr(1), 'g'), chr(1)) AS pieces FROM d LEFT JOIN n USING (doc_id))
SELECT doc_id, array_to_string(list_transform(pieces, lambda x, i: regexp_replace(x, ':\d{{2,5}}\b', ':[PORT]', 'g') || coalesce(names[i], '')), '') AS masked, len(names) AS n FROM s""")  # fmt: skip
def text_masking(spark, sf):
    """Addresses inside whole texts under stable pseudonyms."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("masked"))
    out, _ = masking.mask_addresses(docs, ["doc_id"], [], ["masked"])
    return out.withColumn("n", F.regexp_count("masked", F.lit(r"Masked_IP_\d+")).cast("long"))


@register("ip_mask", r"""
WITH e AS (SELECT event_id, epoch_us(ts) AS t, '10.0.0.' || user_id AS ip FROM events),
p AS (SELECT ip, 'IP_' || row_number() OVER (ORDER BY min((t, event_id))) AS pseudonym FROM e GROUP BY 1)
SELECT event_id, pseudonym, regexp_replace('from ' || pseudonym || ':' || (event_id % 90000 + 10), ':\d{2,5}', ':PORT', 'g') AS line FROM e JOIN p USING (ip)""")  # fmt: skip
def ip_mask(spark, sf):
    """Stable pseudonyms in order of first appearance, and masked ports."""
    e = table(spark, sf, "events").select("event_id", F.expr("unix_micros(cast(ts as timestamp))").alias("t"), F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("ip"))
    first = e.groupBy("ip").agg(F.min("t").alias("t"), F.min_by("event_id", F.struct("t", "event_id")).alias("event_id"))
    names = ordering.global_index(first, F.floor(F.col("t") / 86_400_000_000), ["t", "event_id"])
    names = names.select("ip", F.concat(F.lit("IP_"), F.col("rn").cast("string")).alias("pseudonym"))
    port = F.concat(F.lit("from "), F.col("pseudonym"), F.lit(":"), (F.col("event_id") % 90000 + 10).cast("string"))
    return e.join(names, "ip").select("event_id", "pseudonym", F.regexp_replace(port, r":\d{2,5}", ":PORT").alias("line"))


@register("page_titles", r"""
SELECT page_id, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS title, length(regexp_replace(html, '(?s)<[^>]+>', '', 'g')) AS n FROM pages""")
def page_titles(spark, sf):
    """Title and size of crawled pages without markup."""
    rows = table(spark, sf, "pages")
    return rows.select("page_id", F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1).alias("title"), F.length(F.regexp_replace("html", r"(?s)<[^>]+>", "")).cast("long").alias("n"))


# Retrieval -----------------------------------------------------------------------------------------------------------

_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_COS_SQL = f"""
WITH v AS (SELECT vec_id, label, embedding AS e FROM embeddings),
p AS (SELECT q.vec_id AS q, c.vec_id AS c, c.label AS label, round({_DOT.format('q.e', 'c.e')} / (sqrt({_DOT.format('q.e', 'q.e')}) * sqrt({_DOT.format('c.e', 'c.e')})), 6) AS score
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)"""


def _cosine(spark, sf, k):
    e = table(spark, sf, "embeddings")
    return nearest_rows(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", k)


@register("cosine_topk", _COS_SQL + "SELECT q, c, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM p) WHERE rank <= 10")
def cosine_topk(spark, sf):
    """Exact vector search, itself left out."""
    return _cosine(spark, sf, 10)


@register("near_vectors", _COS_SQL + """
SELECT q, max(score) AS nearest, count(*) FILTER (score > 0.95) AS close, bool_or(score > 0.95) AS dropped FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM p) WHERE rank <= 3 GROUP BY 1""")
def near_vectors(spark, sf):
    """Rows whose three nearest are too similar (U8)."""
    rows = _cosine(spark, sf, 3)
    close = F.col("score") > 0.95
    return rows.groupBy("q").agg(F.max("score").alias("nearest"), F.count_if(close).alias("close"), F.bool_or(close).alias("dropped"))


def _two_stage(spark, sf, head):
    e = table(spark, sf, "embeddings").withColumn("head", F.slice("embedding", 1, head))
    coarse = nearest_rows(e.where("vec_id % 50 = 0"), e, "vec_id", "head", 100).select("q", "c")
    full = e.select("vec_id", "embedding")
    rows = coarse.join(full.withColumnsRenamed({"vec_id": "q", "embedding": "qv"}), "q").join(full.withColumnsRenamed({"vec_id": "c", "embedding": "cv"}), "c")
    return retrieval.best(rows, "q", F.round(vectors.cosine(F.col("qv"), F.col("cv")), 6), ["c"], 3).select("q", "c", "score", "rank")


@register("two_stage_match", f"""
WITH v AS (SELECT vec_id, embedding AS e, embedding[1:46] AS h FROM embeddings),
p AS (SELECT q.vec_id AS q, c.vec_id AS c, round({_DOT.format('q.h', 'c.h')} / (sqrt({_DOT.format('q.h', 'q.h')}) * sqrt({_DOT.format('c.h', 'c.h')})), 6) AS coarse,
      round({_DOT.format('q.e', 'c.e')} / (sqrt({_DOT.format('q.e', 'q.e')}) * sqrt({_DOT.format('c.e', 'c.e')})), 6) AS fine
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY coarse DESC, c) AS n FROM p)
SELECT q, c, fine AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY fine DESC, c) AS rank FROM r WHERE n <= 100) WHERE rank <= 3""")  # fmt: skip
def two_stage_match(spark, sf):
    """Coarse ranking by the first 46 dimensions, fine ranking of its first hundred by all."""
    return _two_stage(spark, sf, 46)


@register("fused_vectors", f"""
WITH v AS (SELECT vec_id, list_concat(list_transform(embedding[1:46], lambda x: CAST(x AS DOUBLE) * sqrt(0.6)), list_transform(embedding[47:], lambda x: CAST(x AS DOUBLE) * sqrt(0.4))) AS f FROM embeddings),
n AS (SELECT vec_id, f, sqrt({_DOT.format('f', 'f')}) AS n FROM v)
SELECT vec_id, CAST(i AS INT) AS pos, round(f[i + 1] / n, 6) AS x FROM (SELECT vec_id, f, n, unnest(range(0, len(f))) AS i FROM n)""")  # fmt: skip
def fused_vectors(spark, sf):
    """Statistics (46 dimensions) and payload (the rest) weighted into one vector of norm 1, every dimension."""
    f = vectors.fused(F.slice("embedding", 1, 46), F.slice("embedding", F.lit(47), F.size("embedding")))
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(f).alias("pos", "x")).withColumn("x", F.round("x", 6))


@register("dataset_recall", f"""
WITH u AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM embeddings),
m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM u GROUP BY 1, 2), g AS (SELECT label, list(x ORDER BY i) AS e FROM m GROUP BY 1),
p AS (SELECT vec_id, v.label AS truth, g.label AS c, round({_DOT.format('v.embedding', 'g.e')} / (sqrt({_DOT.format('v.embedding', 'v.embedding')}) * sqrt({_DOT.format('g.e', 'g.e')})), 6) AS score FROM embeddings v, g WHERE vec_id % 50 = 0)
SELECT vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, c) AS rank FROM p) WHERE truth = c""")  # fmt: skip
def dataset_recall(spark, sf):
    """Rank of the true dataset among all, by their mean vectors."""
    e = table(spark, sf, "embeddings")
    means = e.select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("x"))
    means = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("embedding"))
    means = means.withColumnRenamed("label", "vec_id")
    q = e.where("vec_id % 50 = 0").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    pairs = retrieval.vector_pairs(q, means, "vec_id", "vec_id", "embedding")
    ranked = retrieval.best(pairs, "q", F.round("score", 6), ["c"], 1 << 30)
    true = e.select(F.col("vec_id").alias("q"), F.col("label").alias("c"))
    return ranked.join(true, ["q", "c"]).select(F.col("q").alias("vec_id"), "rank")


_BM25_SQL = r"""
WITH dt AS (SELECT doc_id AS d, CASE WHEN len(ts) > 0 THEN ts ELSE ['__empty__'] END AS ts FROM (SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '(\p{Han})', ' \1 ', 'g'), '[\p{L}\p{N}\p{M}_]+') AS ts FROM documents)),
qt AS (SELECT item_id AS q, unnest(CASE WHEN len(ts) > 0 THEN ts ELSE ['__empty__'] END) AS t FROM (SELECT item_id, regexp_extract_all(regexp_replace(lower(text), '(\p{Han})', ' \1 ', 'g'), '[\p{L}\p{N}\p{M}_]+') AS ts FROM benchmark)),
st AS (SELECT count(*) AS n_docs, avg(len(ts)) AS mean_len FROM dt),
tf AS (SELECT d, l, t, count(*) AS tf FROM (SELECT d, len(ts) AS l, unnest(ts) AS t FROM dt) GROUP BY 1, 2, 3),
i0 AS (SELECT t, ln(n_docs - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, st GROUP BY t, n_docs),
idf AS (SELECT t, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i0) ELSE idf END AS idf FROM i0),
s AS (SELECT q, d, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean_len))), 5) AS score
      FROM (SELECT q, t, count(*) AS qf FROM qt GROUP BY 1, 2) JOIN idf USING (t) JOIN tf USING (t), st GROUP BY 1, 2),
r AS (SELECT q, d, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM s)"""


def _word_tables(spark, sf):
    words = text.search_words(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", words.alias("ts")), table(spark, sf, "benchmark").select("item_id", words.alias("ts"))


@register("bm25_topk", _BM25_SQL + "SELECT q, d, score, rank FROM r WHERE rank <= 5")
def bm25_topk(spark, sf):
    """Okapi BM25 of queries over a corpus, documents of every language."""
    return retrieval.bm25(*_word_tables(spark, sf), "doc_id", "item_id", "ts", 5).select("q", "d", "score", "rank")


_FUSION_SQL = f"""
WITH kb AS (SELECT doc_id AS d, text, embedding AS e FROM documents JOIN embeddings ON vec_id = doc_id WHERE len(embedding) > 0),
dt AS (SELECT d, CASE WHEN len(ts) > 0 THEN ts ELSE ['__empty__'] END AS ts FROM (SELECT d, regexp_extract_all(regexp_replace(lower(text), '(\\p{{Han}})', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+') AS ts FROM kb)),
st AS (SELECT count(*) AS n_docs, avg(len(ts)) AS mean_len FROM dt),
tf AS (SELECT d, l, t, count(*) AS tf FROM (SELECT d, len(ts) AS l, unnest(ts) AS t FROM dt) GROUP BY 1, 2, 3),
i0 AS (SELECT t, ln(n_docs - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, st GROUP BY t, n_docs),
idf AS (SELECT t, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i0) ELSE idf END AS idf FROM i0),
s AS (SELECT q.d AS q, x.d AS d, round(sum(q.tf * idf * x.tf * 2.5 / (x.tf + 1.5 * (0.25 + 0.75 * x.l / mean_len))), 5) AS score
      FROM tf q JOIN idf USING (t) JOIN tf x USING (t), st WHERE q.d % 50 = 0 AND q.d <> x.d GROUP BY 1, 2),
l AS (SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM s),
v AS (SELECT q.d AS q, c.d AS d, round({_DOT.format('q.e', 'c.e')} / (sqrt({_DOT.format('q.e', 'q.e')}) * sqrt({_DOT.format('c.e', 'c.e')})), 6) AS score
      FROM kb q, kb c WHERE q.d % 50 = 0 AND q.d <> c.d),
n AS (SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM v),
f AS (SELECT coalesce(l.q, n.q) AS q, coalesce(l.d, n.d) AS d, round(coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + n.rank), 0), 8) AS score
      FROM (SELECT * FROM l WHERE rank <= 100) l FULL JOIN (SELECT * FROM n WHERE rank <= 100) n ON l.q = n.q AND l.d = n.d)
SELECT q, d, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM f) WHERE rank <= 3"""  # fmt: skip


@register("rank_fusion", _FUSION_SQL)
def rank_fusion(spark, sf):
    """A knowledge base searched by meaning and by words: the three best of each query by reciprocal rank fusion of the first
    hundred of either list, itself and entries without a vector left out (R4, R5, W18)."""
    words, vectors_ = table(spark, sf, "documents").select("doc_id", text.search_words(F.col("text")).alias("ts")), table(spark, sf, "embeddings")
    held = vectors_.where("size(embedding) > 0").select(F.col("vec_id").alias("doc_id"), "embedding")
    kb = settle(words.join(held, "doc_id"))
    asked = kb.where("doc_id % 50 = 0")
    lexical = retrieval.bm25(kb, asked, "doc_id", "doc_id", "ts", 100, itself=False)
    near = VectorIndex(kb, "doc_id", "embedding").search(asked, "doc_id", "embedding", 100, exact=True)
    fused = retrieval.fuse_ranks(lexical, near.withColumnRenamed("c", "d"))
    return retrieval.best(fused, "q", F.round("score", 8), ["d"], 3).select("q", "d", "score", "rank")


@register("indexed_topk", _COS_SQL + "SELECT q, c, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM p) WHERE rank <= 10")
def indexed_topk(spark, sf):
    """Vector search through an inverted file, read until it is proved exact."""
    e = table(spark, sf, "embeddings")
    return VectorIndex(e, "vec_id", "embedding").search(e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10, exact=True)
