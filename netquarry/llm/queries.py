"""Queries over the driver's tables, one for each operator of this package, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.llm import chat_format, decontaminate, edit_counts, html_extract, repeats, resample, sharding, token_alignment, toxicity, url_reputation
from netquarry.llm.exact_dedup import exact_groups
from netquarry.llm.near_dedup import near_classes
from netquarry.llm.packing import pack, tokenize

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal normalised texts of all documents, each row with the identifier that stays."""
    return exact_groups(_table(spark, sf_dir, "documents"))


ORACLE_SQL["op5_exact_dedup"] = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
"""


PACK_WIDTH = 4096
END_ID = 1


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces with the sequence and the offset where each is packed."""
    docs = _table(spark, sf_dir, "documents")
    return pack(tokenize(docs, word_tokenizer_path(), PACK_WIDTH, END_ID), PACK_WIDTH)


@_query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in an occurrence of a benchmark window, and the items they come from."""
    rows = decontaminate.hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return rows.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE_SQL["op10_benchmark_decontamination"] = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, sizes WHERE len(w) >= n),
found AS (
  SELECT doc_id, i, p.n, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM places) p
  JOIN wins USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@_query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, from labels outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    return toxicity.score(docs, toxicity.train(docs, labels)).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@_query
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_classes(_table(spark, sf_dir, "documents"))


URL_RULES = [
    url_reputation.Rule("com", "/", "allow"),
    url_reputation.Rule("example.com", "/en/", "block"),
    url_reputation.Rule("www.example.com", "/en/", "allow"),
    url_reputation.Rule("net", "/es/", "block"),
    url_reputation.Rule("net", "/fr/", "block"),
]


@_query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page urls. A page's outcome is the quality label of the document whose number its path ends with."""
    pages = _table(spark, sf_dir, "pages")
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("outcome"))
    number = F.regexp_extract(url_reputation.url_parts(F.col("url"))[1], r"/(\d{1,18})(?:\.html|/)?$", 1)
    named = pages.select(F.col("url").alias("_url"), number.try_cast("bigint").alias("doc_id"))
    return url_reputation.judge(pages, named.join(labels, "doc_id"), URL_RULES)


ORACLE_SQL["op2_url_filter"] = r"""
WITH parts AS (
  SELECT page_id, u, CASE WHEN pos > 0 THEN substr(u, pos + 3) ELSE '' END AS rest
  FROM (SELECT page_id, coalesce(url, '') AS u, instr(coalesce(url, ''), '://') AS pos FROM pages)),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
quality AS (SELECT doc_id, max(quality) AS good FROM labels GROUP BY 1),
outcome AS (
  SELECT host, CAST(count(good) AS DOUBLE) AS n, CAST(coalesce(sum(1 - good), 0) AS DOUBLE) AS bad
  FROM (SELECT host, TRY_CAST(nullif(regexp_extract(path, '/(\d{1,18})(?:\.html|/)?$', 1), '') AS BIGINT) AS doc_id FROM split)
  LEFT JOIN quality USING (doc_id) GROUP BY host),
hosts AS (
  SELECT host, n, bad, CASE WHEN list_contains(TWO, two) THEN two ELSE split_part(name, '.', -1) END AS suffix,
         CASE WHEN list_contains(TWO, two) THEN array_to_string(string_split(name, '.')[-3:], '.') ELSE two END AS domain
  FROM (SELECT *, array_to_string(string_split(name, '.')[-2:], '.') AS two
        FROM (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', '') AS name FROM outcome))),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY 1),
p0 AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS prior FROM suffixes),
s1 AS (SELECT s.*, prior FROM suffixes s, p0),
k1 AS (SELECT sum((bad - n * prior) ** 2 - n * prior * (1 - prior)) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0) AS rho FROM s1 WHERE n > 0),
t1 AS (SELECT least(200.0, greatest(2.0, CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE 200.0 END)) AS k FROM k1),
q1 AS (SELECT suffix, (k * prior + bad) / (k + n) AS prior FROM s1, t1),
s2 AS (SELECT d.*, prior FROM domains d JOIN q1 USING (suffix)),
k2 AS (SELECT sum((bad - n * prior) ** 2 - n * prior * (1 - prior)) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0) AS rho FROM s2 WHERE n > 0),
t2 AS (SELECT least(200.0, greatest(2.0, CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE 200.0 END)) AS k FROM k2),
q2 AS (SELECT domain, (k * prior + bad) / (k + n) AS prior FROM s2, t2),
s3 AS (SELECT h.*, prior FROM hosts h JOIN q2 USING (domain)),
k3 AS (SELECT sum((bad - n * prior) ** 2 - n * prior * (1 - prior)) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0) AS rho FROM s3 WHERE n > 0),
t3 AS (SELECT least(200.0, greatest(2.0, CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE 200.0 END)) AS k FROM k3),
post AS (SELECT host, k * prior + bad AS a, k * (1 - prior) + n - bad AS b FROM s3, t3),
rep AS (SELECT host, a / (a + b) AS bad_rate, 1 / (1 + exp(-(ln(a / b) - 1.2816 * sqrt(1 / a + 1 / b)))) AS lower FROM post),
ruled AS (
  SELECT s.*, bad_rate, lower,
    CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM split s JOIN rep USING (host))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN lower > 0.5 THEN 'block' ELSE 'allow' END AS verdict, bad_rate, lower
FROM ruled
""".replace("TWO,", f"{url_reputation.TWO_LABEL_SUFFIXES},")


SHARDS = 40


@_query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards of nearly equal bytes; equal texts share a shard."""
    rows = sharding.shard(_table(spark, sf_dir, "documents"), SHARDS)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def made_edits(doc_id: F.Column, n_chars: F.Column, n: int = 6) -> F.Column:
    """A document's edits by rule: at hashed places, in turn an insertion, a deletion and a replacement."""
    at = lambda k: F.pmod(F.xxhash64(doc_id, k), F.greatest(n_chars, F.lit(0)) + 1)
    kind = lambda k: F.pmod(k, F.lit(3))
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda k: F.struct(
            at(k).alias("at"),
            F.when(kind(k) == 0, 0).when(kind(k) == 1, 9).otherwise(5).cast("long").alias("delete"),
            F.when(kind(k) == 0, F.lit(" edited")).when(kind(k) == 1, F.lit("")).otherwise(F.lit("XXXXX")).alias("insert"),
        ),
    )


@_query
def op9_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after six edits each."""
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    docs = docs.withColumn("edits", made_edits(F.col("doc_id"), F.coalesce(F.length("text"), F.lit(0)).cast("long")))
    rows = edit_counts.edited_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.withColumn("text_crc32", F.crc32(F.col("text").cast("binary"))).drop("text")


@_query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    field = html_extract.train(html_extract.labelled_pages())
    rows = html_extract.extract(_table(spark, sf_dir, "pages"), field)
    return rows.withColumn("n_chars", F.length("text").cast("long"))


@_query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that repeats of 400 bytes cover."""
    rows = repeats.remove_repeats(_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def byte_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@_query
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between two tokenizers' tokens of all documents, rated by how many documents hold each link."""
    rows = token_alignment.aligned(_table(spark, sf_dir, "documents"), byte_tokenizer_path(), piece_tokenizer_path())
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return token_alignment.rated(rows.withColumn("groups_sha256", digest).drop("groups"))


@_query
def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, as read back from their formatted text."""
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = chat_format.formatted(given.unionByName(hard))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return rows.withColumn("loss", chat_format.loss_text("formatted", "loss_spans")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL["op12_chat_format"] = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
safe AS (
  SELECT *, regexp_replace(text, '([\[<]\\*)(/?INST\]|/?ROLE\b|/?s>)', '\1\\\2', 'g') AS kept,
         replace(replace(role, '%', '%25'), ']', '%5D') AS name FROM given)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(kept) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 ELSE 16 + length(name) END) AS BIGINT)
         AS formatted_chars
FROM safe GROUP BY conv_id
"""


@_query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighted towards the benchmark's word runs, with the rank of those that are drawn."""
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


# CRC-32 has no function there: it is folded over the bytes of each different feature.
ORACLE_SQL["op13_importance_resampling"] = r"""
WITH RECURSIVE crc_steps(b, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM crc_steps WHERE k = 8),
texts AS (
  SELECT 0 AS kind, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
split AS (
  SELECT kind, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (
  SELECT kind, r, array_to_string(w[i:i + n - 1], ' ') AS feature
  FROM (SELECT kind, r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM split, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n)),
bytes AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM runs)),
hashed AS (
  SELECT feature, xor(list_reduce(list_transform(range(1, CAST(length(h) AS BIGINT), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)),
         lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM bytes, crc_table),
counts AS (
  SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM runs JOIN hashed USING (feature) GROUP BY 1),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (sum(s) OVER () + 10000) / (CAST(s + 1 AS DOUBLE) * (sum(t) OVER () + 10000)))) AS BIGINT) AS g
  FROM counts),
weights AS (
  SELECT r, count(*) AS n_features, CAST(sum(g) AS BIGINT) AS weight FROM runs JOIN hashed USING (feature) JOIN gain USING (bucket)
  WHERE kind = 0 GROUP BY r),
scored AS (
  SELECT doc_id, len(w) >= 20 AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM split LEFT JOIN weights USING (r) WHERE kind = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS p, count(*) FILTER (fit) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND p <= 5 * n // 100 THEN p END AS rank FROM placed
"""
