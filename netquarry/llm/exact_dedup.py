"""Exact deduplication by content sort, in DataFrame operations only.

Rows are range-partitioned by normalised content with splitters taken from a sample of sort keys, sorted inside each
partition by the whole normalised text, and compared with their neighbours in full: a window's groups are runs of
equal adjacent texts, and its sort spills to disk. The sort key ends with the identifier, so a group that holds a
third of all rows is spread over many partitions. Only a group that a splitter cuts can lie in two partitions, so at
most as many groups as there are splitters are summed up in a small second aggregate, again by the whole text.

Null text counts as empty. Rows with equal text and equal identifier are ties: one of them stays. A null identifier
sorts last, so it stays only if its whole group has none. Columns other than identifier and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.llm.common import parts, settle

SAMPLE_PER_PARTITION = 64  # sort keys that the driver gets for each splitter
HEAD = 24  # characters of normalised text at the start of a sort key


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _head(norm: Column) -> Column:
    """Equal texts have equal heads; other texts in between are as good as excluded by the hash."""
    return F.concat(F.substring(norm, 1, HEAD), F.lit("\u0001"), F.lpad(F.hex(F.xxhash64(norm)), 16, "0"))


def _tail(doc_id: Column) -> Column:
    return F.concat(F.lit("\u0002"), F.lpad(F.hex(F.coalesce(F.xxhash64(doc_id), F.lit(0))), 16, "0"))


def splitters(docs: DataFrame, id_col: str, text_col: str, n: int) -> list[str]:
    """At most n - 1 sort keys that cut the rows into n nearly equal ranges."""
    total = docs.count()
    share = max(1, total // max(1, n * SAMPLE_PER_PARTITION))
    norm = normalised(F.col(text_col))
    pick = F.pmod(F.xxhash64(F.lit(7), F.col(id_col)), F.lit(share)) == 0
    sample = docs.where(pick).select(F.concat(_head(norm), _tail(F.col(id_col))).alias("key"))
    keys = sorted((r.key for r in sample.collect()), key=lambda k: k.encode())
    return sorted({keys[i * len(keys) // n] for i in range(1, n)}, key=lambda k: k.encode()) if keys else []


def _bucket(key: Column, cuts: list[str]) -> Column:
    """Number of cuts that are not above the key, found in two steps of about sqrt(n) comparisons."""
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    tops = F.array(*[F.lit(b[0]) for b in blocks])
    inner = F.array(*[F.array(*map(F.lit, b)) for b in blocks])
    block = F.size(F.filter(tops, lambda c: c <= key))
    inside = F.size(F.filter(F.element_at(inner, block), lambda c: c <= key))
    return F.when(block == 0, 0).otherwise((block - 1) * step + inside)


def _sorted_groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _sha, _rank, _again, _keep, _size) of each row, whole groups that a splitter cuts included. Only identifier
    and normalised text go through the sort. _again: the next row of the group has the same identifier."""
    spark = docs.sparkSession
    n = parts(spark)
    cuts = splitters(docs, id_col, text_col, n)
    heads = sorted({c.rpartition("\u0002")[0] for c in cuts})
    keyed = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm"))
    keyed = keyed.withColumn("_head", _head(F.col("_norm")))
    cut = F.array_contains(F.array(*map(F.lit, heads)), F.col("_head")) if heads else F.lit(False)
    keyed = keyed.withColumn("_cut", cut).withColumn("_bucket", _bucket(F.concat("_head", _tail(F.col("_id"))), cuts))

    group = Window.partitionBy("_bucket", "_norm").orderBy(F.col("_id").asc_nulls_last())
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = keyed.drop("_head").repartitionById(n, F.col("_bucket"))
    local = dealt.select(
        "_id", "_cut",
        F.sha2(F.col("_norm"), 256).alias("_sha"),
        F.coalesce(F.lead(F.struct("_id")).over(group) == F.struct("_id"), F.lit(False)).alias("_again"),
        F.row_number().over(group).alias("_rank"),
        F.min("_id").over(whole).alias("_keep"),
        F.count(F.lit(1)).over(whole).alias("_size"),
    )
    # Never more rows than splitters (but for equal 64-bit hashes with equal heads), each without its text.
    summed = keyed.where("_cut").groupBy("_norm").agg(F.min("_id").alias("_k"), F.count(F.lit(1)).alias("_s"))
    summed = summed.select(F.sha2("_norm", 256).alias("_sha"), F.lit(True).alias("_cut"), "_k", "_s")
    joined = local.join(F.broadcast(summed), ["_sha", "_cut"], "left") if heads else local.withColumns(
        {"_k": F.lit(None).cast(local.schema["_keep"].dataType), "_s": F.lit(None).cast("long")}
    )
    return joined.select(
        "_id", "_sha", "_rank", "_again",
        F.when(F.col("_s").isNotNull(), F.col("_k")).otherwise(F.col("_keep")).alias("_keep"),
        F.coalesce("_s", "_size").alias("_size"),
    )


def _stays() -> Column:
    return (F.col("_rank") == 1) & F.col("_id").eqNullSafe(F.col("_keep"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 of the normalised text."""
    rows = _sorted_groups(docs, id_col, text_col)
    return rows.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        _stays().alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns as they came, whatever their names.

    The sort finds identifier and digest of what stays; this small table is written, and the rows join it. Of rows that share
    both, one stays: those few identifiers go through an aggregate that keeps one row in each task before the shuffle."""
    stays = _sorted_groups(docs, id_col, text_col).where(_stays())
    stays = settle(stays.select(F.struct(F.col("_id").alias("i"), F.col("_sha").alias("s")).alias("_key"), "_again"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    sha = F.sha2(normalised(F.col(text_col)), 256)
    rows = docs.select(F.struct(F.col(id_col).alias("i"), sha.alias("s")).alias("_key"), row)
    once = rows.join(stays.where("not _again"), "_key").select("_row.*")
    if stays.where("_again").isEmpty():
        return once
    several = rows.join(stays.where("_again"), "_key").groupBy("_key").agg(F.first("_row").alias("_row"))
    return once.unionByName(several.select("_row.*"))
