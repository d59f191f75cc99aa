"""Shards of nearly equal bytes: longest-processing-time scheduling of groups that must stay together.

A group (rows with equal text) weighs the sum of its rows' sizes. Groups are sorted by weight and each goes to the
least-loaded shard, kept in a heap. This runs on several levels, so that no list of all groups is ever in one place:

1. Groups are dealt to buckets of about `IN_BUCKET` groups by a hash. Each bucket schedules its groups onto lots, a shard's worth split into
   `COARSE` lots; the lightest groups, `FINE_SHARE` of the bucket's bytes, go to much finer lots. A group heavier than
   a coarse lot is a lot by itself, of which there can be at most shards * COARSE.
2. Where that leaves over `MOST_LOTS` lots, the lots are scheduled onto lots in the same way, and so on. Each level has
   at most about shards * (2 * COARSE + FINE_SHARE * FINE) + 2 * buckets lots.
3. The driver schedules the last lots, heaviest first, onto the shards. The last ones to be placed are about a FINE-th of
   a shard or a small bucket, which bounds how far the shards' sizes can be apart.

A single group heavier than a shard's share stays whole, and the other shards share the rest. Rows of a shard are
numbered in salted parts, so no shard is gathered in one task. Null text counts as empty, and as equal to empty text.
Repeated rows are separate rows of one group; null identifiers are allowed. Other columns are not looked at.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import parts, ranked, settle

COARSE, FINE, FINE_SHARE = 16, 1024, 0.06
ROW_BYTES = 16
IN_BUCKET, MOST_LOTS = 100_000, 200_000


def schedule(weights: list[int], n: int) -> list[int]:
    """Bin of each weight: heaviest first to the least-loaded of n bins; ties go to the earlier weight and bin."""
    heap = [(0, b) for b in range(n)]
    out = [0] * len(weights)
    for i in sorted(range(len(weights)), key=lambda i: (-weights[i], i)):
        load, b = heap[0]
        out[i] = b
        heapq.heapreplace(heap, (load + weights[i], b))
    return out


def _lots(weights: np.ndarray, total: int, shards: int) -> np.ndarray:
    """Lot number, within the bucket, of each of its groups (weights in falling order)."""
    coarse, fine = total / (shards * COARSE), total / (shards * FINE)
    heavy = int((weights > coarse).sum())
    rest = weights[heavy:]
    lot = np.arange(len(weights))
    if len(rest):
        light = np.cumsum(rest[::-1])[::-1] <= FINE_SHARE * rest.sum()
        if heavy or not light.any():
            light[-1] = True
        next_lot = heavy
        for part, size in ((~light, coarse), (light, fine)):
            at = np.flatnonzero(part) + heavy
            if len(at):
                n = min(len(at), int(np.ceil(weights[at].sum() / size)))
                lot[at] = next_lot + np.array(schedule(weights[at].tolist(), n))
                next_lot += n
    return lot


def _homes(items: DataFrame, total: int, shards: int) -> DataFrame:
    """(key, shard) of items (key, weight), settled; total is the sum of all weights."""
    spark = items.sparkSession
    n = items.count()
    buckets = max(parts(spark), -(-n // IN_BUCKET))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "key"], ascending=[False, True], kind="stable")
        lot = _lots(pdf["weight"].to_numpy(), total, shards)
        return pd.DataFrame({"key": pdf["key"], "weight": pdf["weight"], "lot": pdf["bucket"].to_numpy() * (1 << 40) + lot})

    kind = items.schema["key"].dataType.simpleString()
    bucketed = items.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    placed = settle(bucketed.groupBy("bucket").applyInPandas(local, f"key {kind}, weight long, lot long"))
    lots = settle(placed.groupBy("lot").agg(F.sum("weight").alias("weight")))
    if MOST_LOTS < lots.count() < n:
        homes = _homes(lots.withColumnRenamed("lot", "key"), total, shards).withColumnRenamed("key", "lot")
        return settle(placed.join(homes, "lot").select("key", "shard"))
    rows = lots.orderBy(F.desc("weight"), "lot").collect()
    where = schedule([r.weight for r in rows], shards)
    table = spark.createDataFrame([(r.lot, s) for r, s in zip(rows, where, strict=True)], "lot long, shard int")
    return placed.join(F.broadcast(table), "lot").select("key", "shard")


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, size, text_crc32, shard, slot (0-based place in the shard)."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(data) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"), F.unhex(F.sha2(data, 256)).alias("_text"),
    )
    rows = settle(rows)
    groups = settle(rows.groupBy("_text").agg(F.sum("size").alias("weight")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    homes = _homes(groups.withColumnRenamed("_text", "key"), total, shards).withColumnRenamed("key", "_text")
    out = settle(rows.join(homes, "_text").drop("_text"))
    out = ranked(out, ["shard"], ["_id"], F.xxhash64("_id", "text_crc32"), parts(docs.sparkSession), "slot")
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot")
