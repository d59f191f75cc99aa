"""Importance resampling towards a target corpus by hashed word runs.

Every run of 1 to `LONGEST` consecutive words is a feature and its hash a bucket. A bucket's gain says how much more of
the target's features than of the pool's fall into it; a document's weight is the sum of its features' gains. Weight
plus a Gumbel number drawn from the identifier is the score, so taking the highest scores is a draw without
replacement in proportion to exp(weight / 1000).

No feature is ever a row while scoring: higher-order functions make each document's bucket array, and `aggregate` sums
`element_at` of one literal array of `BUCKETS` gains. The arrays are written once and read for counting and scoring.
Counting sends at most `BUCKETS` partial sums of each task through a shuffle, and only these totals reach the driver.
Ranks come from ranges of scores: ranges that lie wholly below the draw aren't numbered.

Null and wordless texts have no features, weight 0 and a score, and are never drawn. Equal rows tie and get different
ranks in any order; a null identifier is drawn as the text '' and comes last among equals. An empty pool or an empty
target still gives gains (both counts start at one). Columns other than identifier and text are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.llm.common import Scratch, parts, settle

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words with A-Z lower-cased, other letters as they are."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.regexp_extract_all(F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER)), F.lit(WORD), F.lit(0))


def _bucket(feature: Column) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(BUCKETS)).cast("int")


def with_buckets(texts: DataFrame) -> DataFrame:
    """(_id, _n_words, _buckets) of (_id, _text): one bucket for each feature."""
    split = texts.select("_id", words(F.col("_text")).alias("_words"))

    def runs(n: int) -> Column:
        """Runs of n words begin at each word but the last n - 1."""
        heads = F.slice("_words", F.lit(1), F.greatest(F.size("_words") - (n - 1), F.lit(0)))
        more = [lambda i, k=k: F.get("_words", i + k) for k in range(1, n)]
        return F.transform(heads, lambda w, i: _bucket(F.concat_ws(" ", w, *[m(i) for m in more])))

    return split.select("_id", F.size("_words").alias("_n_words"), F.concat(*[runs(n) for n in range(1, LONGEST + 1)]).alias("_buckets"))


def _totals(made: DataFrame) -> list[int]:
    """Features in each bucket. At most BUCKETS rows come back."""
    counts = made.select(F.explode("_buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    out = [0] * BUCKETS
    for row in counts.collect():
        out[row.bucket] = row.n
    return out


def gains(pool: list[int], target: list[int]) -> list[int]:
    """Gain of each bucket, in thousandths of a natural logarithm."""
    s_all, t_all = sum(pool) + BUCKETS, sum(target) + BUCKETS
    return [
        math.floor(1000 * math.log(float(t + 1) * float(s_all) / (float(s + 1) * float(t_all))))
        for s, t in zip(pool, target, strict=True)
    ]


def _literal(values: list[int]) -> Column:
    """An array that the optimizer folds to one literal; an expression for each entry would be slow to send."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _noise() -> Column:
    """floor(-1000 ln(-ln(u))) of the identifier's u between 0 and 1."""
    name = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(pool: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per pool row: identifier, n_features, weight, score, rank (null where not drawn)."""
    spark = pool.sparkSession
    with Scratch(spark) as scratch:
        made = scratch.keep(with_buckets(pool.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))))
        aim = with_buckets(target.select(F.lit(None).alias("_id"), F.col(text_col).alias("_text")))
        table = _literal(gains(_totals(made), _totals(aim)))
        weight = F.aggregate("_buckets", F.lit(0).cast("long"), lambda sum_, b: sum_ + F.element_at(table, b + 1))
        scored = made.select("_id", F.col("_n_words") >= LEAST_WORDS, F.size("_buckets").cast("long").alias("n_features"), weight.alias("weight"))
        scored = scored.toDF("_id", "_fit", "n_features", "weight").withColumn("score", F.col("weight") + _noise())
        # Ranges of falling score. The row's number cuts rows that agree in all else.
        scored = scored.withColumn("_row", F.monotonically_increasing_id())
        key = [F.col("_fit").desc(), F.col("score").desc(), F.col("_id").asc_nulls_last(), F.col("_row").asc()]
        dealt = scored.repartitionByRange(parts(spark), *key).withColumn("_part", F.spark_partition_id())
        dealt = settle(dealt)
    counts = dealt.groupBy("_part").agg(F.count_if("_fit").alias("n")).orderBy("_part").collect()  # one row for each shuffle partition
    draw = percent * sum(r.n for r in counts) // 100
    starts, before = [], 0
    for r in counts:
        if before < draw:
            starts.append((r._part, before))
        before += r.n
    # Only ranges that reach into the draw are numbered; there are no more of them than shuffle partitions.
    starts = F.broadcast(spark.createDataFrame(starts, "_part int, _start long"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*key)) + F.col("_start")
    drawn = dealt.join(starts, "_part").withColumn("rank", F.when(F.col("_fit") & (place <= draw), place).cast("long"))
    rest = dealt.join(starts, "_part", "left_anti").withColumn("rank", F.lit(None).cast("long"))
    rows = drawn.drop("_start").unionByName(rest)
    return rows.select(F.col("_id").alias(id_col), "n_features", "weight", "score", "rank")
