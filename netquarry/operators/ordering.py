"""Global row numbers, pages, overlapping count windows and reproducible samples, without a single sorting task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.durable import settle


def _ranged(df: DataFrame, bucket: Column, order: list[str], name: str) -> DataFrame:
    """global_index, with the numbers `_first` and `_last` of each row's range; a range is one partition, in order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_bucket", bucket)
    keys = [c for c in ("_bucket", *order)]
    dealt = dealt.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).drop("_bucket")
    dealt = settle(dealt)
    part = F.shiftright("_at", 33).cast("int")
    counts = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = counts.withColumn("_last", F.sum("_n").over(upto))  # one row for each range
    ends = ends.select("_part", (F.col("_last") - F.col("_n") + 1).alias("_first"), "_last")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = dealt.withColumn("_part", part).join(F.broadcast(ends), "_part")
    return numbered.withColumn(name, F.col("_first") + place).drop("_part", "_at")


def global_index(df: DataFrame, bucket: Column, order: list[str], name: str = "rn") -> DataFrame:
    """1-based position of each row in the total order (bucket, order).

    Rows are dealt to as many ranges as there are shuffle partitions, by a sample that Spark takes, and sorted there: a bucket
    that holds all rows is many tasks' work, as long as the order tells rows apart. Sorted ranges are written once, so that
    numbers and counts agree; a row's number is its place in its range and the counts of the ranges before, one row each.
    """
    return _ranged(df, bucket, order, name).drop("_first", "_last")


def count_windows(df: DataFrame, bucket: Column, order: list[str], size: int, name: str = "batch") -> tuple[DataFrame, DataFrame]:
    """Rows with the 0-based number of their window of `size` rows in the total order (bucket, order), in two tables: windows
    that lie inside one sorted range, whose rows are neighbours in one partition and need no shuffle, and the few rows of those
    that go on in another range, or are the last one."""
    rows = _ranged(df, bucket, order, "_rn").withColumn(name, F.floor((F.col("_rn") - 1) / size))
    inside = (F.col(name) * size + 1 >= F.col("_first")) & ((F.col(name) + 1) * size <= F.col("_last"))
    return tuple(rows.where(c).drop("_rn", "_first", "_last") for c in (inside, ~inside))


def page(df: DataFrame, skip: int, limit: int, name: str = "rn") -> DataFrame:
    """Rows skip + 1 to skip + limit of a numbered table, with their 1-based place in the page."""
    rows = df.where(F.col(name).between(skip + 1, skip + limit))
    return rows.withColumn("batch_index", F.col(name) - skip)


def overlapping_windows(df: DataFrame, size: int = 30, back: int = 5, name: str = "rn") -> DataFrame:
    """Each row once for every window it is in: windows of `size` rows that begin every size - back rows."""
    step = size - back
    zero = F.col(name) - 1
    low = F.greatest(F.lit(0), F.ceil((zero - size + 1) / step))
    return df.withColumn("window_id", F.explode(F.sequence(low.cast("long"), F.floor(zero / step).cast("long"))))


def hash_rank(df: DataFrame, key: str, seed: int, name: str = "pos") -> DataFrame:
    """0-based position in an order by a seeded hash: the same on every run and any number of partitions."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    out = global_index(df.withColumn("_hash", h), F.substring("_hash", 1, 2), ["_hash", key], name)
    return out.withColumn(name, F.col(name) - 1).drop("_hash")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group, with their 1-based rank."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
