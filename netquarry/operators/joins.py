"""Interval joins as equi-joins on time bins, nearest and as-of joins by sorted ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.durable import settle


def range_join(left: DataFrame, right: DataFrame, on: list[str], left_ts: Column, right_ts: Column, before: float, after: float) -> DataFrame:
    """Pairs with equal `on` and right time in [left time - before, left time + after].

    Time is cut into bins as wide as the interval, so a left row meets the right rows of two bins (three at a border)
    and the theta join is a hash or sort-merge join on (on, bin). Right columns get the prefix r_.
    """
    width = float(before + after) or 1.0
    low, high = F.floor((left_ts - before) / width), F.floor((left_ts + after) / width)
    lhs = left.withColumn("_ts", left_ts).withColumn("_bin", F.explode(F.sequence(low, high)))
    rhs = right.withColumn("_ts", right_ts).withColumn("_bin", F.floor(right_ts / width))
    rhs = rhs.select(*[F.col(f"`{c}`").alias(f"r_{c}") for c in rhs.columns])
    match = F.col("_bin") == F.col("r__bin")
    for c in on:
        match = match & (F.col(c) == F.col(f"r_{c}"))
    near = F.col("r__ts").between(F.col("_ts") - before, F.col("_ts") + after)
    return lhs.join(rhs, match & near).drop("_bin", "r__bin")


def best_in_range(left: DataFrame, right: DataFrame, key: str, on: list[str], ts: str, values: list[str], before: float, after: float, score: Column, digits: int) -> DataFrame:
    """(key, r_<key>, score): for each left row the right row of least score, rounded to `digits`, and of equal ones the least
    key, among the pairs of range_join; a missing score comes last. `score` is made of `ts`, `values` and the same with r_.

    Rows that agree in all of `on`, `ts` and `values` have the same scores, so they meet as one. The pairs are walked twice, for
    the least score and for the key at it: both are aggregates of numbers, so no pairs are sorted, spilled or shuffled."""
    same = list(dict.fromkeys([*on, ts, *values]))
    places = left.select(*same).distinct()
    flows = right.groupBy(*same).agg(F.min(key).alias(key))
    pairs = lambda df: range_join(df, flows, on, F.col(ts), F.col(ts), before, after)
    # Rounding keeps the order: the least rounded score is the least score rounded.
    least = pairs(places).groupBy(*same).agg(F.round(F.min(score), digits).alias("score"))
    near = score.isNull() | (score <= F.col("score") + 10.0**-digits)
    first = pairs(least).where(near & F.round(score, digits).eqNullSafe(F.col("score")))
    found = first.groupBy(*same, "score").agg(F.min(f"r_{key}").alias(f"r_{key}"))
    found = found.withColumnsRenamed({c: f"_{c}" for c in same})
    match = F.lit(True)
    for c in same:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(found, match).select(key, f"r_{key}", "score")


def _carried(left: DataFrame, right: DataFrame, on: list[str], t: str, side: tuple[int, int]) -> DataFrame:
    """Left rows with `_last`: the `_right` of the last right row before them in the order of (on, t, side).

    Both sides are merged and dealt to sorted ranges of (on, t), so a key's history is many tasks' work. A window carries the
    last right row forward inside a range; what a key brings along from the ranges before is a small second pass over one
    row for each key and range. Equal and null keys match."""
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*on).alias("_on")
    a = left.withColumns({"_on": key, "_side": F.lit(side[0]), "_right": F.lit(None).cast(right.schema["_right"].dataType)})
    b = right.select(*on, t, "_right", key, F.lit(side[1]).alias("_side"))
    merged = a.unionByName(b, allowMissingColumns=True).repartitionByRange(n, "_on", t, "_side")
    merged = settle(merged.withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", "_on").orderBy(t, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = merged.withColumn("_last", F.last("_right", ignorenulls=True).over(inside)).where(F.col("_side") == side[0])
    ends = merged.where(F.col("_right").isNotNull()).groupBy("_on", "_range").agg(F.max_by("_right", t).alias("_end"))
    later = merged.where(F.col("_right").isNull()).select("_on", "_range").distinct()
    before = Window.partitionBy("_on").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    both = later.join(ends, ["_on", "_range"], "full")
    brought = both.withColumn("_brought", F.last("_end", ignorenulls=True).over(before)).drop("_end").where(F.col("_brought").isNotNull())
    out = found.join(brought, ["_on", "_range"], "left")
    return out.select(*left.columns, F.coalesce("_last", "_brought").alias("_last"))


def _first_of_equals(right: DataFrame, on: list[str], right_ts: Column, ties: list[Column]) -> DataFrame:
    """(on, _t, _right: the row) of the first right row in `ties` at each key and time; ties name columns with the prefix r_."""
    named = right.withColumn("_t", right_ts.cast("double"))
    kept = named.select(*on, "_t", *[F.col(f"`{c}`").alias(f"r_{c}") for c in right.columns])
    w = Window.partitionBy(*on, "_t").orderBy(*(ties or [F.lit(0)]))
    kept = kept.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return kept.select(*on, "_t", F.struct("_t", *[F.col(f"`r_{c}`") for c in right.columns]).alias("_right"))


def nearest(left: DataFrame, right: DataFrame, on: list[str], left_ts: Column, right_ts: Column, tolerance: float, ties: list[Column]) -> DataFrame:
    """For each left row the right row nearest in time within the tolerance, an earlier one at equal distance; left rows without
    one are left out. Right columns get the prefix r_.

    The nearest row is the last one up to the left row or the first one after it, so two as-of passes find it and no pairs
    are made. Rows without a time or with a null key match nothing."""
    whole = lambda df: df.where(F.col("_t").isNotNull()).dropna(subset=on) if on else df.where(F.col("_t").isNotNull())
    lhs = whole(left.withColumn("_t", left_ts.cast("double")))
    rhs = whole(_first_of_equals(right, on, right_ts, ties))
    back = _carried(lhs, rhs, on, "_t", (1, 0)).withColumnRenamed("_last", "_back")
    flipped = back.withColumn("_t", -F.col("_t"))
    both = _carried(flipped, rhs.withColumn("_t", -F.col("_t")), on, "_t", (0, 1)).withColumn("_t", -F.col("_t"))
    before, after = F.col("_t") - F.col("_back._t"), F.col("_last._t") - F.col("_t")
    near = F.when(F.coalesce(before <= after, after.isNull()) & (before <= tolerance), F.col("_back")).when(after <= tolerance, F.col("_last"))
    found = both.withColumn("_near", near).where(F.col("_near").isNotNull())
    return found.select(*left.columns, *[F.col(f"_near.r_{c}") for c in right.columns])


def latest_before(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, values: list[str]) -> DataFrame:
    """As-of backward: left rows with the values of the last right row strictly before them, null if there is none."""
    rhs = right.select(*on, F.col(right_ts).alias("_t"), F.struct(*[F.col(v) for v in [right_ts, *values]]).alias("_right"))
    found = _carried(left.withColumn("_t", F.col(left_ts)), rhs, on, "_t", (0, 1))
    return found.select(*left.columns, *[F.col(f"_last.{v}").alias(f"r_{v}") for v in [right_ts, *values]])


def with_fallback(rows: DataFrame, first: DataFrame, second: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """Labels by key: the last of `first`, else the last of `second` (in `order`), else null."""
    last = lambda df: df.groupBy(key).agg(F.max_by(label, order).alias("_l"))
    out = rows.join(last(first).withColumnRenamed("_l", "_l1"), key, "left")
    out = out.join(last(second).withColumnRenamed("_l", "_l2"), key, "left")
    return out.withColumn(label, F.coalesce("_l1", "_l2")).drop("_l1", "_l2")
