"""Keyed state: upserts, cursors whose next start depends on what they found, ordered fallbacks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Windows that a cursor hands on at once.
BATCH = 4096
#: Parts of the order at most; each row is compared with all cuts.
PARTS = 64


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in `order`; rows of `new` win over rows of `old` with the same key."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in rows.columns if c != "_new"]
    best = F.max_by(F.struct(*columns), F.struct("_new", order))
    return rows.groupBy(F.col(key).alias("_key")).agg(best.alias("_row")).select("_row.*")


def upsert_keeping(old: DataFrame, new: DataFrame, key: str, order: str, created: str) -> DataFrame:
    """The same, but a key keeps the time when it was first made."""
    first = old.select(key, created).unionByName(new.select(key, created)).groupBy(key).agg(F.min(created).alias("_first"))
    return upsert(old, new, key, order).join(first, key).withColumn(created, F.col("_first")).drop("_first")


def cursor_windows(flags: DataFrame, by: str, order: str, flag: str, size: int = 30, back: int = 5, literal: bool = False) -> DataFrame:
    """Windows of a cursor over each dataset's rows: after an alert it goes on behind the first run of flagged rows, else
    by size - back. (dataset, window, skip, start, duration); start is 1-based, -1 without an alert.

    With `literal` the cursor leaves out the row after the run, as the reference rule reads when taken by the word.
    A dataset's cursor is sequential by nature. It needs its runs of flagged rows only, so rows are numbered and cut down
    to runs in parts of the order before anything meets in one task, and the cursor then reads its dataset's runs one by
    one and hands windows on in small batches; datasets are independent.
    """
    rows = _placed(flags.select(by, order, F.col(flag).alias("_flag")), by, order)
    # A run is found inside a part; its first and last row tell whether it goes on in the next one, and the cursor joins those.
    rows = rows.withColumn("_island", F.col("_row") - F.row_number().over(Window.partitionBy(by, "_part", "_flag").orderBy("_row")))
    runs = rows.where("_flag").groupBy(by, "_part", "_island", "_start").agg(F.min("_row").alias("_a"), F.max("_row").alias("_b"))
    runs = runs.select(by, (F.col("_start") + F.col("_a") - 1).alias("_a"), (F.col("_start") + F.col("_b") - 1).alias("_b"))
    sizes = flags.groupBy(by).agg(F.count(F.lit(1)).alias("_b")).select(by, F.lit(None).cast("long").alias("_a"), "_b")
    # The row without a start carries the dataset's size and sorts first.
    dealt = sizes.unionByName(runs).repartition(by).sortWithinPartitions(F.col(by).asc_nulls_first(), F.col("_a").asc_nulls_first())
    kind = flags.schema[by].dataType.simpleString()

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(dataset, first, last) with runs that touch joined; the row of a dataset's size has no first."""
        held = None
        for batch in batches:
            for dataset, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and a is not None and held[1] is not None and held[2] + 1 == a:
                    held = (dataset, held[1], b)
                    continue
                if held:
                    yield held
                held = (dataset, a, b)
        if held:
            yield held

    def windows(found: Iterator[tuple]) -> Iterator[tuple]:
        dataset, n, skip, window = None, 0, 0, 0

        def plain(until: int) -> Iterator[tuple]:
            """Windows without an alert, while they end at or before `until`."""
            nonlocal skip, window
            while skip < n and min(skip + size, n) <= until:
                yield dataset, window, skip, -1, -1
                skip, window = skip + size - back, window + 1

        for key, first, last in found:
            if first is None:
                yield from plain(n)
                dataset, n, skip, window = key, last, 0, 0
                continue
            yield from plain(first)
            while skip <= last and skip < n:
                a, b = max(first, skip), min(last, skip + size - 1)
                yield dataset, window, skip, a - skip + 1, b - a + 1
                skip, window = b + 1 + literal, window + 1
        yield from plain(n)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = windows(groups(batches))
        while part := list(islice(made, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names)

    names, types = [by, "window", "skip", "start", "duration"], [to_arrow_type(flags.schema[by].dataType), *[pa.int64()] * 4]
    return dealt.mapInArrow(walk, f"`{by}` {kind}, window long, skip long, start long, duration long")


def _placed(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Adds _part, _row (1-based place inside the part) and _start (rows of the dataset in the parts before).

    Parts follow the order and are cut at quantiles of a sample by hash: a dataset with most rows is many tasks' work."""
    n = min(PARTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sample = rows.where(F.col(order).isNotNull()).select(order).orderBy(F.xxhash64(order), order).limit(20 * n).collect()
    cuts = [F.lit(c) for c in sorted({r[0] for r in sample})[20::20]]
    part = F.size(F.filter(F.array(*cuts), lambda c: c < F.col(order))) if cuts else F.lit(0)
    rows = rows.withColumn("_part", part)
    counts = rows.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(by, "_part").orderBy(order)
    return rows.withColumn("_row", F.row_number().over(inside)).join(starts, [by, "_part"])


def numbered(rows: DataFrame, by: str, order: str, name: str = "place") -> DataFrame:
    """Adds the 0-based place of each row in its dataset. Equal values of `order` get places in any order."""
    return _placed(rows, by, order).withColumn(name, (F.col("_start") + F.col("_row") - 1).cast("long")).drop("_part", "_row", "_start")


def first_valid(candidates: list[tuple[str, Column]], valid) -> tuple[Column, Column]:
    """(name, value) of the first candidate that holds: the ordered fallback of case 1, case 2, case 3."""
    name, value = F.lit(None).cast("string"), F.lit(None)
    for n, c in reversed(candidates):
        name, value = F.when(valid(c), n).otherwise(name), F.when(valid(c), c).otherwise(value)
    return name, value
