"""Structured Streaming: event-time windows, keyed upserts by micro-batch, full groups as they fill."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netquarry.operators.state import upsert


def windowed_counts(events: DataFrame, time: str, by: str, value: str, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window; rows later than `late` are left out once a window is closed."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    rows = events.withWatermark(time, late).groupBy(w.alias("w"), by)
    rows = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return rows.select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, time: str, by: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of each key's events that are less than `gap` apart."""
    rows = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def upsert_stream(rows: DataFrame, path: str, key: str, order: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keeps a keyed table at path up to date, one version per micro-batch: path/v=<batch>.

    A batch that is run again after a failure reads the version before its own, so it gives the same table again."""
    spark = rows.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        merged = batch
        if number:
            merged = upsert(spark.read.parquet(f"{path}/v={number - 1}"), batch, key, order)
        else:
            merged = upsert(batch.limit(0), batch, key, order)
        merged.write.mode("overwrite").parquet(f"{path}/v={number}")

    writer = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def full_groups(rows: DataFrame, by: str, value: str, size: int) -> DataFrame:
    """(key, group, values) as soon as a key has `size` rows since its last group; values in order of arrival."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, held = state.get if state.exists else (0, [])
        held, out = list(held), []
        for pdf in batches:
            held += pdf[value].tolist()
            while len(held) >= size:
                out.append((key[0], done, held[:size]))
                held, done = held[size:], done + 1
        state.update((done, held))
        yield pd.DataFrame(out, columns=[by, "group", "values"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in (by, value)}
    return rows.select(by, value).groupBy(by).applyInPandasWithState(
        step, f"`{by}` {kinds[by]}, group long, values array<{kinds[value]}>", f"done long, held array<{kinds[value]}>",
        "append", GroupStateTimeout.NoTimeout,
    )
