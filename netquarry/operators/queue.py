"""Durable work: a detection cursor that resumes where it was, and a queue of rows that are marked as they are done.

Both keep a log of rounds (`durable.Rounds`) and nothing else: what is left to do follows from the log, so there is no
control row that could disagree with the results. A killed run leaves whole rounds only; the next one goes on from there
and ends with the same rows. A reset starts a new generation of the log and leaves the old one readable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from netquarry.durable import Rounds, delete, names, shared_folder

PROCESSED, FAILED = "processed", "failed"
_ERROR = 500  # characters of a message that are kept
PART = 16384  # rows of a dataset that are walked at a time
SMALL = 100_000  # walks that are broadcast to the rows at most
WARM = 20  # steps before a segment from which it is walked


class _Log:
    """The current generation of a log."""

    def __init__(self, spark: SparkSession, folder: str, reset: bool):
        held = [int(n.partition("=")[2]) for n in names(spark, folder) if n.startswith("generation=")]
        self.generation = max(held, default=-1) + 1 if reset or not held else max(held)
        self.rounds = Rounds(spark, f"{folder}/generation={self.generation}")


class _Chain:
    """The walked segments of one dataset, followed from its cursor on. head: (_d, flow_count, current_id, windows)."""

    def __init__(self, row, part: int, step: int, budget: int | None):
        self.head = tuple(row[c] for c in ("_d", "flow_count", "current_id", "windows"))
        self.part, self.step, self.budget = part, step, budget
        self.walks: dict[tuple[int, int], tuple[int, int]] = {}  # (segment, entry) -> (windows, where it goes on)
        self.guess: dict[int, int] = {}  # segment -> entry of its first walk
        self.chosen: list[tuple[int, int, int]] = []  # (segment, entry, windows before)

    def add(self, segment: int, entry: int, n: int, on: int) -> None:
        self.walks[segment, entry] = n, on
        self.guess.setdefault(segment, entry)

    def lacking(self, ahead: int) -> set[tuple[int, int]]:
        """(segment, entry) of walks to be made; none, once `chosen` is whole. Behind a walk that lacks, the chain is taken to
        meet the first one of its segment, and to enter the next segments, up to `ahead` with its own, shifted alike."""
        _, count, cursor, windows = self.head
        at, done, out, self.chosen = cursor, 0, set(), []
        while at < count and (self.budget is None or done < self.budget):
            k = (at - cursor) // self.part
            walk = (k, at)
            if walk not in self.walks:
                out.add(walk)
                if k not in self.guess:
                    break
                for j in range(k + 1, k + ahead):
                    if j in self.guess:
                        start = cursor + j * self.part
                        other = start + (self.guess[j] + at - self.guess[k] - start) % self.step
                        if other < count and (j, other) not in self.walks:
                            out.add((j, other))
                walk = (k, self.guess[k])
            elif not out:
                self.chosen.append((k, at, windows + done))
            n, on = self.walks[walk]
            if on <= at:  # it was stopped by the budget
                break
            at, done = on, done + n
        return out


class DetectionCursor:
    """Windows of `size` rows over each dataset, judged one after the other: the next one begins behind an alert, else
    size - back rows further on. A window whose judge raises is recorded as failed and passed over by the same step.

    judge: a window's rows as pandas -> (1-based first row, number of rows) of an alert, or None.
    `rows` have the dataset in `by` and their place from 0, without gaps, in `place` (see ordering.global_index).

    One run judges up to `budget` windows of each dataset (all, if None). Each start depends on the result before, but cursors
    that begin at different rows meet as soon as both see an alert's end. So a dataset is walked in segments of about
    `part` rows at once, each from a few windows before it (`WARM`), which count for nothing. The segments are then
    followed from the cursor on: one that was entered where the one before it left is right, any other is walked again
    from there, until the chain is whole. Results are those of one walk from the cursor. Without alerts cursors never meet:
    as the next segments are then entered shifted alike, twice as many are tried from round to round. The judge is
    called for some windows besides, and for the same window at most once in any walk.

    A task reads a segment's rows in order and holds a batch of them. A row for each walk of about `part` rows passes through the
    driver, none for datasets within one segment. Null datasets are one dataset, an empty table has no windows, rows beyond a
    dataset's last full window are a shorter last window. Equal places are an error of the numbering."""

    SCHEMA = "dataset {kind}, window long, skip long, rows long, start long, duration long, next long, status string, error string"

    def __init__(self, spark: SparkSession, folder: str, by: str, place: str, size: int = 30, back: int = 5, reset: bool = False, part: int = PART):
        if not 0 <= back < size:
            raise ValueError("a window must be longer than what it goes back")
        self.by, self.place, self.size, self.back = by, place, size, back
        step = size - back
        self.warm = step * max(WARM, -(-size // step))
        self.part = max(step * (part // step), self.warm)  # a multiple of the step, so that cursors without alerts agree
        self.log = _Log(spark, folder, reset)

    def results(self) -> DataFrame | None:
        """All windows so far, with the round that judged them; None before the first round."""
        return self.log.rounds.read()

    def control(self, rows: DataFrame) -> DataFrame:
        """(dataset, flow_count, current_id, windows, status) of each dataset: where the cursor stands."""
        sizes = rows.groupBy(F.col(self.by).alias("dataset")).agg(F.count(F.lit(1)).alias("flow_count"))
        done = self.results()
        if done is None:
            at = sizes.withColumns({"current_id": F.lit(0).cast("long"), "windows": F.lit(0).cast("long")})
        else:
            last = done.groupBy(F.struct("dataset").alias("_d")).agg(F.max("next").alias("next"), F.count(F.lit(1)).alias("n"))
            at = sizes.withColumn("_d", F.struct("dataset")).join(last, "_d", "left").select(
                "dataset", "flow_count", F.coalesce("next", F.lit(0)).alias("current_id"), F.coalesce("n", F.lit(0)).alias("windows")
            )
        return at.withColumn("status", F.when(F.col("current_id") >= F.col("flow_count"), "done").otherwise("testing"))

    def run(self, rows: DataFrame, judge: Callable[[pd.DataFrame], tuple[int, int] | None], budget: int | None = None) -> bool:
        """One more round. False if every dataset was done before."""
        if budget is not None and budget < 1:
            raise ValueError("a round must be allowed a window")
        spark, kind = self.log.rounds.spark, rows.schema[self.by].dataType.simpleString()
        control = self.control(rows).where("status = 'testing'").select(F.struct("dataset").alias("_d"), "flow_count", "current_id", "windows")
        left = F.col("flow_count") - F.col("current_id")
        walks = F.ceil((left if budget is None else F.least(left, F.lit(budget * self.size))) / self.part)
        size = control.agg(F.sum(walks).alias("walks"), F.sum(left).alias("rows")).first()
        if not size["walks"]:
            return False
        folder, made = shared_folder(spark), []
        first = control.select("*", F.explode(F.sequence(F.lit(0).cast("long"), walks - 1)).alias("_seg"))
        warm = F.greatest(F.lit(0), F.col("_seg") * self.part - self.warm)
        asked = first.withColumn("_from", (F.col("current_id") + warm).cast("long"))
        chains: dict[str, _Chain] = {}
        try:
            while True:
                path = f"{folder}/walk={len(made)}"
                parts = min(size["walks"], max(int(spark.conf.get("spark.sql.shuffle.partitions")), size["rows"] // (4 * self.part)))
                self._walked(rows, asked, judge, budget, size["walks"], parts).write.parquet(path)
                made.append(path)
                new = spark.read.parquet(path).where(left > self.part).groupBy("_d", "flow_count", "current_id", "windows", "_seg", "entry")
                for r in new.agg(F.count(F.lit(1)).alias("n"), F.max("next").alias("next")).toLocalIterator():
                    chain = chains.setdefault(repr(r["_d"]), _Chain(r, self.part, self.size - self.back, budget))
                    chain.add(r["_seg"], r["entry"], r["n"], r["next"])
                lacking = [(c.head[0], *c.head[1:], k, at) for c in chains.values() for k, at in c.lacking(2 ** (len(made) - 1))]
                if not lacking:
                    break
                size = {"walks": len(lacking), "rows": len(lacking) * self.part}
                asked = spark.createDataFrame(lacking, asked.select("_d", "flow_count", "current_id", "windows", "_seg", "_from").schema)
            found = spark.read.parquet(*made)
            columns = [c.split()[0] for c in self.SCHEMA.split(", ")]
            short = found.where(left <= self.part).withColumn("window", F.col("windows") + F.col("index"))
            links = [(c.head[0], *link) for c in chains.values() for link in c.chosen]
            chosen = spark.createDataFrame(links, f"_d struct<dataset:{kind}>, _seg long, entry long, _before long")
            long = found.where(left > self.part).join(F.broadcast(chosen), ["_d", "_seg", "entry"]).withColumn("window", F.col("_before") + F.col("index"))
            both = short.unionByName(long.drop("_before")).where(F.lit(True) if budget is None else F.col("window") < F.col("windows") + budget)
            self.log.rounds.write(both.select("_d.dataset", *columns[1:]))
        finally:
            delete(spark, folder)
        return True

    def _walked(self, rows: DataFrame, asked: DataFrame, judge: Callable, budget: int | None, walks: int, parts: int) -> DataFrame:
        """Windows of the asked segments (_d, flow_count, current_id, windows, _seg, _from), walked from `_from` on: `entry` is a
        walk's first window inside its segment, `index` a window's number from there."""
        kind = rows.schema[self.by].dataType.simpleString()
        about = asked.select("_d", "flow_count", "current_id", "windows").distinct()
        near_by = F.broadcast if walks <= SMALL else lambda df: df  # a shuffle by dataset would be as many tasks' work as there are datasets
        placed = rows.withColumn("_d", F.struct(F.col(self.by).alias("dataset"))).join(near_by(about), "_d").where(F.col(self.place) >= F.col("current_id"))
        # A row is in its own segment, in the one before for that one's last window, and in the next one's first steps.
        at = F.col(self.place) - F.col("current_id")
        own = F.floor(at / self.part)
        near = F.array(own, F.when(at < own * self.part + self.size, own - 1), F.when(at >= (own + 1) * self.part - self.warm, own + 1))
        kept = [F.col(f"`{c}`") for c in rows.columns]
        given = placed.select("_d", F.col(self.place).cast("long").alias("_place"), F.explode(F.filter(near, lambda k: k.isNotNull())).alias("_seg"), F.struct(*kept).alias("_row"))
        dealt = given.join(near_by(asked), ["_d", "_seg"]).where(F.col("_place") >= F.col("_from"))
        dealt = dealt.select("_d.dataset", "_place", "flow_count", "current_id", "windows", "_seg", "_from", "_row")
        dealt = dealt.repartition(parts, "dataset", "_seg", "_from").sortWithinPartitions(F.col("dataset").asc_nulls_first(), "_seg", "_from", "_place")
        schema = f"dataset {kind}, flow_count long, current_id long, windows long, _seg long, entry long, index long, " + self.SCHEMA.partition("window long, ")[2]
        types = to_arrow_schema(self.log.rounds.spark.createDataFrame([], schema).schema)
        size, step, part = self.size, self.size - self.back, self.part

        def judged(window: pd.DataFrame) -> tuple:
            """(start, duration, rows to go on by, status, error)"""
            try:
                found = judge(window)
                if found is None:
                    return -1, -1, step, PROCESSED, None
                start, duration = map(int, found)
                if start < 1 or duration < 1:
                    raise ValueError(f"an alert from row {start} over {duration} rows")
                return start, duration, start + duration - 1, PROCESSED, None
            except Exception as e:  # whatever a judge raises is that window's result
                return -1, -1, step, FAILED, f"{type(e).__name__}: {e}"[:_ERROR]

        def windows_of(held: pa.Table) -> Callable[[int], pd.DataFrame]:
            """The window from a row on. Only flat columns without nulls have the same pandas types in any part of the rows."""
            if any(c.null_count or pa.types.is_nested(c.type) for c in held.columns):
                return lambda i: held.slice(i, size).to_pandas()
            frame = held.to_pandas()
            return lambda i: frame.iloc[i : i + size].reset_index(drop=True)

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, skip, until, begin, entry, index, last = (), None, 0, 0, 0, None, 0, None
            out: list[tuple] = []

            def going() -> bool:
                return skip < until and (budget is None or index < budget)

            def advance(least: int) -> None:
                """Judges windows while at least `least` rows are held from the cursor on."""
                nonlocal held, skip, entry, index
                if held is None or held.num_rows < max(1, least) or not going():
                    return
                first, n = skip, held.num_rows
                window = windows_of(held)
                while n - (skip - first) >= max(1, least) and going():
                    start, duration, on, status, error = judged(window(skip - first))
                    if skip >= begin:
                        entry = skip if entry is None else entry
                        out.append((*key, entry, index, skip, min(size, n - (skip - first)), start, duration, skip + on, status, error))
                        index += 1
                    skip += on
                held = held.slice(min(skip - first, n))

            for batch in batches:
                if not batch.num_rows:
                    continue
                place, seg, origin = (batch.column(k).to_numpy() for k in (1, 5, 6))
                # Any walk holds the row at its `_from`, so that places fall where the next dataset's walk begins.
                new = (np.diff(seg) != 0) | (np.diff(origin) != 0) | (np.diff(place) <= 0)
                ends = [*(np.flatnonzero(new) + 1).tolist(), len(place)]
                for a, b in zip([0, *ends], ends, strict=False):
                    if last is None or last[:2] != (seg[a], origin[a]) or place[a] <= last[2]:
                        advance(1)
                        key = tuple(batch.column(k)[a].as_py() for k in (0, 2, 3, 4, 5))
                        held, skip, entry, index = None, int(origin[a]), None, 0
                        begin = key[2] + key[4] * part
                        until = min(begin + part, key[1])
                    last = seg[a], origin[a], place[b - 1]
                    if going():
                        more = pa.Table.from_batches([pa.RecordBatch.from_struct_array(batch.column(7).slice(a, b - a))])
                        if place[a] < skip:  # an alert may reach beyond the rows that were held
                            more = more.slice(min(skip - int(place[a]), more.num_rows))
                        held = more if held is None else pa.concat_tables([held, more])
                        advance(size)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), types, strict=True)], schema=types)
                    out.clear()
            advance(1)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), types, strict=True)], schema=types)

        return dealt.mapInArrow(walk, schema).select(F.struct("dataset").alias("_d"), *types.names[1:])

    def run_all(self, rows: DataFrame, judge: Callable, budget: int | None = None) -> DataFrame | None:
        """Rounds until every dataset is done."""
        while self.run(rows, judge, budget):
            pass
        return self.results()


class WorkQueue:
    """Rows of a table, taken `n` at a time in an order and marked processed or failed with their result.

    `key` must tell rows apart; of rows with equal or null keys the first in `order` stands for all. Rows without `order` are
    not in the queue. A row that failed is not taken again, unless `retry` asks for it; `attempt` counts."""

    def __init__(self, spark: SparkSession, folder: str, key: str, order: str, reset: bool = False):
        self.key, self.order = key, order
        self.log = _Log(spark, folder, reset)

    def marks(self) -> DataFrame | None:
        """(key, status, error, result, attempt, round): the last attempt of each row so far."""
        log = self.log.rounds.read()
        if log is None:
            return None
        columns = [c for c in log.columns if c != "_key"]
        return log.groupBy("_key").agg(F.max_by(F.struct(*columns), "attempt").alias("r")).select("r.*")

    def pending(self, items: DataFrame, retry: bool = False) -> DataFrame:
        """Rows that wait, with `attempt`: how often they were tried before."""
        waiting = items.where(F.col(self.order).isNotNull()).withColumn("_key", F.struct(F.col(self.key).alias("key")))
        done = self.marks()
        if done is None:
            return waiting.drop("_key").withColumn("attempt", F.lit(0).cast("long"))
        known = done.select(F.struct(F.col(self.key).alias("key")).alias("_key"), "attempt", "status")
        left = waiting.join(known, "_key", "left")
        left = left.where(F.col("status").isNull() | (F.col("status") == FAILED if retry else F.lit(False)))
        return left.select(*items.columns, F.coalesce("attempt", F.lit(0)).alias("attempt"))

    def run(self, items: DataFrame, work: Callable[[dict], object], n: int, retry: bool = False) -> int:
        """Takes the next n rows and marks them. work: a row as a dict (with `attempt`, how often it was tried before) ->
        its result, as text; what it raises is the row's error. Returns how many rows were taken. n is a stated batch size: these rows meet in one place to be ordered."""
        waiting = self.pending(items, retry)
        whole = F.struct(*[F.col(f"`{c}`") for c in waiting.columns])
        one = waiting.groupBy(F.col(self.key).alias("_k")).agg(F.min_by(whole, self.order).alias("r")).select("r.*")
        first = one.orderBy(self.order, self.key).limit(n)
        spark, key = self.log.rounds.spark, self.key
        kind = items.schema[key].dataType.simpleString()
        schema = f"`{key}` {kind}, status string, error string, result string, attempt long, _key struct<key:{kind}>"
        types = to_arrow_schema(spark.createDataFrame([], schema).schema)

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    attempt, error, result = row["attempt"] + 1, None, None
                    try:
                        result = work(row)
                    except Exception as e:  # whatever the work raises is that row's mark
                        error = f"{type(e).__name__}: {e}"[:_ERROR]
                    out.append((row[key], PROCESSED if error is None else FAILED, error, None if result is None else str(result), attempt, {"key": row[key]}))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), types, strict=True)], schema=types)

        taken = first.repartition(max(1, min(n, spark.sparkContext.defaultParallelism))) if n > 1 else first
        number = self.log.rounds.write(taken.mapInArrow(mark, schema))
        return self.log.rounds.read().where(F.col("round") == number).count()
