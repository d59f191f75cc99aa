"""A keyed table on shared storage that rewrites only the buckets that an upsert touches.

Rows are dealt to a fixed number of buckets by a hash of the key. Each upsert adds a version: new files for the buckets that
it touched, and a manifest that says for every bucket which version holds it. The manifest is written last and as one
table, so a version counts when it is whole; a killed upsert leaves files that no manifest names, and the same upsert run
again under its own number gives the same version. Readers see the last whole version, or any earlier one.

Keys can be null (one row) and of any type that hashes. `order` tells which of the new rows with one key wins; `merge` may
combine the row that was there with the new ones instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netquarry.durable import exists, names


class KeyedTable:
    """schema: the rows' DDL. buckets: fixed at the first write; about as many as gives files of some hundred MB."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, order: str, buckets: int = 64):
        self.spark, self.folder, self.schema, self.key, self.order = spark, folder, schema, key, order
        self.buckets = buckets
        if (last := self.version()) is not None:
            self.buckets = self._manifest(last).count()

    def version(self) -> int | None:
        """The last whole version."""
        held = [int(n.partition("=")[2]) for n in names(self.spark, f"{self.folder}/manifest") if n.startswith("version=")]
        return max((v for v in held if exists(self.spark, f"{self.folder}/manifest/version={v}/_SUCCESS")), default=None)

    def _manifest(self, version: int) -> DataFrame:
        return self.spark.read.schema("bucket int, held int").parquet(f"{self.folder}/manifest/version={version}")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.struct(self.key)), F.lit(self.buckets)).cast("int")

    def _stored(self, buckets: dict[int, int]) -> DataFrame:
        """The rows of buckets, each from the version that holds it. A manifest has as many rows as there are buckets."""
        paths = [f"{self.folder}/rows/version={v}/bucket={b}" for b, v in sorted(buckets.items()) if v >= 0]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _held(self, version: int | None) -> dict[int, int]:
        return {r.bucket: r.held for r in self._manifest(version).collect()} if version is not None else dict.fromkeys(range(self.buckets), -1)

    def read(self, version: int | None = None) -> DataFrame:
        return self._stored(self._held(self.version() if version is None else version))

    def _latest(self, old: DataFrame, new: DataFrame) -> DataFrame:
        rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        best = F.max_by(F.struct(*old.columns), F.struct("_new", self.order))
        return rows.groupBy(F.struct(self.key).alias("_k")).agg(best.alias("_row")).select("_row.*")

    def upsert(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, version: int | None = None) -> int:
        """Merges rows in and returns the new version. merge(old, new) gives the touched buckets' rows; by default the last row
        of each key in `order`, new before old. version: the number to write, for a caller that may run again."""
        last = self.version()
        number = (-1 if last is None else last) + 1 if version is None else version
        if last is not None and number <= last:
            return last  # it was whole already
        held = self._held(last)
        rows = rows.select(*self.spark.createDataFrame([], self.schema).columns)
        touched = sorted(r.b for r in rows.select(self._bucket().alias("b")).distinct().collect())  # no more than buckets
        old = self._stored({b: held[b] for b in touched})
        made = (merge or self._latest)(old, rows)
        if touched:
            dealt = made.withColumn("bucket", self._bucket()).repartition(max(1, len(touched)), "bucket")
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/rows/version={number}")
        there = {int(n.partition("=")[2]) for n in names(self.spark, f"{self.folder}/rows/version={number}") if n.startswith("bucket=")}
        new = {b: (number if b in there else -1) if b in touched else v for b, v in held.items()}
        manifest = self.spark.createDataFrame(sorted(new.items()), "bucket int, held int")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/version={number}")
        return number

    def stream(self, rows: DataFrame, checkpoint: str, tries: int = 3, merge=None, required: str | None = None, available_now: bool = True) -> StreamingQuery:
        """Upserts a stream, a version for each micro-batch. A batch that fails is tried up to `tries` times before the stream
        fails; started again it goes on with the same batch, and a batch that was whole changes nothing. Rows whose `required`
        array is null or empty are an error, as they couldn't be found again by it."""

        def write(batch: DataFrame, number: int) -> None:
            if required:
                missing = F.raise_error(F.concat(F.lit(f"missing {required}: "), F.coalesce(F.col(self.key).cast("string"), F.lit("null"))))
                batch = batch.where(F.when(F.coalesce(F.size(required), F.lit(0)) > 0, F.lit(True)).otherwise(missing.cast("boolean")))
            for attempt in range(1, tries + 1):
                try:
                    self.upsert(batch, merge, number)
                    return
                except Exception:
                    if attempt == tries:
                        raise

        writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def edges_merged(key: str, sums: list[str], last: str, most: int = 3) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge for graphs: counts of a snapshot and of new rows add up, and of the records (array `last` of structs that sort
    in order) the last `most` stay. New rows of one key are aggregated first, so that few records meet."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        k = F.struct(key).alias("_k")
        tail = lambda c: F.slice(c, F.greatest(F.size(c) - most, F.lit(0)) + 1, F.lit(most))
        short = new.withColumn(last, tail(F.array_sort(last)))
        exploded = short.select(k, F.explode(last).alias("x"))
        w = Window.partitionBy("_k").orderBy(F.col("x").desc())
        few = exploded.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
        records = few.groupBy("_k").agg(F.array_sort(F.collect_list("x")).alias(last))
        counts = short.groupBy(k).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in new.columns if c not in (*sums, last)])
        fresh = counts.join(records, "_k", "left").withColumn(last, F.coalesce(last, F.array().cast(new.schema[last].dataType)))
        a, b = old.withColumn("_k", F.struct(key)).alias("a"), fresh.alias("b")
        both = a.join(b, F.col("a._k") == F.col("b._k"), "full")
        nothing = F.array().cast(new.schema[last].dataType)
        made = {
            c: F.coalesce(F.col(f"a.{c}"), F.lit(0)) + F.coalesce(F.col(f"b.{c}"), F.lit(0)) if c in sums
            else tail(F.array_sort(F.concat(F.coalesce(f"a.{c}", nothing), F.coalesce(f"b.{c}", nothing)))) if c == last
            else F.coalesce(f"b.{c}", f"a.{c}")
            for c in old.columns
        }
        return both.select(*[v.alias(c) for c, v in made.items()])

    return merge
