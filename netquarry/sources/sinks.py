"""Sinks: appends without duplicates, replacement, nested exports, a catalogue of datasets with splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netquarry.durable import delete
from netquarry.operators.ordering import global_index


def append_new(spark: SparkSession, rows: DataFrame, path: str, key: str) -> None:
    """Appends rows whose key isn't there yet; of rows with equal keys the first by all columns is taken."""
    first = rows.groupBy(key).agg(F.min(F.struct(*[c for c in rows.columns if c != key])).alias("_r")).select(key, "_r.*").select(*rows.columns)
    try:
        there = spark.read.schema(rows.schema).parquet(path).select(key)
        first = first.join(there, key, "left_anti")
    except Exception as e:  # a table that isn't there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    first.write.mode("append").parquet(path)


def append(rows: DataFrame, path: str, batch: int = 5000) -> None:
    """Appends rows in files of `batch` rows at most; each write is committed as a whole."""
    rows.write.mode("append").option("maxRecordsPerFile", batch).parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines with times in ISO form, binary identifiers as hex and null fields kept."""
    made = [F.lower(F.hex(f.name)).alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f"`{f.name}`") for f in rows.schema]
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "dateFormat": "yyyy-MM-dd", "ignoreNullFields": "false"}
    rows.select(*made).write.mode("overwrite").options(**options).json(path)


def reset_all(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that were written to these paths, all of it; paths that aren't there are left alone."""
    for path in paths:
        delete(spark, path)


def envelope(rows: DataFrame) -> DataFrame:
    """Rows as trainers read them: prompt and reward model are placeholders, extra_info is the row."""
    prompt = F.array(F.struct(F.lit("user").alias("role"), F.lit("placeholder").alias("content")))
    model = F.struct(F.lit("rule").alias("style"), F.lit(None).cast("string").alias("ground_truth"))
    return rows.select(prompt.alias("prompt"), model.alias("reward_model"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("extra_info"))


def indexed(rows: DataFrame, order: list[str], split: str) -> DataFrame:
    """Rows with `index`, their 0-based place in the order, and their split, as a row map gets them."""
    return global_index(rows, F.lit(0), order, "index").withColumns({"index": F.col("index") - 1, "split": F.lit(split)})


def replace(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def underscored(df: DataFrame) -> DataFrame:
    """Dots in column names become underscores."""
    return df.withColumnsRenamed({c: c.replace(".", "_") for c in df.columns if "." in c})


def reset(df: DataFrame, *columns: str) -> DataFrame:
    """df without result columns of an earlier run."""
    return df.drop(*columns)


def write_tasks(flows: DataFrame, packets: DataFrame, key: str, order: list[str], path: str) -> None:
    """Flows as JSON tasks for labelling, each with its packets in order."""
    nested = packets.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in packets.columns if c not in (key, *order)]))).alias("packets"))
    tasks = flows.join(nested, key, "left").select(F.struct(*flows.columns, "packets").alias("data"))
    tasks.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").json(path)


def sort_for_lookup(df: DataFrame, path: str, *keys: str) -> None:
    """Files range-partitioned and sorted by key, so that lookups and range filters skip most row groups."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def append_lines(rows: DataFrame, path: str) -> None:
    """Appends rows as JSON lines. Each write adds files of its own, committed as a whole, so writers need no lock."""
    rows.write.mode("append").json(path)


def serialised(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row, with all that is nested in it, as one JSON text; null fields stay."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias(name))


def write_episodes(episodes: DataFrame, path: str, step: str = "training_step") -> DataFrame:
    """Episodes as JSON by training step, and the summary of each step, which is written beside them.

    episodes: the step, episode_id, is_correct, trajectories (array), ..."""
    episodes.write.mode("append").partitionBy(step).json(f"{path}/episodes")
    right = F.count_if(F.coalesce(F.col("is_correct"), F.lit(False)))
    n = F.count(F.lit(1))
    summary = episodes.groupBy(step).agg(
        n.alias("num_episodes"), right.alias("total_correct"), (n - right).alias("total_incorrect"), (right / n).alias("accuracy"),
        F.avg(F.greatest(F.size("trajectories"), F.lit(0))).alias("avg_trajectories_per_episode"),
    )
    summary.write.mode("append").json(f"{path}/summaries")
    return summary


class Datasets:
    """Named datasets with splits as tables of the session's catalogue."""

    def __init__(self, spark: SparkSession, database: str = "default"):
        self.spark, self.database = spark, database

    def _table(self, name: str, split: str, form: str = "") -> str:
        for part in (name, split):
            if not part.replace("_", "").isalnum() or "__" in part:
                raise ValueError(f"not a dataset name: {part}")
        return f"{self.database}.{name}__{split}" + (f"__{form}" if form else "")

    def register(self, name: str, rows: DataFrame, split: str = "train") -> None:
        """The rows and, beside them, the rows in their training envelope."""
        rows.write.mode("overwrite").saveAsTable(self._table(name, split))
        envelope(self.load(name, split)).write.mode("overwrite").saveAsTable(self._table(name, split, "envelope"))

    def load(self, name: str, split: str = "train") -> DataFrame:
        return self.spark.table(self._table(name, split))

    def enveloped(self, name: str, split: str = "train") -> DataFrame:
        return self.spark.table(self._table(name, split, "envelope"))

    def registry(self) -> DataFrame:
        """(name, split, table) of what is registered."""
        found = [t.name.split("__") for t in self.spark.catalog.listTables(self.database)]
        rows = [(p[0], p[1], f"{self.database}.{'__'.join(p)}") for p in found if len(p) == 2]
        return self.spark.createDataFrame(rows, "name string, split string, table string")

    def exists(self, name: str, split: str = "train") -> bool:
        return self.spark.catalog.tableExists(self._table(name, split))

    def splits(self, name: str) -> list[str]:
        tables = (t.name.split("__") for t in self.spark.catalog.listTables(self.database))
        return sorted(p[1] for p in tables if len(p) == 2 and p[0] == name.lower())

    def names(self) -> list[str]:
        return sorted({t.name.split("__")[0] for t in self.spark.catalog.listTables(self.database) if "__" in t.name})

    def remove(self, name: str, split: str | None = None) -> None:
        for s in [split] if split else self.splits(name):
            for form in ("", "envelope"):
                self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name, s, form)}")
