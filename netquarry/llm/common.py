"""Helpers that several text operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Maps ASCII separators to a space and A-Z to a-z; bytes of 0x80 and above stay, so code points above ASCII are word characters.
WORD_TABLE = bytes(
    i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split() if text else []


def small(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that what is made from one at a time stays small."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; a temporary one only in local mode where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """df as written to the shared checkpoint folder, with its lineage cut. Spark's cleaner deletes it after its last use."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as written to a Parquet table in the shared folder, with its lineage cut; it stays there."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Parquet tables of one computation, in a folder of their own below the shared one.

    A table is dropped as soon as what is made from it is written, and the rest at the end of the `with` block; so what
    leaves the block must be settled. Lost executors read the tables again, as no machine keeps them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        self.number, self.paths = count(), {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.folder)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{next(self.number)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path, out
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self._delete(self.paths.pop(id(df))[0])

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def ranked(df: DataFrame, keys: list[str], order: list[str], salt: F.Column, n: int, name: str) -> DataFrame:
    """Adds `name`: 0-based gapless position of each row among the rows with equal keys.

    Each key's rows are dealt to n salts, numbered there in `order`, and shifted by the counts of the salts before:
    a key that holds most rows is n tasks' work. df is read twice, so it should be cheap to make or settled.
    """
    df = df.withColumn("_salt", F.pmod(salt, F.lit(n)).cast("int"))
    counts = df.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_salt").orderBy(*order)
    numbered = df.withColumn("_row", F.row_number().over(inside) - 1)
    return (
        numbered.join(starts, [*keys, "_salt"])
        .withColumn(name, (F.col("_start") + F.col("_row")).cast("long"))
        .drop("_salt", "_start", "_row")
    )
