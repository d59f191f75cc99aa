"""Tables that outlive a job, a task or an executor, in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only in local mode where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _path(spark, path)
    return files.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if it isn't there."""
    at, files = _path(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    at, files = _path(spark, path)
    files.delete(at, True)


class Rounds:
    """A log of Parquet tables, one for each round: round=0, round=1, ... A round counts once its job has committed, so a round
    that was killed is written again under the same number and nothing counts twice."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def done(self) -> int:
        """Number of committed rounds."""
        n = 0
        while exists(self.spark, f"{self.folder}/round={n}/_SUCCESS"):
            n += 1
        return n

    def write(self, rows: DataFrame) -> int:
        n = self.done()
        rows.write.mode("overwrite").parquet(f"{self.folder}/round={n}")
        return n

    def read(self, schema: str | None = None) -> DataFrame | None:
        """All committed rounds with the column `round`; None before the first."""
        n = self.done()
        if not n:
            return None
        paths = [f"{self.folder}/round={k}" for k in range(n)]
        reader = self.spark.read.option("basePath", self.folder)
        return (reader.schema(schema) if schema else reader).parquet(*paths)


def settle(df: DataFrame) -> DataFrame:
    """df as written to the shared checkpoint folder, with its lineage cut. Spark's cleaner deletes it after its last use."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as written to a Parquet table in a new folder below the shared one, with its lineage cut; it stays there."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
