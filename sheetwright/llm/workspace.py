"""Shared scratch space of the operators: tables that cut lineage.

Everything an operator has to keep between jobs is written as Parquet below
``spark.checkpoint.dir``, which the driver and all executors see. Where the
setting is missing, a local master (tests, a laptop) uses a folder of its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from sheetwright.shipping import ship


#: Rows of an Arrow batch, where the session has Spark's default: ten thousand long texts are much to hold at once.
BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> None:
    """What every operator needs: the package on the executors, and batches of few rows."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, BATCH_ROWS)


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = os.path.join(tempfile.gettempdir(), f"sheetwright-{os.getpid()}")
    os.makedirs(local, exist_ok=True)
    return f"file://{local}"


class Workspace:
    """A folder of one operator call. ``save`` writes a table and reads it again."""

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._taken = 0

    def folder(self, name: str) -> str:
        self._taken += 1
        return f"{self.path}/{name}-{self._taken}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        target = self.folder(name)
        df.write.parquet(target)
        kept = self.spark.read.schema(df.schema).parquet(target)
        kept._sheetwright_path = target
        return kept

    def drop(self, *saved) -> None:
        """Delete saved tables (or folders) that nothing reads any more."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for table in saved:
            where = table if isinstance(table, str) else table._sheetwright_path
            path = jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(conf).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
