"""Helpers shared by the training-data operators: table readers, scratch tables and size checks."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows times this row size stay below BROADCAST_BYTES.
BROADCAST_BYTES = 64 << 20


def reach(spark: SparkSession) -> None:
    """Let Python workers import this package also where the driver found it through sys.path alone. On a cluster the
    package itself is shipped (--py-files) or installed."""
    root, paths = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only in local mode, as in tests, a temporary one stands in where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skriva-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


class Scratch:
    """Written tables that cut lineage; they live in the shared folder, so a lost executor costs no recomputation. What is not dropped before goes
    when the driver ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/skriva-{label}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return it as a plain table scan."""
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def fits_broadcast(n_rows: int, row_bytes: int) -> bool:
    return n_rows * row_bytes <= BROADCAST_BYTES


def measured(df: DataFrame, row_bytes: Column | int) -> DataFrame:
    """Hint a broadcast if the sum of row_bytes over all rows of df (a written table, read once more for it) allows one."""
    return F.broadcast(df) if (df.agg(F.sum(F.lit(0).cast("long") + row_bytes)).first()[0] or 0) <= BROADCAST_BYTES else df


def small(df: DataFrame, n_rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast if the counted size allows one; else leave the join to a shuffle."""
    return F.broadcast(df) if fits_broadcast(n_rows, row_bytes) else df
