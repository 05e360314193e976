"""Session settings that every pipeline relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "skriva", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A temporary one stands in only in local mode, where one machine is all there is."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/skriva"
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/skriva-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{path.toString()}/{name}"


#: Rows of a part that one task aggregates or sorts.
ROWS = 1_250_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df by its keys in parts whose number grows with its rows, so that what a task holds does not; a grouping or window by these keys or more needs no other shuffle."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS))
    return df.repartition(parts, *keys)


def written(df: DataFrame) -> DataFrame:
    """The rows of df as a table in the shared folder: for what a plan reads several times and costs more to compute than to read."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
