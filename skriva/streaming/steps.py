"""Stateful streams whose keys may be of any size: each micro-batch is a distributed job, the state is a table.

A stateful operator hands all of a key's rows in a batch to one task. Here a batch is worked on by the batch operators, which split a key into parts, and what goes on
to the next batch is one small row per key, kept as Parquet in the stream's folder: a batch writes the keys that it changed, every COMPACT batches all of them. Output and
state are written under the number of their batch and replaced if it is run again, so a restarted stream goes on where it stopped and loses or repeats nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scans, store
from ..session import written

COMPACT = 16
#: (rows of the batch, state) -> (rows to put out, changed rows of the state).
Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def _batches(spark: SparkSession, path: str) -> list[int]:
    """The batches with a finished table under path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    found = [f.getPath() for f in files.listStatus(where)]
    return sorted(int(p.getName().partition("=")[2]) for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def state_before(spark: SparkSession, path: str, batch: int, schema: str) -> DataFrame:
    """The state (key, ...) that the batches before this one left: the last row of each key since the last whole table."""
    done = [b for b in _batches(spark, f"{path}/state") if b < batch]
    whole = [b for b in done if b % COMPACT == 0]
    rows = None
    for b in [b for b in done if not whole or b >= whole[-1]]:
        one = spark.read.schema(schema).parquet(f"{path}/state/batch={b}").withColumn("__batch", F.lit(b))
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        return spark.createDataFrame([], schema)
    return store.latest(rows, ["key"], ["__batch"]).drop("__batch")


def stepped(stream: DataFrame, spark: SparkSession, path: str, checkpoint: str, step: Step, schema: str) -> DataFrame:
    """Run a stream over what is there, batch by batch, and read its whole output. ``schema``: of the state, whose first column is ``key``."""
    made: list = []

    def run(batch: DataFrame, number: int) -> None:
        state = state_before(spark, path, number, schema)
        out, changed = step(written(batch), state)
        out = written(out)
        out.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        if number % COMPACT == 0:
            both = state.withColumn("__new", F.lit(0)).unionByName(changed.withColumn("__new", F.lit(1)))
            changed = store.latest(both, ["key"], ["__new"]).drop("__new")
        changed.write.mode("overwrite").parquet(f"{path}/state/batch={number}")
        made.append(out.schema)

    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(run).start()
    query.awaitTermination()
    done = _batches(spark, f"{path}/out")
    if not done:
        return step(spark.createDataFrame([], stream.schema), spark.createDataFrame([], schema))[0]
    reader = spark.read.schema(made[0]) if made else spark.read
    return reader.parquet(*[f"{path}/out/batch={b}" for b in done])


NUMBERS = "key long, sequence long, closed boolean"


def numbering(terminal: list[str] | None = None) -> Step:
    """STR1, STR3: each key's next numbers in order of time and id within a batch. With ``terminal``, events behind a key's first terminal one are dropped. State: NUMBERS."""

    def step(events: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        live = events.select("key", "event_id", "ts", "event_type").join(state.where("closed").select("key"), "key", "left_anti")
        rows = written(store.sequenced(live, "key", ["ts", "event_id"], state.select("key", "sequence")))
        ends = F.min(F.when(F.col("key").isNotNull() & F.col("event_type").isin(terminal or []), F.col("sequence")))  # nothing ends the events without a key
        last = rows.groupBy("key").agg(F.max("sequence").alias("__last"), ends.alias("__end"))
        shown = rows.join(last.select("key", "__end"), "key", "left").where(F.col("__end").isNull() | (F.col("sequence") <= F.col("__end"))).drop("__end")
        return shown, last.select("key", F.coalesce("__end", "__last").alias("sequence"), F.col("__end").isNotNull().alias("closed"))

    return step


STATES = "key long, status string, applied int, refused int"


def moving(moves: dict[str, tuple[list[str], str]], start: str) -> Step:
    """STR9-10: claims and other actions (key, at, action) on state machines: per batch, the state of each key that was acted on. State: STATES."""

    def step(actions: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        out = written(scans.states(scans.parted(actions.select("key", "at", "action"), "key", ["at", "action"]), "action", start, moves, state))
        return out, out

    return step


CURSORS = "key long, cursor long"


def delivering(cursors: DataFrame | None = None) -> Step:
    """STR2: what a consumer with a cursor per key is sent of numbered events (key, sequence, ...): each number beyond the cursor once, however often it arrives;
    the cursor then stands at the last one. ``cursors`` (key, cursor): where consumers begin. State: CURSORS."""

    def step(events: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        at = state
        if cursors is not None:
            at = at.unionByName(cursors.select("key", "cursor")).groupBy("key").agg(F.max("cursor").alias("cursor"))
        new = events.join(at, "key", "left").where(F.col("sequence") > F.coalesce("cursor", F.lit(0))).drop("cursor").dropDuplicates(["key", "sequence"])
        new = written(new)
        return new, new.groupBy("key").agg(F.max("sequence").alias("cursor"))

    return step
