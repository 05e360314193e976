"""Append-only event streams per key: numbers, cursors, terminal cut-off, deduplication, recovery.

State is one small row per key. The same functions run over a file stream in tests and over any other source in production; with a
checkpoint location a restarted query goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

NUMBERED = "key long, event_id long, ts timestamp, event_type string, sequence long"


def numbered(events: DataFrame, terminal: list[str] | None = None) -> DataFrame:
    """STR1, STR3: (key, event_id, ts, event_type, sequence): each key's next numbers in order of time and id within a batch. With
    ``terminal``, events behind a key's first terminal one are dropped."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, closed = state.get if state.exists else (0, False)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        if closed:
            rows = rows.iloc[:0]
        elif terminal:
            ends = rows["event_type"].isin(terminal).to_numpy().nonzero()[0]
            if len(ends):
                rows, closed = rows.iloc[: ends[0] + 1], True
        rows = rows.assign(sequence=range(last + 1, last + 1 + len(rows)))
        state.update((last + len(rows), closed))
        yield rows[["key", "event_id", "ts", "event_type", "sequence"]]

    return events.select("key", "event_id", "ts", "event_type").groupBy("key").applyInPandasWithState(
        run, NUMBERED, "last long, closed boolean", "append", GroupStateTimeout.NoTimeout)


def deduplicated(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """STR5: repeated deliveries of an event go; state older than the delay is dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["key", "event_id"])


def stalled(beats: DataFrame, seconds: int) -> DataFrame:
    """STR4, STR11: (key, last_beat) of keys whose heartbeat stayed away for so long in event time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "last_beat": [pd.Timestamp(last, unit="ms")]})
            return
        newest = max(int(b["ts"].max().timestamp() * 1000) for b in batches)
        if state.exists:
            newest = max(newest, state.get[0])
        state.update((newest,))
        # A beat that comes late may be due already; it is reported with the next trigger.
        state.setTimeoutTimestamp(max(newest + 1000 * seconds, state.getCurrentWatermarkMs() + 1))

    return beats.withWatermark("ts", "0 seconds").groupBy("key").applyInPandasWithState(
        run, "key long, last_beat timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def accumulated(tokens: DataFrame) -> DataFrame:
    """STR7: a message's content so far, from its numbered pieces."""
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("sequence", "piece"))), lambda r: r["piece"])
    return tokens.groupBy("message_id").agg(F.array_join(pieces, "").alias("content"), F.max("sequence").alias("last"))


def windowed(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """An extension beyond the parity items: counts and sums per tumbling window and type, late rows dropped by a watermark."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Events as a file stream, in the shape of the functions above."""
    schema = spark.read.parquet(path).schema
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    # A stream reads folders; a single file is picked out of its own.
    if "*" not in path and files.getFileStatus(where).isFile():
        reader, path = reader.option("pathGlobFilter", where.getName()), str(where.getParent())
    s = reader.parquet(path)
    return s.select(F.col("user_id").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


def drained(stream: DataFrame, spark: SparkSession, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into Parquet and read it back. With mode complete each batch replaces the table."""
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = out.format("parquet").option("path", path).start()
    else:
        query = out.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.parquet(path)


def retried(calls: DataFrame, key: str, retries: int = 2, budget: float = 60.0, base: float = 0.5, cap: float = 8.0) -> DataFrame:
    """STR14: (key, attempts, waited, outcome) of calls (key, statuses array: the answer of each attempt, retry_after or null, jitter from 0 to 1): rate limits
    and server errors are asked again after a doubling delay, or what the server said, while the total budget lasts. A fold over each call's few attempts."""
    zero = F.struct(F.lit(0).cast("long").alias("attempts"), F.lit(0.0).alias("waited"), F.lit(None).cast("string").alias("outcome"))

    def step(a, s):
        delay = F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), a["attempts"]))
        wait = F.coalesce(F.col("retry_after"), delay + F.col("jitter") * F.least(F.lit(0.25), delay * 0.1))
        again = (s == 429) | (s >= 500)
        end = F.when(s.between(200, 299), "ok").when(~again, "refused").when(a["attempts"] >= retries, "exhausted").when(wait >= budget - a["waited"], "budget")
        return F.when(a["outcome"].isNotNull(), a).otherwise(F.struct((a["attempts"] + 1).alias("attempts"), F.when(end.isNull(), a["waited"] + wait).otherwise(a["waited"]).alias("waited"), end.alias("outcome")))

    return calls.select(key, F.aggregate("statuses", zero, step).alias("r")).select(key, "r.*")


BRANCHES = "report_id long, position int, task_id string, status string, attempts int, error_class string, notes string"


def fan_out(tasks: DataFrame, run: Callable[[str, str, int], str], retries: int = 1, parts: int | None = None) -> DataFrame:
    """STR13: BRANCHES of tasks (report_id, position, task_id, payload): run(task_id, payload, attempt) for each, retried, with failures kept as rows. The
    number of partitions bounds how many run at once."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples():
                notes = error = None
                for attempt in range(1, retries + 2):
                    try:
                        notes, error = run(r.task_id, r.payload, attempt), None
                        break
                    except Exception as e:  # a failed branch is a gap, not a failed job
                        error = type(e).__name__
                out.append((r.report_id, r.position, r.task_id, "failed" if error else "success", attempt, error, notes))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BRANCHES.split(", ")])

    return (tasks.repartition(parts) if parts else tasks).mapInPandas(work, BRANCHES)


def gathered(branches: DataFrame) -> DataFrame:
    """STR13: per report the notes in plan order, the tasks that failed, and counts."""
    rows = F.array_sort(F.collect_list(F.struct("position", "task_id", "status", "notes")))
    g = branches.groupBy("report_id").agg(rows.alias("r"), F.count("*").alias("branches"), F.count_if(F.col("status") == "failed").alias("failed_branches"), F.sum("attempts").alias("attempts"))
    good = F.filter("r", lambda x: x["status"] == "success")
    bad = F.filter("r", lambda x: x["status"] == "failed")
    return g.select("report_id", F.array_join(F.transform(good, lambda x: x["notes"]), "\n").alias("notes"), F.transform(bad, lambda x: x["task_id"]).alias("gaps"), "branches", "failed_branches", "attempts")


def resumed(events: DataFrame, cursors: DataFrame, terminal: list[str], limit: int = 1000) -> DataFrame:
    """STR2-3: what a consumer that comes back is sent: cursors (key, after, header): from the greater of both on, a header that is no number
    counting as after, nothing behind the key's first terminal event, at most ``limit`` rows a key."""
    c = cursors.select("key", F.coalesce("after", F.lit(0)).alias("after"), F.try_to_number("header", F.lit("999999999999")).cast("long").alias("last_event_id"))
    ends = events.where(F.col("event_type").isin(terminal)).groupBy("key").agg(F.min("sequence").alias("__end"))
    shown = events.join(ends, "key", "left").where(F.col("__end").isNull() | (F.col("sequence") <= F.col("__end"))).drop("__end")
    new = shown.join(c.select("key", F.greatest("after", F.coalesce("last_event_id", F.lit(0))).alias("__c")), "key").where(F.col("sequence") > F.col("__c")).drop("__c")
    return new.withColumn("__n", F.row_number().over(W.partitionBy("key").orderBy("sequence"))).where(F.col("__n") <= limit).drop("__n")
