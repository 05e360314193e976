"""The streaming operators, drained over the events table; their results equal those of the batch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path, table
from ..operators import store as S
from ..streaming import sequences as Q
from ..streaming import steps as P
from .reports import _machine
from .tables import ORACLES as TABLES
from .tables import SEQ, event_sequence


def _place(spark) -> str:
    return scratch_path(spark, "stream")


def stream_sequence(spark, sf_dir):
    """STR1."""
    place = _place(spark)
    out = P.stepped(Q.event_stream(spark, f"{sf_dir}/events.parquet"), spark, f"{place}/run", f"{place}/offsets", P.numbering(), P.NUMBERS)
    return out.select("key", "event_id", "sequence")


def stream_until_terminal(spark, sf_dir):
    """STR3."""
    place = _place(spark)
    out = P.stepped(Q.event_stream(spark, f"{sf_dir}/events.parquet"), spark, f"{place}/run", f"{place}/offsets", P.numbering(["error"]), P.NUMBERS)
    return out.groupBy("key").agg(F.count("*").alias("shown"), F.max("sequence").alias("last"))


def _twice(spark, sf_dir):
    """The events as two files, the second one with half of them again: what a reconnecting source delivers."""
    place = _place(spark)
    e = table(spark, sf_dir, "events")
    e.coalesce(1).write.parquet(f"{place}/in/a")
    e.where("event_id % 2 = 0").coalesce(1).write.parquet(f"{place}/in/b")
    return Q.event_stream(spark, f"{place}/in/*"), place


def stream_deduplicated(spark, sf_dir):
    """STR5: repeated deliveries within the delay are dropped."""
    s, place = _twice(spark, sf_dir)
    out = Q.drained(Q.deduplicated(s, "400 days"), spark, f"{place}/out", f"{place}/state")
    return out.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("events"))


def stream_accumulated(spark, sf_dir):
    """STR7: messages put together from pieces that arrive in two batches."""
    m = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "text")
    m = m.groupBy("message_id").agg(F.max("text").alias("text"))
    p = m.select("message_id", F.posexplode(F.split("text", "(?<= )")).alias("sequence", "piece"))
    place = _place(spark)
    p.where("sequence % 2 = 0").write.mode("append").parquet(f"{place}/in")
    p.where("sequence % 2 = 1").write.mode("append").parquet(f"{place}/in")
    s = spark.readStream.schema(p.schema).parquet(f"{place}/in")
    return Q.drained(Q.accumulated(s), spark, f"{place}/out", f"{place}/state", "complete").select("message_id", F.sha2("content", 256).alias("content"), F.col("last").cast("long").alias("last"))


def stream_windowed(spark, sf_dir):
    """An extension: counts per hour and type over the whole stream."""
    place = _place(spark)
    s = Q.event_stream(spark, f"{sf_dir}/events.parquet")
    out = Q.drained(Q.windowed(s, "1 hour", "10 minutes"), spark, f"{place}/out", f"{place}/state", "complete")
    return out.select(F.col("window.start").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_stalled(spark, sf_dir):
    """STR4, STR11: keys of the first half of the stream that stay silent until the second, a year later, arrives."""
    place = _place(spark)
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    e.where("key % 2 = 0").coalesce(1).write.parquet(f"{place}/in/a")
    late = e.where("key % 2 = 1").withColumn("ts", F.col("ts") + F.expr("INTERVAL 365 DAYS"))
    late.coalesce(1).write.parquet(f"{place}/in/b")
    spark.createDataFrame([(-1, )], "key long").select("key", (F.expr("TIMESTAMP '2024-01-01 00:00:00'") + F.expr("INTERVAL 366 DAYS")).alias("ts")).coalesce(1).write.parquet(f"{place}/in/c")
    s = spark.readStream.schema("key long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{place}/in/*")
    return Q.drained(Q.stalled(s, 3600), spark, f"{place}/out", f"{place}/state").where("key % 2 = 0").select("key", "last_beat")


def resumed_stream(spark, sf_dir):
    """STR2: clients that come back with a cursor, a header, both or a broken header."""
    e = event_sequence(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    k = F.col("key")
    cursors = e.select("key").distinct().select("key", F.when(k % 4 != 0, k % 6).alias("after"), F.when(k % 3 == 0, "3").when(k % 3 == 1, "x7").alias("header"))
    return Q.resumed(e, cursors, ["error"], 4).select("key", "sequence", "event_id")


def _halves(spark, rows, order, again, step, schema):
    """Numbered rows through a stream that takes two deliveries, cut within every key, and is restarted between them; ``again``: the second one repeats the first.

    A delivery is one batch: its files are finished in any order and a key may lie in several, so a batch of only some of them could hold a key's later rows before its earlier ones."""
    place = _place(spark)
    for name, some in (("a", rows.where(F.col(order) <= 30)), ("b", rows if again else rows.where(F.col(order) > 30))):
        some.write.parquet(f"{place}/in/{name}")
        s = spark.readStream.schema(rows.schema).parquet(f"{place}/in/*")
        out = P.stepped(s, spark, f"{place}/run", f"{place}/offsets", step, schema)
    return out


def stream_delivered(spark, sf_dir):
    """STR2: consumers with a cursor each, over deliveries that repeat themselves."""
    e = event_sequence(spark, sf_dir).where("key IS NOT NULL").select("key", "sequence", "event_id")  # no consumer without a key
    cursors = e.groupBy("key").agg((F.col("key") % 6).cast("long").alias("cursor"))
    out = _halves(spark, e, "sequence", True, P.delivering(cursors), P.CURSORS)
    return out.select("key", "sequence", "event_id")


def stream_states(spark, sf_dir):
    """STR9-10: each user's events as actions on a task, in two batches; the last state that each key was left in."""
    e = event_sequence(spark, sf_dir)
    named = e.select("key", F.col("sequence").alias("at"), S.action_of("task", F.col("event_id")).alias("action"))
    out = _halves(spark, named, "at", False, P.moving(S.ACTIONS["task"], "pending"), P.STATES)
    last = out.groupBy("key").agg(F.max_by("status", F.col("applied") + F.col("refused")).alias("status"), F.max("applied").alias("applied"), F.max("refused").alias("refused"))
    return S.owned(last, "key").select(F.lit("task").alias("machine"), "key", "status", "applied", "refused")


QUERIES = {f.__name__: f for f in (stream_states, stream_delivered, stream_sequence, stream_until_terminal, stream_deduplicated, stream_accumulated, stream_windowed, stream_stalled, resumed_stream)}
#: The stream reads a table of one file in one batch, so the order within a key is that of the batch query.
ORACLES = {
    "stream_states": "WITH RECURSIVE " + SEQ + ", " + _machine("task") + " SELECT 'task' AS machine, key, last(status ORDER BY sequence) AS status, last(applied ORDER BY sequence) AS applied, last(refused ORDER BY sequence) AS refused FROM task_s GROUP BY key",
    "stream_delivered": f"WITH {SEQ} SELECT key, sequence, event_id FROM seq WHERE sequence > key % 6",
    "stream_sequence": TABLES["event_sequence"], "stream_until_terminal": TABLES["until_terminal"],
    "stream_deduplicated": "SELECT user_id AS key, count(DISTINCT event_id) AS n, count(DISTINCT event_id) AS events FROM events GROUP BY ALL",
    "stream_accumulated": """WITH m AS (SELECT conv_id * 1000 + turn AS message_id, max(text) AS t FROM conversations WHERE text IS NOT NULL GROUP BY ALL)
SELECT message_id, sha256(t) AS content, (len(string_split(t, ' ')) - 1)::BIGINT AS last FROM m""",
    "stream_windowed": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_stalled": "SELECT user_id AS key, date_trunc('millisecond', max(ts)) AS last_beat FROM events WHERE user_id % 2 = 0 GROUP BY user_id",
    "resumed_stream": f"""WITH {SEQ}, e AS (SELECT key, min(sequence) AS stop FROM seq WHERE event_type = 'error' GROUP BY key),
c AS (SELECT s.*, row_number() OVER (PARTITION BY key ORDER BY sequence) AS n FROM seq s LEFT JOIN e USING (key) WHERE (stop IS NULL OR sequence <= stop) AND sequence > greatest(CASE WHEN key % 4 <> 0 THEN key % 6 ELSE 0 END, CASE WHEN key % 3 = 0 THEN 3 ELSE 0 END))
SELECT key, sequence, event_id FROM c WHERE n <= 4""",
}
