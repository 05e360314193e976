"""Streams by steps: hot keys, restarts, replayed batches, compaction."""

import random

import pytest
from pyspark.sql import functions as F

from skriva.operators import store
from skriva.streaming import sequences, steps

SCHEMA = "user_id long, event_id long, ts timestamp, event_type string, value double"


def put(spark, path, rows, name):
    df = spark.createDataFrame(rows, "user_id long, event_id long, s long, event_type string, value double")
    df.select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"), "event_type", "value").coalesce(1).write.parquet(f"{path}/in/{name}")


def drain(spark, path, step, schema):
    s = sequences.event_stream(spark, f"{path}/in/*")
    return steps.stepped(s, spark, f"{path}/run", f"{path}/offsets", step, schema)


def test_numbers_go_on_after_a_restart(spark, tmp_path, monkeypatch):
    """A key with most of the events; three deliveries, the stream restarted between them; state made whole at the second batch."""
    monkeypatch.setattr(steps, "COMPACT", 2)
    rnd, path, rows = random.Random(4), f"file://{tmp_path}", []
    for b in range(3):
        some = [(1 if rnd.random() < 0.9 else rnd.randrange(2, 6), 1000 * b + i, 10_000 * b + rnd.randrange(5000), "click", 1.0) for i in range(300)]
        rows += [some]
        put(spark, path, some, f"b{b}")
        out = drain(spark, path, steps.numbering(), steps.NUMBERS)
    want, count = {}, {}
    for some in rows:
        for k, e, *_ in sorted(some, key=lambda r: (r[2], r[1])):
            want[e] = (k, count.setdefault(k, 0) + 1)
            count[k] += 1
    assert {r.event_id: (r.key, r.sequence) for r in out.collect()} == want
    assert {r.key: r.sequence for r in steps.state_before(spark, f"{path}/run", 99, steps.NUMBERS).collect()} == count


def test_a_batch_that_is_run_again_replaces_itself(spark, tmp_path):
    path, step = f"file://{tmp_path}", steps.numbering()
    events = lambda ids: spark.createDataFrame([(1, i, "x") for i in ids], "key long, event_id long, event_type string").withColumn("ts", F.timestamp_seconds("event_id"))
    for number, ids in ((0, (1, 2)), (1, (3, 4)), (1, (3, 4))):
        out, changed = step(events(ids), steps.state_before(spark, path, number, steps.NUMBERS))
        assert [r.sequence for r in out.orderBy("event_id").collect()] == list(ids)
        changed.write.mode("overwrite").parquet(f"{path}/state/batch={number}")


def test_nothing_behind_the_end(spark, tmp_path):
    path = f"file://{tmp_path}"
    put(spark, path, [(1, 1, 1, "click", 0.0), (1, 2, 2, "error", 0.0), (1, 3, 3, "click", 0.0), (2, 4, 1, "click", 0.0)], "a")
    assert sorted((r.key, r.sequence) for r in drain(spark, path, steps.numbering(["error"]), steps.NUMBERS).collect()) == [(1, 1), (1, 2), (2, 1)]
    put(spark, path, [(1, 5, 9, "click", 0.0), (2, 6, 9, "error", 0.0), (2, 7, 10, "error", 0.0)], "b")
    assert sorted((r.key, r.sequence) for r in drain(spark, path, steps.numbering(["error"]), steps.NUMBERS).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_claims_and_cursors(spark):
    act = lambda rows: spark.createDataFrame(rows, "key long, at long, action string")
    step = steps.moving(store.ACTIONS["task"], "pending")
    out, state = step(act([(1, 1, "claim"), (1, 2, "claim"), (2, 1, "complete")]), spark.createDataFrame([], steps.STATES))
    assert {r.key: (r.status, r.applied, r.refused) for r in out.collect()} == {1: ("running", 1, 1), 2: ("pending", 0, 1)}
    out, _ = step(act([(1, 3, "fail"), (1, 4, "retry"), (3, 1, "cancel")]), state)
    assert {r.key: (r.status, r.applied, r.refused) for r in out.collect()} == {1: ("pending", 3, 1), 3: ("canceled", 1, 0)}
    events = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 3), (2, 1), (None, 1)], "key long, sequence long")
    out, state = steps.delivering()(events, spark.createDataFrame([(1, 1)], steps.CURSORS))
    assert sorted((r.key or 0, r.sequence) for r in out.collect()) == [(0, 1), (1, 2), (1, 3), (2, 1)]
    assert {r.key: r.cursor for r in state.collect()} == {1: 3, 2: 1, None: 1}


def test_a_stream_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/in/a")
    assert drain(spark, f"file://{tmp_path}", steps.numbering(), steps.NUMBERS).collect() == []
