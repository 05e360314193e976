"""Queries over conversations, events and task tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..operators import store as S
from ..session import spread, table, written

NOW = "TIMESTAMP '2024-01-01 00:00:00'"


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def history_budget(spark, sf_dir):
    out = E.history(_messages(spark, sf_dir), limit=4, budget=60)
    return out.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))


def previous_user_turn(spark, sf_dir):
    return E.previous_user_turn(_messages(spark, sf_dir))


def conversation_search(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return S.conversation_search(m.select("conv_id").distinct(), m, "the")


def message_page(spark, sf_dir):
    """Each conversation's messages in order with their number and the total: page 2 of 3 rows each."""
    from pyspark.sql import Window as W

    order = W.partitionBy("conv_id").orderBy("turn", F.when(F.col("role") == "user", 0).otherwise(1), "text")
    m = _messages(spark, sf_dir).withColumn("n", F.row_number().over(order).cast("long")).withColumn("total", F.count("*").over(W.partitionBy("conv_id")))
    return m.where("n > 3 AND n <= 6").select("conv_id", "n", "total", "turn", "role")


def conversation_archive(spark, sf_dir):
    a = E.conversation_archive(_messages(spark, sf_dir).where("text IS NOT NULL"))
    return a.select("conv_id", "messages", F.sha2("archive", 256).alias("digest"))


def task_page(spark, sf_dir):
    """Orders as tasks: finished ones with a term in the priority, newest first, the third page."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status")
    rows = S.listing(o, F.col("o_orderpriority"), F.col("o_orderkey").cast("string"), "F", "URG")
    return S.page(rows, [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 40, 20).select("o_orderkey", "o_orderpriority", F.round("o_totalprice", 2).alias("o_totalprice"))


def last_page(spark, sf_dir):
    """TOP3: the last twenty lines, the newest first."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    order = [F.col("l_shipdate").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    return S.page(rows, order, max(rows.count() - 20, 0), 20).select("l_orderkey", "l_linenumber")


def task_count(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status")
    return S.listing(o, F.col("o_orderpriority"), F.col("o_orderkey").cast("string"), "F", "URG").agg(F.count("*").alias("total"))


def active_parent_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return table(spark, sf_dir, "lineitem").join(o, "l_orderkey").groupBy("o_orderpriority").agg(F.count("*").alias("children"), F.count_distinct("l_orderkey").alias("parents"))


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "ts", "event_type", "value", "props")
    return S.sequenced(e, "key", ["ts", "event_id"])


def event_sequence(spark, sf_dir):
    return _events(spark, sf_dir).select("key", "event_id", "sequence")


def events_after_cursor(spark, sf_dir):
    e = _events(spark, sf_dir)
    cursors = e.select("key").distinct().select("key", (F.col("key") % 5).alias("after"), F.when(F.col("key") % 3 == 0, 4).alias("last_event_id"))
    return S.after(e, cursors, "key", 3).select("key", "sequence", "event_id")


def latest_state(spark, sf_dir):
    return S.latest(_events(spark, sf_dir).select("key", "sequence", "event_type", "event_id"), ["key"], ["sequence"])


def until_terminal(spark, sf_dir):
    out = S.until_terminal(_events(spark, sf_dir), "key", F.col("event_type") == "error")
    return out.groupBy("key").agg(F.count("*").alias("shown"), F.max("sequence").alias("last"))


def stale_keys(spark, sf_dir):
    """Users without an event in the last hour of the table, their last event not terminal."""
    last = S.latest(_events(spark, sf_dir).select("key", "sequence", "event_type", "ts"), ["key"], ["sequence"])
    now = table(spark, sf_dir, "events").agg(F.max("ts").alias("now"))
    t = last.crossJoin(F.broadcast(now)).withColumn("status", F.when(F.col("event_type") == "error", "failed").otherwise("running")).withColumn("heartbeat_at", F.col("ts")).withColumn("updated_at", F.col("ts"))
    return S.stale(t, F.col("now"), 3600).select("key", "sequence", "event_type")


def trace_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("stage"), F.when(F.col("user_id") % 4 == 0, "branch").alias("branch_id"), F.col("value").cast("double").alias("duration_ms"),
        (F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 77).alias("output_tokens"))
    return S.trace_rollup(e, ["stage"], 0.4, 1.2)


def usage_deltas(spark, sf_dir):
    e = _events(spark, sf_dir).select("key", "sequence", (F.col("event_id") * 3).alias("tokens"))
    return S.usage_deltas(e, "key", "sequence", ["tokens"])


def json_props(spark, sf_dir):
    """Public keys of the JSON properties."""
    e = table(spark, sf_dir, "events").select("event_type", F.explode(S.public_json(F.col("props"))).alias("k", "v"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("long")).alias("total"))


def sse_round_trip(spark, sf_dir):
    """Events as frames and back; the result is what the frames carry."""
    e = _events(spark, sf_dir)
    f = e.select("key", S.sse_fields(S.sse_frame(F.col("sequence"), F.col("event_type"), F.coalesce("props", F.lit("")))).alias("f"))
    return f.select("key", F.col("f.id").alias("sequence"), "f.event", "f.data")


def lenient_json(spark, sf_dir):
    """Messages wrapped as JSON with fences, remarks and trailing commas."""
    body = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"), "turn"))
    broken = F.concat(F.lit("Sure:\n```json\n"), F.regexp_replace(body, r"\}$", ",}"), F.lit("\n``` done {"))
    return _messages(spark, sf_dir).select("conv_id", "turn", T.lenient_json(broken).alias("parsed"))


def request_validation(spark, sf_dir):
    """SC35: page bounds come in pairs, in order."""
    from ..schemas import validate

    low, high = F.when(F.col("turn") % 3 != 0, F.col("turn")), F.when(F.col("turn") % 4 != 0, F.lit(3).cast("long"))
    m = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), low.alias("a"), high.alias("b"))
    return validate(m, {"paired_bounds": F.col("a").isNull() == F.col("b").isNull(), "ordered_bounds": F.coalesce(F.col("a") <= F.col("b"), F.lit(True))}, "id")


def _tasks(spark, sf_dir):
    """Orders as tasks."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("pending")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("dedup_key"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp")).alias("completed_at"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderdate").cast("timestamp")).alias("cleaned_at"),
        F.when(F.col("o_orderkey") % 11 == 0, F.col("o_orderdate").cast("timestamp")).alias("deleted_at"), F.lit(0).alias("attempt_count"))


def expired_files(spark, sf_dir):
    return S.expired(_tasks(spark, sf_dir), F.expr("TIMESTAMP '1998-01-01 00:00:00'"), 30).select("task_id", "dedup_key")


def active_duplicates(spark, sf_dir):
    return S.active_duplicate(_tasks(spark, sf_dir)).select("dedup_key", "task_id", "status")


def checkpoint_upsert(spark, sf_dir):
    """Line items as checkpoints (order, line): odd lines come again with a later version."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").cast("long").alias("step"), F.round("l_quantity", 2).alias("state"))
    # A table may hold a key several times already; the largest state of a version stands for it.
    stored = written(spread(rows, "task_id", "step").groupBy("task_id", "step").agg(F.max("state").alias("state"))).withColumn("version", F.lit(1).cast("long"))
    new = stored.where("step % 2 = 1").withColumn("version", F.lit(2).cast("long")).withColumn("state", F.round(F.col("state") + 1, 2))
    return S.upsert(stored, new, ["task_id", "step"], "version").select("task_id", "step", "version", "state")


def cascade_delete(spark, sf_dir):
    """Line items left when the deleted tasks' rows go with them."""
    gone = _tasks(spark, sf_dir).where("deleted_at IS NOT NULL").select(F.col("task_id").alias("l_orderkey"))
    return S.without(table(spark, sf_dir, "lineitem"), gone, ["l_orderkey"]).groupBy("l_returnflag").agg(F.count("*").alias("n"))


def state_transitions(spark, sf_dir):
    """A claim of every task: pending ones start to run, all others stay."""
    t = S.transition(_tasks(spark, sf_dir), {"running": ["pending"]}, F.lit("running"))
    return t.groupBy("status", "changed").agg(F.count("*").alias("n"), F.sum("attempt_count").cast("long").alias("attempts"))


def client_view(spark, sf_dir):
    """STR5: deliveries with numbers that come again."""
    d = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("arrival"), (F.col("event_id") - F.col("event_id") * 7 % 400).alias("id"))
    return S.client_view(d, "key", "arrival", "id", 5).select("key", "arrival", "id")


def heartbeats(spark, sf_dir):
    """STR4: a heartbeat after each hour without an event of a user."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"))
    return S.heartbeats(e, "key", "at", 3600).groupBy("key").agg(F.count("*").alias("beats"), F.max("n").alias("longest"))


QUERIES = {f.__name__: f for f in (
    client_view, heartbeats, history_budget, previous_user_turn, conversation_search, message_page, conversation_archive, task_page, last_page, task_count, active_parent_join, event_sequence, events_after_cursor,
    latest_state, until_terminal, stale_keys, trace_rollup, usage_deltas, json_props, sse_round_trip, lenient_json, request_validation,
    expired_files, active_duplicates, checkpoint_upsert, cascade_delete, state_transitions)}

SEQ = "seq AS (SELECT user_id AS key, event_id, ts, event_type, value, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events)"
TASKS = """t AS (SELECT o_orderkey AS task_id, o_custkey AS dedup_key, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'pending' END AS status, o_orderdate AS created_at FROM orders)"""
STRIP = r"regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''), '\s+$', '')"

ORACLES = {
    "last_page": """WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS i, count(*) OVER () AS n FROM lineitem) SELECT l_orderkey, l_linenumber FROM r WHERE i > n - 20""",
    "client_view": """WITH d AS (SELECT user_id AS key, event_id AS arrival, event_id - event_id * 7 % 400 AS id FROM events), t AS (SELECT *, max(id) OVER (PARTITION BY key ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id DESC) AS n FROM t WHERE top IS NULL OR id > top) SELECT key, arrival, id FROM n WHERE n <= 5""",
    "heartbeats": """WITH g AS (SELECT user_id AS key, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts) AS gap FROM events), b AS (SELECT key, (gap - 1) // 3600000000 AS n FROM g WHERE gap > 3600000000)
SELECT key, sum(n)::BIGINT AS beats, max(n) AS longest FROM b GROUP BY key""",
    "history_budget": f"""WITH m AS (SELECT conv_id, turn, role, {STRIP} AS t FROM conversations), e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM m WHERE t <> '' AND role IN ('user', 'assistant')),
c AS (SELECT *, ceil((2 * length(role) + 5) / 4.0)::BIGINT AS w, ceil(length(t) / 4.0)::BIGINT AS k FROM e WHERE n <= 4), s AS (SELECT *, sum(w + k) OVER (PARTITION BY conv_id ORDER BY n) AS spent FROM c)
SELECT conv_id, turn, role, CASE WHEN spent <= 60 THEN length(t) ELSE length(regexp_replace(substr(t, 1, ((60 - w) * 4 - 2)::BIGINT), '\\s+$', '')) + 2 END::BIGINT AS n_chars FROM s WHERE spent <= 60 OR (n = 1 AND w < 60)""",
    "previous_user_turn": f"""WITH u AS (SELECT conv_id, turn, {STRIP} AS q FROM conversations WHERE role = 'user'),
j AS (SELECT a.conv_id, a.turn, a.q, max_by(b.q, b.turn) AS previous FROM u a LEFT JOIN u b ON b.conv_id = a.conv_id AND b.turn < a.turn AND b.q <> a.q GROUP BY ALL)
SELECT conv_id, turn, coalesce(previous, '') AS previous, concat_ws(' ', nullif(previous, ''), nullif(q, '')) AS fallback_query FROM j""",
    "conversation_search": "SELECT DISTINCT conv_id FROM conversations WHERE contains(lower(text), 'the')",
    "message_page": """WITH m AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, CASE role WHEN 'user' THEN 0 ELSE 1 END, text) AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations)
SELECT conv_id, n, total, turn, role FROM m WHERE n BETWEEN 4 AND 6""",
    "conversation_archive": """WITH m AS (SELECT conv_id, turn, role, text, '{"turn":' || turn || ',"role":' || to_json(role)::VARCHAR || ',"text":' || to_json(text)::VARCHAR || '}' AS j FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, count(*) AS messages, sha256('[' || string_agg(j, ',' ORDER BY turn, role, text) || ']') AS digest FROM m GROUP BY conv_id""",
    "task_page": "SELECT o_orderkey, o_orderpriority, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderstatus = 'F' AND (contains(lower(o_orderpriority), 'urg') OR contains(o_orderkey::VARCHAR, 'urg')) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40",
    "task_count": "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority ILIKE '%urg%'",
    "active_parent_join": "SELECT o_orderpriority, count(*) AS children, count(DISTINCT l_orderkey) AS parents FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY o_orderpriority",
    "event_sequence": f"WITH {SEQ} SELECT key, event_id, sequence FROM seq",
    "events_after_cursor": f"""WITH {SEQ}, c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sequence) AS n FROM seq WHERE sequence > greatest(key % 5, CASE WHEN key % 3 = 0 THEN 4 ELSE 0 END)) SELECT key, sequence, event_id FROM c WHERE n <= 3""",
    "latest_state": f"WITH {SEQ}, m AS (SELECT *, max(sequence) OVER (PARTITION BY key) AS top FROM seq) SELECT key, sequence, event_type, event_id FROM m WHERE sequence = top",
    "until_terminal": f"WITH {SEQ}, e AS (SELECT key, min(sequence) AS stop FROM seq WHERE event_type = 'error' GROUP BY key) SELECT s.key, count(*) AS shown, max(sequence) AS last FROM seq s LEFT JOIN e USING (key) WHERE stop IS NULL OR sequence <= stop GROUP BY s.key",
    "stale_keys": f"WITH {SEQ}, m AS (SELECT *, max(sequence) OVER (PARTITION BY key) AS top FROM seq) SELECT key, sequence, event_type FROM m WHERE sequence = top AND event_type <> 'error' AND ts <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
    "trace_rollup": """SELECT event_type AS stage, count(*) AS calls, round(sum(CASE WHEN user_id % 4 = 0 THEN 0 ELSE value END)::DOUBLE, 6) AS duration_ms, sum(event_id % 1000)::BIGINT AS input_tokens, sum(event_id % 77)::BIGINT AS output_tokens,
round_even((sum(event_id % 1000)::DOUBLE * 0.4::DOUBLE + sum(event_id % 77)::DOUBLE * 1.2::DOUBLE) / 1e6, 8) AS cost_usd FROM events GROUP BY event_type""",
    "usage_deltas": f"WITH {SEQ} SELECT key, sequence, (3 * event_id - coalesce(lag(3 * event_id) OVER (PARTITION BY key ORDER BY sequence), 0))::BIGINT AS tokens FROM seq",
    "json_props": """WITH k AS (SELECT event_type, unnest(json_keys(props)) AS k, props FROM events) SELECT event_type, k, count(*) AS n, sum(json_extract_string(props, '$.' || k)::BIGINT)::BIGINT AS total FROM k WHERE NOT regexp_matches(lower(k), 'token|secret|password') GROUP BY ALL""",
    "sse_round_trip": f"WITH {SEQ} SELECT key, sequence, event_type AS event, coalesce(props, '') AS data FROM seq",
    "lenient_json": """SELECT conv_id, turn, '{"text":' || to_json(coalesce(text, ''))::VARCHAR || ',"turn":' || turn || '}' AS parsed FROM conversations""",
    "request_validation": """WITH m AS (SELECT conv_id || '-' || turn AS key, CASE WHEN turn % 3 <> 0 THEN turn END AS a, CASE WHEN turn % 4 <> 0 THEN 3 END AS b FROM conversations)
SELECT key, 'paired_bounds' AS rule FROM m WHERE (a IS NULL) <> (b IS NULL) UNION ALL SELECT key, 'ordered_bounds' FROM m WHERE a > b""",
    "expired_files": f"WITH {TASKS} SELECT task_id, dedup_key FROM t WHERE status = 'completed' AND created_at <= TIMESTAMP '1997-12-02 00:00:00' AND task_id % 7 <> 0",
    "active_duplicates": f"WITH {TASKS}, r AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY created_at DESC, task_id DESC) AS k FROM t WHERE status <> 'completed' AND task_id % 11 <> 0) SELECT dedup_key, task_id, status FROM r WHERE k = 1",
    "checkpoint_upsert": "SELECT l_orderkey AS task_id, l_linenumber::BIGINT AS step, (1 + l_linenumber % 2)::BIGINT AS version, round(max(l_quantity) + l_linenumber % 2, 2) AS state FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "cascade_delete": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 11 = 0) GROUP BY l_returnflag",
    "state_transitions": f"WITH {TASKS} SELECT CASE WHEN status = 'pending' THEN 'running' ELSE status END AS status, status = 'pending' AS changed, count(*) AS n, count(*) FILTER (status = 'pending') AS attempts FROM t GROUP BY ALL",
}
