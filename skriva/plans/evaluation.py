"""Queries of the retrieval evaluation. A question's gold chunks are those that hold its whole text; half of the questions have none."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate as E
from ..operators import retrieval as R
from ..session import table, written
from .documents import chunks
from .ranking import FLAT, TOKENS, indexed, lexical, questions


def gold(spark, sf_dir):
    """(query_id, relevant): chunks that contain the question.

    Of a question's inner terms the longest is its probe: a chunk that contains the question has that term as a word of its own,
    so the equi-join on the probe misses nothing, and only its hits are searched. Questions of fewer than three terms have none;
    these few are held against every chunk."""
    q = T.normalised(questions(spark, sf_dir).withColumn("n", F.col("query")), "n").withColumn("t", T.terms(F.col("n")))
    inner = F.when(F.size("t") >= 3, F.slice("t", 2, F.size("t") - 2))
    probe = F.aggregate(inner, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    q = q.select("query_id", "query", probe.alias("term"))
    c = chunks(spark, sf_dir).select("chunk_id", "text")
    # The questions are a stated set; their size decides whether they are broadcast.
    probed, short = q.where("term IS NOT NULL"), q.where("term IS NULL")
    hint = F.broadcast if R.fits(q, F.octet_length("query") + 64) else (lambda df: df)
    near = indexed(spark, sf_dir).select("chunk_id", F.explode("terms").alias("term")).join(hint(probed), "term").select("chunk_id", "query_id", "query")
    # The few chunks with a probe, measured, go to the texts, not all texts to them.
    near = written(near)
    some = F.broadcast(near) if R.fits(near, F.octet_length("query") + F.octet_length("chunk_id") + 64) else near
    hits = c.join(some, "chunk_id").where(F.contains("text", "query")).select("query_id", "chunk_id")
    found = hits
    if not short.isEmpty():
        found = hits.unionByName(c.join(hint(short), F.contains("text", "query")).select("query_id", "chunk_id"))
    return found.groupBy("query_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("relevant"))


def cases(spark, sf_dir):
    q = questions(spark, sf_dir).select("query_id", (F.length("query") > 200).alias("long_question"))
    return q.join(gold(spark, sf_dir), "query_id", "left").withColumn("half", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd"))


def _stored(spark, sf_dir):
    return lexical(spark, sf_dir, 20).where("score >= 25")


def observations(spark, sf_dir):
    return E.observations(cases(spark, sf_dir), _stored(spark, sf_dir))


def ir_metrics(spark, sf_dir):
    return E.metrics(observations(spark, sf_dir))


def ir_metrics_sliced(spark, sf_dir):
    return E.sliced(observations(spark, sf_dir), ["half", "long_question", "should_refuse"])


def latency_percentiles(spark, sf_dir):
    return E.latency(table(spark, sf_dir, "events"), "value", ["event_type"])


def evidence_coverage_any(spark, sf_dir):
    """Each gold chunk is a minimum evidence set of its own, and all of them together another."""
    o = observations(spark, sf_dir).where("NOT should_refuse")
    sets = F.concat(F.transform("relevant", lambda c: F.array(c)), F.array("relevant"))
    return o.select("query_id", E.any_set_covered(sets, F.col("top")).alias("covered"))


def set_f1(spark, sf_dir):
    o = observations(spark, sf_dir)
    return o.select("query_id", F.round(E.set_f1(F.col("top"), F.col("relevant")), 6).alias("set_f1"))


def token_f1(spark, sf_dir):
    top = _stored(spark, sf_dir).where("rank = 1").join(chunks(spark, sf_dir).select("chunk_id", "text"), "chunk_id")
    pairs = questions(spark, sf_dir).join(top.select("query_id", "text"), "query_id", "left")
    return E.token_f1(pairs, ["query_id"], "text", "query")


def _grid(spark):
    return spark.range(60).select(F.col("id").cast("int").alias("config"), (F.lit(20.0) + 5.0 * (F.col("id") % 10)).alias("min_score"), (F.lit(1) + F.floor(F.col("id") / 10)).cast("int").alias("top_k"))


def _replayed(spark, sf_dir):
    s = lexical(spark, sf_dir, 20).select("query_id", "chunk_id", "rank", "score")
    return E.replay(s, cases(spark, sf_dir).select("query_id", "relevant"), _grid(spark))


def grid_replay(spark, sf_dir):
    return _replayed(spark, sf_dir).select(F.col("config").cast("long").alias("config"), "recall_at_6", "precision_at_6", "noise_rate", "false_refusal_rate", "no_answer_refusal_rate")


def grid_replay_best(spark, sf_dir):
    best = E.best_config(_replayed(spark, sf_dir), [F.col("precision_at_6") + F.col("recall_at_6"), F.col("no_answer_refusal_rate"), -F.col("noise_rate")])
    return best.select(F.col("config").cast("long").alias("config"), "min_score", F.col("top_k").cast("long").alias("top_k"), "recall_at_6", "precision_at_6", "no_answer_refusal_rate")


def worst_fold(spark, sf_dir):
    """Metrics per fold of questions and depth; the worst of each depth."""
    o = observations(spark, sf_dir).withColumn("fold", F.col("query_id") % 4)
    deep = o.withColumn("config", F.lit(1)).unionByName(o.withColumn("config", F.lit(2)).withColumn("top", F.slice("top", 1, 2)))
    out = E.worst_fold(E.metrics(deep, ["config", "fold"]), ["recall_at_6", "mrr"], ["noise_rate", "false_refusal_rate"])
    return out.withColumn("config", F.col("config").cast("long"))


def gate_failures(spark, sf_dir):
    rules = {"recall": F.col("recall_at_6") >= 0.5, "noise": F.col("noise_rate") <= 0.5, "refusal": F.col("no_answer_refusal_rate") >= 0.9, "mrr": F.col("mrr") >= 0.99}
    out = E.gates(E.metrics(observations(spark, sf_dir), ["half"]), rules)
    return out.select("half", F.array_join("failures", ",").alias("failures"), "passed")


def threshold_midpoints(spark, sf_dir):
    s = lexical(spark, sf_dir, 3).withColumn("score", F.round("score", 1))
    return E.thresholds(s).select(F.round("threshold", 6).alias("threshold"))


def dataset_violations(spark, sf_dir):
    """Rules over labels joined to their documents."""
    from ..schemas import validate

    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), "doc_id", "left")
    return validate(j, {
        "document_exists": F.col("text").isNotNull(), "quality_is_binary": F.col("quality").isin(0, 1), "good_is_not_toxic": ~((F.col("quality") == 1) & (F.col("toxic") == 1)),
        "long_enough": F.col("n_chars") >= 100}, "doc_id")


def adjudicated_view(spark, sf_dir):
    """Reviewed documents with their decision, and per language how many still lack one (anti-join)."""
    d, r = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    done = d.join(r.where("toxic = 0"), "doc_id").groupBy("lang").agg(F.count("*").alias("reviewed"), F.sum("quality").cast("long").alias("accepted"))
    pending = d.join(r, "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("pending"))
    return done.join(pending, "lang", "full_outer").select("lang", F.coalesce("reviewed", F.lit(0)).alias("reviewed"), F.coalesce("accepted", F.lit(0)).alias("accepted"), F.coalesce("pending", F.lit(0)).alias("pending"))


def failure_attribution(spark, sf_dir):
    """AGG11: reasons of failed cases, by half."""
    m = E.case_metrics(observations(spark, sf_dir))
    reasons = F.array_compact(F.array(
        F.when(F.col("recall") < 1, "missed"), F.when(F.col("precision") < 0.5, "noisy"), F.when(F.col("should_refuse") & ~F.col("refused"), "answered_unanswerable"),
        F.when(~F.col("should_refuse") & F.col("refused"), "false_refusal")))
    return m.select("half", F.explode(reasons).alias("reason")).groupBy("half", "reason").agg(F.count("*").alias("n"))


def first_mode(spark, sf_dir):
    """AGG16: each source's most frequent language, the one of the smallest doc_id among equals."""
    out = E.first_mode(table(spark, sf_dir, "documents"), "source", "lang", "doc_id")
    return out.select("source", "lang", F.col("n"))


def _typed(spark, sf_dir):
    """Every document as a case; a paper holds the documents of a source whose numbers share a remainder."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    kind = F.element_at(F.array(*map(F.lit, E.TYPES)), (F.pmod(F.col("doc_id") * 7 + F.length("source"), F.lit(4)) + 1).cast("int"))
    return d.select(F.col("doc_id").alias("case_id"), F.concat_ws("-", "source", (F.col("doc_id") % 7).cast("string")).alias("paper_id"), kind.alias("answer_type"))


def pilot_sampling(spark, sf_dir):
    c = _typed(spark, sf_dir)
    return E.pilot_sample(c, c.groupBy("paper_id").agg((F.count("*") * 3).alias("chunks")), {"extractive": 9, "free_form": 8, "yes_no": 6, "unanswerable": 4}, 4)


def balanced_folds(spark, sf_dir):
    return E.balanced_folds(_typed(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    ir_metrics, ir_metrics_sliced, latency_percentiles, evidence_coverage_any, set_f1, token_f1, grid_replay, grid_replay_best, worst_fold,
    gate_failures, threshold_midpoints, dataset_violations, adjudicated_view, failure_attribution, first_mode, pilot_sampling,
)}
#: Cases that the tables cannot hold, or that one task or a stand-in for a service works on: run by the tests, not registered.
FIXED = {f.__name__: f for f in (
    balanced_folds,
)}

GOLD = FLAT + """,
gold AS (SELECT b.item_id AS query_id, list(c.chunk_id ORDER BY c.chunk_id) AS relevant FROM benchmark b JOIN chunks c ON contains(c.text, b.text) GROUP BY ALL),
cases AS (SELECT b.item_id AS query_id, coalesce(g.relevant, []) AS relevant, CASE WHEN b.item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS half, length(b.text) > 200 AS long_question FROM benchmark b LEFT JOIN gold g ON g.query_id = b.item_id),
stored AS (SELECT query_id, chunk_id, rank, score FROM lexical WHERE rank <= 20)"""


def _case_sql(ranks: str, source: str, keys: str = "") -> str:
    """Metrics per case from ranked rows: k is the depth."""
    return f"""SELECT c.query_id, c.half, c.long_question, len(c.relevant) AS n, len(c.relevant) = 0 AS should_refuse{keys},
  coalesce(count(s.chunk_id) FILTER (s.r <= {ranks}), 0) AS returned, coalesce(count(*) FILTER (s.r <= {ranks} AND list_contains(c.relevant, s.chunk_id)), 0) AS hits,
  coalesce(count(*) FILTER (list_contains(c.relevant, s.chunk_id)), 0) AS found, min(s.r) FILTER (s.r <= {ranks} AND list_contains(c.relevant, s.chunk_id)) AS first_hit FROM {source}"""


METRICS = """count(*) AS cases, round(coalesce(avg(CASE WHEN NOT should_refuse THEN hits::DOUBLE / n END), 0), 6) AS recall_at_6,
 round(coalesce(avg(CASE WHEN NOT should_refuse THEN coalesce(hits::DOUBLE / nullif(returned, 0), 0) END), 0), 6) AS precision_at_6,
 round(coalesce(avg(CASE WHEN NOT should_refuse THEN coalesce(1::DOUBLE / first_hit, 0) END), 0), 6) AS mrr,
 round(coalesce(avg(CASE WHEN NOT should_refuse THEN found::DOUBLE / n END), 0), 6) AS candidate_recall_at_20,
 round(coalesce(sum(CASE WHEN NOT should_refuse THEN hits END)::DOUBLE / nullif(sum(CASE WHEN NOT should_refuse THEN n END), 0), 0), 6) AS evidence_coverage,
 round(coalesce(sum(returned - hits)::DOUBLE / nullif(sum(returned), 0), 0), 6) AS noise_rate,
 round(coalesce(count(*) FILTER (should_refuse AND returned = 0)::DOUBLE / nullif(count(*) FILTER (should_refuse), 0), 0), 6) AS no_answer_refusal_rate,
 round(count(*) FILTER (NOT should_refuse AND returned = 0)::DOUBLE / greatest(count(*) FILTER (NOT should_refuse), 1), 6) AS false_refusal_rate, round(avg(returned)::DOUBLE, 6) AS average_returned"""
PER_CASE = GOLD + ", per_case AS (" + _case_sql("6", "cases c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM stored WHERE score >= 25) s USING (query_id) GROUP BY ALL") + ")"
REPLAYED = GOLD + """, grid AS (SELECT i AS config, 20::DOUBLE + 5 * (i % 10) AS min_score, 1 + i // 10 AS top_k FROM range(60) t(i)),
kept AS (SELECT g.config, s.*, row_number() OVER (PARTITION BY g.config, s.query_id ORDER BY s.rank) AS r FROM grid g JOIN stored s ON s.score >= g.min_score),
per_case AS (""" + _case_sql("g.top_k", "grid g CROSS JOIN cases c LEFT JOIN kept s ON s.config = g.config AND s.query_id = c.query_id GROUP BY ALL", ", g.config, g.min_score, g.top_k") + f"""),
replayed AS (SELECT config, min_score, top_k, {METRICS} FROM per_case GROUP BY ALL)"""
_SLICES = " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d}::VARCHAR AS slice, {METRICS} FROM per_case GROUP BY {d}" for d in ("half", "long_question", "should_refuse"))

ORACLES = {
    "ir_metrics": f"WITH {PER_CASE} SELECT {METRICS} FROM per_case",
    "ir_metrics_sliced": f"WITH {PER_CASE} SELECT 'all' AS dimension, 'all' AS slice, {METRICS} FROM per_case UNION ALL {_SLICES}",
    "latency_percentiles": "SELECT event_type, count(*) AS n, round(quantile_cont(value::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(value::DOUBLE, 0.95), 6) AS p95 FROM events GROUP BY event_type",
    "evidence_coverage_any": f"WITH {PER_CASE} SELECT query_id, hits > 0 AS covered FROM per_case WHERE NOT should_refuse",
    "set_f1": f"WITH {PER_CASE} SELECT query_id, round(CASE WHEN n = 0 AND returned = 0 THEN 1 ELSE 2::DOUBLE * hits / (n + returned) END, 6) AS set_f1 FROM per_case",
    "token_f1": f"""WITH {FLAT}, pairs AS (SELECT item_id AS query_id, b.text AS q, coalesce(c.text, '') AS p FROM benchmark b LEFT JOIN (SELECT * FROM lexical WHERE rank = 1 AND score >= 25) l ON l.query_id = b.item_id LEFT JOIN chunks c USING (chunk_id)),
toks AS (SELECT query_id, {TOKENS.format('q')} AS a, {TOKENS.format('p')} AS b FROM pairs),
ca AS (SELECT query_id, t, count(*) AS n FROM (SELECT query_id, unnest(a) AS t FROM toks) GROUP BY ALL), cb AS (SELECT query_id, t, count(*) AS n FROM (SELECT query_id, unnest(b) AS t FROM toks) GROUP BY ALL),
o AS (SELECT query_id, sum(least(ca.n, cb.n)) AS o FROM ca JOIN cb USING (query_id, t) GROUP BY query_id)
SELECT query_id, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 ELSE coalesce(2::DOUBLE * o / nullif(len(a) + len(b), 0), 0) END, 6) AS token_f1 FROM toks LEFT JOIN o USING (query_id)""",
    "grid_replay": f"WITH {REPLAYED} SELECT config, recall_at_6, precision_at_6, noise_rate, false_refusal_rate, no_answer_refusal_rate FROM replayed",
    "grid_replay_best": f"""WITH {REPLAYED} SELECT config, min_score, top_k, recall_at_6, precision_at_6, no_answer_refusal_rate FROM replayed ORDER BY precision_at_6 + recall_at_6 DESC, no_answer_refusal_rate DESC, noise_rate, config LIMIT 1""",
    "worst_fold": f"""WITH {GOLD}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM stored WHERE score >= 25), depth AS (SELECT 1::BIGINT AS config, 6 AS k UNION ALL SELECT 2, 2),
per_case AS ({_case_sql('d.k', 'depth d CROSS JOIN cases c LEFT JOIN top s ON s.query_id = c.query_id GROUP BY ALL', ', d.config, d.k, c.query_id % 4 AS fold')}), f AS (SELECT config, fold, {METRICS} FROM per_case GROUP BY ALL)
SELECT config, min(recall_at_6) AS recall_at_6, min(mrr) AS mrr, max(noise_rate) AS noise_rate, max(false_refusal_rate) AS false_refusal_rate FROM f GROUP BY config""",
    "gate_failures": f"""WITH {PER_CASE}, m AS (SELECT half, {METRICS} FROM per_case GROUP BY half),
g AS (SELECT half, list_filter([CASE WHEN recall_at_6 < 0.5 THEN 'recall' END, CASE WHEN noise_rate > 0.5 THEN 'noise' END, CASE WHEN no_answer_refusal_rate < 0.9 THEN 'refusal' END, CASE WHEN mrr < 0.99 THEN 'mrr' END], lambda x: x IS NOT NULL) AS f FROM m)
SELECT half, array_to_string(f, ',') AS failures, len(f) = 0 AS passed FROM g""",
    "threshold_midpoints": f"""WITH {FLAT}, s AS (SELECT DISTINCT round(score, 1) AS t FROM lexical WHERE rank <= 3), m AS (SELECT round((t + lead(t) OVER (ORDER BY t)) / 2, 9) AS t FROM s)
SELECT DISTINCT round(t, 6) AS threshold FROM (SELECT t FROM s UNION ALL SELECT t FROM m WHERE t IS NOT NULL)""",
    "dataset_violations": """WITH j AS (SELECT l.*, d.text, d.n_chars FROM labels l LEFT JOIN documents d USING (doc_id))
SELECT doc_id::VARCHAR AS key, 'document_exists' AS rule FROM j WHERE text IS NULL UNION ALL SELECT doc_id::VARCHAR, 'quality_is_binary' FROM j WHERE quality NOT IN (0, 1) OR quality IS NULL
UNION ALL SELECT doc_id::VARCHAR, 'good_is_not_toxic' FROM j WHERE quality = 1 AND toxic = 1 UNION ALL SELECT doc_id::VARCHAR, 'long_enough' FROM j WHERE n_chars < 100 OR n_chars IS NULL""",
    "adjudicated_view": """SELECT lang, count(*) FILTER (l.doc_id IS NOT NULL AND toxic = 0) AS reviewed, coalesce(sum(quality) FILTER (toxic = 0), 0)::BIGINT AS accepted, count(*) FILTER (l.doc_id IS NULL) AS pending
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang""",
    "failure_attribution": f"""WITH {PER_CASE}, r AS (SELECT half, unnest(list_filter([CASE WHEN NOT should_refuse AND hits < n THEN 'missed' END, CASE WHEN NOT should_refuse AND coalesce(hits::DOUBLE / nullif(returned, 0), 0) < 0.5 THEN 'noisy' END,
 CASE WHEN should_refuse AND returned > 0 THEN 'answered_unanswerable' END, CASE WHEN NOT should_refuse AND returned = 0 THEN 'false_refusal' END], lambda x: x IS NOT NULL)) AS reason FROM per_case)
SELECT half, reason, count(*) AS n FROM r GROUP BY ALL""",
    "first_mode": """WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS seen FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, seen) AS k FROM c)
SELECT source, lang, n FROM r WHERE k = 1""",
}
