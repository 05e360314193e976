"""Queries of evaluation reports and decisions. Labelled documents stand for cases, sources for papers; small tables that the driver's data cannot
give are written out once and used by query and twin alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import retrieval as R
from ..operators import review as V
from ..session import table, written
from .evaluation import GOLD, METRICS, _case_sql, cases, observations
from .literals import rows_of, values
from .ranking import FLAT, HASHED, hashed, lexical, questions

PAPERS = [("p1", "analysis", ["a", "b"], "s1", "s1"), ("p2", "analysis", ["c"], "s2", "s2"), ("p3", "validation", ["d", "e"], "s3", "x3"), ("p4", "test", ["f"], "s4", None), ("p4", "test", ["f"], "s4", "s4")]
PAPER = "paper_id string, split string, chunk_ids array<string>, state_sha256 string, found_sha256 string"
CASES = [
    ("c1", "p1", "analysis", "en", True, ["a"], [["a"], ["a", "b"]], "none", "reviewed", False), ("c2", "p1", "analysis", "zh", False, [], [], "near", "reviewed", False),
    ("c3", "p2", "validation", "en", True, ["c", "z"], [["y", "c"]], "none", "reviewed", False), ("c4", "p4", "test", "en", True, ["f"], [["f"]], "none", "reviewed", True),
    ("c5", "p4", "test", "en", True, ["f"], [["f"]], "none", "candidate", False), ("c6", "p9", "analysis", "en", True, [], [], "far", "reviewed", False), ("c1", "p3", "validation", "en", True, ["d"], [["d"]], "none", "reviewed", None)]
CASE = "id string, paper_id string, split string, language string, answerable boolean, relevant_chunk_ids array<string>, minimum_evidence_sets array<array<string>>, distractor_type string, review_status string, frozen boolean"
REQUIRED = ["near", "far", "swapped"]
POLICY = {"minimum_papers": 4, "minimum_cases": 8, "cases_per_paper": 1, "language_cases": 2, "split_tolerance": 0.15, "unanswerable": (0.15, 0.4), "multi_evidence_min": 0.5, "distractors": REQUIRED}


def _labelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    j = table(spark, sf_dir, "labels").join(d, "doc_id")
    split = F.when(F.col("doc_id") % 5 == 0, "validation").when(F.col("doc_id") % 5 == 1, "test").otherwise("analysis")
    return j.select(
        F.col("doc_id").alias("case_id"), F.col("source").alias("paper_id"), F.col("lang").alias("language"), split.alias("split"), F.when(F.col("doc_id") % 7 == 0, "candidate").otherwise("reviewed").alias("review_status"),
        (F.col("quality") == 1).alias("answerable"), F.col("n_chars").cast("double").alias("latency_ms"), "toxic")


def eligible_cases(spark, sf_dir):
    return V.eligible(_labelled(spark, sf_dir), "validation").select("case_id", "paper_id")


def unused_versions(spark, sf_dir):
    """FLT24: validation cases whose paper was not used by a test case yet."""
    c = _labelled(spark, sf_dir)
    used = c.where("split = 'test' AND case_id % 3 = 0").select("paper_id")
    return V.unused(c.where("split = 'validation'"), used, ["paper_id"]).select("case_id", "paper_id")


def dataset_ratios(spark, sf_dir):
    return V.split_ratios(rows_of(spark, PAPERS, PAPER), rows_of(spark, CASES, CASE))


def paper_languages(spark, sf_dir):
    return V.language_counts(_labelled(spark, sf_dir))


def invalid_references(spark, sf_dir):
    out = V.invalid_references(rows_of(spark, CASES, CASE), rows_of(spark, PAPERS, PAPER))
    return out.select("id", F.array_join("invalid", ",").alias("invalid"))


def missing_distractors(spark, sf_dir):
    return V.missing_distractors(rows_of(spark, CASES, CASE), REQUIRED)


def dataset_rules(spark, sf_dir):
    return V.violations(rows_of(spark, PAPERS, PAPER), rows_of(spark, CASES, CASE), POLICY)


def _runs(spark, sf_dir):
    """Every labelled case under two scenarios."""
    c = _labelled(spark, sf_dir).select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("scenario")) for i, s in ((1, "bm25"), (2, "hybrid"))])).alias("x")).select("*", "x.*")
    n = F.col("case_id") + 3 * F.col("i")
    yes = F.col("answerable")
    kind = F.when(~yes, "unanswerable").when(n % 3 == 0, "extractive").when(n % 3 == 1, "yes_no").otherwise("free_form")
    reason = F.when(n % 4 == 0, "answerability_threshold").when(n % 6 == 1, "evidence_filter_empty")
    return c.select(
        "scenario", "case_id", "answerable", kind.alias("answer_type"), reason.alias("refusal_reason"), reason.isNotNull().alias("refused"), F.when(yes, (n % 11) / 10).alias("recall"), F.when(yes, (n % 7) / 6).alias("precision"),
        F.when(yes, 1 / (1 + n % 4)).alias("mrr"), ((n % 9) / 8).alias("token_f1"), (F.col("latency_ms") / F.col("i")).alias("latency_ms"), F.when(n % 13 == 0, "timeout").when(n % 17 == 0, "index").alias("degraded_reason"),
        F.when(n % 13 == 0, "bm25").otherwise(F.col("scenario")).alias("effective_mode"))


def scenario_summary(spark, sf_dir):
    out = V.scenario_summary(_runs(spark, sf_dir))
    return out.select(*[c for c in out.columns if c not in ("effective_modes", "degraded_reasons")], F.array_join("effective_modes", ",").alias("effective_modes"), F.array_join("degraded_reasons", ",").alias("degraded_reasons"))


def scenario_failures(spark, sf_dir):
    return V.failed_cases(_runs(spark, sf_dir))


def answer_quality(spark, sf_dir):
    return V.answer_quality(_runs(spark, sf_dir))


def candidate_totals(spark, sf_dir):
    """AGG10 over BM25 and hashed vectors with a threshold."""
    b, v = lexical(spark, sf_dir, 20), written(R.ranked(hashed(spark, sf_dir), 20))
    kept = R.positive(v, 0.6)
    count = lambda df, n: df.groupBy("query_id").agg(F.count("*").alias(n))
    fused = R.rrf([b, R.ranked(kept.drop("rank"))])
    j = questions(spark, sf_dir).select("query_id")
    for df, n in ((b, "bm25"), (v, "vector_raw"), (kept, "vector_filtered"), (fused, "rrf")):
        j = j.join(count(df, n), "query_id", "left").withColumn(n, F.coalesce(n, F.lit(0)))
    return V.candidate_totals(j.withColumn("vector_removed", F.col("vector_raw") - F.col("vector_filtered")))


def index_stats(spark, sf_dir):
    """Events as loads of an index."""
    e = table(spark, sf_dir, "events")
    return V.index_stats(e.select(
        F.when(F.col("event_type") == "click", F.col("value")).otherwise(0.0).alias("build_ms"), F.col("value").alias("load_ms"), (F.col("event_id") % 3 == 0).alias("cache_hit"),
        (F.col("event_id") % 5 < 2).alias("memory_cache_hit"), (F.col("event_type") == "error").alias("cold_build_failed")))


SCENARIOS = ["bm25", "vector", "rrf", "reranker"]


def confidences(spark, sf_dir):
    """AGG28: the best score of every question, on the scale of each scenario."""
    top = lexical(spark, sf_dir, 1).select("query_id", F.round("score", 6).alias("score"))
    s = questions(spark, sf_dir).select("query_id").join(top, "query_id", "left").select("query_id", "score", F.explode(F.array(*map(F.lit, SCENARIOS))).alias("scenario"))
    score = F.when(F.col("scenario").isin("bm25", "reranker"), F.col("score")).otherwise(F.col("score") / 1000)
    return s.select("query_id", "scenario", F.round(V.confidence(F.col("scenario"), score), 6).alias("confidence"))


def call_stats(spark, sf_dir):
    """AGG30: events as calls of up to three attempts."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("schema"), F.col("event_id").alias("call_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("attempt"))
    # The call succeeds at attempt event_id % 5 (0 at the first, 4 never).
    good = F.greatest(F.col("call_id") % 5, F.lit(1))
    return V.call_stats(e.where(F.col("attempt") <= good).withColumn("ok", F.col("attempt") == good))


def production_mode(spark, sf_dir):
    """AGG31: depth 1 stands for the reranked run, depths 2 and 6 for the others, by halves of the questions."""
    o = observations(spark, sf_dir)
    runs = [o.withColumn("scenario", F.lit(n)).withColumn("top", F.slice("top", 1, k)) for n, k in (("one", 1), ("two", 2), ("six", 6))]
    m = E.metrics(runs[0].unionByName(runs[1]).unionByName(runs[2]), ["scenario"])
    g = E.gates(m, {"recall": F.col("recall_at_6") >= 0.3, "noise": F.col("noise_rate") <= 0.9})
    return V.production_mode(g.withColumn("reranked", F.col("scenario") == "one"))


def _folded(spark, sf_dir):
    """Metrics of each depth, over all questions and as the worst of four folds."""
    o = observations(spark, sf_dir).withColumn("fold", F.col("query_id") % 4)
    deep = o.select("*", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("config")).withColumn("top", F.slice("top", 1, F.col("config")))
    worst = E.worst_fold(E.metrics(deep, ["config", "fold"]), ["recall_at_6", "mrr"], ["noise_rate"])
    worst = worst.select("config", F.col("recall_at_6").alias("worst_recall"), F.col("noise_rate").alias("worst_noise"))
    return E.metrics(deep, ["config"]).select("config", "recall_at_6", "precision_at_6").join(worst, "config")


def config_selection(spark, sf_dir):
    c = _folded(spark, sf_dir).withColumn("retrieval_passed", F.col("recall_at_6") >= 0.2).withColumn("folds_passed", (F.col("worst_recall") >= 0.1) & (F.col("worst_noise") <= 0.8))
    out = V.select_config(c, [F.col("worst_recall"), F.col("precision_at_6")])
    return out.select(F.col("config").cast("long").alias("config"), "recall_at_6", "worst_recall", "retrieval_qualified", "folds_qualified", "fallback_used")


def config_fallback(spark, sf_dir):
    """The same where no configuration passes the gate of the folds."""
    c = _folded(spark, sf_dir).withColumn("retrieval_passed", F.col("recall_at_6") >= 0.2).withColumn("folds_passed", F.col("worst_recall") > 1)
    out = V.select_config(c, [F.col("worst_recall"), F.col("precision_at_6")])
    return out.select(F.col("config").cast("long").alias("config"), "recall_at_6", "worst_recall", "retrieval_qualified", "folds_qualified", "fallback_used")


def failure_counters(spark, sf_dir):
    """AGG11 over the runs of labelled cases: five dimensions."""
    r = _runs(spark, sf_dir).join(_labelled(spark, sf_dir).select("case_id", "paper_id", "language"), "case_id")
    reasons = F.array_compact(F.array(
        F.when(F.col("answerable") & (F.col("recall") == 0), "relevant_evidence_missed"), F.when(F.col("answerable") & F.col("refused"), "false_refusal"), F.when(~F.col("answerable") & ~F.col("refused"), "no_answer_not_refused")))
    r = r.withColumn("reasons", reasons).withColumn("answerability", F.when(F.col("answerable"), "answerable").otherwise("unanswerable")).withColumn("distractor_type", F.col("answer_type"))
    return V.failure_counters(r, ["paper_id", "language", "answerability", "distractor_type"])


def score_boundaries(spark, sf_dir):
    """WIN11 with deciles."""
    s = lexical(spark, sf_dir, 3).withColumn("score", F.round("score", 1))
    return V.boundaries(s, [0.0, 25.0]).select(F.round("threshold", 6).alias("threshold"))


FIELDS = [("p1", "title", ["Untitled"], "pdf", 0.9), ("p1", "authors", [], "text", 0.5), ("p1", "doi", ["10.1/a"], "text", 0.96), ("p1", "year", ["1999"], "text", 0.62), ("p2", "title", ["Deep Maps"], "layout", 0.82), ("p2", "venue", ["Old"], "text", 0.9),
          ("p3", "title", ["A B"], "pdf", 0.9), ("p4", "title", ["Maps of Ann Lee"], "pdf", 0.9)]
FIELD = "paper_id string, field string, values array<string>, source string, confidence double"
PROPOSALS = [("p1", "title", ["Ranking Long Texts"], 0.8), ("p1", "authors", ["Ann Lee", "Bo Ek"], 0.99), ("p1", "doi", ["10.2/b"], 0.9), ("p1", "year", ["2021"], 0.7), ("p2", "title", ["Invented Heading Words"], 0.9), ("p2", "venue", ["NEW Conf"], 0.6),
             ("p2", "keywords", ["maps"], None), ("p3", "authors", ["Dept of X University"], 0.9), ("p3", "title", ["arXiv: 2101"], 0.9), ("p4", "authors", ["Ann Lee"], 0.9), ("p4", "abstract", [], 0.9)]
PROPOSAL = "paper_id string, field string, values array<string>, confidence double"
ATTESTED = [("p1", "Ranking long texts\nAnn Lee, Bo Ek"), ("p2", "Deep maps new conf"), ("p3", "Dept of X University arXiv: 2101"), ("p4", "Maps of Ann Lee")]
#: What the rules give, case by case.
ADJUDICATED = [
    ("p1", "authors", "Ann Lee|Bo Ek", "llm", 0.85), ("p1", "doi", "10.1/a", "text", 0.96), ("p1", "title", "Ranking Long Texts", "llm", 0.8), ("p1", "year", "2021", "llm", 0.7), ("p2", "keywords", "maps", "llm", 0.6), ("p2", "title", "Deep Maps", "layout", 0.82),
    ("p2", "venue", "Old", "text", 0.9), ("p3", "authors", None, None, None), ("p3", "title", "A B", "pdf", 0.9), ("p4", "abstract", None, None, None), ("p4", "authors", None, None, None), ("p4", "title", "Maps of Ann Lee", "pdf", 0.9)]


def metadata_adjudication(spark, sf_dir):
    out = V.adjudicated(rows_of(spark, FIELDS, FIELD), rows_of(spark, PROPOSALS, PROPOSAL), rows_of(spark, ATTESTED, "paper_id string, text string"))
    return out.select("paper_id", "field", F.array_join("values", "|").alias("value"), "source", "confidence")


PARAGRAPHS = [("p1", "a", 1, "One  text"), ("p1", "b", 2, "Twice"), ("p1", "c", 3, "Twice"), ("p1", "d", 4, "Thrice"), ("p1", "e", 5, "Thrice"), ("p1", "f", 6, "Thrice"), ("p1", "g", 7, " "), ("p2", "h", 1, "One text")]


def _answer(evidence=(), spans=(), free="", yes=None, none=False):
    return (none, list(spans), free, yes, list(evidence))


ASKED = [
    ("p1", "q1", " What  now?", [_answer(["One text"], spans=["s", " s "]), _answer(["One text", "Twice", "Twice"], free="f")]), ("p1", "q2", "Q", [_answer(none=True), _answer(none=True)]), ("p1", "q3", "Q", [_answer(none=True), _answer(["One text"], yes=True)]),
    ("p1", "q4", "Q", [_answer(["float selected: Figure 1"], yes=False)]), ("p1", "q5", "Q", [_answer(["Twice"], free="x")]), ("p1", "q6", "Q", [_answer(["Nowhere"], free="x")]), ("p1", "q7", "Q", [_answer([" "], free="x")]), ("p1", "q8", " ", [_answer(["One text"], free="x")]),
    ("p1", "q9", "Q", []), ("p1", "q10", "Q", [_answer(["One text", "One text"], free="x")]), ("p1", "q11", "Q", [_answer(["Thrice"] * 3 + ["One text"], yes=True), _answer(["One text"], yes=True), _answer(["One text"], free="z")]), ("p2", "q12", "Q", [_answer(["Twice"], free="x")])]
ANSWERED = "paper_id string, question_id string, question string, annotations array<struct<unanswerable:boolean,extractive_spans:array<string>,free_form_answer:string,yes_no:boolean,evidence:array<string>>>"
#: What the rules give, question by question.
ADAPTED = [
    ("q1", None, "extractive", "a;a,b,c", "s|f"), ("q2", None, "unanswerable", "", ""), ("q3", "answerability_disagreement", None, None, None), ("q4", "figure_or_table", None, None, None), ("q5", "ambiguous_duplicate_evidence", None, None, None),
    ("q6", "unmapped_evidence", None, None, None), ("q7", "missing_evidence", None, None, None), ("q8", "blank_question", None, None, None), ("q9", "missing_annotations", None, None, None), ("q10", "unmapped_evidence", None, None, None),
    ("q11", None, "yes_no", "d,e,f,a;a;a", "yes|z"), ("q12", "unmapped_evidence", None, None, None)]


def _adapted(spark):
    return V.adapted_cases(rows_of(spark, ASKED, ANSWERED), rows_of(spark, PARAGRAPHS, "paper_id string, chunk_id string, place int, text string"))


def adapted_cases(spark, sf_dir):
    """AGG16, AGG22, AGG24, JN13 on questions of every kind."""
    return _adapted(spark).select("question_id", "reason", "answer_type", F.array_join(F.transform("minimum_sets", lambda x: F.array_join(x, ",")), ";").alias("sets"), F.array_join("gold_answers", "|").alias("gold"))


def exclusion_counts(spark, sf_dir):
    return V.exclusions(_adapted(spark))


QUERIES = {f.__name__: f for f in (
    eligible_cases, unused_versions, paper_languages, scenario_summary, scenario_failures, answer_quality, candidate_totals, index_stats, confidences,
    call_stats, production_mode, config_selection, config_fallback, failure_counters, score_boundaries,
)}
#: Cases that the tables cannot hold, or that one task or a stand-in for a service works on: run by the tests, not registered.
FIXED = {f.__name__: f for f in (
    dataset_ratios, invalid_references, missing_distractors, dataset_rules, metadata_adjudication, adapted_cases, exclusion_counts,
)}

LABELLED = """labelled AS (SELECT l.doc_id AS case_id, d.source AS paper_id, d.lang AS language, CASE l.doc_id % 5 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'analysis' END AS split,
  CASE WHEN l.doc_id % 7 = 0 THEN 'candidate' ELSE 'reviewed' END AS review_status, l.quality = 1 AS answerable, d.n_chars::DOUBLE AS latency_ms FROM labels l JOIN documents d USING (doc_id))"""
RUNS = LABELLED + """,
numbered AS (SELECT *, case_id + 3 * i AS n FROM labelled CROSS JOIN (VALUES (1, 'bm25'), (2, 'hybrid')) s(i, scenario)),
runs AS (SELECT scenario, case_id, paper_id, language, answerable, CASE WHEN NOT answerable THEN 'unanswerable' WHEN n % 3 = 0 THEN 'extractive' WHEN n % 3 = 1 THEN 'yes_no' ELSE 'free_form' END AS answer_type,
  CASE WHEN n % 4 = 0 THEN 'answerability_threshold' WHEN n % 6 = 1 THEN 'evidence_filter_empty' END AS refusal_reason, n % 4 = 0 OR n % 6 = 1 AS refused, CASE WHEN answerable THEN (n % 11) / 10.0::DOUBLE END AS recall,
  CASE WHEN answerable THEN (n % 7) / 6.0::DOUBLE END AS prec, CASE WHEN answerable THEN 1::DOUBLE / (1 + n % 4) END AS mrr, (n % 9) / 8.0::DOUBLE AS token_f1, latency_ms / i AS latency_ms,
  CASE WHEN n % 13 = 0 THEN 'timeout' WHEN n % 17 = 0 THEN 'index' END AS degraded_reason, CASE WHEN n % 13 = 0 THEN 'bm25' ELSE scenario END AS effective_mode FROM numbered)"""
P_, C_ = values(PAPERS, PAPER, "papers"), values(CASES, CASE, "cases")
USED = "list_distinct(relevant_chunk_ids || flatten(minimum_evidence_sets))"
RATIOS = f"""p AS (SELECT count(*) AS papers, {', '.join(f"round(avg((split = '{s}')::INT), 6) AS {s}_ratio" for s in V.SPLITS)} FROM papers),
r AS (SELECT count(*) AS reviewed, round(avg((NOT answerable)::INT), 6) AS unanswerable_ratio, round(avg((len(list_filter(minimum_evidence_sets, lambda g: len(g) > 1)) > 0)::INT), 6) AS multi_evidence_ratio FROM cases WHERE review_status = 'reviewed')"""
_DEPTHS = GOLD + ", top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM stored WHERE score >= 25)"
_FOLDED = f"""{_DEPTHS}, depth AS (SELECT i AS config, i AS k FROM range(1, 7) t(i)), per_case AS ({_case_sql('d.k', 'depth d CROSS JOIN cases c LEFT JOIN top s ON s.query_id = c.query_id GROUP BY ALL', ', d.config, d.k, c.query_id % 4 AS fold')}),
whole AS (SELECT config, {METRICS} FROM per_case GROUP BY config), folds AS (SELECT config, fold, {METRICS} FROM per_case GROUP BY ALL),
worst AS (SELECT config, min(recall_at_6) AS worst_recall, max(noise_rate) AS worst_noise FROM folds GROUP BY config),
m AS (SELECT config, recall_at_6, precision_at_6, worst_recall, worst_noise FROM whole JOIN worst USING (config))"""


def _selection(folds_passed: str) -> str:
    return f"""WITH {_FOLDED}, g AS (SELECT *, recall_at_6 >= 0.2 AS a, {folds_passed} AS b FROM m), n AS (SELECT count(*) FILTER (a) AS retrieval_qualified, count(*) FILTER (a AND b) AS folds_qualified FROM g)
SELECT config, recall_at_6, worst_recall, retrieval_qualified, folds_qualified, folds_qualified = 0 AS fallback_used FROM g CROSS JOIN n
ORDER BY CASE WHEN a AND b THEN 2 WHEN a THEN 1 ELSE 0 END DESC, worst_recall DESC, precision_at_6 DESC, config LIMIT 1"""


ORACLES = {
    "eligible_cases": f"WITH {LABELLED} SELECT case_id, paper_id FROM labelled WHERE split = 'validation' AND review_status = 'reviewed'",
    "unused_versions": f"WITH {LABELLED} SELECT case_id, paper_id FROM labelled WHERE split = 'validation' AND paper_id NOT IN (SELECT paper_id FROM labelled WHERE split = 'test' AND case_id % 3 = 0 AND paper_id IS NOT NULL)",
    "dataset_ratios": f"WITH {P_}, {C_}, {RATIOS} SELECT * FROM p CROSS JOIN r",
    "paper_languages": f"WITH {LABELLED} SELECT paper_id, language, count(*) AS cases FROM labelled WHERE review_status = 'reviewed' GROUP BY ALL",
    "invalid_references": f"""WITH {P_}, {C_}, u AS (SELECT c.id, c.paper_id, unnest({USED}) AS x, row_number() OVER () AS k FROM cases c),
b AS (SELECT u.id, p.state_sha256, p.found_sha256, u.k, u.x FROM u JOIN papers p ON p.paper_id = u.paper_id WHERE NOT list_contains(p.chunk_ids, u.x)) SELECT id, string_agg(x, ',' ORDER BY x) AS invalid FROM b GROUP BY id, state_sha256, found_sha256""",
    "missing_distractors": f"WITH {C_} SELECT unnest(['near', 'far', 'swapped']) AS distractor_type EXCEPT SELECT distractor_type FROM cases WHERE review_status = 'reviewed'",
    "dataset_rules": f"""WITH {P_}, {C_}, {RATIOS}, n AS (SELECT count(*) FILTER (language = 'zh') AS zh, count(*) FILTER (language = 'en') AS en FROM cases WHERE review_status = 'reviewed')
SELECT paper_id AS key, 'paper_id_unique' AS rule FROM papers GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT id, 'case_id_unique' FROM cases GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT id, 'paper_exists' FROM cases WHERE paper_id NOT IN (SELECT paper_id FROM papers) UNION ALL SELECT c.id, 'split_of_paper' FROM cases c JOIN papers p USING (paper_id) WHERE c.split <> p.split
UNION ALL SELECT id, 'test_case_frozen' FROM cases WHERE split = 'test' AND NOT coalesce(frozen, false)
UNION ALL SELECT c.id, 'chunks_of_paper' FROM cases c JOIN papers p USING (paper_id) WHERE len(list_filter({USED}, lambda x: NOT list_contains(p.chunk_ids, x))) > 0
UNION ALL SELECT paper_id, 'state_exists' FROM papers WHERE found_sha256 IS NULL UNION ALL SELECT paper_id, 'state_digest' FROM papers WHERE found_sha256 <> state_sha256 UNION ALL SELECT 'swapped', 'distractor_present'
UNION ALL SELECT p.paper_id, 'cases_per_paper' FROM (SELECT DISTINCT paper_id FROM papers) p LEFT JOIN cases c ON c.paper_id = p.paper_id AND c.review_status = 'reviewed' GROUP BY p.paper_id HAVING count(c.id) <> 1
UNION ALL SELECT 'dataset', x FROM (SELECT unnest([CASE WHEN papers < 4 THEN 'minimum_papers' END, CASE WHEN reviewed < 8 THEN 'minimum_cases' END, CASE WHEN abs(analysis_ratio - 0.6) > 0.15 THEN 'split_analysis' END,
  CASE WHEN abs(validation_ratio - 0.2) > 0.15 THEN 'split_validation' END, CASE WHEN abs(test_ratio - 0.2) > 0.15 THEN 'split_test' END, CASE WHEN unanswerable_ratio NOT BETWEEN 0.15 AND 0.4 THEN 'unanswerable_ratio' END,
  CASE WHEN multi_evidence_ratio < 0.5 THEN 'multi_evidence_ratio' END, CASE WHEN zh < 2 THEN 'language_zh' END, CASE WHEN en < 2 THEN 'language_en' END]) AS x FROM p CROSS JOIN r CROSS JOIN n) WHERE x IS NOT NULL""",
    "scenario_summary": f"""WITH {RUNS} SELECT scenario, count(*) AS case_count, round(coalesce(avg(recall), 0), 6) AS recall_at_6, round(coalesce(avg(prec), 0), 6) AS precision_at_6, round(coalesce(avg(mrr), 0), 6) AS mrr,
 round(coalesce(avg(refused::INT) FILTER (NOT answerable), 0), 6) AS unanswerable_refusal_rate, round(coalesce(avg(refused::INT) FILTER (answerable), 0), 6) AS answerable_false_refusal_rate,
 round(avg((coalesce(refusal_reason, '') = 'answerability_threshold')::INT), 6) AS answerability_refusal_rate, round(avg((coalesce(refusal_reason, '') = 'evidence_filter_empty')::INT), 6) AS evidence_empty_rate,
 round(avg(token_f1), 6) AS answer_token_f1, round(quantile_cont(latency_ms, 0.5), 6) AS latency_p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95_ms, round(avg((degraded_reason IS NOT NULL)::INT), 6) AS degradation_rate,
 count(*) FILTER (CASE WHEN answerable THEN recall < 1 ELSE NOT refused END) AS failures, string_agg(DISTINCT effective_mode, ',' ORDER BY effective_mode) AS effective_modes, coalesce(string_agg(DISTINCT degraded_reason, ',' ORDER BY degraded_reason), '') AS degraded_reasons FROM runs GROUP BY scenario""",
    "scenario_failures": f"WITH {RUNS} SELECT scenario, case_id FROM runs WHERE CASE WHEN answerable THEN recall < 1 ELSE NOT refused END",
    "answer_quality": f"WITH {RUNS} SELECT scenario, answer_type, count(*) AS cases, round(avg(token_f1), 6) AS token_f1 FROM runs GROUP BY ALL",
    "candidate_totals": f"""WITH {FLAT} {HASHED}, b AS (SELECT query_id, chunk_id FROM lexical WHERE rank <= 20), v AS (SELECT query_id, chunk_id, score FROM hashed WHERE rank <= 20)
SELECT (SELECT count(*) FROM b) AS bm25, (SELECT count(*) FROM v) AS vector_raw, (SELECT count(*) FROM v WHERE score >= 0.6) AS vector_filtered, (SELECT count(*) FROM v WHERE score < 0.6) AS vector_removed,
 (SELECT count(*) FROM (SELECT query_id, chunk_id FROM b UNION SELECT query_id, chunk_id FROM v WHERE score >= 0.6)) AS rrf""",
    "index_stats": """SELECT round(sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END), 3) AS build_ms, round(sum(value), 3) AS load_ms, round(avg((event_id % 3 = 0)::INT), 6) AS cache_hit_rate,
 round(avg((event_id % 5 < 2)::INT), 6) AS memory_cache_hit_rate, round(avg((event_type = 'error')::INT), 6) AS cold_build_failed_rate FROM events""",
    "confidences": f"""WITH {FLAT}, t AS (SELECT query_id, round(score, 6) AS s FROM lexical WHERE rank = 1), q AS (SELECT item_id AS query_id, coalesce(s, 0) AS s FROM benchmark LEFT JOIN t ON query_id = item_id)
SELECT query_id, 'bm25' AS scenario, round(s / (1 + s), 6) AS confidence FROM q UNION ALL SELECT query_id, 'vector', round(greatest(0, least(1, s / 1000)), 6) FROM q UNION ALL SELECT query_id, 'rrf', round(least(1, s / 1000 * 30.5), 6) FROM q
UNION ALL SELECT query_id, 'reranker', round(least(1, s), 6) FROM q""",
    "call_stats": """WITH c AS (SELECT event_type AS schema, greatest(event_id % 5, 1) AS good FROM events)
SELECT schema, count(*) AS calls, sum(least(good, 3))::BIGINT AS attempts, count(*) FILTER (good <= 3) AS successes, count(*) FILTER (good = 1) AS first_attempt_successes, count(*) FILTER (good IN (2, 3)) AS retried_calls, count(*) FILTER (good = 4) AS failures FROM c GROUP BY schema""",
    "production_mode": f"""WITH {_DEPTHS}, depth AS (SELECT * FROM (VALUES ('one', 1), ('two', 2), ('six', 6)) d(scenario, k)), per_case AS ({_case_sql('d.k', 'depth d CROSS JOIN cases c LEFT JOIN top s ON s.query_id = c.query_id GROUP BY ALL', ', d.scenario, d.k')}),
m AS (SELECT scenario, {METRICS} FROM per_case GROUP BY scenario), a AS (SELECT precision_at_6 AS p, recall_at_6 >= 0.3 AND noise_rate <= 0.9 AS ok FROM m WHERE scenario = 'one'),
b AS (SELECT scenario, precision_at_6 FROM m WHERE scenario <> 'one' ORDER BY precision_at_6 DESC, scenario DESC LIMIT 1)
SELECT scenario AS baseline, round(p - precision_at_6, 6) AS uplift, CASE WHEN round(p - precision_at_6, 6) >= 0.1 AND ok THEN 'enabled' ELSE 'disabled' END AS mode FROM a CROSS JOIN b""",
    "config_selection": _selection("worst_recall >= 0.1 AND worst_noise <= 0.8"),
    "config_fallback": _selection("worst_recall > 1"),
    "failure_counters": f"""WITH {RUNS}, r AS (SELECT *, list_filter([CASE WHEN answerable AND recall = 0 THEN 'relevant_evidence_missed' END, CASE WHEN answerable AND refused THEN 'false_refusal' END,
  CASE WHEN NOT answerable AND NOT refused THEN 'no_answer_not_refused' END], lambda x: x IS NOT NULL) AS reasons FROM runs), f AS (SELECT * FROM r WHERE len(reasons) > 0)
SELECT 'paper_id' AS dimension, paper_id AS value, count(*) AS n FROM f GROUP BY ALL UNION ALL SELECT 'language', language, count(*) FROM f GROUP BY ALL UNION ALL SELECT 'distractor_type', answer_type, count(*) FROM f GROUP BY ALL
UNION ALL SELECT 'answerability', CASE WHEN answerable THEN 'answerable' ELSE 'unanswerable' END, count(*) FROM f GROUP BY ALL UNION ALL SELECT 'failure_reason', x, count(*) FROM (SELECT unnest(reasons) AS x FROM f) GROUP BY ALL""",
    "score_boundaries": f"""WITH {FLAT}, s AS (SELECT DISTINCT round(score, 1) AS v FROM lexical WHERE rank <= 3), d AS (SELECT unnest(quantile_cont(v, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])) AS t FROM s UNION SELECT unnest([0::DOUBLE, 25])),
m AS (SELECT t, lead(t) OVER (ORDER BY t) AS u FROM d) SELECT DISTINCT round(t, 6) AS threshold FROM (SELECT t FROM d UNION SELECT (t + u) / 2 FROM m WHERE u IS NOT NULL)""",
    "adapted_cases": f"WITH {values(ADAPTED, 'question_id string, reason string, answer_type string, sets string, gold string', 'a')} SELECT * FROM a",
    "exclusion_counts": f"WITH {values(ADAPTED, 'question_id string, reason string, answer_type string, sets string, gold string', 'a')} SELECT reason, count(*) AS n FROM a WHERE reason IS NOT NULL GROUP BY reason",
    "metadata_adjudication": f"WITH {values(ADJUDICATED, 'paper_id string, field string, value string, source string, confidence double', 'a')} SELECT * FROM a",
}
