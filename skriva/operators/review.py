"""Evaluation reports and decisions: eligible cases, dataset rules, scenario summaries, selection under gates, metadata adjudication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import scans

SPLITS = {"analysis": 0.6, "validation": 0.2, "test": 0.2}
ANSWER_TYPES = ["extractive", "yes_no", "free_form", "unanswerable"]
# Words that no author's name holds; the fields that a model adjudicates.
NOT_NAMES = ["university", "department", "institute", "laboratory", "abstract", "@"]
ADJUDICATED = ["title", "authors", "venue"]


def eligible(cases: DataFrame, split: str) -> DataFrame:
    """FLT16: reviewed cases of a split. The test split is never read this way."""
    if split == "test":
        raise ValueError("the test split is read by the frozen test alone")
    return cases.where((F.col("split") == split) & (F.col("review_status") == "reviewed"))


def guarded(df: DataFrame, used: DataFrame, key: list[str], what: str) -> DataFrame:
    """FLT24: df, or an error if any of its keys is registered as used already."""
    if not used.join(df.select(*key).distinct(), key, "left_semi").isEmpty():
        raise ValueError(f"{what} may be used once")
    return df


def unused(df: DataFrame, used: DataFrame, key: list[str]) -> DataFrame:
    """FLT24 for many keys: the rows whose key is not registered."""
    return df.join(used.select(*key).distinct(), key, "left_anti")


# --- Datasets ------------------------------------------------------------------------------------------------------------


def split_ratios(papers: DataFrame, cases: DataFrame) -> DataFrame:
    """AGG17: one row: the share of papers per split, and of reviewed cases without an answer and with several pieces of evidence."""
    share = lambda c: F.coalesce(F.avg(c.cast("int")), F.lit(0.0))
    p = papers.agg(F.count("*").alias("papers"), *[F.round(share(F.col("split") == s), 6).alias(f"{s}_ratio") for s in SPLITS])
    multi = F.exists("minimum_evidence_sets", lambda g: F.size(g) > 1)
    c = cases.where("review_status = 'reviewed'").agg(
        F.count("*").alias("reviewed"), F.round(share(~F.col("answerable")), 6).alias("unanswerable_ratio"), F.round(share(multi), 6).alias("multi_evidence_ratio"))
    return p.crossJoin(c)  # one row each


def language_counts(cases: DataFrame) -> DataFrame:
    """AGG17: reviewed cases per paper and language."""
    return cases.where("review_status = 'reviewed'").groupBy("paper_id", "language").agg(F.count("*").alias("cases"))


def invalid_references(cases: DataFrame, papers: DataFrame) -> DataFrame:
    """SET4, JN12: (id, invalid): chunk ids that a case uses and its paper does not have, sorted."""
    used = F.array_distinct(F.concat("relevant_chunk_ids", F.flatten("minimum_evidence_sets")))
    j = cases.join(papers.select("paper_id", "chunk_ids"), "paper_id")
    return j.select("id", F.array_sort(F.array_except(used, "chunk_ids")).alias("invalid")).where(F.size("invalid") > 0)


def missing_distractors(cases: DataFrame, required: list[str]) -> DataFrame:
    """SET9: required kinds of distractors that no reviewed case has."""
    seen = cases.where("review_status = 'reviewed'").agg(F.collect_set("distractor_type").alias("seen"))  # at most the kinds there are
    return seen.select(F.explode(F.array_except(F.array(*map(F.lit, required)), F.coalesce("seen", F.array().cast("array<string>")))).alias("distractor_type"))


def violations(papers: DataFrame, cases: DataFrame, policy: dict) -> DataFrame:
    """FLT19: (key, rule), one row per violated rule; empty means valid. papers: (paper_id, split, chunk_ids, state_sha256, found_sha256); cases as
    schemas.CASE. policy: minimum_papers, minimum_cases, cases_per_paper, language_cases (least per language), split_tolerance,
    unanswerable (least, most), multi_evidence_min, distractors."""
    twice = lambda df, key, rule: df.groupBy(F.col(key).alias("key")).count().where("count > 1").select("key", F.lit(rule).alias("rule"))
    reviewed = cases.where("review_status = 'reviewed'")
    known = papers.select("paper_id", F.col("split").alias("paper_split"), F.lit(True).alias("known"))
    j = cases.join(known, "paper_id", "left")
    found = [
        twice(papers, "paper_id", "paper_id_unique"), twice(cases, "id", "case_id_unique"),
        j.where("known IS NULL").select(F.col("id").alias("key"), F.lit("paper_exists").alias("rule")),
        j.where("known AND NOT split <=> paper_split").select(F.col("id").alias("key"), F.lit("split_of_paper").alias("rule")),
        cases.where("split = 'test' AND NOT coalesce(frozen, false)").select(F.col("id").alias("key"), F.lit("test_case_frozen").alias("rule")),
        invalid_references(cases, papers).select(F.col("id").alias("key"), F.lit("chunks_of_paper").alias("rule")),
        papers.where("found_sha256 IS NULL").select(F.col("paper_id").alias("key"), F.lit("state_exists").alias("rule")),
        papers.where("found_sha256 <> state_sha256").select(F.col("paper_id").alias("key"), F.lit("state_digest").alias("rule")),
        missing_distractors(cases, policy["distractors"]).select(F.col("distractor_type").alias("key"), F.lit("distractor_present").alias("rule"))]
    per = papers.select("paper_id").distinct().join(reviewed.groupBy("paper_id").agg(F.count("*").alias("n")), "paper_id", "left")
    found.append(per.where(F.coalesce("n", F.lit(0)) != policy["cases_per_paper"]).select(F.col("paper_id").alias("key"), F.lit("cases_per_paper").alias("rule")))
    r = split_ratios(papers, cases).crossJoin(reviewed.agg(*[F.count_if(F.col("language") == x).alias(x) for x in ("zh", "en")]))
    low, high = policy["unanswerable"]
    rules = {
        "minimum_papers": F.col("papers") >= policy["minimum_papers"], "minimum_cases": F.col("reviewed") >= policy["minimum_cases"],
        **{f"split_{s}": F.abs(F.col(f"{s}_ratio") - share) <= policy["split_tolerance"] for s, share in SPLITS.items()},
        "unanswerable_ratio": F.col("unanswerable_ratio").between(low, high), "multi_evidence_ratio": F.col("multi_evidence_ratio") >= policy["multi_evidence_min"],
        **{f"language_{x}": F.col(x) >= policy["language_cases"] for x in ("zh", "en")}}
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(n)) for n, ok in rules.items()]))
    found.append(r.select(F.lit("dataset").alias("key"), F.explode(broken).alias("rule")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


# --- Reports of runs -----------------------------------------------------------------------------------------------------


def failed_cases(rows: DataFrame) -> DataFrame:
    """AGG9: (scenario, case_id) of answerable cases that miss evidence and unanswerable ones that were answered."""
    bad = F.when(F.col("answerable"), F.coalesce("recall", F.lit(0.0)) < 1).otherwise(~F.col("refused"))
    return rows.where(bad).select("scenario", "case_id")


def scenario_summary(rows: DataFrame) -> DataFrame:
    """AGG9: one row per scenario. rows: (scenario, case_id, answerable, refused, refusal_reason, recall, precision, mrr, token_f1, latency_ms,
    degraded_reason, effective_mode). Means skip nulls; of nothing they are 0."""
    yes, no, all_ = F.col("answerable"), ~F.col("answerable"), F.lit(True)
    mean = lambda c, who: F.round(F.coalesce(F.avg(F.when(who, c)), F.lit(0.0)), 6)
    flag = lambda c: c.cast("int")
    reason = lambda r, who: mean(flag(F.coalesce(F.col("refusal_reason") == r, F.lit(False))), who)
    failed = F.when(yes, F.coalesce("recall", F.lit(0.0)) < 1).otherwise(~F.col("refused"))
    ms = scans.quantiles(rows, ["scenario"], "latency_ms", {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95})
    ms = ms.select(F.col("scenario").alias("__scenario"), *[F.round(c, 6).alias(c) for c in ("latency_p50_ms", "latency_p95_ms")])
    out = rows.groupBy("scenario").agg(
        F.count("*").alias("case_count"), mean(F.col("recall"), yes).alias("recall_at_6"), mean(F.col("precision"), yes).alias("precision_at_6"), mean(F.col("mrr"), yes).alias("mrr"),
        mean(flag(F.col("refused")), no).alias("unanswerable_refusal_rate"), mean(flag(F.col("refused")), yes).alias("answerable_false_refusal_rate"),
        reason("answerability_threshold", all_).alias("answerability_refusal_rate"), reason("evidence_filter_empty", all_).alias("evidence_empty_rate"),
        mean(F.col("token_f1"), all_).alias("answer_token_f1"),
        mean(flag(F.col("degraded_reason").isNotNull()), all_).alias("degradation_rate"), F.count_if(failed).alias("failures"),
        F.array_sort(F.collect_set("effective_mode")).alias("effective_modes"), F.array_sort(F.collect_set("degraded_reason")).alias("degraded_reasons"))
    return out.join(ms, F.col("scenario").eqNullSafe(F.col("__scenario")), "left").drop("__scenario")


def answer_quality(rows: DataFrame) -> DataFrame:
    """AGG9: cases and mean token F1 per scenario and kind of answer."""
    return rows.where(F.col("answer_type").isin(ANSWER_TYPES)).groupBy("scenario", "answer_type").agg(F.count("*").alias("cases"), F.round(F.coalesce(F.avg("token_f1"), F.lit(0.0)), 6).alias("token_f1"))


def candidate_totals(counts: DataFrame) -> DataFrame:
    """AGG10: sums of the candidates that each step kept."""
    steps = ("bm25", "vector_raw", "vector_filtered", "vector_removed", "rrf")
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in steps])


def index_stats(rows: DataFrame) -> DataFrame:
    """AGG25: times of all indexes, and rates of the flags; of no rows 0."""
    rate = lambda c: F.round(F.coalesce(F.avg(F.col(c).cast("int")), F.lit(0.0)), 6)
    total = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 3)
    return rows.agg(total("build_ms").alias("build_ms"), total("load_ms").alias("load_ms"), *[rate(c).alias(f"{c}_rate") for c in ("cache_hit", "memory_cache_hit", "cold_build_failed")])


def confidence(scenario: Column, score: Column) -> Column:
    """AGG28: the first score of a ranking on a scale from 0 to 1; nothing found is 0."""
    s = F.coalesce(score, F.lit(0.0))
    return F.when(scenario.isin("bm25", "embedding_degraded"), s / (1 + s)).when(scenario == "vector", F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))).when(
        scenario.isin("rrf", "reranker_degraded"), F.least(F.lit(1.0), s * 30.5)).otherwise(F.least(F.lit(1.0), s))


def call_stats(attempts: DataFrame) -> DataFrame:
    """AGG30: per schema from one row per attempt (schema, call_id, attempt from 1, ok): calls, attempts, successes (how many at once, how many
    after a retry), failures."""
    calls = attempts.groupBy("schema", "call_id").agg(F.count("*").alias("tries"), F.max("ok").alias("ok"), F.min(F.when(F.col("ok"), F.col("attempt"))).alias("first"))
    return calls.groupBy("schema").agg(
        F.count("*").alias("calls"), F.sum("tries").alias("attempts"), F.count_if("ok").alias("successes"), F.count_if(F.col("first") == 1).alias("first_attempt_successes"),
        F.count_if(F.col("first") > 1).alias("retried_calls"), F.count_if(~F.col("ok")).alias("failures"))


def production_mode(reports: DataFrame, least: float = 0.10) -> DataFrame:
    """AGG31: (baseline, uplift, mode): reranking goes into production if its precision exceeds the best other scenario's by ``least`` and no gate
    fails. reports: (scenario, reranked, precision_at_6, failures)."""
    best = F.max_by(F.struct("scenario", "precision_at_6"), F.struct("precision_at_6", F.col("scenario")))
    r = reports.agg(F.max(F.when(F.col("reranked"), F.col("precision_at_6"))).alias("p"), F.max(F.when(F.col("reranked"), F.size("failures"))).alias("n"))
    b = reports.where("NOT reranked").agg(best.alias("b"))
    uplift = F.round(F.col("p") - F.col("b.precision_at_6"), 6)
    return r.crossJoin(b).select(F.col("b.scenario").alias("baseline"), uplift.alias("uplift"), F.when((uplift >= least) & (F.col("n") == 0), "enabled").otherwise("disabled").alias("mode"))


def select_config(configs: DataFrame, keys: list[Column]) -> DataFrame:
    """TOP12: the best of the pool that passes the retrieval gate and the gate of all folds; else of the first gate's pool; else of all. configs: (config,
    retrieval_passed, folds_passed, ...). Adds the pools' sizes and whether it fell back. One aggregate over all pools."""
    both = F.col("retrieval_passed") & F.col("folds_passed")
    pool = F.when(both, 2).when(F.col("retrieval_passed"), 1).otherwise(0)
    best = F.max_by(F.struct(*configs.columns), F.struct(pool, *keys, -F.col("config")))
    out = configs.agg(best.alias("b"), F.count_if("retrieval_passed").alias("retrieval_qualified"), F.count_if(both).alias("folds_qualified"))
    return out.select("b.*", "retrieval_qualified", "folds_qualified", (F.col("folds_qualified") == 0).alias("fallback_used"))


def failure_counters(cases: DataFrame, dimensions: list[str]) -> DataFrame:
    """AGG11: (dimension, value, n): failed cases by each dimension, and how often each reason holds. cases: (reasons array, dimensions)."""
    failed = cases.where(F.size("reasons") > 0)
    kinds = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    reasons = F.transform("reasons", lambda r: F.struct(F.lit("failure_reason").alias("dimension"), r.alias("value")))
    return failed.select(F.explode(F.concat(kinds, reasons)).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def boundaries(scores: DataFrame, fixed: list[float], value: str = "score") -> DataFrame:
    """WIN11: the fixed thresholds, the deciles of the observed distinct values, and the midpoints of neighbours. Deciles are selected by
    ranges; what is put in order here is at most eleven values and the fixed ones."""
    seen = scores.select(F.col(value).cast("double").alias("v")).where(~F.isnan("v") & (F.abs("v") < float("inf"))).distinct()
    tenths = scans.quantiles(seen, [], "v", {f"d{i}": i / 10 for i in range(11)}).select(F.array(*[f"d{i}" for i in range(11)]).alias("d"))
    # One row, also where nothing is observed.
    deciles = tenths.agg(F.first("d").alias("d"))
    all_ = F.array_sort(F.array_distinct(F.concat(F.array(*[F.lit(float(x)) for x in fixed]), F.coalesce("d", F.array().cast("array<double>")))))
    both = F.array_distinct(F.concat("a", F.transform(F.slice("a", 2, F.greatest(F.size("a") - 1, F.lit(0))), lambda x, i: (x + F.get("a", i)) / 2)))
    return deciles.select(all_.alias("a")).select(F.explode(F.array_sort(both)).alias("threshold"))


# --- Metadata ------------------------------------------------------------------------------------------------------------


def words(c: Column) -> Column:
    return F.regexp_extract_all(T.casefolded(F.coalesce(c, F.lit(""))), F.lit(r"(?U)[\w-]+"), F.lit(0))


def supported(field: Column, values: Column, attested: Column, title: Column) -> Column:
    """SC22: every value of a proposal has at least nine of ten words in the text it came from; a title is short and neither stamp nor date; authors
    hold no institution and are not the title."""
    known = words(attested)
    each = F.forall(values, lambda v: (F.size(words(v)) > 0) & (F.size(F.filter(words(v), lambda w: F.array_contains(known, w))) >= 0.9 * F.size(words(v))))
    joined = F.lower(F.array_join(values, " "))
    own = F.array_distinct(words(joined))
    as_title = (F.length(joined) <= 300) & ~joined.startswith("arxiv:") & ~joined.rlike(r"^(?:19|20)\d{2}")
    overlap = F.size(F.array_intersect(own, F.array_distinct(words(title)))) / F.greatest(F.size(own), F.lit(1))
    as_authors = ~F.exists(F.array(*map(F.lit, NOT_NAMES)), lambda w: F.contains(joined, w)) & (overlap <= 0.7)
    return F.coalesce((F.size(values) > 0) & each & F.when(field == "title", as_title).when(field == "authors", as_authors).otherwise(F.length(joined) <= 200), F.lit(False))


def adjudicated(current: DataFrame, proposals: DataFrame, attested: DataFrame, floor: float = 0.7, accept: float = 0.65, cap: float = 0.85) -> DataFrame:
    """AGG32: (paper_id, field, values, source, confidence) after a model's proposals. Title, authors and venue are replaced where the proposal is
    supported and sure enough; other fields only where they are empty or below ``floor``. current and proposals: (paper_id, field, values
    array, confidence); attested: (paper_id, text)."""
    c = current.select("paper_id", "field", F.col("values").alias("old"), F.col("source"), F.col("confidence").alias("sure"))
    p = proposals.select("paper_id", "field", F.col("values").alias("new"), F.least(F.coalesce("confidence", F.lit(0.6)), F.lit(cap)).alias("trust"))
    title = current.where("field = 'title'").select("paper_id", F.array_join("values", " ").alias("title"))
    j = c.join(p, ["paper_id", "field"], "full_outer").join(attested, "paper_id", "left").join(title, "paper_id", "left")
    empty = F.col("old").isNull() | (F.size("old") == 0)
    judged = F.col("field").isin(ADJUDICATED)
    take = F.when(judged, (F.col("trust") >= accept) & supported(F.col("field"), F.col("new"), F.col("text"), F.col("title"))).otherwise((empty | (F.col("sure") < floor)) & (F.size("new") > 0))
    take = F.coalesce(take, F.lit(False))
    pick = lambda a, b: F.when(take, a).otherwise(b)
    return j.select("paper_id", "field", pick(F.col("new"), F.col("old")).alias("values"), pick(F.lit("llm"), F.col("source")).alias("source"), pick(F.col("trust"), F.col("sure")).alias("confidence"))


def frozen_digest(cases: DataFrame, papers: DataFrame) -> DataFrame:
    """SNK7, SC26: (rows, sha256) of the test split of one dataset: the digests of its rows in order, so that any change of a frozen test shows."""
    row = lambda df, kind: df.where("split = 'test'").select(F.sha2(F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(F.to_json(F.struct(F.col(c))), F.lit("")) for c in sorted(df.columns)]), 256).alias("h"))
    both = row(cases, "case").unionByName(row(papers, "paper"))
    return both.agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("sha256"))


def chunks_digest(chunks: DataFrame, key: str = "paper_id") -> DataFrame:
    """SC26: (key, chunks, sha256) over a paper's chunks (position, chunk_id, text) in order: what an index was built from."""
    rows = F.array_sort(F.collect_list(F.struct("position", F.sha2(F.concat_ws("\n", "chunk_id", "text"), 256).alias("h"))))
    return chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.sha2(F.array_join(F.transform(rows, lambda r: r["h"]), ""), 256).alias("sha256"))


def cache_key(digest: Column, provider: str, model: str, schema: int) -> Column:
    """SC26: under what name an index is stored."""
    return F.sha2(F.concat_ws("\n", digest, F.lit(provider), F.lit(model), F.lit(schema).cast("string")), 256)


# --- Public benchmarks as datasets ---------------------------------------------------------------------------------------

def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def adapted_cases(questions: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """AGG16, AGG22, AGG24, JN13: one row per question (paper_id, question_id, question, annotations array of answers as readers.ANSWER): the reason why it is
    excluded, or null and answer_type (the most frequent, of equals the first), minimum_sets of chunk ids, gold_answers. paragraphs: (paper_id,
    chunk_id, place, text).

    Evidence is known by its text alone: it must stand in the paper exactly as often as it is cited, or once. The first annotation that
    fails decides."""
    p = paragraphs.select("paper_id", "chunk_id", "place", squeezed(F.col("text")).alias("text")).where("text <> ''")
    p = p.groupBy("paper_id", "text").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "chunk_id"))), lambda r: r["chunk_id"]).alias("chunks"))
    key = ["paper_id", "question_id"]
    a = questions.select(*key, F.posexplode("annotations").alias("n", "a"))
    cited = a.select(*key, "n", F.posexplode(F.coalesce("a.evidence", F.array().cast("array<string>"))).alias("at", "e")).select(*key, "n", "at", squeezed(F.col("e")).alias("text")).where("text <> ''")
    cited = cited.groupBy(*key, "n", "text").agg(F.min("at").alias("at"), F.count("*").alias("times")).join(p, ["paper_id", "text"], "left")
    many = F.size(F.coalesce("chunks", F.array().cast("array<string>")))
    wrong = F.when(many == 0, "unmapped_evidence").when((many != F.col("times")) & (many > 1), "ambiguous_duplicate_evidence").when(F.col("times") > many, "unmapped_evidence")
    rows = F.array_sort(F.collect_list(F.struct("at", wrong.alias("wrong"), F.slice(F.coalesce("chunks", F.array().cast("array<string>")), 1, F.col("times").cast("int")).alias("chunks"))))
    sets = cited.groupBy(*key, "n").agg(F.max(F.upper("text").contains("FLOAT SELECTED")).alias("figure"), rows.alias("r"))
    sets = sets.select(*key, "n", "figure", F.get(F.filter(F.transform("r", lambda x: x["wrong"]), lambda x: x.isNotNull()), F.lit(0)).alias("wrong"), F.array_distinct(F.flatten(F.transform("r", lambda x: x["chunks"]))).alias("set"))
    answer = F.col("a")
    kind = F.when(F.coalesce(answer["unanswerable"], F.lit(False)), "unanswerable").when(answer["yes_no"].isNotNull(), "yes_no").when(F.size(F.coalesce(answer["extractive_spans"], F.array().cast("array<string>"))) > 0, "extractive").otherwise("free_form")
    gold = F.when(kind == "yes_no", F.array(F.when(answer["yes_no"], "yes").otherwise("no"))).when(kind == "extractive", F.transform(answer["extractive_spans"], squeezed)).when(
        kind == "free_form", F.array(squeezed(answer["free_form_answer"]))).otherwise(F.array().cast("array<string>"))
    each = a.select(*key, "n", kind.alias("kind"), gold.alias("gold")).join(sets, [*key, "n"], "left")
    failed = F.when(F.col("kind") == "unanswerable", None).when(F.coalesce("figure", F.lit(False)), "figure_or_table").when(F.col("set").isNull(), "missing_evidence").otherwise(F.col("wrong"))
    each = each.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("n", "kind", "gold", "set", failed.alias("failed")))).alias("r"))
    q = questions.select(*key, squeezed(F.col("question")).alias("question")).join(each, key, "left")
    kinds = F.transform("r", lambda x: x["kind"])
    refused = F.size(F.filter(kinds, lambda k: k == "unanswerable"))
    first = F.get(F.filter(F.transform("r", lambda x: x["failed"]), lambda x: x.isNotNull()), F.lit(0))
    reason = F.when(F.col("r").isNull(), "missing_annotations").when((refused > 0) & (refused < F.size("r")), "answerability_disagreement").when(refused == 0, first)
    reason = F.coalesce(reason, F.when(F.col("question") == "", "blank_question"))
    score = F.transform(F.array_distinct(kinds), lambda k: F.struct(F.size(F.filter(kinds, lambda x: x == k)).alias("n"), (-F.array_position(kinds, k)).alias("at"), k.alias("kind")))
    out = q.withColumn("reason", reason)
    good = F.col("reason").isNull()
    texts = F.array_distinct(F.filter(F.flatten(F.transform("r", lambda x: x["gold"])), lambda t: t != ""))
    return out.select(*key, "question", "reason", F.when(good, F.array_max(score)["kind"]).alias("answer_type"), F.when(good, F.filter(F.transform("r", lambda x: x["set"]), lambda x: x.isNotNull())).alias("minimum_sets"), F.when(good, texts).alias("gold_answers"))


def exclusions(adapted: DataFrame) -> DataFrame:
    """AGG24: questions by the reason of their exclusion."""
    return adapted.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))
