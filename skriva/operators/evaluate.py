"""Retrieval evaluation: metrics per case, slices, percentiles, replays of parameter grids, gates, splits and data checks."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..session import written
from . import scans


def observations(cases: DataFrame, ranked: DataFrame, k: int = 6, candidates: int = 20) -> DataFrame:
    """cases: (query_id, relevant array, ...); ranked: (query_id, chunk_id, rank). Adds top (k ids) and found (candidate ids)."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda r: r["chunk_id"])
    lists = ranked.where(F.col("rank") <= candidates).groupBy("query_id").agg(ids.alias("found"))
    none = F.array().cast("array<string>")
    out = cases.join(lists, "query_id", "left").withColumn("found", F.coalesce("found", none)).withColumn("relevant", F.coalesce("relevant", none))
    return out.withColumn("top", F.slice("found", 1, k)).withColumn("should_refuse", F.size("relevant") == 0).withColumn("refused", F.size("top") == 0)


def case_metrics(obs: DataFrame) -> DataFrame:
    """SET2, WIN14: recall, precision, reciprocal rank and counts of each case. Nothing retrieved counts as precision 0."""
    hits, n = F.size(F.array_intersect("relevant", "top")), F.size("relevant")
    ranks = F.filter(F.transform("top", lambda c, i: F.when(F.array_contains("relevant", c), 1 / (i + 1))), lambda x: x.isNotNull())
    ok = ~F.col("should_refuse")
    return (
        obs.withColumn("recall", F.when(ok, hits / n)).withColumn("precision", F.when(ok, F.coalesce(hits / F.nullif(F.size("top"), F.lit(0)), F.lit(0.0))))
        .withColumn("candidate_recall", F.when(ok, F.size(F.array_intersect("relevant", "found")) / n))
        .withColumn("reciprocal_rank", F.when(ok, F.coalesce(F.array_max(ranks), F.lit(0.0))))
        .withColumn("covered", F.when(ok, hits).otherwise(0)).withColumn("allowed", F.when(ok, n).otherwise(0))
        .withColumn("noise", F.size("top") - hits).withColumn("returned", F.size("top")))


METRICS = [
    "recall_at_6", "precision_at_6", "mrr", "candidate_recall_at_20", "evidence_coverage", "noise_rate", "no_answer_refusal_rate", "false_refusal_rate", "average_returned"]


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def metric_columns(places: int = 6) -> list[Column]:
    """AGG6: macro means over answerable cases, micro ratios over all; an empty denominator gives 0."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    refuse, answer = F.count_if("should_refuse"), F.count_if(~F.col("should_refuse"))
    found = {
        "recall_at_6": mean("recall"), "precision_at_6": mean("precision"), "mrr": mean("reciprocal_rank"), "candidate_recall_at_20": mean("candidate_recall"),
        "evidence_coverage": _ratio(F.sum("covered"), F.sum("allowed")), "noise_rate": _ratio(F.sum("noise"), F.sum("returned")),
        "no_answer_refusal_rate": _ratio(F.count_if(F.col("should_refuse") & F.col("refused")), refuse),
        "false_refusal_rate": F.count_if(~F.col("should_refuse") & F.col("refused")) / F.greatest(answer, F.lit(1)),
        "average_returned": F.avg("returned"),
    }
    return [F.round(c, places).alias(n) for n, c in found.items()]


def metrics(obs: DataFrame, by: list[str] | None = None) -> DataFrame:
    m = case_metrics(obs)
    return (m.groupBy(*by) if by else m.groupBy()).agg(F.count("*").alias("cases"), *metric_columns())


def sliced(obs: DataFrame, dimensions: list[str]) -> DataFrame:
    """AGG8: one row per value of each dimension, and one for all, by grouping sets: a single pass over the cases."""
    m = case_metrics(obs)
    sets = [[], *[[d] for d in dimensions]]
    out = m.groupingSets([[F.col(d) for d in s] for s in sets], *dimensions).agg(F.count("*").alias("cases"), *metric_columns(), *[F.grouping(d).alias(f"__{d}") for d in dimensions])
    name, value = F.lit("all"), F.lit("all")
    for d in dimensions:
        name = F.when(F.col(f"__{d}") == 0, d).otherwise(name)
        value = F.when(F.col(f"__{d}") == 0, F.col(d).cast("string")).otherwise(value)
    return out.withColumn("dimension", name).withColumn("slice", value).drop(*dimensions, *[f"__{d}" for d in dimensions])


def latency(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """AGG7: exact percentiles by linear interpolation."""
    found = scans.quantiles(df, by, value, {"p50": 0.5, "p95": 0.95}).withColumnsRenamed({c: f"__{c}" for c in by})
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return counts.join(found, same, "left").select(*by, "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


def any_set_covered(sets: Column, top: Column) -> Column:
    """SET3: at least one minimum evidence set lies within the retrieved ids."""
    return F.exists(sets, lambda g: F.size(F.array_except(g, top)) == 0)


def set_f1(predicted: Column, expected: Column) -> Column:
    """SET6: both empty give 1."""
    p, e = F.size(F.array_distinct(predicted)), F.size(F.array_distinct(expected))
    both = F.size(F.array_intersect(predicted, expected))
    return F.when((p == 0) & (e == 0), 1.0).otherwise(F.coalesce(2 * both / F.nullif(p + e, F.lit(0)), F.lit(0.0)))


def token_f1(pairs: DataFrame, key: list[str], predicted: str, expected: str) -> DataFrame:
    """SET7: multiset overlap of evaluation tokens."""
    counts = lambda c, n: pairs.select(*key, F.explode(T.eval_tokens(F.coalesce(c, F.lit("")))).alias("t")).groupBy(*key, "t").agg(F.count("*").alias(n))
    sizes = pairs.select(*key, F.size(T.eval_tokens(F.coalesce(predicted, F.lit("")))).alias("np"), F.size(T.eval_tokens(F.coalesce(expected, F.lit("")))).alias("ne"))
    both = counts(predicted, "a").join(counts(expected, "b"), [*key, "t"]).groupBy(*key).agg(F.sum(F.least("a", "b")).alias("overlap"))
    j = sizes.join(both, key, "left")
    f1 = F.when((F.col("np") == 0) & (F.col("ne") == 0), 1.0).otherwise(F.coalesce(2 * F.col("overlap") / F.nullif(F.col("np") + F.col("ne"), F.lit(0)), F.lit(0.0)))
    return j.select(*key, F.round(f1, 6).alias("token_f1"))


def replay(scores: DataFrame, cases: DataFrame, grid: DataFrame, k: int = 6) -> DataFrame:
    """JN16: every grid point (config, min_score, top_k) over stored scores (query_id, chunk_id, rank, score); metrics per config.

    A sweep: a case's results change with min_score only at its own stored scores, so between two of these each metric is one value for all grid points there. It is
    added where the stretch begins and taken off where it ends, summed per top_k and place, and sums over the places give the metrics of all grid
    points. The work is cases x stored depth x top_ks, however fine the grid; only its thresholds and top_ks, which the caller states, are known to all tasks."""
    points = sorted(r["min_score"] for r in grid.select(F.col("min_score").cast("double").alias("min_score")).distinct().collect())
    tops = sorted(r["top_k"] for r in grid.select("top_k").distinct().collect())
    if not points:
        return grid.limit(0).select("config", "min_score", "top_k", F.lit(0).cast("long").alias("cases"), *[F.lit(0.0).alias(n) for n in METRICS])
    none = F.array().cast("array<string>")
    lists = scores.where(F.col("score").isNotNull()).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("stored"))
    x = cases.join(lists, "query_id", "left").withColumn("relevant", F.coalesce("relevant", none))
    # A case's own scores from the highest on, and how many of the grid's thresholds each reaches.
    x = x.withColumn("marks", F.coalesce(F.sort_array(F.array_distinct(F.transform("stored", lambda r: r["score"].cast("double"))), asc=False), F.array().cast("array<double>")))
    grid_points = F.array(*[F.lit(float(g)) for g in points])
    x = x.withColumn("reach", F.transform("marks", lambda s: F.size(F.filter(grid_points, lambda g: g <= s)) - 1))
    begins, ends = F.concat(F.array(F.lit(len(points) - 1)), "reach"), F.concat("reach", F.array(F.lit(-1)))
    stretches = F.zip_with(begins, ends, lambda first, last: F.struct(first.alias("first"), last.alias("last")))
    stretches = F.filter(F.transform(stretches, lambda r, i: F.struct(r["first"].alias("first"), r["last"].alias("last"), i.alias("mark"))), lambda r: r["first"] > r["last"])
    x = x.withColumn("at", F.explode(stretches))
    kept = F.filter("stored", lambda r: r["score"] >= F.get("marks", F.col("at.mark") - 1))
    found = F.when(F.col("at.mark") == 0, none).otherwise(F.transform(kept, lambda r: r["chunk_id"]))
    x = x.select("query_id", "relevant", "at", found.alias("found")).withColumn("top_k", F.explode(F.array(*map(F.lit, tops)))).withColumn("top", F.slice("found", 1, F.col("top_k")))
    m = case_metrics(x.withColumn("should_refuse", F.size("relevant") == 0).withColumn("refused", F.size("top") == 0))
    refuse, refused = F.col("should_refuse"), F.col("refused")
    one = lambda c: c.cast("long")
    parts = {
        "cases": F.lit(1).cast("long"), "answer": one(~refuse), **{c: F.coalesce(c, F.lit(0.0)) for c in ("recall", "precision", "reciprocal_rank", "candidate_recall")},
        **{c: one(F.col(c)) for c in ("covered", "allowed", "noise", "returned")}, "kept_off": one(refuse & refused), "lost": one(~refuse & refused)}
    ends_ = F.explode(F.array(F.struct(F.col("at.first").alias("place"), F.lit(1).alias("sign")), F.struct(F.col("at.last").alias("place"), F.lit(-1).alias("sign")))).alias("e")
    moves = m.select("top_k", ends_, *[c.alias(n) for n, c in parts.items()]).where("e.place >= 0").groupBy("top_k", F.col("e.place").alias("place")).agg(*[F.sum(F.col(n) * F.col("e.sign")).alias(n) for n in parts])
    # One row per top_k and threshold from here on.
    place = lambda c: F.array_position(grid_points, c.cast("double")).cast("int") - 1
    asked = grid.select("top_k", place(F.col("min_score")).alias("place")).distinct()
    sums = moves.join(asked, ["top_k", "place"], "full")
    above = W.partitionBy("top_k").orderBy(F.col("place").desc()).rowsBetween(W.unboundedPreceding, 0)
    sums = sums.select("top_k", "place", *[F.coalesce(F.sum(n).over(above), F.lit(0)).alias(n) for n in parts])
    out = grid.withColumn("place", place(F.col("min_score"))).join(sums, ["top_k", "place"]).where("cases > 0")
    mean = lambda c: _ratio(F.col(c), F.col("answer"))
    found = {
        "recall_at_6": mean("recall"), "precision_at_6": mean("precision"), "mrr": mean("reciprocal_rank"), "candidate_recall_at_20": mean("candidate_recall"),
        "evidence_coverage": _ratio(F.col("covered"), F.col("allowed")), "noise_rate": _ratio(F.col("noise"), F.col("returned")),
        "no_answer_refusal_rate": _ratio(F.col("kept_off"), F.col("cases") - F.col("answer")), "false_refusal_rate": F.col("lost") / F.greatest("answer", F.lit(1)),
        "average_returned": F.col("returned") / F.col("cases")}
    return out.select("config", "min_score", "top_k", "cases", *[F.round(c, 6).alias(n) for n, c in found.items()])


def best_config(results: DataFrame, keys: list[Column], by: list[str] | None = None) -> DataFrame:
    """AGG18: arg-max by a lexicographic tuple; ties go to the smallest config index."""
    best = F.max_by(F.struct(*results.columns), F.struct(*keys, -F.col("config")))
    return (results.groupBy(*by) if by else results.groupBy()).agg(best.alias("b")).select("b.*")


def worst_fold(results: DataFrame, low: list[str], high: list[str]) -> DataFrame:
    """AGG19: the least of each quality metric, the greatest of each cost, by config."""
    return results.groupBy("config").agg(*[F.min(c).alias(c) for c in low], *[F.max(c).alias(c) for c in high])


def gates(results: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """AGG20: names of failed rules and whether all passed. A null metric fails."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))
    return results.withColumn("failures", failed).withColumn("passed", F.size("failures") == 0)


def thresholds(scores: DataFrame, value: str = "score") -> DataFrame:
    """WIN11: the observed values and the midpoints between neighbours. The order over all values comes from a range partitioning: neighbours inside a part
    from a window over it, the last value's neighbour from the parts' least values (one row per part)."""
    seen = scores.select(F.round(value, 6).alias("t")).where("t IS NOT NULL").distinct()
    parts = written(seen.repartitionByRange("t").withColumn("part", F.spark_partition_id()))
    least = parts.groupBy("part").agg(F.min("t").alias("least"))
    after = least.select(F.col("part").alias("part"), F.lead("least").over(W.orderBy("part")).alias("after"))
    mid = parts.join(F.broadcast(after), "part").withColumn("next", F.coalesce(F.lead("t").over(W.partitionBy("part").orderBy("t")), F.col("after")))
    mid = mid.where("next IS NOT NULL").select(F.round((F.col("t") + F.col("next")) / 2, 9).alias("t"))
    return parts.select("t").unionByName(mid).distinct().select(F.col("t").alias("threshold"))


def hash_split(rows: DataFrame, key: str, seed: str, shares: tuple[float, float] = (0.6, 0.2)) -> DataFrame:
    """WIN12: exact shares in the order of a seeded hash: analysis, validation, test.

    The order over all rows comes from a range partitioning: counts per bucket of the hash first, then ranks inside each bucket."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    df = rows.select(F.col(key)).distinct().withColumn("h", h).withColumn("bucket", F.substring("h", 1, 3))
    sizes = df.groupBy("bucket").agg(F.count("*").alias("c"))  # at most 4,096 rows
    before = sizes.withColumn("before", F.coalesce(F.sum("c").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    n = df.count()
    ranked = df.withColumn("r", F.row_number().over(W.partitionBy("bucket").orderBy("h", key))).join(F.broadcast(before), "bucket")
    place = F.col("r") + F.col("before")
    a, b = round(n * shares[0]), round(n * shares[0]) + round(n * shares[1])
    return ranked.select(key, place.cast("long").alias("place"), F.when(place <= a, "analysis").when(place <= b, "validation").otherwise("test").alias("split"))


def leaks(rows: DataFrame, key: str, split: str) -> DataFrame:
    """SET5: keys in more than one split."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def mapped_paragraphs(evidence: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """JN13: (evidence_id, reason, place): evidence text that equals one paragraph of its document; else why it is excluded."""
    p = paragraphs.groupBy("doc_id", "text").agg(F.count("*").alias("times"), F.min("line").alias("place"))
    j = evidence.join(p, ["doc_id", "text"], "left")
    reason = (
        F.when(F.col("text").rlike(r"^(?i)(?:figure|table|float)\b"), "figure_or_table").when(F.trim("text") == "", "missing").when(F.col("times").isNull(), "unmapped")
        .when(F.col("times") > 1, "ambiguous_duplicate").otherwise("mapped"))
    return j.select("evidence_id", "doc_id", reason.alias("reason"), F.when(F.col("times") == 1, F.col("place")).alias("place"))


def first_mode(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """AGG16: the most frequent value; of equals the one seen first."""
    c = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    return c.groupBy(key).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("seen"))).alias("m")).select(key, "m.*")


SAME = ["dataset_version", "frozen_test_sha256", "configuration_sha256", "case_count"]
MEASURED = ["latency_p50_ms", "latency_p95_ms", "total_input_tokens", "total_output_tokens", "estimated_cost_usd", "evidence_recall", "report_quality", "coverage_gap_rate"]


def compare_modes(runs: DataFrame, tolerance: float = 0.0, strict: bool = True) -> DataFrame:
    """AGG26: per run the serial against the parallel mode (rows run, mode, SAME, MEASURED): deltas, speed-up, and parallel where nothing got worse and no
    gap opened. Modes that do not measure the same thing are an error, or named where not ``strict``."""
    side = lambda mode, c: F.max(F.when(F.col("mode") == mode, F.col(c))).alias(f"{mode[0]}_{c}")
    j = runs.groupBy("run").agg(*[side(m, c) for m in ("serial", "parallel") for c in [*SAME, *MEASURED]])
    wrong = F.array_compact(F.array(*[F.when(~F.col(f"s_{c}").eqNullSafe(F.col(f"p_{c}")), F.lit(c)) for c in SAME]))
    if strict:
        wrong = F.when(F.size(wrong) > 0, F.raise_error(F.concat(F.lit("modes differ in "), F.array_join(wrong, ", "))).cast("array<string>")).otherwise(wrong)
    good = (F.col("p_evidence_recall") + tolerance >= F.col("s_evidence_recall")) & (F.col("p_report_quality") + tolerance >= F.col("s_report_quality")) & (F.col("p_coverage_gap_rate") == 0)
    delta = lambda c: F.col(f"p_{c}") - F.col(f"s_{c}")
    j = j.withColumn("mismatches", wrong).withColumn("quality_not_degraded", good & (F.size("mismatches") == 0))
    return j.select("run", "mismatches", F.round(F.col("s_latency_p95_ms") / F.nullif(F.col("p_latency_p95_ms"), F.lit(0.0)), 6).alias("p95_speedup"), *[(F.round(delta(c), 6) if "tokens" not in c else delta(c)).alias(f"{c}_delta") for c in MEASURED],
                    "quality_not_degraded", F.when(F.col("quality_not_degraded"), "parallel").otherwise("serial").alias("recommendation"))


TYPES = ["extractive", "free_form", "yes_no", "unanswerable"]


def taken(has: list[int], wanted: list[int], cap: int) -> tuple[int, ...]:
    """How many cases of each type to take from a paper: as many as the cap allows, first of the types of which least is still wanted (each case is then the
    largest share of that), earlier types before later ones."""
    out = [0] * len(has)
    for i in sorted(range(len(has)), key=lambda i: (max(1, wanted[i]), i)):
        out[i] = min(has[i], wanted[i], cap - sum(out))
    return tuple(out)


def pilot_sample(cases: DataFrame, papers: DataFrame, quotas: dict[str, int], per_paper: int = 4, seed: str = "pilot") -> DataFrame:
    """TOP10: (paper_id, case_id, answer_type): cases that fill the quotas of all types exactly, paper by paper: the paper that fills most comes next, of those
    the one whose index is cheapest per case (batches of eight chunks), then by a seeded hash. cases: (case_id, paper_id, answer_type); papers:
    (paper_id, chunks).

    The choice is a sequence, so it runs in one task, on few rows: papers alike in their capped numbers of cases differ in cost and hash only, so of
    each of the at most (per_paper + 1) ** 4 kinds no more can be chosen than all quotas together."""
    total = sum(quotas.values())
    counts = cases.groupBy("paper_id").agg(*[F.least(F.count_if(F.col("answer_type") == t), F.lit(per_paper)).alias(t) for t in TYPES])
    p = counts.join(papers.select("paper_id", F.ceil(F.col("chunks") / 8).alias("batches")), "paper_id").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), "paper_id"), 256))
    few = p.withColumn("n", F.row_number().over(W.partitionBy(*TYPES).orderBy("batches", "h"))).where(F.col("n") <= total).drop("n")

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        wanted, out = np.array([quotas.get(t, 0) for t in TYPES]), []
        has = dict(zip(g["paper_id"], g[TYPES].to_numpy(int).tolist(), strict=True))

        def offer(name: str, batches: int, h: str) -> tuple | None:
            mix = taken(has[name], wanted.tolist(), per_paper)
            return (-sum(mix), batches / sum(mix), batches, h, name, mix) if any(mix) else None

        # What is wanted only shrinks, so an offer only gets worse: an outdated one at the top is made anew and put back.
        queue = [o for o in map(offer, g["paper_id"], g["batches"].astype(int), g["h"]) if o]
        heapq.heapify(queue)
        while wanted.any():
            if not queue:
                raise ValueError(f"no papers left for {dict(zip(TYPES, wanted.tolist(), strict=True))}")
            old = heapq.heappop(queue)
            now = offer(old[4], old[2], old[3])
            if now == old:
                wanted -= now[5]
                out.append((now[4], *now[5]))
            elif now:
                heapq.heappush(queue, now)
        return pd.DataFrame(out, columns=["paper_id", *TYPES])

    chosen = few.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(choose, "paper_id string, " + ", ".join(f"{t} int" for t in TYPES))
    take = F.coalesce(*[F.when(F.col("answer_type") == t, F.col(t)) for t in TYPES])
    j = cases.join(chosen, "paper_id").withColumn("n", F.row_number().over(W.partitionBy("paper_id", "answer_type").orderBy("case_id")))
    return j.where(F.col("n") <= take).select("paper_id", "case_id", "answer_type")


def balanced_folds(cases: DataFrame, folds: int = 5, seed: str = "fold") -> DataFrame:
    """TOP11: (paper_id, fold) of cases (paper_id, answer_type): papers, largest first, each to the fold where the squared loads of all types and of all cases,
    in shares of a fold's even part, grow least; the first papers open one fold each. A sequence over the papers of one evaluation set, in
    one task: one short row per paper."""
    sizes = cases.groupBy("paper_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("answer_type") == t).alias(t) for t in TYPES]).withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), "paper_id"), 256))

    def assign(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["n", "h"], ascending=[False, True])
        sizes_ = g[[*TYPES, "n"]].to_numpy(float)
        sizes_ = sizes_[:, sizes_.any(axis=0)]
        many = min(folds, len(g))
        even, held = sizes_.sum(axis=0) / many, sizes_[:many].copy()  # one paper opens each fold
        place = list(range(many))
        for paper in sizes_[many:]:
            height = np.square((held + paper) / even).sum(axis=1)
            # The lowest; of equal ones that with fewer cases (the last column), then the first.
            place.append(int(np.lexsort((held[:, -1], height))[0]))
            held[place[-1]] += paper
        return pd.DataFrame({"paper_id": g["paper_id"], "fold": place})

    return sizes.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(assign, "paper_id string, fold int")
