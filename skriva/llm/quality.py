"""Quality rules with risk-controlled thresholds (native DataFrame expressions only).

Every document gets a few rule scores. A labelled holdout decides, per stratum (language), from which score on a rule may
reject: a cutoff is certified if the exact binomial upper bound of its false-rejection rate lies at or below
``alpha / n_rules``. The bound is tested at level ``delta / (n_rules * n_strata)`` (Bonferroni over rules and strata). Within a
rule the cutoffs are nested, so the bound is monotone and testing them from lenient to strict in a fixed sequence needs no
further correction. Of the certified cutoffs the one that rejects most bad documents, minus ``cost`` times the good ones, wins;
ties go to the lenient one. With too few labels in a stratum nothing is certified, and no rule rejects there.

Edge cases: a null text has no words and fails the base rules; a null language is a stratum of its own; label rows that
repeat a doc_id count once (the worst quality), and so do rows of a labelled document (its least statistics); unlabelled documents are judged by the cutoffs of their stratum. Extra columns
stay untouched. An empty table gives an empty result; without labels only the base rules act.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch, table

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
#: Rule -> (numerator, denominator column, step of the cutoff grid, cutoffs). A rule rejects scores above its cutoff.
RULES = {
    "symbols": ("n_symbols", "n_words", 0.05, 60),
    "dup_lines": ("n_dup_lines", "n_lines", 0.02, 50),
    "repeats": ("n_repeat_words", "n_words", 0.02, 50),
    "long_words": ("word_chars", "n_words", 0.5, 60),
}
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append the base statistics (long) and n_lines; all work stays inside one row, nothing is shuffled."""
    body = F.coalesce(F.col(text), F.lit(""))
    lag = lambda i: i - 1
    df = docs.withColumn("__w", F.array_remove(F.split(body, SPACE), ""))
    df = df.withColumn("__l", F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD)))
    df = df.withColumn("__n", F.size("__w"))
    triples = F.transform(
        F.sequence(F.lit(0), F.col("__n") - 3),
        lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)),
    )
    df = df.withColumn("__h", F.when(F.col("__n") >= 3, triples).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("__repeats", F.size(F.array_distinct("__h")) < F.size("__h"))
    placed = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    df = df.withColumn("__s", F.when(F.col("__repeats"), placed))
    again = F.filter("__s", lambda e, i: (F.get("__s", lag(i))["h"] == e["h"]) | (F.get("__s", i + 1)["h"] == e["h"]))
    df = df.withColumn("__p", F.sort_array(F.transform(again, lambda e: e["p"])))
    covered = F.aggregate(
        F.transform("__p", lambda p, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get("__p", lag(i))))),
        F.lit(0), lambda a, x: a + x,
    )
    stats = {
        "n_words": F.col("__n").cast("long"),
        "word_chars": F.length(F.regexp_replace(body, SPACE, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "n_lines": F.size("__l").cast("long"),
    }
    return df.select(*docs.columns, *(c.alias(k) for k, c in stats.items()))


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    n = F.col("n_words")
    return (n < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * n)


def score(rule: str) -> Column:
    top, bottom, _, _ = RULES[rule]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) exactly, summed down from the term at k: ratios of neighbouring terms stay in range of a double.

    The exact upper confidence bound of k of n rejections is at most p if and only if this tail is at most the level."""
    odds = (1 - p) / p
    # log of the term at k, by sums of logs: n * log(1-p) + sum_j log((n-j)/(j+1) * p/(1-p)).
    log_k = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(0).cast("long"), k - 1)).otherwise(F.array().cast("array<bigint>")),
        n * F.log(F.lit(1 - p)), lambda a, j: a + F.log((n - j) / ((j + 1) * F.lit(odds))),
    )
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    sums = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start,
        lambda a, i: F.struct(
            (a["term"] * (k - i + 1) / (n - k + i) * F.lit(odds)).alias("term"),
            (a["sum"] + a["term"] * (k - i + 1) / (n - k + i) * F.lit(odds)).alias("sum"),
        ),
    )["sum"]
    # A far larger k than expected makes the sum overflow; such a tail is near 1.
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(log_k) * sums)


def certified_cutoffs(
    labelled: DataFrame, scratch: Scratch, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05, cost: float = 10.0
) -> DataFrame:
    """One row (stratum, rule, cutoff, n_good, false_rejections, tail) per certified rule.

    labelled: the statistics with a 0/1 column ``quality``. Scores are counted on a fixed grid of cutoffs, so what is gathered
    has at most strata x rules x grid rows, whatever the input."""
    n_rules = len(RULES)
    parts = F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(step).alias("step"),
                 F.least(F.ceil(score(r) / step), F.lit(size + 1)).cast("int").alias("bin"))
        for r, (_, _, step, size) in RULES.items()
    ]))
    rows = labelled.where(~base_failed()).select(F.col(stratum).alias("stratum"), "quality", parts.alias("x"))
    counts = scratch.keep(rows.groupBy("stratum", "x.rule", "x.step", "x.bin").agg(
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")), "counts")
    n_strata = max(1, counts.select("stratum").distinct().count())  # a null stratum is one, an empty one another
    # A score in bin b exceeds exactly the cutoffs step * c with c < b.
    key = ["stratum", "rule"]
    above = Window.partitionBy(*key).orderBy(F.col("bin").desc())
    whole = Window.partitionBy(*key)
    at = counts.select(
        *key, "step", (F.col("bin") - 1).alias("c"),
        F.sum("good").over(above).alias("k"), F.sum("bad").over(above).alias("hit"),
        F.sum("good").over(whole).alias("n_good"), F.sum("bad").over(whole).alias("n_bad"),
    ).where("c >= 0")
    level = delta / (n_rules * n_strata)
    tested = at.withColumn("tail", binomial_tail(F.col("k"), F.col("n_good"), alpha / n_rules))
    gain = F.col("hit") / F.greatest(F.col("n_bad"), F.lit(1)) - cost * F.col("k") / F.greatest(F.col("n_good"), F.lit(1))
    passed = tested.where((F.col("tail") <= level) & (F.col("n_good") > 0)).withColumn("gain", gain).where("gain > 0")
    best = passed.groupBy(*key).agg(F.max_by(
        F.struct((F.col("c") * F.col("step")).alias("cutoff"), F.col("n_good"), F.col("k").alias("false_rejections"), "tail"),
        F.struct("gain", "c")).alias("b"))
    return best.select(*key, "b.*")


def with_verdict(stats: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Append base_failed and kept. The cutoffs are one narrow row per stratum (bounded by the distinct strata)."""
    wide = cutoffs.groupBy(F.col("stratum").alias("__stratum")).agg(
        *[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"__cut_{r}") for r in RULES])
    joined = stats.join(wide, F.col(stratum).eqNullSafe(F.col("__stratum")), "left")
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(score(r) > F.col(f"__cut_{r}"), F.lit(False))
    return joined.select(*stats.columns, base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"))


def one_label(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))


def cutoffs_of(stats: DataFrame, labels: DataFrame, scratch: Scratch, **risk) -> DataFrame:
    """The certified cutoffs. Each labelled document is one trial, however many rows it has."""
    columns = ["lang", *STATS, "n_lines"]
    once = stats.join(one_label(labels), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*columns)).alias("s")).select("quality", "s.*")
    return scratch.keep(certified_cutoffs(once, scratch, **risk).coalesce(1), "cutoffs")


def judge(docs: DataFrame, labels: DataFrame, scratch: Scratch, **risk) -> DataFrame:
    """(doc_id, lang, statistics, base_failed, kept) for every row of docs. The statistics are written once and read twice."""
    stats = scratch.keep(with_stats(docs.select("doc_id", "lang", "text")).drop("text"), "stats")
    return with_verdict(stats, cutoffs_of(stats, labels, scratch, **risk))


def keep_good(docs: DataFrame, labels: DataFrame, **risk) -> DataFrame:
    """The rows of docs that pass, with their own columns. Rows and statistics are written once: the cutoffs read the statistics alone,
    the verdict all."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.keep(with_stats(docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "lang", "text")).drop("text"), "stats")
    cutoffs = cutoffs_of(rows.drop("__row"), labels, scratch, **risk)
    return with_verdict(rows, cutoffs).where("kept").select("__row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, the four base statistics, base_failed, kept."""
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "op5"))
    return out.select("doc_id", *STATS, "base_failed", "kept")
