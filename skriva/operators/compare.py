"""Side-by-side comparison of documents: chunk selection under a budget and the matrix of dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..schemas import DEFAULTS

# The dimensions of a comparison and their key words.
DIMENSIONS = {
    "research_question": ["objective", "problem", "aim", "research question", "目标", "问题"],
    "dataset": ["dataset", "cohort", "sample", "benchmark", "数据集", "队列", "样本"],
    "method": ["method", "model", "architecture", "framework", "方法", "模型", "架构"],
    "baseline": ["baseline", "state-of-the-art", "comparison", "基线", "对比"],
    "metrics": ["metric", "accuracy", "auc", "f1", "c-index", "指标", "准确率"],
    "results": ["result", "outperform", "improve", "performance", "结果", "提升", "性能"],
    "limitations": ["limitation", "future work", "however", "局限", "未来工作"],
}


def occurrences(haystack: Column, word: Column) -> Column:
    """How often a literal word stands in a text, without overlaps."""
    gone = F.replace(haystack, word, F.lit(""))
    return ((F.length(haystack) - F.length(gone)) / F.greatest(F.length(word), F.lit(1))).cast("long")


def scored_chunks(chunks: DataFrame, focus: str, dimensions: dict[str, list[str]] | None = None) -> DataFrame:
    """JN18: adds score (key words, three times the focus words, 0.2 for page 1) and dimensions (names whose words occur)."""
    dimensions = dimensions or DIMENSIONS
    low = F.lower(F.concat_ws(" ", F.coalesce("section", F.lit("")), F.coalesce("text", F.lit(""))))
    df = chunks.withColumn("__low", low)
    words = [w for ws in dimensions.values() for w in ws]
    keyword = F.aggregate(F.array(*map(F.lit, words)), F.lit(0).cast("long"), lambda a, w: a + occurrences(F.col("__low"), w))
    focused = F.aggregate(T.focus_words(F.lit(focus)), F.lit(0).cast("long"), lambda a, w: a + 3 * occurrences(F.col("__low"), w))
    found = F.array_compact(F.array(*[F.when(F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(F.col("__low"), w)), F.lit(d)) for d, ws in dimensions.items()]))
    page1 = F.when(F.col("page_start") == 1, 0.2).otherwise(0.0)
    return df.withColumn("score", keyword + focused + page1).withColumn("dimensions", found).drop("__low")


def select_greedily(scored: DataFrame, key: str, order: str, items: int = DEFAULTS.comparison_items, budget: int = DEFAULTS.comparison_tokens) -> DataFrame:
    """TOP7: by falling score, what does not fit is skipped and later ones still tried; the first is always taken.

    A fold over each document's ranked (score, length) pairs; texts stay out of it."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(order).alias("o"), F.length("text").alias("n"))))
    start = F.struct(F.lit(0).cast("long").alias("chars"), F.array().cast("array<long>").alias("picked"))

    def step(a: Column, c: Column) -> Column:
        skip = (F.size(a["picked"]) >= items) | ((F.size(a["picked"]) > 0) & (a["chars"] + c["n"] > 4 * budget))
        return F.when(skip, a).otherwise(F.struct((a["chars"] + c["n"]).alias("chars"), F.concat(a["picked"], F.array(c["o"].cast("long"))).alias("picked")))

    picked = scored.groupBy(key).agg(F.aggregate(ranked, start, step)["picked"].alias("p")).select(key, F.posexplode("p").alias("i", order))
    return scored.join(picked.select(key, F.col(order), (F.col("i") + 1).alias("pick")), [key, order])


def matrix(selected: DataFrame, key: str, per_cell: int = 2, dimensions: dict[str, list[str]] | None = None) -> DataFrame:
    """AGG27: (dimension, key, evidence): the first ``per_cell`` picks of each cell."""
    each = selected.select(key, "pick", "chunk_id", F.explode("dimensions").alias("dimension"))
    order = W.partitionBy(key, "dimension").orderBy("pick")
    top = each.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_cell)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("n", "chunk_id"))), lambda r: r["chunk_id"])
    return top.groupBy("dimension", key).agg(ids.alias("evidence"))


def pivoted(cells: DataFrame, key: str, dimensions: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per document, one column per dimension."""
    return cells.groupBy(key).pivot("dimension", list(dimensions or DIMENSIONS)).agg(F.first("evidence"))


def gaps(documents: DataFrame, cells: DataFrame, key: str, dimensions: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, dimension) without evidence."""
    all_ = documents.select(key).distinct().select(key, F.explode(F.array(*map(F.lit, dimensions or DIMENSIONS))).alias("dimension"))
    return all_.join(cells.select(key, "dimension"), [key, "dimension"], "left_anti")


def strided(rows: DataFrame, order: str, start: int, stride: int = 5, most: int = 5) -> DataFrame:
    """TOP9: every stride-th row from start on, at most ``most``; ``order`` numbers the rows from 1."""
    n = F.col(order) - 1 - start
    return rows.where((n >= 0) & (n % stride == 0) & (n / stride < most))
