"""Benchmark decontamination (native): a hash set of normalised benchmark n-grams against every training token window.

Words are runs of [0-9a-z] and non-ASCII characters after A-Z is lower-cased. An item's windows are its 10-word runs; an
item of 1 to 9 words is one window of its own length. One scan joins the hash of every document window with the broadcast
set of benchmark windows and verifies a hit by its words within that join; one more key, the empty window, brings every
document through with its word count. So the text is read once and never shuffled. Very long texts are scanned in blocks of words that overlap by
a window. The set's bytes are measured; where they are too many to broadcast, the same join runs by shuffle.

Edge cases: null or wordless texts have n_words 0 and are never hit; items without words have no windows; repeated items
count once per distinct id; items without an id mark words but are not listed; an empty benchmark leaves every document clean.
Repeated documents are judged row by row. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, measured, small, table

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing.
RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WIDTH = 10
#: Words of a document whose windows are spelled out at once.
BLOCK = 4096


def words(text: Column) -> Column:
    """The exact words: only A-Z is folded."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def folded(text: Column) -> Column:
    """A-Z lower-cased. `lower` does that much faster than `translate`, and is the same where no other capital occurs."""
    other_capital = text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^\x00-\x7F]]")
    return F.when(other_capital, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def windows_of(array: str, width: int, most: int) -> Column:
    """The width-word runs that start at the first ``most`` words, as strings; words hold no space, so joining them loses nothing."""
    starts = F.when(F.size(array) >= width, F.sequence(F.lit(0), F.least(F.size(array) - width, F.lit(most - 1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda p: F.array_join(F.slice(array, p + 1, width), " "))


def item_windows(bench: DataFrame, width: int = WIDTH) -> DataFrame:
    """(window, len, item_id), distinct."""
    w = bench.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(width))
    w = w.select("item_id", "w", size.alias("len"))
    windows = F.transform(F.sequence(F.lit(0), F.size("w") - F.col("len")), lambda p: F.array_join(F.slice("w", p + 1, F.col("len")), " "))
    return w.select(F.explode(windows).alias("window"), "len", "item_id").distinct()


def scan(docs: DataFrame, bench: DataFrame, scratch: Scratch, width: int = WIDTH, keyed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n_words, hits array<struct<p, len, h>>), one row per row of docs, and the benchmark's (h, item_id). With
    ``keyed`` the rows also have the text's hash, as key."""
    ids = ["row", "doc_id", *(["key"] if keyed else [])]
    owned = scratch.keep(item_windows(bench, width).withColumn("h", F.xxhash64("window")), "windows")
    # At most `width` rows, whatever the benchmark holds.
    lengths = sorted(r["len"] for r in owned.select("len").distinct().collect())
    keys = owned.select("h", "window", "len").distinct()
    empty = docs.sparkSession.range(1).select(F.lit("").alias("window"), F.lit(0).alias("len"))
    keys = scratch.keep(keys.unionByName(empty.select(F.xxhash64("window").alias("h"), "window", "len")), "keys")
    d = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("key"), folded(F.coalesce("text", F.lit(""))).alias("t"))
    d = d.select(*ids, F.array_remove(F.split("t", GAP), "").alias("w"))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(BLOCK)), lambda b: F.struct(b.alias("b"), F.slice("w", b + 1, BLOCK + width - 1).alias("w")))
    d = d.select(*ids, F.size("w").alias("n_words"), F.explode(blocks).alias("x")).select(*ids, "n_words", "x.b", "x.w")
    runs = F.concat(F.when(F.col("b") == 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")), *[windows_of("w", n, BLOCK) for n in lengths])
    d = d.select(*ids, "n_words", "b", F.size("w").alias("size"), F.posexplode(runs).alias("at", "s"))
    d = d.withColumn("h", F.xxhash64("s"))
    found = d.join(measured(keys, F.octet_length("window") + 64), "h").where(F.col("s") == F.col("window"))
    # Where in the list of runs the first one of each length stands.
    first, before = F.lit(0), F.when(F.col("b") == 0, 1).otherwise(0)
    for n in lengths:
        first = F.when(F.col("len") == n, before).otherwise(first)
        before = before + F.greatest(F.least(F.col("size") - (n - 1), F.lit(BLOCK)), F.lit(0))
    # At most one hit per position and length, so the list is bounded by the document's own text.
    hit = F.when(F.col("len") > 0, F.struct((F.col("b") + F.col("at") - first).alias("p"), "len", "h"))
    rows = found.groupBy(*ids, "n_words").agg(F.collect_list(hit).alias("hits"))
    return scratch.keep(rows, "scan"), owned.select("h", "item_id")


def hit_words(hits: str = "hits") -> Column:
    """The distinct word positions inside any hit window, sorted."""
    spans = F.transform(hits, lambda s: F.sequence(s["p"], s["p"] + s["len"] - 1))
    return F.sort_array(F.array_distinct(F.flatten(spans)))


def contamination(docs: DataFrame, bench: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items."""
    rows, owned = scan(docs, bench, scratch)
    # Each document's distinct windows first, so that a window met often is joined once per document.
    met = rows.where(F.size("hits") > 0).select("row", F.explode(F.array_distinct(F.transform("hits", lambda x: x["h"]))).alias("h"))
    owned = owned.where("item_id IS NOT NULL")
    pairs = met.join(small(owned, owned.count(), 24), "h").select("row", "item_id").distinct()
    items = pairs.groupBy("row").agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    out = rows.withColumn("n_hit", F.size(hit_words()).cast("long")).join(items, "row", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), items.alias("items"))


def remove(docs: DataFrame, bench: DataFrame, scratch: Scratch, whole: bool = False, max_share: float = 0.5) -> DataFrame:
    """docs without benchmark text: hit words are cut out with the gaps before them. With ``whole``, or where more than
    max_share of the words are hit, the document is removed. Every row is cut by the hits of its own text, also where rows share
    a doc_id or have none."""
    rows, _ = scan(docs, bench, scratch, keyed=True)
    found = rows.where(F.size("hits") > 0).select(F.col("doc_id").alias("__id"), F.col("key").alias("__k"), hit_words().alias("__p"))
    # Rows that agree in id and text have the same hits. By shuffle at every size: the ids of hit documents grow with the corpus.
    few = found.groupBy("__id", "__k").agg(F.first("__p").alias("__p")).hint("merge")
    docs_ = docs.withColumn("__text", F.xxhash64("text"))
    same = docs_["doc_id"].eqNullSafe(few["__id"]) & (docs_["__text"] == few["__k"])
    if whole:
        return docs_.join(few, same, "left_anti").select(*docs.columns)
    out = docs_.join(few, same, "left")
    out = out.withColumn("__w", F.when(F.col("__p").isNotNull(), F.array_remove(F.split("text", RAW_GAP), "")))
    out = out.where(F.col("__p").isNull() | (F.size("__p") <= max_share * F.size("__w")))
    out = out.withColumn("__g", F.when(F.col("__p").isNotNull(), F.split("text", RAW_WORD, -1)))
    # Gap i stands before word i, the last gap behind all words.
    left = F.array_except(F.sequence(F.lit(0), F.size("__w") - 1), F.col("__p"))
    kept = F.transform(left, lambda i: F.concat(F.get("__g", i), F.get("__w", i)))
    text = F.when(F.col("__p").isNull(), F.col("text")).otherwise(F.concat(F.array_join(kept, ""), F.element_at("__g", -1)))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__p").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op6"))
    return out.drop("items")
