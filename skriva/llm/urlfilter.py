"""URL filters (native): host-suffix x path-prefix expressions, an equi-join on short hash prefixes, then full digests.

A URL's host lies between the first `://` and the next `/`, `?`, `#` or the end, with A-Z lower-cased; the path follows up to
`?`, `#` or the end. A rule (host, path, action) fits its host and all subdomains where the path starts with the rule's path.
Every URL is expanded into its label suffixes and path prefixes, as many labels and as long prefixes as the deepest and the longest rule
have (beyond these no rule can fit); the first four bytes of an expression's SHA-256
join it with the rules, the full digest confirms, and the longest rule wins (by characters; then the longer host; then block
before allow). Without a fitting rule the verdict is `default`.

Edge cases: a null url or one without `://` has an empty host and path and no rule. An empty path starts with no rule path
but the empty one. Null rule parts count as empty strings, rules without a host fit nothing. Repeated pages are judged row by
row; clashing extra columns are not read. Many rules: the rules are broadcast only while their measured size allows; else distinct
expressions are joined by shuffle, so a hot host costs one expression row. A very long URL costs no more expressions than its
beginning; it stands for itself by a digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import measured, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the contract (host, path, action).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
PREFIX_HEX = 8


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffixes(host: str, labels: int) -> Column:
    """The label suffixes of a host of at most so many labels, the longest first."""
    parts = F.split(F.col(host), r"\.", -1)
    tail = F.slice(parts, F.greatest(F.size(parts) - labels + 1, F.lit(1)), labels)
    return F.when(F.col(host) == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(tail)), lambda i: F.array_join(F.slice(tail, i, labels), ".")))


def prefixes(path: str, longest: int, lengths: list[int]) -> Column:
    """Of at most ``longest`` characters: the path cut behind each slash, the whole path, the empty one, and the cuts at the given lengths."""
    head = F.substring(F.col(path), 1, longest)
    parts = F.split(head, "/", -1)
    cuts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.when(i < F.size(parts), "/").otherwise("")))
    odd = F.transform(F.array(*map(F.lit, lengths)), lambda n: F.substring(head, F.lit(1), n)) if lengths else F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(F.lit("")), cuts, odd))


def digest(host: Column, path: Column) -> Column:
    """The host's length keeps host and path apart."""
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def rule_rows(rules: DataFrame) -> DataFrame:
    r = rules.select(
        F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"),
        F.lower(F.coalesce("action", F.lit("block"))).alias("action")).where("rule_host <> ''").distinct()
    r = r.withColumn("full", digest(F.col("rule_host"), F.col("rule_path")))
    # Of two rules alike but for the action, block wins.
    r = r.groupBy("full", "rule_host", "rule_path").agg(F.max("action").alias("action"))
    return r.select(F.substring("full", 1, PREFIX_HEX).alias("short"), "full", F.concat("rule_host", "rule_path").alias("rule"), F.length("rule_host").alias("host_len"), "action",
                    F.size(F.split("rule_host", r"\.", -1)).alias("labels"), F.length("rule_path").alias("path_len"))


def expressions(urls: DataFrame, labels: int, longest: int, lengths: list[int]) -> DataFrame:
    """(url_key, short, full): one row per expression of each distinct host and path."""
    e = urls.select("url_key", suffixes("host", labels).alias("s"), prefixes("path", longest, lengths).alias("e")).distinct()
    e = e.select("url_key", F.explode("s").alias("s"), "e").select("url_key", "s", F.explode("e").alias("e"))
    e = e.select("url_key", digest(F.col("s"), F.col("e")).alias("full"))
    return e.select("url_key", F.substring("full", 1, PREFIX_HEX).alias("short"), "full")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per row of pages: its columns page_id and url, then host, path, rule, verdict."""
    rows = rule_rows(rules)
    reach = rows.agg(F.max("labels"), F.max("path_len")).first()
    # Rule paths that do not end at a slash need cuts at their own lengths; these are bounded by the longest path.
    odd = rules.where("path IS NOT NULL AND path <> '' AND NOT endswith(path, '/')").select(F.length("path").alias("n")).distinct()
    lengths = sorted(r["n"] for r in odd.collect())
    urls = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # A digest stands for host and path, which may be long.
    urls = urls.withColumn("url_key", digest(F.col("host"), F.col("path")))
    rule = measured(rows.drop("labels", "path_len"), F.octet_length("rule") + 160)
    found = expressions(urls, reach[0] or 0, reach[1] or 0, lengths).join(rule, ["short", "full"])
    best = F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), "host_len", "action"))
    found = found.groupBy("url_key").agg(best.alias("best"))
    out = urls.join(found, "url_key", "left")
    return out.select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge(table(spark, sf_dir, "pages"), rules).drop("url")
