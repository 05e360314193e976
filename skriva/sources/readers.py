"""Scans with declared schemas; nothing is inferred, and what is invalid is named."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import vectors as V
from ..schemas import STATE

SECRET = "api_?key|token|secret|password|credential|authorization|cookie"


def states(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """SRC5: state JSON files (or, without whole_files, one state per line) as chunk rows (paper_id, position from 0, the chunk's fields)."""
    s = spark.read.schema(STATE).json(path, multiLine=whole_files)
    c = s.select(F.col("document.metadata.paper_id").alias("state_paper"), F.posexplode("document.chunks").alias("position", "c"))
    return c.select(F.coalesce("c.paper_id", "state_paper").alias("paper_id"), "position", "c.chunk_id", "c.text", "c.section", "c.page_start", "c.page_end", "c.char_start", "c.char_end")


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """SRC6: JSON lines. Strict: the first malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def jsonl_errors(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """SRC6: (file, line from 1, value, reason) of every line that is blank, no JSON object, lacks a required field or has one of another type. Line numbers need whole files, which
    for lists of cases are small; the rows themselves are read by ``jsonl``."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n", -1)).alias("n", "value"))
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    fields = [f.strip().split(" ")[0] for f in re.split(r",\s*(?![^<>]*>)", schema)]
    missing = F.concat_ws(",", F.lit(None).cast("string"), *[F.when(F.get_json_object("value", f"$.{n}").isNull(), F.lit(n)) for n in required])
    wrong = F.concat_ws(",", *[F.when(F.get_json_object("value", f"$.{n}").isNotNull() & parsed[n].isNull(), F.lit(n)) for n in fields])
    reason = F.when(F.trim("value") == "", "blank").when(F.try_parse_json("value").isNull() | ~F.trim("value").startswith("{"), "no object").when(missing != "", F.concat(F.lit("missing "), missing)).when(
        wrong != "", F.concat(F.lit("wrong type "), wrong))
    return t.select("file", (F.col("n") + 1).alias("line"), "value", reason.alias("reason")).where("reason IS NOT NULL")


def _papers(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, p variant) of a public benchmark file in any of its shapes: a map of papers, a list, or {"papers": [...]}."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    raw = raw.select(F.coalesce(F.try_variant_get("v", "$.papers", "variant"), F.col("v")).alias("v"))
    # A list explodes by position, a map by key.
    listed = F.try_variant_get("v", "$", "array<variant>")
    mapped = F.try_variant_get("v", "$", "map<string,variant>")
    a = raw.where(listed.isNotNull()).select(F.explode(listed).alias("p")).select(F.coalesce(F.try_variant_get("p", "$.paper_id", "string"), F.try_variant_get("p", "$.id", "string")).alias("paper_id"), "p")
    b = raw.where(listed.isNull() & mapped.isNotNull()).select(F.explode(mapped).alias("paper_id", "p"))
    return a.unionByName(b)


def benchmark_papers(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: (paper_id, title, section_name, paragraph, place) of a public benchmark file; sections as rows or as parallel columns."""
    row = "struct<section_name:string,paragraphs:array<string>>"
    by_row = F.try_variant_get("p", "$.full_text", f"array<{row}>")
    names, texts = F.try_variant_get("p", "$.full_text.section_name", "array<string>"), F.try_variant_get("p", "$.full_text.paragraphs", "array<array<string>>")
    by_column = F.zip_with(names, texts, lambda n, t: F.struct(n.alias("section_name"), t.alias("paragraphs")))
    s = _papers(spark, path).select("paper_id", F.try_variant_get("p", "$.title", "string").alias("title"), F.posexplode(F.coalesce(by_row, by_column)).alias("section_place", "s"))
    return s.select("paper_id", "title", "section_place", F.col("s.section_name").alias("section_name"), F.posexplode("s.paragraphs").alias("place", "paragraph"))


ANSWER = "struct<unanswerable:boolean,extractive_spans:array<string>,free_form_answer:string,yes_no:boolean,evidence:array<string>>"


def benchmark_questions(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: (paper_id, question_id, question, place, answer_place, answer) of the same files; questions and answers as rows or as parallel columns."""
    answer = f"struct<annotation_id:string,answer:{ANSWER}>"
    rows = F.try_variant_get("p", "$.qas", f"array<struct<question_id:string,question:string,answers:array<{answer}>>>")
    column = lambda n, kind: F.try_variant_get("p", f"$.qas.{n}", f"array<{kind}>")
    ids, texts, found = column("question_id", "string"), column("question", "string"), column("answers", f"struct<annotation_id:array<string>,answer:array<{ANSWER}>>")
    columns = F.transform(F.arrays_zip(ids.alias("i"), texts.alias("q"), found.alias("a")), lambda x: F.struct(
        x["i"].alias("question_id"), x["q"].alias("question"), F.transform(x["a"]["answer"], lambda y, k: F.struct(F.get(x["a"]["annotation_id"], k).alias("annotation_id"), y.alias("answer"))).alias("answers")))
    q = _papers(spark, path).select("paper_id", F.posexplode(F.coalesce(rows, columns)).alias("place", "q"))
    return q.select("paper_id", F.col("q.question_id").alias("question_id"), F.col("q.question").alias("question"), "place", F.posexplode("q.answers").alias("answer_place", "a")).select(
        "paper_id", "question_id", "question", "place", "answer_place", F.col("a.answer").alias("answer"))


def verified(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """SRC8: the file's content, or an error where its digest differs."""
    f = spark.read.format("binaryFile").load(path)
    ok = F.sha2("content", 256) == sha256
    return f.select("path", F.when(ok, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("digest differs: "), "path")).cast("binary")).alias("content"))


def uploads(spark: SparkSession, path: str, most: int = 50 << 20) -> DataFrame:
    """SRC14: (path, sha256, problems) of uploaded files. Spark does not list files of no bytes, so these never arrive. A declared type (path, mime) may be
    joined by ``upload_types``."""
    f = spark.read.format("binaryFile").load(path)
    rules = {"suffix": ~F.lower("path").endswith(".pdf"), "header": F.substring("content", 1, 5) != F.lit("%PDF-").cast("binary"), "size": F.col("length") > most}
    return f.select("path", F.sha2("content", 256).alias("sha256"), F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])).alias("problems"))


def upload_types(checked: DataFrame, declared: DataFrame) -> DataFrame:
    """SRC14: the problems of ``uploads`` with those of the declared MIME type."""
    j = checked.join(declared, "path", "left")
    bad = ~F.coalesce("mime", F.lit("")).isin("application/pdf", "application/x-pdf", "application/octet-stream")
    return j.select("path", "sha256", F.when(bad, F.concat("problems", F.array(F.lit("mime")))).otherwise(F.col("problems")).alias("problems"))


def vector_index(spark: SparkSession, path: str, digest: str, model: str, dimension: int) -> DataFrame | None:
    """SRC10: the index, or None if any vector or digest is invalid."""
    try:
        v = spark.read.parquet(path)
    except AnalysisException:  # no such folder, or nothing in it
        return None
    if not {"chunk_id", "position", "vector", "digest", "model"} <= set(v.columns):
        return None
    good = (F.col("digest") == digest) & (F.col("model") == model) & F.coalesce(V.valid_vector(F.col("vector"), dimension), F.lit(False)) & F.col("chunk_id").isNotNull()
    checked = v.agg(F.count("*").alias("n"), F.count_if(good).alias("good"), F.count_distinct("chunk_id").alias("ids")).first()
    return v if checked.n and checked.n == checked.good == checked.ids else None


@F.pandas_udf(BooleanType())
def names_secret(s: pd.Series) -> pd.Series:
    """Does any key of a JSON value, at any depth, name a secret?"""

    def one(text: str | None) -> bool:
        todo = [json.loads(text)] if text else []
        while todo:
            x = todo.pop()
            if isinstance(x, dict):
                if any(re.search(SECRET, k, re.I) for k in x):
                    return True
                todo += x.values()
            elif isinstance(x, list):
                todo += x
        return False

    return s.map(one)


def latest_report(spark: SparkSession, path: str, allowed: list[str]) -> DataFrame:
    """SRC12: the newest report file (time, then name) of an allowed schema version without sensitive keys at any depth."""
    r = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_name").alias("name"), "value")
    r = r.where(F.try_parse_json("value").isNotNull()).where(F.get_json_object("value", "$.schema_version").isin(allowed)).where(~names_secret("value"))
    return r.orderBy(F.col("at").desc(), F.col("name").desc()).limit(1)


def templates(spark: SparkSession, path: str) -> DataFrame:
    """SRC13, SC30: (name, text, sha256, variables) of prompt templates."""
    t = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^([^.]+)", 1).alias("name"), F.col("value").alias("text"))
    return t.select("*", F.sha2("text", 256).alias("sha256"), F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<!\{)\{([a-zA-Z_]\w*)\}(?!\})"), F.lit(1))).alias("variables"))


def rendered(text: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return text


def legacy_import(old: DataFrame, stored: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """SRC15: rows not stored yet, and the counts (imported, skipped, failed); rows without a key fail."""
    good = old.where(F.col(key).isNotNull())
    new = good.join(stored.select(key), key, "left_anti").dropDuplicates([key])
    counts = old.agg(F.count("*").alias("all"), F.count_if(F.col(key).isNull()).alias("failed")).crossJoin(new.agg(F.count("*").alias("imported")))
    return new, counts.select("imported", (F.col("all") - F.col("failed") - F.col("imported")).alias("skipped"), "failed")


def state_digest(row: Column) -> Column:
    """SRC11, SC26: SHA-256 of the canonical JSON of a struct."""
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def content_digest(state: Column) -> Column:
    """SRC11: the digest of a state's JSON without its own metadata, keys sorted (variants are stored so)."""
    v = F.try_parse_json(state)
    return F.sha2(F.to_json(F.struct(F.try_variant_get(v, "$.document", "variant").alias("document"))), 256)


def state_index(entries: DataFrame, states_: DataFrame) -> DataFrame:
    """SRC11: entries (paper_id, digest) of a content-addressed index with the state (digest, value) they name, and whether its content still has that
    digest; a missing state is not valid."""
    j = entries.join(states_, "digest", "left")
    return j.select("paper_id", "digest", "value", F.coalesce(content_digest(F.col("value")) == F.col("digest"), F.lit(False)).alias("valid"))


def relational(spark: SparkSession, url: str, name: str, key: str, parts: int = 8, **options: str) -> DataFrame:
    """SRC9: a table of a relational database, read in ranges of a numeric key; filters and columns are pushed to the database."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    low, high = reader.option("query", f"SELECT min({key}) AS low, max({key}) AS high FROM {name}").load().first()
    reader = spark.read.format("jdbc").option("url", url).options(**options).option("dbtable", name)
    if low is None or low == high:
        return reader.load()
    return reader.option("partitionColumn", key).option("lowerBound", str(low)).option("upperBound", str(high)).option("numPartitions", str(parts)).load()
