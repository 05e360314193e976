"""Sinks: reports, archives, indexes and append-only tables. Spark's commit protocol makes each write whole or absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V


def report_markdown(sections: DataFrame) -> DataFrame:
    """SNK1, TOP8: (report_id, markdown) from sections (report_id, section_order, title, content, evidence_ids)."""
    cite = F.when(F.size("evidence_ids") > 0, F.concat(F.lit("\n\nEvidence: "), F.array_join("evidence_ids", ", "))).otherwise("")
    part = F.concat(F.lit("## "), "title", F.lit("\n\n"), F.coalesce("content", F.lit("")), cite)
    rows = F.array_sort(F.collect_list(F.struct("section_order", part.alias("part"))))
    return sections.groupBy("report_id").agg(F.array_join(F.transform(rows, lambda r: r["part"]), "\n\n").alias("markdown"))


def report_json(sections: DataFrame) -> DataFrame:
    """SNK1: (report_id, json): the report as one object, its sections in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("section_order").alias("order"), "title", F.coalesce("content", F.lit("")).alias("content"), "evidence_ids")))
    return sections.groupBy("report_id").agg(F.to_json(F.struct(F.first("report_id").alias("report_id"), rows.alias("sections"))).alias("json"))


def state_json(chunks: DataFrame) -> DataFrame:
    """SNK1: (paper_id, json): states as ``readers.states`` reads them, from chunks (paper_id, position, chunk_id, text, section, page_start, page_end)."""
    c = F.transform(F.array_sort(F.collect_list(F.struct("position", "chunk_id", "text", "section", "page_start", "page_end"))), lambda r: F.struct(*[r[n].alias(n) for n in ("chunk_id", "text", "section", "page_start", "page_end")]))
    meta = F.struct(F.first("paper_id").cast("string").alias("paper_id"))
    return chunks.groupBy("paper_id").agg(F.to_json(F.struct(F.struct(meta.alias("metadata"), c.alias("chunks")).alias("document"))).alias("json"))


def conversation_markdown(messages: DataFrame, cited: DataFrame, key: str = "conv_id") -> DataFrame:
    """SNK4: (key, markdown): messages (key, message_id, turn, role, text) in order, each with the evidence (message_id, place, evidence_id, text) it cites."""
    line = F.concat(F.lit("> ["), "evidence_id", F.lit("] "), T.short(F.col("text")))
    per = cited.groupBy("message_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda r: r["line"]), "\n").alias("quotes"))
    part = F.concat(F.lit("**"), "role", F.lit("**\n\n"), F.coalesce("text", F.lit("")), F.when(F.col("quotes").isNotNull(), F.concat(F.lit("\n\n"), "quotes")).otherwise(""))
    rows = F.array_sort(F.collect_list(F.struct("turn", "message_id", part.alias("part"))))
    return messages.join(per, "message_id", "left").groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["part"]), "\n\n").alias("markdown"))


def report_html(sections: DataFrame) -> DataFrame:
    """SNK2: (report_id, html)."""
    part = F.concat(F.lit("<section><h2>"), T.html_escape(F.col("title")), F.lit("</h2><p>"), T.html_escape(F.coalesce("content", F.lit(""))), F.lit("</p></section>"))
    rows = F.array_sort(F.collect_list(F.struct("section_order", part.alias("part"))))
    return sections.groupBy("report_id").agg(F.concat(F.lit("<!DOCTYPE html><html><body>"), F.array_join(F.transform(rows, lambda r: r["part"]), ""), F.lit("</body></html>")).alias("html"))


def matrix_markdown(cells: DataFrame, documents: list[str]) -> DataFrame:
    """SNK3: a comparison's matrix as a Markdown table, one line per row (dimension, doc, summary)."""
    wide = cells.groupBy("dimension").pivot("doc", documents).agg(F.first("summary"))
    return wide.select("dimension", F.concat(F.lit("| "), F.concat_ws(" | ", "dimension", *[T.table_cell(F.coalesce(F.col(f"`{d}`"), F.lit("-"))) for d in documents]), F.lit(" |")).alias("line"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """SNK7."""
    df.write.mode("overwrite").json(path)


def write_vector_index(vectors: DataFrame, path: str, digest: str, model: str) -> None:
    """SNK5: L2-normalised vectors with the digests that a reader checks."""
    v = vectors.select("chunk_id", "position", V.unit(F.col("vector")).cast("array<float>").alias("vector"), F.lit(digest).alias("digest"), F.lit(model).alias("model"))
    v.write.mode("overwrite").parquet(path)


def write_new(rows: DataFrame, stored: DataFrame | None, path: str, content: Column) -> DataFrame:
    """SNK6: content-addressed: rows whose digest is not stored yet, once each, appended under their digest."""
    new = rows.withColumn("digest", F.sha2(content, 256)).dropDuplicates(["digest"])
    if stored is not None:
        new = new.join(stored.select("digest"), "digest", "left_anti")
    new.write.mode("append").parquet(path)
    return new


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """SNK10: only the partitions that rows holds are overwritten."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def pending(cases: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """SNK12, JN15, STR8: what a resumed evaluation still has to do."""
    return cases.join(done.select(*key).distinct(), key, "left_anti")
