"""Evidence, citations, conversation history and report quality."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import text as T
from ..schemas import DEFAULTS
from ..session import written
from . import scans
from .retrieval import overlaps_pages


def evidence_ids(ranked: DataFrame, query_number: Column) -> DataFrame:
    """WIN2, SC24: ev_q001_r002."""
    return ranked.withColumn("evidence_id", F.format_string("ev_q%03d_r%03d", query_number, F.col("rank")))


def neighbours(hits: DataFrame, chunks: DataFrame, key: str = "scope", width: int = 1, pages: tuple[int, int] | None = None) -> DataFrame:
    """JN7: the chunks right before and after a hit in the unscoped list of its document, if of the same section and, where a range of pages is
    asked for, overlapping it."""
    near = hits.select("query_id", F.col("chunk_id").alias("hit_id"), key, F.col("section").alias("hit_section"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("relation"), (F.col("chunk_index") + d).alias("chunk_index")) for n, d in (("before", -width), ("after", width))])).alias("x"))
    near = near.select("query_id", "hit_id", key, "hit_section", "x.*")
    if pages:
        chunks = chunks.where(overlaps_pages(F.col("page_start"), F.col("page_end"), F.lit(pages[0]), F.lit(pages[1])))
    j = near.join(chunks.select(key, "chunk_index", "chunk_id", "section", "text"), [key, "chunk_index"])
    return j.where(F.col("section").eqNullSafe(F.col("hit_section"))).select("query_id", "hit_id", "relation", "chunk_id", "section", "text")


def evidence_budget(ranked: DataFrame, budget: int = DEFAULTS.evidence_tokens, wrapper: int = DEFAULTS.evidence_wrapper) -> DataFrame:
    """WIN7: passages in rank order while they fit; the first that does not is truncated, and nothing follows it.

    A query has at most the retrieval's evidence cap of passages, so the running sum's partitions are small."""
    df = ranked.withColumn("text", F.substring(T.strip(F.coalesce("text", F.lit(""))), 1, DEFAULTS.passage_chars)).where("text <> ''")
    df = df.withColumn("tokens", T.estimate_tokens(F.col("text")))
    before = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("room", F.lit(budget) - F.coalesce(F.sum(F.col("tokens") + wrapper).over(before), F.lit(0)) - wrapper)
    # Behind a misfit the running sum is beyond the budget for good.
    cut = T.truncated(F.col("text"), F.col("room"))
    out = df.where("room > 0").withColumn("whole", F.col("tokens") <= F.col("room")).withColumn("text", F.when(F.col("tokens") <= F.col("room"), F.col("text")).otherwise(cut))
    return out.where("text <> ''").drop("room", "tokens")


def eligible(messages: DataFrame) -> DataFrame:
    """FLT9: said by user or assistant, not blank; an assistant's only when completed."""
    done = F.coalesce(F.col("status"), F.lit("completed")) == "completed" if "status" in messages.columns else F.lit(True)
    content = T.strip(F.coalesce("text", F.lit("")))
    return messages.withColumn("text", content).where((F.col("text") != "") & F.col("role").isin("user", "assistant") & ((F.col("role") != "assistant") | done))


def history(messages: DataFrame, limit: int = DEFAULTS.history_messages, budget: int = DEFAULTS.history_tokens, key: str = "conv_id") -> DataFrame:
    """WIN8: the newest messages that fit, none skipped; only when even the newest does not fit is it truncated."""
    df = eligible(messages).withColumn("n", F.row_number().over(W.partitionBy(key).orderBy(F.col("turn").desc()))).where(F.col("n") <= limit)
    wrapper = T.estimate_tokens(F.concat(F.lit("<"), F.col("role"), F.lit("></"), F.col("role"), F.lit(">")))
    df = df.withColumn("wrapper", wrapper).withColumn("cost", F.col("wrapper") + T.estimate_tokens(F.col("text")))
    df = df.withColumn("spent", F.sum("cost").over(W.partitionBy(key).orderBy("n").rowsBetween(W.unboundedPreceding, 0)))
    fits = F.col("spent") <= budget
    first = (F.col("n") == 1) & ~fits & (F.col("wrapper") < budget)
    out = df.where(fits | first).withColumn("text", F.when(fits, F.col("text")).otherwise(T.truncated(F.col("text"), F.lit(budget) - F.col("wrapper"))))
    return out.where("text <> ''").drop("n", "wrapper", "cost", "spent")


def previous_user_turn(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """WIN10: for each user turn the latest earlier user text that differs from it, and both joined as the fallback query."""
    users = messages.where("role = 'user'").select(key, "turn", T.strip(F.coalesce("text", F.lit(""))).alias("q"))
    parts = scans.parted(users, key, ["turn"])
    # Runs of equal texts share their predecessor: the text before the run.
    df = scans.previous(parts, ["q"], keep=True)
    df = df.withColumn("prior", F.when(F.coalesce(F.col("__before_q") != F.col("q"), F.lit(True)), F.col("__before_q")))
    df = scans.last_known(scans.Parts(written(df), key, parts.order), "prior", "earlier")
    df = df.withColumn("previous", F.coalesce("prior", "earlier", F.lit("")))
    return df.select(key, "turn", "previous", F.concat_ws(" ", F.nullif(F.col("previous"), F.lit("")), F.nullif(F.col("q"), F.lit(""))).alias("fallback_query"))


def cited_evidence(messages: DataFrame, evidence: DataFrame) -> DataFrame:
    """JN10: evidence a message cites, in citation order."""
    cites = messages.select("message_id", F.posexplode("citation_ids").alias("place", "evidence_id"))
    return cites.join(evidence, ["message_id", "evidence_id"])


def whitelisted(cells: DataFrame, allowed: DataFrame, key: str = "report_id") -> DataFrame:
    """FLT15: evidence_ids of every cell cut down to the report's allowed ids, with the number removed."""
    a = allowed.groupBy(key).agg(F.collect_set("evidence_id").alias("__ok"))
    j = cells.join(a, key, "left").withColumn("__ok", F.coalesce("__ok", F.array().cast("array<string>")))
    clean = F.filter("evidence_ids", lambda e: F.exists("__ok", lambda o: o == e))
    return j.withColumn("__clean", clean).withColumn("removed", F.size("evidence_ids") - F.size("__clean")).withColumn("evidence_ids", F.col("__clean")).drop("__clean", "__ok")


def report_quality(sections: DataFrame, evidence: DataFrame, chunks: DataFrame, critical: int = 65, pass_score: int = 75, citation_score: int = 90) -> DataFrame:
    """JN11, AGG21. sections: (report_id, section_id, title, content, evidence_ids); evidence: (report_id, evidence_id, chunk_id, section,
    page_start, page_end); chunks: (chunk_id, section, page_start, page_end). One row of scores per report."""
    s = sections.withColumn("ids", F.array_distinct("evidence_ids"))
    refs = s.select("report_id", F.explode("ids").alias("evidence_id")).alias("r")
    e, c = evidence.alias("e"), chunks.alias("c")
    j = refs.join(e, (F.col("r.report_id") == F.col("e.report_id")) & (F.col("r.evidence_id") == F.col("e.evidence_id")), "left")
    j = j.join(c, F.col("e.chunk_id") == F.col("c.chunk_id"), "left")
    known, traced = F.col("e.evidence_id").isNotNull(), F.col("c.chunk_id").isNotNull()
    same = F.col("e.section").eqNullSafe(F.col("c.section")) & F.col("e.page_start").eqNullSafe(F.col("c.page_start")) & F.col("e.page_end").eqNullSafe(F.col("c.page_end"))
    counts = j.groupBy(F.col("r.report_id").alias("report_id")).agg(F.count("*").alias("refs"), F.count_if(known).alias("valid"), F.count_if(~known | ~traced | ~same).alias("issues"))
    written = T.strip(F.coalesce("content", F.lit(""))) != ""
    heads = s.groupBy("report_id").agg(F.count_if(written).alias("key_sections"), F.count_if(written & (F.size("ids") > 0)).alias("cited"),
                                       F.max(F.when(F.lower("title").rlike("limit|critic|局限|批判"), 85).otherwise(critical)).alias("critical"))
    q = heads.join(counts, "report_id", "left").na.fill(0, ["refs", "valid", "issues"])
    q = q.withColumn("validity", F.when(F.col("refs") > 0, F.bround(100 * F.col("valid") / F.col("refs"))).otherwise(100).cast("long"))
    q = q.withColumn("coverage", F.when(F.col("key_sections") > 0, F.col("cited") / F.col("key_sections")).otherwise(1.0))
    q = q.withColumn("faithfulness", F.greatest(F.lit(0), 100 - 12 * F.col("issues")).cast("long"))
    q = q.withColumn("completeness", F.bround(55 + 45 * F.col("coverage")).cast("long")).withColumn("accuracy", F.least("validity", "faithfulness"))
    total = (F.col("accuracy") + F.col("completeness") + F.col("faithfulness") + F.col("validity") + F.col("critical")) / 5
    q = q.withColumn("overall", F.bround(total).cast("long"))
    passed = (F.col("issues") == 0) & (F.col("overall") >= pass_score) & (F.col("validity") >= citation_score)
    return q.select("report_id", "refs", "issues", "validity", "coverage", "faithfulness", "completeness", "accuracy", "overall", passed.alias("passed"))


def merged_notes(notes: DataFrame) -> DataFrame:
    """AGG23: per report the branches' texts in plan order without repeats, their list items, and the gaps."""
    seq = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("position", c))), lambda r: r[c])
    texts = F.array_distinct(F.filter(seq("text"), lambda t: t.isNotNull() & (t != "")))
    items = F.array_distinct(F.flatten(F.filter(seq("items"), lambda x: x.isNotNull())))
    gaps = F.transform(F.array_sort(F.collect_list(F.when(F.col("failed"), F.struct("position", "question")))), lambda r: r["question"])
    return notes.groupBy("report_id").agg(
        F.array_join(texts, "\n").alias("text"), items.alias("items"), gaps.alias("gaps"), F.count("*").alias("branches"), F.count_if("failed").alias("failed_branches"))


def conversation_archive(messages: DataFrame, cited: DataFrame | None = None, key: str = "conv_id") -> DataFrame:
    """SNK4: one JSON document per conversation, messages in order, only cited evidence."""
    row = [F.col("turn"), F.col("role"), F.col("text")]
    if cited is not None:
        per = cited.groupBy("message_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "evidence_id", "text"))), lambda r: F.struct(r["evidence_id"].alias("id"), r["text"].alias("text"))).alias("evidence"))
        messages, row = messages.join(per, "message_id", "left"), [*row, F.col("evidence")]
    return messages.groupBy(key).agg(F.count("*").alias("messages"), F.to_json(F.array_sort(F.collect_list(F.struct(*row)))).alias("archive"))


def location(page_start: Column, page_end: Column, section: Column) -> Column:
    """SC29: where a passage stands."""
    start, end = page_start.cast("string"), page_end.cast("string")
    page = F.when(page_start.isNull(), "unknown page").when(page_end.isNull() | (page_start == page_end), F.concat(F.lit("page "), start)).otherwise(F.concat(F.lit("pages "), start, F.lit("-"), end))
    return F.concat(page, F.lit(", "), F.coalesce(F.nullif(section, F.lit("")), F.lit("unknown section")))


def context(passages: DataFrame, key: str = "query_id", most: int | None = None) -> DataFrame:
    """SC29: (key, context): the passages (rank, chunk_id, evidence_id or null, page_start, page_end, section, text) of a prompt as blocks in rank order."""
    head = F.concat(F.when(F.col("evidence_id").isNotNull(), F.concat(F.lit("[Evidence ID: "), "evidence_id", F.lit("]\n"))).otherwise(""), F.lit("[Chunk ID: "), F.col("chunk_id"), F.lit("]\n"))
    block = F.concat(head, F.lit("[Location: "), location(F.col("page_start"), F.col("page_end"), F.col("section")), F.lit("]\n"), F.coalesce("text", F.lit("")))
    some = passages.where(F.col("rank") <= most) if most else passages
    rows = F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda r: r["block"])
    return some.groupBy(key).agg(F.array_join(rows, "\n\n---\n\n").alias("context"))


ALLOWED = StructType([StructField("payload", StringType()), StructField("removed", IntegerType())])


@F.pandas_udf(ALLOWED)
def whitelisted_json(payload: pd.Series, allowed: pd.Series) -> pd.DataFrame:
    """FLT15 at any depth: every list under a key evidence_ids of a JSON value keeps only the allowed ids; canonical JSON and the number removed."""
    out = []
    for text, ids in zip(payload, allowed, strict=True):
        if text is None:
            out.append((None, 0))
            continue
        ok, gone, value = set(() if ids is None else ids), 0, json.loads(text)
        todo = [value]
        while todo:
            x = todo.pop()
            if isinstance(x, dict):
                for k, v in x.items():
                    if k == "evidence_ids" and isinstance(v, list):
                        x[k] = [i for i in v if isinstance(i, str) and i in ok]
                        gone += len(v) - len(x[k])
                    else:
                        todo.append(v)
            elif isinstance(x, list):
                todo += x
        out.append((json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")), gone))
    return pd.DataFrame(out, columns=["payload", "removed"])
