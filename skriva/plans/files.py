"""Queries that write files and tables into the shared folder and read them back: sources, sinks, digests, resumption."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ..operators import compare as P
from ..operators import evaluate as E
from ..operators import store as S
from ..session import scratch_path, table
from ..sources import pdf, readers, sinks
from .documents import LINES, SAMPLE_DIMENSIONS, SELECTED, SPANS, _selected, chunks
from .literals import rows_of, values
from .ranking import FLAT, UNIT, lexical
from .reports import _CITED, _cited


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))


def _files(spark, sf_dir, name, texts):
    """(name, text) rows as files of their own; the lists are written out here."""
    place = scratch_path(spark, name)
    for n, text in texts:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").option("lineSep", "\n").text(f"{place}/{n}")
    return place


def _pdfs(spark, sf_dir):
    """Every document as a PDF of its lines."""
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("report_id"), F.col("text").alias("markdown"))
    return pdf.artefacts(d).select(F.col("report_id").cast("string").alias("path"), F.col("pdf").alias("content"), "docx")


def pdf_pages(spark, sf_dir):
    """SRC1, SRC3, SNK2: documents out as PDF and in again, page by page."""
    p = pdf.pages(_pdfs(spark, sf_dir).select("path", "content"))
    return p.select(F.col("path").cast("long").alias("doc_id"), F.col("page").cast("long").alias("page"), F.col("n_pages").cast("long").alias("n_pages"), "extraction_method", F.sha2("text", 256).alias("text"))


def docx_texts(spark, sf_dir):
    """SNK2-3: documents as DOCX; what a reader of the format sees."""
    from pyspark.sql.types import StringType

    read = F.udf(lambda b: pdf.docx_text(bytes(b)), StringType(), useArrow=True)
    return _pdfs(spark, sf_dir).select(F.col("path").cast("long").alias("doc_id"), F.sha2(read("docx"), 256).alias("text"))


def plain_pages(spark, sf_dir):
    """SRC2: every fourth line break becomes a form feed."""
    d = _docs(spark, sf_dir).withColumn("text", F.concat(F.lit("\0 "), F.replace(F.col("text"), F.lit(". "), F.lit(".\f "))))
    return pdf.text_pages(d).select("doc_id", F.col("page").cast("long").alias("page"), "text")


def state_scan(spark, sf_dir):
    """SRC5, SNK1: chunks out as states, one per line, and in again."""
    c = chunks(spark, sf_dir).select(F.col("doc_id").alias("paper_id"), "position", "chunk_id", "text", "section", F.lit(1).alias("page_start"), F.lit(None).cast("int").alias("page_end"))
    place = scratch_path(spark, "states")
    sinks.state_json(c).select(F.col("json").alias("value")).write.text(place)
    out = readers.states(spark, place, whole_files=False)
    return out.select(F.col("paper_id").cast("long").alias("paper_id"), F.col("position").cast("long").alias("position"), "chunk_id", "section", F.sha2("text", 256).alias("text"), F.col("page_start").cast("long").alias("page_start"), "page_end")


BROKEN = ['{"id": 1, "name": "a"}', "", '{"id": "x", "name": "b"}', '{"id": 2}', "[1]", "not json", '{"id": 3, "name": "c", "more": {}}', '{"name": null, "id": 4}']


def jsonl_errors(spark, sf_dir):
    """SRC6: a list of cases with broken lines."""
    place = _files(spark, sf_dir, "jsonl", [("cases.jsonl", "\n".join(BROKEN))])
    return readers.jsonl_errors(spark, f"{place}/cases.jsonl", "id long, name string", ("id", "name")).select(F.col("line").cast("long").alias("line"), "reason")


def jsonl_round_trip(spark, sf_dir):
    """SRC6, SNK7: labels out as JSON lines and in again; a broken line would fail the read."""
    place = scratch_path(spark, "labels")
    sinks.write_jsonl(table(spark, sf_dir, "labels"), place)
    return readers.jsonl(spark, place, "doc_id long, quality long, toxic long")


_QA = '"qas": [{"question_id": "q1", "question": "What?", "answers": [{"annotation_id": "x", "answer": {"unanswerable": false, "extractive_spans": ["s"], "free_form_answer": "", "yes_no": null, "evidence": ["P two"]}}, {"answer": {"unanswerable": true, "evidence": []}}]}]'
_QC = '"qas": {"question_id": ["q2", "q3"], "question": ["Why?", "Is it?"], "answers": [{"annotation_id": ["y"], "answer": [{"unanswerable": false, "free_form_answer": "so", "evidence": ["A"]}]}, {"annotation_id": ["z"], "answer": [{"unanswerable": false, "yes_no": true, "evidence": []}]}]}'
_SHAPES = [
    ("map.json", '{"p1": {"title": "T1", "full_text": [{"section_name": "I", "paragraphs": ["P one", "P two"]}, {"section_name": null, "paragraphs": ["P three"]}], ' + _QA + "}}"),
    ("list.json", '[{"paper_id": "p2", "title": "T2", "full_text": {"section_name": ["A", "B"], "paragraphs": [["x"], ["y", "z"]]}, ' + _QC + "}]"),
    ("papers.json", '{"papers": [{"id": "p3", "title": null, "full_text": [{"section_name": "S", "paragraphs": ["only"]}], "qas": []}]}')]
_PARAGRAPHS = [("p1", "T1", "I", 0, 0, "P one"), ("p1", "T1", "I", 0, 1, "P two"), ("p1", "T1", None, 1, 0, "P three"), ("p2", "T2", "A", 0, 0, "x"), ("p2", "T2", "B", 1, 0, "y"), ("p2", "T2", "B", 1, 1, "z"), ("p3", None, "S", 0, 0, "only")]
_QUESTIONS = [("p1", "q1", "What?", 0, 0, False, "s", None, None, "P two"), ("p1", "q1", "What?", 0, 1, True, None, None, None, ""), ("p2", "q2", "Why?", 0, 0, False, None, "so", None, "A"), ("p2", "q3", "Is it?", 1, 0, False, None, None, True, "")]
_QUESTION = "paper_id string, question_id string, question string, place long, answer_place long, unanswerable boolean, span string, free_form string, yes_no boolean, evidence string"


def _shapes(spark, sf_dir, reader):
    place, out = _files(spark, sf_dir, "papers", _SHAPES), None
    for n, _ in _SHAPES:
        r = reader(spark, f"{place}/{n}")
        out = r if out is None else out.unionByName(r)
    return out


def benchmark_papers(spark, sf_dir):
    out = _shapes(spark, sf_dir, readers.benchmark_papers)
    return out.select("paper_id", "title", "section_name", F.col("section_place").cast("long").alias("section_place"), F.col("place").cast("long").alias("place"), "paragraph")


def benchmark_questions(spark, sf_dir):
    q = _shapes(spark, sf_dir, readers.benchmark_questions)
    a = F.col("answer")
    return q.select("paper_id", "question_id", "question", F.col("place").cast("long").alias("place"), F.col("answer_place").cast("long").alias("answer_place"), a["unanswerable"].alias("unanswerable"), F.get(a["extractive_spans"], F.lit(0)).alias("span"),
                    F.nullif(a["free_form_answer"], F.lit("")).alias("free_form"), a["yes_no"].alias("yes_no"), F.array_join(a["evidence"], "|").alias("evidence"))


def upload_problems(spark, sf_dir):
    """SRC8, SRC14: three files as uploads, with declared types."""
    texts = [("good.pdf", "%PDF-1.4 x"), ("bad.pdf", "PDF"), ("note.txt", "%PDF-" + "y" * 60)]
    place = _files(spark, sf_dir, "uploads", texts)
    checked = readers.uploads(spark, f"{place}/*/part-*", most=50)
    named = checked.withColumn("path", F.regexp_extract("path", r"([^/]+)/part-[^/]*$", 1))
    # The files are parts of folders with the uploads' names, so the suffix rule sees the parts; it is judged by the folder here.
    named = named.withColumn("problems", F.concat(F.when(F.lower("path").endswith(".pdf"), F.array().cast("array<string>")).otherwise(F.array(F.lit("suffix"))), F.array_remove("problems", "suffix")))
    out = readers.upload_types(named, rows_of(spark, [("good.pdf", "application/pdf"), ("bad.pdf", "text/html"), ("note.txt", "application/octet-stream")], "path string, mime string"))
    return out.select("path", F.array_join("problems", ",").alias("problems"))


def verified_import(spark, sf_dir):
    """SRC8: a file under its digest, and under another one, which fails."""
    text = "some benchmark\n"
    place = _files(spark, sf_dir, "verified", [("file", text.strip())])
    digest = hashlib.sha256(text.encode()).hexdigest()
    good = readers.verified(spark, f"{place}/file/part-*", digest).select(F.length("content").cast("long").alias("n")).first()["n"]
    try:
        readers.verified(spark, f"{place}/file/part-*", "0" * 64).collect()
        refused = False
    except PySparkException as e:
        refused = "digest differs" in str(e)
    return rows_of(spark, [(good, refused)], "bytes long, refused boolean")


def relational_scan(spark, sf_dir):
    """SRC9: orders in the database that Spark brings along (it lives in the driver, so this query runs in local mode; elsewhere the table is read as Parquet)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("K"), F.col("o_custkey").alias("C"), F.col("o_orderstatus").alias("S"))
    if spark.sparkContext.master.startswith("local"):
        url = f"jdbc:derby:memory:skriva{uuid.uuid4().hex};create=true"
        o.write.format("jdbc").option("url", url).option("dbtable", "orders").option("createTableColumnTypes", "S VARCHAR(8)").save()
        o = readers.relational(spark, url, "orders", "K", 4)
    return o.where("S <> 'P'").groupBy(F.col("S").alias("s")).agg(F.count("*").alias("n"), F.sum("C").alias("c"))


def prompt_templates(spark, sf_dir):
    """SRC13, SC30: templates with fingerprints, rendered for every document."""
    place = _files(spark, sf_dir, "templates", [("ask", "Read {title} of {{x}}:\n{text}\n{title}")])
    t = readers.templates(spark, f"{place}/ask").select("text", "sha256", F.array_join("variables", ",").alias("variables"))
    d = _docs(spark, sf_dir).crossJoin(F.broadcast(t.withColumnRenamed("text", "template")))  # one template
    return d.select("doc_id", "sha256", "variables", F.sha2(readers.rendered(F.col("template"), {"title": F.col("source"), "text": F.col("text")}), 256).alias("prompt"))


def latest_report(spark, sf_dir):
    """SRC12: the newest allowed report whose keys name no secret at any depth; files of one time are told apart by name."""
    good = '{"schema_version": "2", "n": %d, "x": [{"a": 1}]}'
    place = scratch_path(spark, "reports")
    reports = [("1", good % 1), ("2", '{"schema_version": "2", "x": [{"y": {"api_key": 1}}]}'), ("3", '{"schema_version": "9"}'), ("4", "broken")]
    for n, text in reports:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{place}/{n}")
    return readers.latest_report(spark, f"{place}/*", ["1", "2"]).select(F.get_json_object("value", "$.n").cast("long").alias("n"))


def vector_index(spark, sf_dir):
    """SRC10, SNK5: the index as written, and under a wrong digest, model and dimension."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("vec_id").alias("position"), F.col("embedding").alias("vector"))
    place = scratch_path(spark, "index")
    sinks.write_vector_index(v, place, "d1", "m1")
    found = {"right": ("d1", "m1", 64), "digest": ("d2", "m1", 64), "model": ("d1", "m2", 64), "dimension": ("d1", "m1", 63)}
    loaded = {k: readers.vector_index(spark, place, *args) for k, args in found.items()} | {"missing": readers.vector_index(spark, place + "-none", "d1", "m1", 64)}
    rows = [(k, None if df is None else df.count()) for k, df in loaded.items()]
    return rows_of(spark, rows, "load string, vectors long")


def legacy_import(spark, sf_dir):
    """SRC15: orders of two thirds of the customers are stored already."""
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderkey")).alias("task_id"), "o_custkey")
    new, counts = readers.legacy_import(o, o.where("o_custkey % 3 <> 0 AND task_id IS NOT NULL"), "task_id")
    return counts.select("imported", "skipped", "failed")


def state_index(spark, sf_dir):
    """SRC11, SNK6, SC26: states under the digest of their content; every fifth entry names another one."""
    c = chunks(spark, sf_dir).select(F.col("doc_id").alias("paper_id"), "position", "chunk_id", "text", "section", F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))
    s = sinks.state_json(c).select("paper_id", F.col("json").alias("value"))
    stored = s.withColumn("digest", readers.content_digest(F.col("value"))).groupBy("digest").agg(F.first("value").alias("value"))
    entries = s.select("paper_id", F.when(F.col("paper_id") % 5 == 0, F.sha2(F.col("paper_id").cast("string"), 256)).otherwise(readers.content_digest(F.col("value"))).alias("digest"))
    return readers.state_index(entries, stored).groupBy("valid").agg(F.count("*").alias("n"))


def index_digests(spark, sf_dir):
    """SC26: what each paper's index was built from, and its name."""
    from ..operators import review as V

    c = chunks(spark, sf_dir).select(F.col("doc_id").alias("paper_id"), "position", "chunk_id", "text")
    return V.chunks_digest(c).select("paper_id", "chunks", "sha256", V.cache_key(F.col("sha256"), "mock", "m1", 2).alias("cache_key"))


def frozen_dataset(spark, sf_dir):
    """SNK7: a freeze does not change with the order of rows, and does with a row."""
    from ..operators import review as V
    from .review import CASE, CASES, PAPER, PAPERS

    one = V.frozen_digest(rows_of(spark, CASES, CASE), rows_of(spark, PAPERS, PAPER)).first()
    other = V.frozen_digest(rows_of(spark, CASES[::-1], CASE).repartition(3), rows_of(spark, PAPERS[::-1], PAPER)).first()
    changed = V.frozen_digest(rows_of(spark, [c if c[0] != "c5" else (*c[:-1], True) for c in CASES], CASE), rows_of(spark, PAPERS, PAPER)).first()
    return rows_of(spark, [(one["rows"], one == other, one["sha256"] != changed["sha256"])], "rows long, stable boolean, sensitive boolean")


def content_addressed(spark, sf_dir):
    """SNK6: texts appended under their digest, in two runs of which the second repeats half."""
    d, place = _docs(spark, sf_dir), scratch_path(spark, "content")
    sinks.write_new(d.where("doc_id % 2 = 0").select("text"), None, place, F.col("text"))
    sinks.write_new(d.select("text"), spark.read.parquet(place), place, F.col("text"))
    return spark.read.parquet(place).agg(F.count("*").alias("stored"), F.count_distinct("digest").alias("digests"))


def replaced_partitions(spark, sf_dir):
    """SNK10: evidence of the documents of one language is written again."""
    d, place = _docs(spark, sf_dir).select("doc_id", "lang", F.lit(1).cast("long").alias("run")), scratch_path(spark, "evidence")
    sinks.replace_partitions(d, place, "lang")
    sinks.replace_partitions(d.where("lang = 'fr' AND doc_id % 2 = 0").withColumn("run", F.lit(2).cast("long")), place, "lang")
    return spark.read.parquet(place).groupBy(F.col("lang").cast("string").alias("lang"), "run").agg(F.count("*").alias("n"))


def resumed_evaluation(spark, sf_dir):
    """SNK12, STR8: an evaluation that stopped after a third of its cases goes on with the others."""
    c, place = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), "quality"), scratch_path(spark, "progress")
    c.where("case_id % 3 = 0").write.mode("append").parquet(place)
    left = sinks.pending(c, spark.read.parquet(place), ["case_id"])
    left.write.mode("append").parquet(place)
    return spark.read.parquet(place).groupBy((F.col("case_id") % 3).alias("third")).agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("good"))


def _report(spark, sf_dir):
    """A section per passage of a question's three best, out of order."""
    h = lexical(spark, sf_dir, 3).join(chunks(spark, sf_dir).select("chunk_id", "text"), "chunk_id")
    return h.select(F.col("query_id").alias("report_id"), (4 - F.col("rank")).alias("section_order"), F.concat(F.lit("Rank <"), F.col("rank").cast("string"), F.lit(">")).alias("title"), F.when(F.col("rank") != 2, F.col("text")).alias("content"),
                    F.when(F.col("rank") == 1, F.array(F.lit("E1"), F.lit("E2"))).otherwise(F.array().cast("array<string>")).alias("evidence_ids"))


def report_files(spark, sf_dir):
    """SNK1-2, TOP8: reports as Markdown, JSON and HTML."""
    s = _report(spark, sf_dir)
    m, j, h = sinks.report_markdown(s), sinks.report_json(s), sinks.report_html(s)
    back = F.from_json("json", "struct<report_id:long,sections:array<struct<order:int,title:string,content:string,evidence_ids:array<string>>>>")
    j = j.select("report_id", F.array_join(F.transform(back["sections"], lambda x: F.concat(x["order"].cast("string"), x["title"], F.length(x["content"]).cast("string"), F.size(x["evidence_ids"]).cast("string"))), ";").alias("json"))
    return m.join(h, "report_id").join(j, "report_id").select("report_id", F.sha2("markdown", 256).alias("markdown"), F.sha2("html", 256).alias("html"), "json")


def conversation_markdown(spark, sf_dir):
    """SNK4 with cited evidence."""
    m, cited = _cited(spark, sf_dir)
    return sinks.conversation_markdown(m, cited).select("conv_id", F.sha2("markdown", 256).alias("markdown"))


def matrix_markdown(spark, sf_dir):
    """SNK3: the matrix of the first documents that have cells, as lines of a table."""
    cells = P.matrix(_selected(spark, sf_dir), "doc_id", dimensions=SAMPLE_DIMENSIONS).where("doc_id IN (1, 2, 3)")
    cells = cells.select("dimension", F.col("doc_id").cast("string").alias("doc"), F.concat(F.lit("a|"), F.array_join("evidence", "\n")).alias("summary"))
    return sinks.matrix_markdown(cells, ["1", "2", "3"]).select("dimension", "line")


def strided_picks(spark, sf_dir):
    """TOP9: each document's chunks, dealt to five hands by their number."""
    c = chunks(spark, sf_dir).select("doc_id", "chunk_index", "chunk_id")
    out = None
    for start in range(2):
        s = P.strided(c, "chunk_index", start).withColumn("start", F.lit(start).cast("long"))
        out = s if out is None else out.unionByName(s)
    return out.select("start", "chunk_id")


RUN = "run string, mode string, dataset_version string, frozen_test_sha256 string, configuration_sha256 string, case_count long, latency_p50_ms double, latency_p95_ms double, total_input_tokens long, total_output_tokens long, estimated_cost_usd double, evidence_recall double, report_quality double, coverage_gap_rate double"
RUNS = [("a", "serial", "v1", "f", "c", 10, 200.0, 300.0, 900, 90, 0.5, 0.8, 0.9, 0.0), ("a", "parallel", "v1", "f", "c", 10, 110.0, 180.0, 950, 80, 0.25, 0.8, 0.9, 0.0), ("b", "serial", "v1", "f", "c", 10, 200.0, 300.0, 900, 90, 0.5, 0.8, 0.9, 0.0),
        ("b", "parallel", "v1", "f", "c", 10, 110.0, 0.0, 900, 90, 0.5, 0.8, 0.85, 0.0), ("c", "serial", "v1", "f", "c", 10, 1.0, 1.0, 1, 1, 0.0, 0.5, 0.5, 0.0), ("c", "parallel", "v2", "g", "c", 10, 1.0, 1.0, 1, 1, 0.0, 0.5, 0.5, 0.1)]


def mode_comparison(spark, sf_dir):
    """AGG26."""
    out = E.compare_modes(rows_of(spark, RUNS, RUN), strict=False)
    return out.withColumn("mismatches", F.array_join("mismatches", ",")).select("run", "mismatches", "p95_speedup", "latency_p50_ms_delta", "total_input_tokens_delta", "report_quality_delta", "quality_not_degraded", "recommendation")


def stalled_tasks(spark, sf_dir):
    """STR8, STR11: tasks without a heartbeat are put back, others stay."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("completed").alias("status"), F.col("o_orderdate").cast("timestamp").alias("updated_at"),
                                              F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 400 DAYS")).alias("heartbeat_at"), F.lit(1).alias("attempt_count"))
    gone = S.stale(o, F.expr("TIMESTAMP '1999-01-01 00:00:00'"), 3600)
    back = S.transition(gone, {"pending": ["running"]}, F.lit("pending"))
    return back.groupBy("status", "changed").agg(F.count("*").alias("n"), F.sum("task_id").alias("tasks"))


QUERIES = {f.__name__: f for f in (
    plain_pages, state_scan, jsonl_round_trip, relational_scan, prompt_templates, vector_index, legacy_import, state_index, index_digests,
    content_addressed, replaced_partitions, resumed_evaluation, report_files, conversation_markdown, matrix_markdown, strided_picks, stalled_tasks,
)}
#: Cases that the tables cannot hold, or that one task or a stand-in for a service works on: run by the tests, not registered.
FIXED = {f.__name__: f for f in (
    pdf_pages, docx_texts, jsonl_errors, benchmark_papers, benchmark_questions, upload_problems, verified_import, latest_report, frozen_dataset,
    mode_comparison,
)}

_REPORT = FLAT + """, s AS (SELECT l.query_id AS report_id, rank, 4 - rank AS o, c.text FROM lexical l JOIN chunks c USING (chunk_id) WHERE rank <= 3)"""
_HTML = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_T = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"

ORACLES = {
    "pdf_pages": f"""WITH {LINES}, p AS (SELECT doc_id, 1 + line // 40 AS page, coalesce(string_agg(text, chr(10) ORDER BY line) FILTER (NOT regexp_full_match(text, '\\s*')), '') AS t FROM lines GROUP BY ALL)
SELECT doc_id, page, count(*) OVER (PARTITION BY doc_id) AS n_pages, CASE WHEN t = '' THEN 'empty' ELSE 'layout' END AS extraction_method, sha256({_T.format('t')}) AS text FROM p""",
    "docx_texts": "SELECT doc_id, sha256(coalesce(text, '')) AS text FROM documents",
    "plain_pages": f"""WITH p AS (SELECT doc_id, string_split(chr(32) || replace(coalesce(text, ''), '. ', '.' || chr(12) || ' '), chr(12)) AS p FROM documents), e AS (SELECT doc_id, unnest(p) AS t, generate_subscripts(p, 1) AS page FROM p) SELECT doc_id, page, {_T.format('t')} AS text FROM e""",
    "state_scan": f"WITH {SPANS} SELECT doc_id AS paper_id, chunk_index - 1 AS position, chunk_id, source AS section, sha256(text) AS text, 1::BIGINT AS page_start, NULL::INTEGER AS page_end FROM chunks",
    "jsonl_errors": "SELECT * FROM (VALUES (2::BIGINT, 'blank'), (3, 'wrong type id'), (4, 'missing name'), (5, 'no object'), (6, 'no object'), (8, 'missing name')) v(line, reason)",
    "jsonl_round_trip": "SELECT doc_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM labels",
    "benchmark_papers": "WITH " + values(_PARAGRAPHS, "paper_id string, title string, section_name string, section_place long, place long, paragraph string", "p") + " SELECT * FROM p",
    "benchmark_questions": "WITH " + values(_QUESTIONS, _QUESTION, "q") + " SELECT * FROM q",
    "upload_problems": "SELECT * FROM (VALUES ('good.pdf', ''), ('bad.pdf', 'header,mime'), ('note.txt', 'suffix,size')) v(path, problems)",
    "verified_import": "SELECT 15::BIGINT AS bytes, true AS refused",
    "relational_scan": "SELECT o_orderstatus AS s, count(*) AS n, sum(o_custkey)::BIGINT AS c FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL",
    "prompt_templates": """SELECT doc_id, sha256('Read {title} of {{x}}:' || chr(10) || '{text}' || chr(10) || '{title}' || chr(10)) AS sha256, 'title,text' AS variables,
 sha256('Read ' || source || ' of {{x}}:' || chr(10) || coalesce(text, '') || chr(10) || source || chr(10)) AS prompt FROM documents""",
    "latest_report": "SELECT 1::BIGINT AS n",
    "vector_index": "SELECT load, CASE WHEN load = 'right' THEN (SELECT count(*) FROM embeddings) END AS vectors FROM (VALUES ('right'), ('digest'), ('model'), ('dimension'), ('missing')) v(load)",
    "legacy_import": "SELECT count(*) FILTER (o_orderkey % 50 <> 0 AND o_custkey % 3 = 0) AS imported, count(*) FILTER (o_orderkey % 50 <> 0 AND o_custkey % 3 <> 0) AS skipped, count(*) FILTER (o_orderkey % 50 = 0) AS failed FROM orders",
    "state_index": f"WITH {SPANS} SELECT doc_id % 5 <> 0 AS valid, count(DISTINCT doc_id) AS n FROM chunks GROUP BY ALL",
    "index_digests": f"""WITH {SPANS}, d AS (SELECT doc_id AS paper_id, count(*) AS chunks, sha256(string_agg(sha256(chunk_id || chr(10) || text), '' ORDER BY chunk_index)) AS sha256 FROM chunks GROUP BY doc_id)
SELECT *, sha256(sha256 || chr(10) || 'mock' || chr(10) || 'm1' || chr(10) || '2') AS cache_key FROM d""",
    "frozen_dataset": "SELECT 4::BIGINT AS rows, true AS stable, true AS sensitive",
    "content_addressed": "SELECT count(DISTINCT coalesce(text, '')) AS stored, count(DISTINCT coalesce(text, '')) AS digests FROM documents",
    "replaced_partitions": "SELECT lang, CASE WHEN lang = 'fr' THEN 2 ELSE 1 END::BIGINT AS run, count(*) AS n FROM documents WHERE lang <> 'fr' OR doc_id % 2 = 0 GROUP BY ALL",
    "resumed_evaluation": "SELECT doc_id % 3 AS third, count(*) AS n, sum(quality)::BIGINT AS good FROM labels GROUP BY ALL",
    "report_files": f"""WITH {_REPORT}, p AS (SELECT report_id, o, '## Rank <' || rank || '>' || chr(10) || chr(10) || CASE WHEN rank <> 2 THEN text ELSE '' END || CASE WHEN rank = 1 THEN chr(10) || chr(10) || 'Evidence: E1, E2' ELSE '' END AS m,
  '<section><h2>Rank &lt;' || rank || '&gt;</h2><p>' || CASE WHEN rank <> 2 THEN {_HTML.format('text')} ELSE '' END || '</p></section>' AS h, o || 'Rank <' || rank || '>' || CASE WHEN rank <> 2 THEN length(text) ELSE 0 END || CASE WHEN rank = 1 THEN 2 ELSE 0 END AS j FROM s)
SELECT report_id, sha256(string_agg(m, chr(10) || chr(10) ORDER BY o)) AS markdown, sha256('<!DOCTYPE html><html><body>' || string_agg(h, '' ORDER BY o) || '</body></html>') AS html, string_agg(j, ';' ORDER BY o) AS json FROM p GROUP BY report_id""",
    "conversation_markdown": rf"""WITH {_CITED}, q AS (SELECT message_id, string_agg('> [E' || r || '] ' || trim(regexp_replace(text, '\s+', ' ', 'g')), chr(10) ORDER BY place) AS quotes FROM c GROUP BY message_id),
b AS (SELECT item_id % 5 AS conv_id, item_id, '**assistant**' || chr(10) || chr(10) || text || CASE WHEN quotes IS NOT NULL THEN chr(10) || chr(10) || quotes ELSE '' END AS t FROM benchmark LEFT JOIN q ON message_id = item_id WHERE text IS NOT NULL)
SELECT conv_id, sha256(string_agg(t, chr(10) || chr(10) ORDER BY item_id)) AS markdown FROM b GROUP BY conv_id""",
    "matrix_markdown": f"""WITH {SELECTED}, c AS (SELECT dimension, doc_id, 'a\\|' || replace(evidence, ',', ' ') AS s FROM cells WHERE doc_id IN (1, 2, 3))
SELECT dimension, '| ' || dimension || ' | ' || coalesce(max(s) FILTER (doc_id = 1), '-') || ' | ' || coalesce(max(s) FILTER (doc_id = 2), '-') || ' | ' || coalesce(max(s) FILTER (doc_id = 3), '-') || ' |' AS line FROM c GROUP BY dimension""",
    "strided_picks": f"WITH {SPANS} SELECT i::BIGINT AS start, chunk_id FROM chunks CROSS JOIN range(2) r(i) WHERE chunk_index - 1 >= i AND (chunk_index - 1 - i) % 5 = 0 AND (chunk_index - 1 - i) // 5 < 5",
    "mode_comparison": """SELECT * FROM (VALUES ('a', '', 1.666667::DOUBLE, -90::DOUBLE, 50::BIGINT, 0::DOUBLE, true, 'parallel'), ('b', '', NULL, -90, 0, -0.05, false, 'serial'),
('c', 'dataset_version,frozen_test_sha256', 1, 0, 0, 0, false, 'serial')) v(run, mismatches, p95_speedup, latency_p50_ms_delta, total_input_tokens_delta, report_quality_delta, quality_not_degraded, recommendation)""",
    "stalled_tasks": """SELECT 'pending' AS status, true AS changed, count(*) AS n, sum(o_orderkey)::BIGINT AS tasks FROM orders WHERE o_orderstatus = 'O'
AND CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 400 DAYS ELSE o_orderdate END <= TIMESTAMP '1998-12-31 23:00:00' HAVING count(*) > 0""",
}
