"""Queries over page layout. Lines of documents stand for blocks; their boxes, fonts and headings follow from their numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks as C
from ..operators import evidence as E
from ..session import table
from .documents import LINES, PAGE, PAGED, SIGNATURE, SPANS, chunks, paged_lines
from .literals import rows_of, values
from .ranking import FLAT, lexical

WIDTH = 600.0


def _lines(spark, sf_dir):
    return C.lines(table(spark, sf_dir, "documents"))


def _blocks(spark, sf_dir):
    """Twelve lines to a page: every fifth spans both columns, the others stand left or right."""
    b, k = _lines(spark, sf_dir), F.col("line") % 5
    y = (F.floor(F.pmod("line", F.lit(12)) / 2) * 20).cast("double")
    return b.select(
        "doc_id", (1 + F.floor(F.col("line") / 12)).cast("int").alias("page"), F.col("line").alias("source_index"), F.when(k.isin(0, 1, 3), 50.0).otherwise(310.0).alias("x0"), F.when(k.isin(1, 3), 290.0).otherwise(550.0).alias("x1"),
        y.alias("y0"), (y + 15).alias("y1"), "text", (9.0 + (F.col("line") * 7) % 5).alias("size"))


def reading_order(spark, sf_dir):
    out = C.reading_order(_blocks(spark, sf_dir), F.lit(WIDTH), ["doc_id", "page"])
    return out.select("doc_id", F.col("page").cast("long").alias("page"), F.col("source_index").cast("long").alias("source_index"), F.col("reading_order").cast("long").alias("reading_order"), "two_columns")


def title_lines(spark, sf_dir):
    b = _blocks(spark, sf_dir).select("doc_id", "text", (F.col("source_index") * 12).cast("double").alias("y"), F.lit(0.0).alias("x"), "size")
    return C.title_lines(b, "doc_id")


def body_font(spark, sf_dir):
    b = _blocks(spark, sf_dir).withColumn("font_sizes", F.array_repeat("size", F.length("text")))
    return C.body_font(b, "doc_id")


def kept_lines(spark, sf_dir):
    """SRC4: three lines to a block; rotated ones and images go."""
    b, n = _lines(spark, sf_dir), F.col("line")
    raw = b.select(
        F.col("doc_id").alias("page_number"), F.floor(n / 3).cast("int").alias("source_index"), n.alias("line"), F.when(n % 7 == 6, "image").otherwise("text").alias("kind"), F.when(n % 5 == 4, 0.0).otherwise(1.0).alias("dx"),
        F.when(n % 5 == 4, 1.0).otherwise(0.0).alias("dy"), "text", (8.0 + n % 3).alias("size"), (n % 4 * 10.0).alias("x0"), (n * 12.0).alias("y0"), (n % 4 * 10.0 + 100).alias("x1"), (n * 12.0 + 10).alias("y1"))
    out = C.kept_lines(raw)
    return out.select(F.col("page_number").alias("doc_id"), F.col("source_index").cast("long").alias("block"), "x0", "y0", "x1", "y1", "text", F.size("font_sizes").cast("long").alias("sized"))


def without_margins(spark, sf_dir):
    """FLT17: blocks left per document when the lines that recur as first or last ones are gone."""
    b = _lines(spark, sf_dir)
    zone = F.when(F.col("line") == 0, "top").when(F.col("line") == F.col("n_lines") - 1, "bottom").otherwise("body")
    rep = C.repeated_margins(b, "doc_id", F.nullif(zone, F.lit("body")), share=0.0005)
    return C.without_margins(b, rep, zone).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum("line").alias("places"))


def page_texts(spark, sf_dir):
    """SRC2-3: synthetic pages as plain text; layout failed on every fifth page and found nothing on every seventh."""
    p = paged_lines(spark, sf_dir).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda r: r["text"]), "\n").alias("text"))
    lay = p.where("page % 5 <> 0").select("doc_id", "page", F.when(F.col("page") % 7 == 0, " ").otherwise(F.upper("text")).alias("text"))
    return C.page_texts(lay, p).select("doc_id", F.col("page").cast("long").alias("page"), "extraction_method", F.length("text").cast("long").alias("n_chars"))


def _heads(spark, sf_dir):
    """Every third line becomes a numbered heading, the next one the word abstract."""
    p, n = paged_lines(spark, sf_dir), F.col("line")
    marked = F.when(n % 6 == 0, F.concat((n + 1).cast("string"), F.lit(" Part "), (n % 4).cast("string"))).when(n % 6 == 1, F.lit(" Abstract ")).when(n % 6 == 2, F.lit("ABSTRACT")).otherwise(F.substring("text", 1, 30))
    return C.headings(p.withColumn("text", F.when(F.length("text") > 0, marked).otherwise(F.col("text"))))


def headings(spark, sf_dir):
    return _heads(spark, sf_dir).select("doc_id", F.col("line").cast("long").alias("line"), F.col("page").cast("long").alias("page"), "name")


def _sections(spark, sf_dir):
    pages = paged_lines(spark, sf_dir).groupBy("doc_id").agg(F.max("page").alias("n_pages"))
    toc = pages.where("doc_id % 2 = 0").select("doc_id", F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(t).alias("title"), F.lit(p).alias("page")) for i, t, p in TOC])).alias("x")).select("doc_id", "x.*")
    return C.sections(toc, _heads(spark, sf_dir), pages)


TOC = [(1, "Front", 1), (2, " ", 1), (3, "Main part", 2), (4, "Lost", 0), (5, "Appendix", 9)]


def toc_sections(spark, sf_dir):
    """SC21: documents of even number have a table of contents."""
    return _sections(spark, sf_dir).select("doc_id", F.col("section_index").cast("long").alias("section_index"), "name", F.col("page_start").cast("long").alias("page_start"), F.col("page_end").cast("long").alias("page_end"))


def section_catalogue(spark, sf_dir):
    out = C.section_catalogue(_sections(spark, sf_dir), chunks(spark, sf_dir).select("doc_id", "chunk_index", "section"))
    return out.select("doc_id", F.array_join("names", "|").alias("names"))


def scope_problems(spark, sf_dir):
    """FLT3: one request per document, its section and bounds by its number."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    i = F.col("doc_id")
    req = d.select("doc_id", i.alias("request_id"), F.when(i % 4 == 0, "Front").when(i % 4 == 1, "src3").when(i % 4 == 2, "").alias("section"), F.when(i % 5 != 0, i % 3 + 1).cast("int").alias("page_start"), F.when(i % 7 != 0, F.lit(2)).alias("page_end"))
    cat = C.section_catalogue(_sections(spark, sf_dir), chunks(spark, sf_dir).select("doc_id", "chunk_index", "section"))
    pages = paged_lines(spark, sf_dir).groupBy("doc_id").agg(F.max("page").alias("page_count"))
    return C.scope_problems(req, cat, pages)


def hierarchical_flags(spark, sf_dir):
    """FLT23 with limits that fit the synthetic pages."""
    p = paged_lines(spark, sf_dir).groupBy("doc_id").agg(F.max("page").alias("pages"), F.max("char_end").alias("chars"))
    depth = F.when(F.col("doc_id") % 9 == 0, "deep").when(F.col("doc_id") % 2 == 0, "standard")
    return p.select("doc_id", C.hierarchical(depth, F.col("pages"), F.col("chars"), 3, 10_000).alias("hierarchical"))


CANDIDATES = [("p1", "title", 1, "A", "pdf", 0.8, False), ("p1", "title", 2, "B", "layout", 0.9, False), ("p1", "title", 3, "C", "llm", 0.5, True), ("p1", "title", 4, "D", "text", 0.9, None), ("p1", "year", 1, "1999", "text", 0.62, False),
              ("p1", "year", 2, None, "llm", 0.9, True), ("p2", "year", 2, "2001", "llm", 0.1, False), ("p2", "year", 1, "2000", "text", 0.7, False), ("p3", "doi", 1, "x", "text", 0.69, False), ("p3", "doi", 2, "y", "llm", 0.2, False)]
CANDIDATE = "paper_id string, field string, seq int, value string, source string, confidence double, force boolean"


def metadata_winner(spark, sf_dir):
    return C.metadata_winner(rows_of(spark, CANDIDATES, CANDIDATE))


def paper_metadata(spark, sf_dir):
    """SC19-20 on papers made of the documents: a line of authors, an abstract, key words."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), (F.col("doc_id") % 4).alias("k"))
    names = F.when(F.col("k") == 0, "Ann Lee; Bo  Ek*; ").when(F.col("k") == 1, "Ann Lee1,2, and Bo Ek†").when(F.col("k") == 2, "Ann Lee and Bo Ek 12").otherwise("University of X")
    body = F.regexp_replace("t", r"\s+", " ")
    paper = F.concat(F.lit("Abstract: "), body, F.lit("\nKeywords: alpha, beta；gamma ;, \n1 Introduction\n"))
    stem = F.concat(F.lit("scan"), F.col("doc_id").cast("string"))
    title = F.when(F.col("k") == 0, F.concat(F.lit(" Scan"), F.col("doc_id").cast("string"))).when(F.col("k") == 1, "arXiv:1").when(F.col("k") == 2, "2021-03-04").otherwise("Some Title")
    return d.select("doc_id", F.array_join(T.authors(names), "|").alias("authors"), T.looks_like_authors(names).alias("author_line"), T.is_placeholder(title, stem).alias("placeholder"),
                    F.sha2(F.coalesce(T.abstract(paper), F.lit("")), 256).alias("abstract"), F.array_join(T.keywords(paper), "|").alias("keywords"))


def joined_lines(spark, sf_dir):
    """SC16 over texts broken behind every fifth character pair."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "([a-z])an([a-z])", "$1an-\n $2").alias("t"))
    return d.select("doc_id", F.sha2(T.dehyphenated(F.col("t")), 256).alias("joined"))


def evidence_context(spark, sf_dir):
    """SC29: the passages of each question as a prompt's blocks."""
    top = lexical(spark, sf_dir, 4).drop("scope").join(chunks(spark, sf_dir).select("chunk_id", "chunk_index", "section", "text"), "chunk_id")
    n = F.col("chunk_index")
    p = top.select("query_id", "rank", "chunk_id", F.when(F.col("rank") != 4, F.format_string("E%d", F.col("rank"))).alias("evidence_id"), F.when(n % 4 != 0, n).alias("page_start"), F.when(n % 3 != 0, n + n % 2).alias("page_end"),
                   F.when(n % 5 == 0, "").otherwise(F.col("section")).alias("section"), "text")
    return E.context(p).select("query_id", F.sha2("context", 256).alias("context"), F.length("context").cast("long").alias("n_chars"))


def scoped_neighbors(spark, sf_dir):
    """JN7 within a range of pages."""
    c = chunks(spark, sf_dir).withColumn("page_start", (1 + F.floor(F.col("char_start") / PAGE)).cast("int")).withColumn("page_end", F.lit(None).cast("int"))
    hits = lexical(spark, sf_dir, 6).drop("scope").join(c.select("chunk_id", "doc_id", "chunk_index", "section"), "chunk_id")
    return E.neighbours(hits, c, "doc_id", pages=(1, 2)).select("query_id", "hit_id", "relation", "chunk_id")


QUERIES = {f.__name__: f for f in (
    reading_order, title_lines, body_font, kept_lines, without_margins, page_texts, headings, toc_sections, section_catalogue, scope_problems,
    hierarchical_flags, paper_metadata, joined_lines, evidence_context, scoped_neighbors,
)}
#: Cases that the tables cannot hold, or that one task or a stand-in for a service works on: run by the tests, not registered.
FIXED = {f.__name__: f for f in (
    metadata_winner,
)}

BLOCKS = LINES + """,
blocks AS (SELECT doc_id, 1 + line // 12 AS page, line AS source_index, text, CASE WHEN line % 5 IN (0, 1, 3) THEN 50 ELSE 310 END AS x0, CASE WHEN line % 5 IN (1, 3) THEN 290 ELSE 550 END AS x1,
  (line % 12) // 2 * 20 AS y0, (line % 12) // 2 * 20 + 15 AS y1, 9::DOUBLE + (line * 7) % 5 AS size FROM lines)"""
HEADS = PAGED + r""",
marked AS (SELECT *, CASE WHEN text = '' THEN '' WHEN line % 6 = 0 THEN (line + 1) || ' Part ' || line % 4 WHEN line % 6 = 1 THEN ' Abstract ' WHEN line % 6 = 2 THEN 'ABSTRACT' ELSE substr(text, 1, 30) END AS t FROM paged),
named AS (SELECT doc_id, line, page, trim(regexp_replace(t, '\s+', ' ', 'g')) AS name FROM marked WHERE regexp_matches(t, '(?i)^\s*((\d+(\.\d+)*)[.、]?\s+[^\n]{2,90}|abstract|introduction|background|method(ology)?|experiments?|results?|discussion|limitations?|conclusion|references)\s*$')),
before AS (SELECT *, lag(name) OVER w AS a, lag(page) OVER w AS b FROM named WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
heads AS (SELECT doc_id, line, page, name FROM before WHERE NOT coalesce(a = name AND b = page, false))"""
SECTIONS = HEADS + """,
pages AS (SELECT doc_id, max(page) AS n_pages FROM paged GROUP BY doc_id),
entries AS (SELECT doc_id, i AS line, least(p, n_pages) AS page, t AS name FROM pages CROSS JOIN (VALUES (1, 'Front', 1), (3, 'Main part', 2), (5, 'Appendix', 9)) v(i, t, p) WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, line, page, name FROM heads WHERE doc_id % 2 = 1),
placed AS (SELECT e.*, n_pages, row_number() OVER w AS section_index, lead(page) OVER w AS nxt FROM entries e JOIN pages USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
sections AS (SELECT doc_id, section_index, name, page AS page_start, greatest(page, CASE WHEN nxt IS NULL THEN n_pages WHEN nxt > page THEN nxt - 1 ELSE nxt END) AS page_end FROM placed)"""
CATALOGUE = SECTIONS + ", " + SPANS + """,
both_ AS (SELECT doc_id, name, 0 AS kind, section_index AS place FROM sections UNION ALL SELECT doc_id, source, 1, chunk_index FROM chunks), firsts AS (SELECT doc_id, name, min(kind * 1000000000 + place) AS first_place FROM both_ WHERE name <> '' GROUP BY ALL),
catalogue AS (SELECT doc_id, list(name ORDER BY first_place) AS names FROM firsts GROUP BY doc_id)"""
_W = "PARTITION BY doc_id, page"

ORACLES = {
    "reading_order": f"""WITH {BLOCKS}, w AS (SELECT *, x1 - x0 >= 420 AS wide FROM blocks), r AS (SELECT *, 2 * coalesce(count(*) FILTER (wide) OVER ({_W} ORDER BY y0, x0, source_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + wide::INT AS region,
  CASE WHEN x1 <= 312 THEN 'l' WHEN x0 >= 288 THEN 'r' END AS side FROM w),
s AS (SELECT doc_id, page, region, count(*) FILTER (side IS NULL) = 0 AND coalesce(least(max(y1) FILTER (side = 'l'), max(y1) FILTER (side = 'r')) - greatest(min(y0) FILTER (side = 'l'), min(y0) FILTER (side = 'r')), -1) > 5
  AND count(*) FILTER (side = 'l') > 0 AND count(*) FILTER (side = 'r') > 0 AS two FROM r GROUP BY ALL)
SELECT doc_id, page, source_index, row_number() OVER ({_W} ORDER BY region, CASE WHEN two AND side = 'r' THEN 1 ELSE 0 END, y0, x0, source_index) - 1 AS reading_order, bool_or(two) OVER ({_W}) AS two_columns FROM r JOIN s USING (doc_id, page, region)""",
    "title_lines": f"""WITH {BLOCKS}, t AS (SELECT *, source_index * 12 AS y, max(size) OVER (PARTITION BY doc_id) AS top FROM blocks), b AS (SELECT *, coalesce(y - lag(y) OVER (PARTITION BY doc_id ORDER BY y), 0) > 1.8 * top AS jump FROM t WHERE size >= 0.92 * top),
i AS (SELECT *, sum(jump::INT) OVER (PARTITION BY doc_id ORDER BY y) AS island, row_number() OVER (PARTITION BY doc_id ORDER BY y) AS n FROM b) SELECT doc_id, string_agg(text, ' ' ORDER BY n) AS title FROM i WHERE island = 0 AND n <= 3 GROUP BY doc_id""",
    "body_font": f"WITH {BLOCKS}, e AS (SELECT doc_id, size, unnest(range(length(text))) AS k FROM blocks) SELECT doc_id, quantile_cont(size, 0.5) AS body_size FROM e GROUP BY doc_id",
    "kept_lines": rf"""WITH {LINES}, k AS (SELECT * FROM lines WHERE line % 7 <> 6 AND line % 5 <> 4), g AS (SELECT doc_id, line // 3 AS block, min(line % 4 * 10)::DOUBLE AS x0, min(line * 12)::DOUBLE AS y0, max(line % 4 * 10 + 100)::DOUBLE AS x1, max(line * 12 + 10)::DOUBLE AS y1,
  string_agg(text, chr(10) ORDER BY line) AS t, sum(length(text))::BIGINT AS sized FROM k GROUP BY ALL)
SELECT doc_id, block, x0, y0, x1, y1, trim(regexp_replace(regexp_replace(t, '([A-Za-z])-\s*\n\s*([a-z])', '\1\2', 'g'), '\s+', ' ', 'g')) AS text, sized FROM g""",
    "without_margins": f"""WITH {LINES}, z AS (SELECT doc_id, line, {SIGNATURE} AS signature, CASE WHEN line = 0 THEN 'top' WHEN line = max(line) OVER (PARTITION BY doc_id) THEN 'bottom' ELSE 'body' END AS zone FROM lines),
r AS (SELECT zone, signature FROM z WHERE zone <> 'body' AND signature <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT doc_id) >= 0.0005::DOUBLE * (SELECT count(DISTINCT doc_id) FROM documents))
SELECT doc_id, count(*) AS blocks, sum(line)::BIGINT AS places FROM z LEFT JOIN r USING (zone, signature) WHERE r.zone IS NULL GROUP BY doc_id""",
    "page_texts": f"""WITH {PAGED}, p AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY line) AS t FROM paged GROUP BY ALL)
SELECT doc_id, page, CASE WHEN page % 5 <> 0 AND page % 7 <> 0 AND trim(t) <> '' THEN 'layout' WHEN trim(t) = '' THEN 'empty' ELSE 'legacy_fallback' END AS extraction_method,
 CASE WHEN page % 5 <> 0 AND page % 7 <> 0 AND trim(t) <> '' THEN length(replace(t, 'ß', 'SS')) ELSE length(t) END AS n_chars FROM p""",
    "headings": f"WITH {HEADS} SELECT doc_id, line, page, name FROM heads",
    "toc_sections": f"WITH {SECTIONS} SELECT doc_id, section_index, name, page_start, page_end FROM sections",
    "section_catalogue": f"WITH {CATALOGUE} SELECT doc_id, array_to_string(names, '|') AS names FROM catalogue",
    "scope_problems": f"""WITH {CATALOGUE}, q AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Front' WHEN 1 THEN 'src3' ELSE '' END AS s, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 3 + 1 END AS a, CASE WHEN doc_id % 7 <> 0 THEN 2 END AS b FROM documents),
j AS (SELECT q.*, names, n_pages FROM q LEFT JOIN catalogue USING (doc_id) LEFT JOIN pages USING (doc_id))
SELECT doc_id AS request_id, 'section_exists' AS rule FROM j WHERE s <> '' AND NOT coalesce(list_contains(names, s), false) UNION ALL SELECT doc_id, 'paired_bounds' FROM j WHERE (a IS NULL) <> (b IS NULL)
UNION ALL SELECT doc_id, 'ordered_bounds' FROM j WHERE a > b UNION ALL SELECT doc_id, 'within_document' FROM j WHERE b > n_pages""",
    "hierarchical_flags": f"WITH {PAGED} SELECT doc_id, doc_id % 9 = 0 OR max(page) > 3 OR max(char_start + length(text)) > 10000 AS hierarchical FROM paged GROUP BY doc_id",
    "metadata_winner": "WITH " + values([("p1", "title", "D", "text", 0.9), ("p1", "year", "1999", "text", 0.62), ("p2", "year", "2000", "text", 0.7), ("p3", "doi", "y", "llm", 0.2)], "paper_id string, field string, value string, source string, confidence double", "w") + " SELECT * FROM w",
    "paper_metadata": r"""WITH d AS (SELECT doc_id, doc_id % 4 AS k, regexp_replace(coalesce(text, ''), '\s+', ' ', 'g') AS t, chr(10) || 'Keywords: alpha, beta；gamma ;, ' AS k_ FROM documents)
SELECT doc_id, CASE WHEN k < 3 THEN 'Ann Lee|Bo Ek' ELSE 'University of X' END AS authors, k < 3 AS author_line, k < 3 AS placeholder,
 sha256(CASE WHEN length(t) >= 79 THEN trim(t) WHEN length(t || k_) >= 79 THEN trim(regexp_replace(t || k_, '\s+', ' ', 'g')) ELSE '' END) AS abstract, 'alpha|beta|gamma' AS keywords FROM d""",
    "joined_lines": r"""SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS joined FROM documents""",
    "evidence_context": f"""WITH {FLAT}, h AS (SELECT l.query_id, l.rank, c.chunk_id, c.chunk_index AS n, c.source, c.text FROM lexical l JOIN chunks c USING (chunk_id) WHERE rank <= 4),
b AS (SELECT query_id, rank, CASE WHEN rank <> 4 THEN '[Evidence ID: E' || rank || ']' || chr(10) ELSE '' END || '[Chunk ID: ' || chunk_id || ']' || chr(10) || '[Location: ' || CASE WHEN n % 4 = 0 THEN 'unknown page' WHEN n % 3 = 0 OR n % 2 = 0 THEN 'page ' || n ELSE 'pages ' || n || '-' || (n + 1) END
  || ', ' || CASE WHEN n % 5 = 0 OR source IS NULL THEN 'unknown section' ELSE source END || ']' || chr(10) || text AS b FROM h),
x AS (SELECT query_id, string_agg(b, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS x FROM b GROUP BY query_id) SELECT query_id, sha256(x) AS context, length(x) AS n_chars FROM x""",
    "scoped_neighbors": f"""WITH {FLAT}, hits AS (SELECT l.query_id, c.* FROM lexical l JOIN chunks c USING (chunk_id) WHERE rank <= 6)
SELECT h.query_id, h.chunk_id AS hit_id, CASE WHEN c.chunk_index < h.chunk_index THEN 'before' ELSE 'after' END AS relation, c.chunk_id FROM hits h JOIN chunks c ON c.doc_id = h.doc_id AND abs(c.chunk_index - h.chunk_index) = 1 AND c.source IS NOT DISTINCT FROM h.source
WHERE 1 + c.char_start // {PAGE} BETWEEN 1 AND 2""",
}
