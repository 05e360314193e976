"""Queries over the text of documents: chunks, terms, lines, sections, metadata, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import chunks as C
from ..operators import compare as P
from ..operators import evaluate as E
from ..operators import retrieval as R
from ..operators import store as S
from ..session import table

PAGE = 3000  # characters of a synthetic page

#: SQL parts that several twins share.
DOCS = r"""docs AS (SELECT doc_id, lang, source, regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(0), ''), '^\s+', ''), '\s+$', '') AS t FROM documents)"""
SPANS = DOCS + r""",
starts AS (SELECT *, unnest(range(0, CASE WHEN length(t) <= 1200 THEN 1 ELSE 1 + ceil((length(t) - 1200) / 1050.0)::BIGINT END)) * 1050 AS s FROM docs WHERE t <> ''),
cut AS (SELECT doc_id, lang, source, s AS char_start, least(s + 1200, length(t)) AS char_end,
  regexp_replace(regexp_replace(substr(t, s + 1, 1200), '^\s+', ''), '\s+$', '') AS text FROM starts),
chunks AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY doc_id ORDER BY char_start) AS chunk_index, char_start, char_end, text,
  doc_id || '_page_1_chunk_' || row_number() OVER (PARTITION BY doc_id ORDER BY char_start) AS chunk_id FROM cut WHERE text <> '')"""
STOP = f"({', '.join(map(repr, T.ENGLISH_STOPWORDS))})"
TERMS = rf"list_filter(regexp_extract_all(replace(lower({{}}), '’', ''''), '[A-Za-z0-9_]+|[\x{{{{3400}}}}-\x{{{{9fff}}}}]+'), lambda x: x NOT IN {STOP})"
LINES = r"""raw AS (SELECT doc_id, lang, source, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
numbered AS (SELECT doc_id, lang, source, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS line FROM raw),
lines AS (SELECT doc_id, lang, source, line, text,
  (coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS char_start FROM numbered)"""


def chunks(spark, sf_dir):
    """scope, chunk_id, position and section for retrieval, with the chunk's own columns."""
    df = C.chunk_spans(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return df.withColumn("chunk_id", C.chunk_id(F.col("doc_id"), F.lit(1), F.col("chunk_index"))).withColumn("position", C.position(F.col("doc_id"), F.col("chunk_index"))).withColumn(
        "scope", F.lit("all")).withColumn("section", F.col("source"))


def paged_lines(spark, sf_dir):
    """Lines with the synthetic page they start on."""
    return C.lines(table(spark, sf_dir, "documents")).withColumn("page", (1 + F.floor(F.col("char_start") / PAGE)).cast("int"))


def chunk_spans(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return c.select("doc_id", "chunk_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), "text")


def terms_freq(spark, sf_dir):
    # Counted in the row; only partial sums by term are shuffled.
    t = R.counted(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]).select(F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
    return t.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def page_overlap_filter(spark, sf_dir):
    c = chunks(spark, sf_dir)
    first = (1 + F.floor(F.col("char_start") / PAGE)).cast("long")
    last = (1 + F.floor((F.col("char_end") - 1) / PAGE)).cast("long")
    # Every third chunk lacks its start, every fifth its end: a missing one is taken from the other.
    k = F.pmod(F.col("doc_id") + F.col("chunk_index"), F.lit(15))
    c = c.select("chunk_id", F.when(k % 3 != 0, first).alias("page_start"), F.when(k % 5 != 0, last).alias("page_end"))
    return c.where(R.overlaps_pages(F.col("page_start"), F.col("page_end"), F.lit(2), F.lit(3)))


def running_offsets(spark, sf_dir):
    b = C.lines(table(spark, sf_dir, "documents")).select("doc_id", "line", "text")
    out = C.running_offsets(b, ["doc_id"], "line")
    return out.select("doc_id", F.col("line").cast("long").alias("line"), "char_start", "char_end")


def line_dedup_margin(spark, sf_dir):
    """Lines as blocks, the first and last of a document its margins; those that recur on enough documents go."""
    b = C.lines(table(spark, sf_dir, "documents"))
    zone = F.when(F.col("line") == 0, "top").when(F.col("line") == F.col("n_lines") - 1, "bottom")
    found = C.repeated_margins(b, "doc_id", zone, share=0.0005)
    return found.select("zone", "signature", F.col("pages").cast("long").alias("pages"))


def section_ranges(spark, sf_dir):
    """Every line that is not blank stands for a heading, synthetic pages for pages. (``headings`` and ``toc_sections`` run the heading rule.)"""
    lines = paged_lines(spark, sf_dir)
    heads = lines.withColumn("name", F.trim("text")).where("name <> ''")
    pages = lines.groupBy("doc_id").agg(F.max("page").alias("n_pages"))
    out = C.section_ranges(heads, pages)
    return out.select("doc_id", F.col("section_index").cast("long").alias("section_index"), "name", F.col("page_start").cast("long").alias("page_start"), F.col("page_end").cast("long").alias("page_end"))


def heading_lines(spark, sf_dir):
    heads = C.headings(paged_lines(spark, sf_dir))
    return heads.select("doc_id", F.col("line").cast("long").alias("line"), F.col("page").cast("long").alias("page"), "name")


def range_join_section(spark, sf_dir):
    lines = paged_lines(spark, sf_dir)
    heads = lines.withColumn("name", F.trim("text")).where("name <> ''")
    pages = lines.groupBy("doc_id").agg(F.max("page").alias("n_pages"))
    all_pages = lines.select("doc_id", "page").distinct()
    out = C.first_section(all_pages, C.section_ranges(heads, pages))
    return out.select("doc_id", F.col("page").cast("long").alias("page"), "section")


def interval_overlap(spark, sf_dir):
    # Spans are cut from the stripped text; the documents' leading white space shifts them.
    docs = table(spark, sf_dir, "documents").select("doc_id", T.strip(F.coalesce("text", F.lit(""))).alias("text"))
    c = C.chunk_spans(docs)
    b = C.lines(docs)
    out = C.chunk_blocks(c.select("doc_id", "chunk_index", "char_start", "char_end"), b.select("doc_id", "line", "char_start", "char_end"))
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.size("lines").cast("long").alias("n_lines"), F.array_min("lines").cast("long").alias("first_line"), F.array_max("lines").cast("long").alias("last_line"))


def metadata_regex(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return d.select(
        "doc_id", T.doi(F.col("t")).alias("doi"), T.arxiv_id(F.col("t")).alias("arxiv_id"), T.year(F.col("t")).cast("long").alias("year"), T.language(F.col("t")).alias("language"),
        T.estimate_tokens(F.col("t")).alias("tokens"), T.block_type(F.col("t"), F.lit(10.0), F.lit(10.0)).alias("block_type"))


def dedup_key(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    q = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    d = d.select("doc_id", S.dedup_key([F.sha2(F.col("text"), 256), q, F.col("lang")]).alias("dedup_key"))
    return d.groupBy("dedup_key").agg(F.count("*").alias("tasks"), F.max("doc_id").alias("newest"))


def hash_split(spark, sf_dir):
    return E.hash_split(table(spark, sf_dir, "documents"), "doc_id", "seed-7")


def split_leakage(spark, sf_dir):
    """Texts that occur in more than one split of the documents."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"))
    s = E.hash_split(d, "doc_id", "seed-7").select("doc_id", "split")
    out = E.leaks(d.join(s, "doc_id"), "digest", "split")
    return out.select("digest", F.array_join("splits", ",").alias("splits"))


def paragraph_mapping(spark, sf_dir):
    """Every line of each document as evidence against all of its lines, by exclusion reason."""
    lines = C.lines(table(spark, sf_dir, "documents"))
    ev = lines.select(F.concat_ws(":", "doc_id", "line").alias("evidence_id"), "doc_id", "text")
    out = E.mapped_paragraphs(ev, lines.select("doc_id", "line", "text"))
    return out.groupBy("reason").agg(F.count("*").alias("n"), F.sum(F.coalesce("place", F.lit(0))).cast("long").alias("places"))


#: Words of the synthetic languages stand for the key words of a comparison.
SAMPLE_DIMENSIONS = {"research_question": ["erth", "ouan"], "dataset": ["the of", "de la"], "method": ["tion"], "baseline": ["zing"], "metrics": ["and", "und"], "results": ["reth"], "limitations": ["ñ"]}
SAMPLE_FOCUS = "tion the"


def _selected(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("page_start", F.lit(1) + F.floor(F.col("char_start") / PAGE).cast("int"))
    scored = P.scored_chunks(c, SAMPLE_FOCUS, SAMPLE_DIMENSIONS)
    return P.select_greedily(scored, "doc_id", "chunk_index", items=4, budget=700)


def greedy_selection(spark, sf_dir):
    return _selected(spark, sf_dir).select("doc_id", F.col("pick").cast("long").alias("pick"), "chunk_id", F.round("score", 6).alias("score"), F.array_join("dimensions", ",").alias("dimensions"))


def compare_matrix(spark, sf_dir):
    cells = P.matrix(_selected(spark, sf_dir), "doc_id", dimensions=SAMPLE_DIMENSIONS)
    return cells.select("dimension", "doc_id", F.array_join("evidence", ",").alias("evidence"))


def compare_gaps(spark, sf_dir):
    cells = P.matrix(_selected(spark, sf_dir), "doc_id", dimensions=SAMPLE_DIMENSIONS)
    out = P.gaps(chunks(spark, sf_dir), cells, "doc_id", SAMPLE_DIMENSIONS)
    return out.groupBy("dimension").agg(F.count("*").alias("documents"))


def page_counts(spark, sf_dir):
    """AGG33 over synthetic pages: configured for every third document, pages of lines, last page of any chunk."""
    c = chunks(spark, sf_dir).select("doc_id", (1 + F.floor(F.col("char_start") / PAGE)).cast("int").alias("page_start"), (1 + F.floor((F.col("char_end") - 1) / PAGE)).cast("int").alias("page_end"))
    p = paged_lines(spark, sf_dir).select("doc_id", "page").distinct()
    conf = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, 2).alias("page_count"))
    return C.page_count(c, p, conf).select("doc_id", F.col("page_count").cast("long").alias("page_count"))


def unknown_sections(spark, sf_dir):
    """FLT3: every language asked for every source; the pairs that no document has."""
    c = chunks(spark, sf_dir).select(F.col("lang").alias("scope"), "section")
    sections = c.select("section").distinct()
    asked = c.select("scope").distinct().crossJoin(F.broadcast(sections) if R.fits(sections, F.octet_length("section")) else sections)
    return C.unknown_sections(asked, c.where("section <> 'src3' OR scope = 'en'")).select("scope", "section")


def parsing_summary(spark, sf_dir):
    """AGG14 over synthetic pages: two columns where a page has an even number of lines."""
    p = paged_lines(spark, sf_dir).groupBy("doc_id", "page").agg(F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("chars"))
    p = p.withColumn("extraction_method", F.when(F.col("chars") == 0, "empty").when(F.col("page") % 5 == 0, "legacy_fallback").otherwise("layout")).withColumn("n_removed", F.lit(1))
    return C.parsing_summary(p.withColumn("column_layout", F.when(F.col("n_blocks") % 2 == 0, "double_column").otherwise("single_column")))


def citation_merge(spark, sf_dir):
    """AGG23: lines as branch notes: texts in order without repeats, their first letters as items, short ones failed."""
    from ..operators import evidence as V_

    lines = C.lines(table(spark, sf_dir, "documents"))
    n = lines.select(F.col("doc_id").alias("report_id"), F.col("line").alias("position"), F.concat(F.lit("q"), F.col("line").cast("string")).alias("question"), F.col("text"),
                     F.array(F.substring("text", 1, 1)).alias("items"), (F.length("text") < 20).alias("failed"))
    m = V_.merged_notes(n)
    return m.select("report_id", "text", F.array_join("items", ",").alias("items"), F.array_join("gaps", ",").alias("gaps"), "branches", "failed_branches")


def mock_embed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", V.mock_embed()(F.col("text")).alias("embedding"))


QUERIES = {f.__name__: f for f in (
    chunk_spans, terms_freq, page_overlap_filter, running_offsets, line_dedup_margin, section_ranges, heading_lines, range_join_section, interval_overlap, metadata_regex,
    dedup_key, hash_split, split_leakage, paragraph_mapping, greedy_selection, compare_matrix, compare_gaps, mock_embed, page_counts, unknown_sections, parsing_summary, citation_merge)}

SIGNATURE = r"trim(regexp_replace(regexp_replace(lower(text), '\d+', '#', 'g'), '\s+', ' ', 'g'))"
PAGED = LINES + f", paged AS (SELECT *, 1 + char_start // {PAGE} AS page FROM lines)"
RANGES = PAGED + r""", heads AS (SELECT doc_id, line, page, trim(text, ' ') AS name FROM paged WHERE trim(text, ' ') <> ''),
pages AS (SELECT doc_id, max(page) AS n_pages FROM paged GROUP BY doc_id),
ordered AS (SELECT h.*, n_pages, row_number() OVER w AS section_index, lead(page) OVER w AS nxt FROM heads h JOIN pages USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
sections AS (SELECT doc_id, section_index, name, page AS page_start, greatest(page, CASE WHEN nxt IS NULL THEN n_pages WHEN nxt > page THEN nxt - 1 ELSE nxt END) AS page_end FROM ordered)"""
SPLIT = """ranked AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('seed-7:' || doc_id), doc_id) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM documents)),
parts AS (SELECT doc_id, place, CASE WHEN place <= round_even(n * 0.6, 0) THEN 'analysis' WHEN place <= round_even(n * 0.6, 0) + round_even(n * 0.2, 0) THEN 'validation' ELSE 'test' END AS split FROM ranked)"""


def _count(word: str) -> str:
    return f"((length(low) - length(replace(low, '{word}', ''))) // {len(word)})"


_WORDS = " + ".join(_count(w) for ws in SAMPLE_DIMENSIONS.values() for w in ws)
_FOCUS = " + ".join(f"3 * {_count(w)}" for w in SAMPLE_FOCUS.split())
_FOUND = ", ".join("CASE WHEN " + " OR ".join(f"contains(low, '{w}')" for w in ws) + f" THEN '{d}' END" for d, ws in SAMPLE_DIMENSIONS.items())
SELECTED = "RECURSIVE " + SPANS + f""",
lowered AS (SELECT *, lower(source || ' ' || text) AS low FROM chunks),
scored AS (SELECT doc_id, chunk_index, chunk_id, length(text) AS n, ({_WORDS} + {_FOCUS})::DOUBLE + CASE WHEN char_start < {PAGE} THEN 0.2::DOUBLE ELSE 0 END AS score,
  list_filter([{_FOUND}], lambda x: x IS NOT NULL) AS dims FROM lowered),
queue AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_index) AS r FROM scored),
walk AS (SELECT doc_id, r, n AS chars, 1 AS taken, true AS picked FROM queue WHERE r = 1
  UNION ALL SELECT q.doc_id, q.r, CASE WHEN w.taken < 4 AND w.chars + q.n <= 2800 THEN w.chars + q.n ELSE w.chars END,
    CASE WHEN w.taken < 4 AND w.chars + q.n <= 2800 THEN w.taken + 1 ELSE w.taken END, w.taken < 4 AND w.chars + q.n <= 2800
  FROM walk w JOIN queue q ON q.doc_id = w.doc_id AND q.r = w.r + 1),
selected AS (SELECT q.*, row_number() OVER (PARTITION BY q.doc_id ORDER BY q.r) AS pick FROM walk w JOIN queue q USING (doc_id, r) WHERE picked),
cells AS (SELECT dimension, doc_id, string_agg(chunk_id, ',' ORDER BY pick) AS evidence FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, dimension ORDER BY pick) AS k FROM (SELECT doc_id, pick, chunk_id, unnest(dims) AS dimension FROM selected)) WHERE k <= 2 GROUP BY ALL)"""

ORACLES = {
    "chunk_spans": f"WITH {SPANS} SELECT doc_id, chunk_id, chunk_index, char_start, char_end, text FROM chunks",
    "terms_freq": f"WITH t AS (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL) SELECT term, count(*) AS df, sum(n)::BIGINT AS cf FROM tf GROUP BY term",
    "page_overlap_filter": f"""WITH {SPANS}, k AS (SELECT chunk_id, 1 + char_start // {PAGE} AS a, 1 + (char_end - 1) // {PAGE} AS b, (doc_id + chunk_index) % 15 AS k FROM chunks),
p AS (SELECT chunk_id, CASE WHEN k % 3 <> 0 THEN a END AS page_start, CASE WHEN k % 5 <> 0 THEN b END AS page_end FROM k)
SELECT * FROM p WHERE coalesce(page_start, page_end) <= 3 AND coalesce(page_end, page_start) >= 2""",
    "running_offsets": f"""WITH {LINES}, o AS (SELECT doc_id, line, text, (coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 2 * line)::BIGINT AS char_start FROM lines)
SELECT doc_id, line, char_start, char_start + length(text) AS char_end FROM o""",
    "line_dedup_margin": f"""WITH {LINES}, z AS (SELECT doc_id, {SIGNATURE} AS signature, CASE WHEN line = 0 THEN 'top' WHEN line = max(line) OVER (PARTITION BY doc_id) THEN 'bottom' END AS zone FROM lines)
SELECT zone, signature, count(DISTINCT doc_id) AS pages FROM z WHERE zone IS NOT NULL AND signature <> '' GROUP BY ALL
HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT doc_id) >= 0.0005::DOUBLE * (SELECT count(DISTINCT doc_id) FROM documents)""",
    "section_ranges": f"WITH {RANGES} SELECT doc_id, section_index, name, page_start, page_end FROM sections",
    "range_join_section": f"""WITH {RANGES}, all_pages AS (SELECT DISTINCT doc_id, page FROM paged)
SELECT p.doc_id, p.page, min_by(s.name, s.section_index) AS section FROM all_pages p LEFT JOIN sections s ON s.doc_id = p.doc_id AND p.page BETWEEN s.page_start AND s.page_end GROUP BY ALL""",
    "interval_overlap": f"""WITH {SPANS}, pieces AS (SELECT doc_id, string_split(t, chr(10)) AS p FROM docs), each AS (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS line FROM pieces),
placed AS (SELECT doc_id, line, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, length(text) AS n FROM each)
SELECT c.doc_id, chunk_index, count(DISTINCT line) AS n_lines, min(line) AS first_line, max(line) AS last_line FROM chunks c JOIN placed b ON b.doc_id = c.doc_id AND b.a < c.char_end AND b.a + b.n > c.char_start GROUP BY ALL""",
    "metadata_regex": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, nullif(regexp_replace(regexp_extract(t, '{T.DOI}'), '[.,]+$', ''), '') AS doi, nullif(regexp_extract(t, '{T.ARXIV}', 1), '') AS arxiv_id,
 nullif(regexp_extract(substr(t, 1, 6000), '{T.YEAR}', 1), '')::BIGINT AS year, 'en' AS language, ceil(length(t) / 4.0)::BIGINT AS tokens,
 CASE WHEN regexp_matches(trim(t), '{T.CAPTION}') THEN 'caption' WHEN regexp_matches(trim(t), '(?i)^(?:(?:\d+(?:\.\d+)*)\s+)?(?:{T.HEADINGS})\b') THEN 'heading'
  WHEN length(trim(t)) <= 2 AND NOT regexp_matches(t, '[A-Za-z0-9]') THEN 'other' ELSE 'body' END AS block_type FROM d""",
    "dedup_key": r"""WITH k AS (SELECT doc_id, sha256(sha256(text) || chr(10) || trim(regexp_replace(lower(text), '\s+', ' ', 'g')) || chr(10) || lang) AS dedup_key FROM documents WHERE text IS NOT NULL)
SELECT dedup_key, count(*) AS tasks, max(doc_id) AS newest FROM k GROUP BY dedup_key""",
    "hash_split": f"WITH {SPLIT} SELECT doc_id, place, split FROM parts",
    "split_leakage": f"""WITH {SPLIT}, d AS (SELECT sha256(text) AS digest, split FROM documents JOIN parts USING (doc_id) WHERE text IS NOT NULL)
SELECT digest, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM d GROUP BY digest HAVING count(DISTINCT split) > 1""",
    "paragraph_mapping": rf"""WITH {LINES}, e AS (SELECT doc_id, line AS own, text FROM lines), j AS (SELECT e.doc_id, e.own, e.text, count(l.line) AS times, min(l.line) AS place FROM e LEFT JOIN lines l ON l.doc_id = e.doc_id AND l.text = e.text GROUP BY ALL),
r AS (SELECT *, CASE WHEN regexp_matches(text, '(?i)^(?:figure|table|float)\b') THEN 'figure_or_table' WHEN trim(text) = '' THEN 'missing' WHEN times = 0 THEN 'unmapped' WHEN times > 1 THEN 'ambiguous_duplicate' ELSE 'mapped' END AS reason FROM j)
SELECT reason, count(*) AS n, sum(CASE WHEN times = 1 THEN place ELSE 0 END)::BIGINT AS places FROM r GROUP BY reason""",
    "greedy_selection": f"WITH {SELECTED} SELECT doc_id, pick, chunk_id, round(score, 6) AS score, array_to_string(dims, ',') AS dimensions FROM selected",
    "compare_matrix": f"WITH {SELECTED} SELECT dimension, doc_id, evidence FROM cells",
    "compare_gaps": f"""WITH {SELECTED} SELECT dimension, count(*) AS documents FROM (SELECT DISTINCT doc_id FROM chunks) CROSS JOIN (SELECT unnest([{', '.join(repr(d) for d in SAMPLE_DIMENSIONS)}]) AS dimension)
ANTI JOIN cells USING (doc_id, dimension) GROUP BY dimension""",
    "heading_lines": rf"""WITH {PAGED}, h AS (SELECT doc_id, line, page, trim(regexp_replace(regexp_extract(text, '{T.HEADING_LINE}', 1), '\s+', ' ', 'g')) AS name FROM paged),
f AS (SELECT *, lag(name) OVER w AS a, lag(page) OVER w AS b FROM h WHERE name <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY line))
SELECT doc_id, line, page, name FROM f WHERE NOT coalesce(a = name AND b = page, false)""",
    "page_counts": f"""WITH {SPANS}, {LINES}, a AS (SELECT doc_id, max(1 + (char_end - 1) // {PAGE}) AS a FROM chunks GROUP BY doc_id), b AS (SELECT doc_id, count(DISTINCT 1 + char_start // {PAGE}) AS b FROM lines GROUP BY doc_id)
SELECT d.doc_id, greatest(coalesce(a, 0), coalesce(b, 0), CASE WHEN d.doc_id % 3 = 0 THEN 2 ELSE 0 END)::BIGINT AS page_count FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)""",
    "unknown_sections": f"WITH {SPANS}, s AS (SELECT DISTINCT lang AS scope FROM chunks), r AS (SELECT DISTINCT source AS section FROM chunks) SELECT scope, section FROM s CROSS JOIN r WHERE section <> '' EXCEPT SELECT lang, source FROM chunks WHERE source <> 'src3' OR lang = 'en'",
    "parsing_summary": f"""WITH {LINES}, p AS (SELECT doc_id, 1 + char_start // {PAGE} AS page, count(*) AS n, sum(length(text)) AS c FROM lines GROUP BY ALL)
SELECT count(*) AS total_pages, count(*) FILTER (c > 0 AND page % 5 <> 0) AS layout_pages, 0::BIGINT AS legacy_pages, count(*) FILTER (c > 0 AND page % 5 = 0) AS fallback_pages, count(*) FILTER (c = 0) AS empty_pages,
 count(*) FILTER (n % 2 = 1) AS single_column_pages, count(*) FILTER (n % 2 = 0) AS double_column_pages, sum(n)::BIGINT AS blocks_retained, count(*) AS header_footer_blocks_removed FROM p""",
    "citation_merge": f"""WITH {LINES}, n AS (SELECT doc_id, line, text AS t, substr(text, 1, 1) AS i, length(text) < 20 AS f FROM lines),
t AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY line) AS text FROM (SELECT doc_id, t, min(line) AS line FROM n WHERE t <> '' GROUP BY ALL) GROUP BY doc_id),
i AS (SELECT doc_id, string_agg(i, ',' ORDER BY line) AS items FROM (SELECT doc_id, i, min(line) AS line FROM n GROUP BY ALL) GROUP BY doc_id),
g AS (SELECT doc_id, coalesce(string_agg('q' || line, ',' ORDER BY line) FILTER (f), '') AS gaps, count(*) AS branches, count(*) FILTER (f) AS failed_branches FROM n GROUP BY doc_id)
SELECT doc_id AS report_id, coalesce(text, '') AS text, items, gaps, branches, failed_branches FROM g LEFT JOIN t USING (doc_id) LEFT JOIN i USING (doc_id)""",
}
