"""Queries over rankings: BM25, vectors, fusion, reranking, evidence, snippets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..operators import postings as P
from ..operators import retrieval as R
from ..session import table, written
from .documents import SPANS, TERMS, chunks


def questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_INDEXES: dict = {}


def _state(spark, path):
    """Names, sizes and times of a table's files: what is kept for a table goes with them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def _kept(spark, sf_dir, name, make):
    key = (spark.sparkContext.applicationId, sf_dir, name, _state(spark, f"{sf_dir}/documents.parquet"))
    if key not in _INDEXES:
        _INDEXES[key] = make()
    return _INDEXES[key]


def indexed(spark, sf_dir):
    """The forward index of the documents' chunks: built once in a session for the same files, shared by all queries."""
    return _kept(spark, sf_dir, "forward", lambda: R.index(chunks(spark, sf_dir), ("lang",)))


def postings(spark, sf_dir):
    return _kept(spark, sf_dir, "postings", lambda: P.build(indexed(spark, sf_dir)))


def lexical(spark, sf_dir, k):
    """The k best chunks of each question, as a written table: it is small, so a query may read it several times and join it to texts without shuffling these."""
    return written(R.ranked(P.best(questions(spark, sf_dir), indexed(spark, sf_dir), lambda: postings(spark, sf_dir), k), k))


def _score(name="score", places=6):
    return F.round(name, places).alias(name)


def bm25_topk(spark, sf_dir):
    return lexical(spark, sf_dir, 6).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", _score())


def bm25_scoped(spark, sf_dir):
    """The same within one language: statistics of that scope alone."""
    forward = indexed(spark, sf_dir).withColumn("scope", F.col("lang"))
    q = questions(spark, sf_dir).withColumn("scope", F.when(F.col("query_id") % 2 == 0, "en").otherwise("fr"))
    found = P.best(q, forward, lambda: _kept(spark, sf_dir, "postings by language", lambda: P.build(forward)), 6)
    return R.ranked(found, 6).select("query_id", "scope", F.col("rank").cast("long").alias("rank"), "chunk_id", _score())


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumn("position", F.col("vec_id"))


def vector_topk(spark, sf_dir):
    """Every vector whose id is divisible by 20 against all others."""
    v = _vectors(spark, sf_dir)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return R.ranked(R.vector_hits(q, v, 6), 6).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", _score())


def vector_threshold(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    s = R.vector_hits(q, v, threshold=0.25).groupBy("query_id").agg(F.count("*").alias("passed"), F.max("score").alias("best"))
    return s.select("query_id", "passed", _score("best"))


def hashed(spark, sf_dir):
    return R.hashed_topk(questions(spark, sf_dir), chunks(spark, sf_dir), 20)


def hashing_cosine(spark, sf_dir):
    return R.ranked(hashed(spark, sf_dir), 6).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", _score())


def rrf_fusion(spark, sf_dir):
    fused = R.rrf([lexical(spark, sf_dir, 20), R.ranked(hashed(spark, sf_dir), 20)])
    return R.ranked(fused, 20).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", _score(places=9))


def _reranked(spark, sf_dir):
    return R.overlap_rerank(questions(spark, sf_dir), lexical(spark, sf_dir, 20), chunks(spark, sf_dir))


def overlap_rerank(spark, sf_dir):
    return _reranked(spark, sf_dir).select("query_id", F.col("rank").cast("long").alias("rank"), F.col("base_rank").cast("long").alias("base_rank"), "chunk_id", _score("rerank_score"))


def rank_changes(spark, sf_dir):
    return R.rank_changes(_reranked(spark, sf_dir))


def answerability_gate(spark, sf_dir):
    return R.gate(_reranked(spark, sf_dir), 40.0, 20.0).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", _score("rerank_score"))


def evidence_ids(spark, sf_dir):
    return E.evidence_ids(lexical(spark, sf_dir, 5), F.col("query_id") + 1).select("evidence_id", "query_id", "chunk_id")


def neighbor_context(spark, sf_dir):
    c = chunks(spark, sf_dir)
    hits = lexical(spark, sf_dir, 3).drop("scope").join(c.select("chunk_id", "doc_id", "chunk_index", "section"), "chunk_id")
    out = E.neighbours(hits, c, "doc_id")
    return out.select("query_id", "hit_id", "relation", "chunk_id", F.substring("text", 1, 600).alias("text"))


def snippet(spark, sf_dir):
    top = lexical(spark, sf_dir, 3).join(chunks(spark, sf_dir).select("chunk_id", "text"), "chunk_id")
    q = questions(spark, sf_dir).select("query_id", F.array_distinct(T.terms(F.col("query"))).alias("qt"))
    return top.join(q, "query_id").select("query_id", "chunk_id", T.snippet(F.col("text"), F.col("qt"), 200).alias("snippet"))


def evidence_budget(spark, sf_dir):
    """Whole passages under 700 tokens; the truncated one shows its length."""
    hits = lexical(spark, sf_dir, 6).join(chunks(spark, sf_dir).select("chunk_id", "text"), "chunk_id")
    out = E.evidence_budget(hits, 700)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "whole", F.length("text").cast("long").alias("n_chars"))


def citation_whitelist(spark, sf_dir):
    """An answer per question cites ranks 1 to 6 and an unknown id; ranks up to 4 are allowed."""
    ids = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda r: F.format_string("msg_%d:E%d", F.col("query_id"), r))
    q = questions(spark, sf_dir).select("query_id", ids.alias("ids"))
    answer = F.concat(F.lit("See ["), F.array_join("ids", "] and ["), F.lit("] but [msg_x:E99]."))
    out = q.select("query_id", T.sanitised(answer, F.slice("ids", 1, 4)).alias("answer"), F.size(T.cited(answer)).cast("long").alias("n_cited"))
    return out


def report_quality(spark, sf_dir):
    """A report per question: a section cites the top 3 and an unknown id for every seventh question, another section has no citation."""
    top = E.evidence_ids(lexical(spark, sf_dir, 3), F.col("query_id") + 1)
    ev = top.select(F.col("query_id").alias("report_id"), "evidence_id", "chunk_id", F.lit("body").alias("section"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))
    c = chunks(spark, sf_dir).select("chunk_id", F.lit("body").alias("section"), F.when(F.col("chunk_index") <= 5, 1).otherwise(2).alias("page_start"), F.lit(1).alias("page_end"))
    ids = ev.groupBy("report_id").agg(F.array_sort(F.collect_list("evidence_id")).alias("ids"))
    ids = ids.withColumn("ids", F.when(F.col("report_id") % 7 == 0, F.concat("ids", F.array(F.lit("ev_unknown")))).otherwise(F.col("ids")))
    first = ids.select("report_id", F.lit(1).alias("section_id"), F.lit("Method").alias("title"), F.lit("text").alias("content"), F.col("ids").alias("evidence_ids"))
    second = ids.select("report_id", F.lit(2).alias("section_id"), F.when(F.col("report_id") % 2 == 0, "Limitations").otherwise("Other").alias("title"), F.lit("text").alias("content"), F.array().cast("array<string>").alias("evidence_ids"))
    out = E.report_quality(first.unionByName(second), ev, c)
    return out.select("report_id", "refs", "issues", "validity", F.round("coverage", 6).alias("coverage"), "faithfulness", "completeness", "accuracy", "overall", "passed")


QUERIES = {f.__name__: f for f in (
    bm25_topk, bm25_scoped, vector_topk, vector_threshold, hashing_cosine, rrf_fusion, overlap_rerank, rank_changes, answerability_gate, evidence_ids, neighbor_context, snippet,
    evidence_budget, citation_whitelist, report_quality)}

#: BM25 over the chunk table, scope by scope: {scope} of chunks, {qscope} of questions.
BM25 = SPANS + """,
sized AS (SELECT {scope} AS scope, doc_id, lang, chunk_id, chunk_index, doc_id * 1000000 + chunk_index AS position, text, """ + TERMS.format("text") + """ AS w FROM chunks),
stats AS (SELECT scope, count(*)::DOUBLE AS n, greatest(avg(len(w)), 1)::DOUBLE AS avg_len FROM sized GROUP BY scope),
tf AS (SELECT scope, chunk_id, position, len_, term, count(*)::DOUBLE AS tf FROM (SELECT scope, chunk_id, position, len(w)::DOUBLE AS len_, unnest(w) AS term FROM sized) GROUP BY ALL),
df AS (SELECT scope, term, count(*)::DOUBLE AS df FROM tf GROUP BY ALL),
asked AS (SELECT item_id AS query_id, {qscope} AS scope, unnest(""" + TERMS.format("text") + """) AS term FROM benchmark),
bm25 AS (SELECT query_id, scope, chunk_id, position, round(sum(ln(1::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE
  / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len_ / avg_len))), 9) AS score
  FROM asked JOIN tf USING (scope, term) JOIN df USING (scope, term) JOIN stats USING (scope) GROUP BY ALL),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS rank FROM bm25 WHERE score > 0)"""
FLAT = BM25.replace("{scope}", "'all'").replace("{qscope}", "'all'")
TOKENS = r"regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[a-z0-9]+(?:[-''][a-z0-9]+)*|[\x{{3400}}-\x{{9fff}}]')"
HASHED = """,
tok AS (SELECT 'c' AS kind, chunk_id AS id, doc_id * 1000000 + chunk_index AS position, unnest(""" + TOKENS.format("text") + """) AS t FROM chunks
  UNION ALL SELECT 'q', item_id::VARCHAR, item_id, unnest(""" + TOKENS.format("text") + """) FROM benchmark),
slots AS (SELECT kind, id, position, ('0x' || substr(sha256(t), 1, 8))::BIGINT % 256 AS slot, count(*)::DOUBLE AS c FROM tok GROUP BY ALL),
weights AS (SELECT *, c / sqrt(sum(c * c) OVER (PARTITION BY kind, id)) AS w FROM slots),
cosine AS (SELECT q.id::BIGINT AS query_id, c.id AS chunk_id, c.position, round(sum(q.w * c.w), 9) AS score FROM weights q JOIN weights c ON q.slot = c.slot AND q.kind = 'q' AND c.kind = 'c' GROUP BY ALL),
hashed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS rank FROM cosine WHERE score > 0)"""
RERANKED = """,
base AS (SELECT * FROM lexical WHERE rank <= 20),
qt AS (SELECT item_id AS query_id, list_distinct(""" + TOKENS.format("text") + """) AS qt FROM benchmark),
over AS (SELECT b.query_id, b.chunk_id, b.rank AS base_rank, round(len(list_intersect(qt, list_distinct(""" + TOKENS.format("c.text") + """)))::DOUBLE / greatest(len(qt), 1) + b.score, 9) AS rerank_score
  FROM base b JOIN qt USING (query_id) JOIN chunks c USING (chunk_id)),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, base_rank) AS rank FROM over)"""
UNIT = """unit AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
scores AS (SELECT q.vec_id AS query_id, u.vec_id, round(list_sum(list_transform(list_zip(q.v, u.v), lambda p: p[1] * p[2])), 9) AS score FROM unit q CROSS JOIN unit u WHERE q.vec_id % 20 = 0)"""

ORACLES = {
    "bm25_topk": f"WITH {FLAT} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM lexical WHERE rank <= 6",
    "bm25_scoped": "WITH " + BM25.replace("{scope}", "lang").replace("{qscope}", "CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'fr' END") + " SELECT query_id, scope, rank, chunk_id, round(score, 6) AS score FROM lexical WHERE rank <= 6",
    "vector_topk": f"WITH {UNIT}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores WHERE score > 0) SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 6",
    "vector_threshold": f"WITH {UNIT} SELECT query_id, count(*) AS passed, round(max(score), 6) AS best FROM scores WHERE score >= 0.25 GROUP BY query_id",
    "hashing_cosine": f"WITH {SPANS} {HASHED} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM hashed WHERE rank <= 6",
    "rrf_fusion": f"""WITH {FLAT} {HASHED}, both_ AS (SELECT query_id, chunk_id, position, rank FROM lexical WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, position, rank FROM hashed WHERE rank <= 20),
fused AS (SELECT query_id, chunk_id, position, round(sum(1::DOUBLE / (60 + rank)), 12) AS score FROM both_ GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS rank FROM fused)
SELECT query_id, rank, chunk_id, round(score, 9) AS score FROM r WHERE rank <= 20""",
    "overlap_rerank": f"WITH {FLAT} {RERANKED} SELECT query_id, rank, base_rank, chunk_id, round(rerank_score, 6) AS rerank_score FROM reranked",
    "rank_changes": f"WITH {FLAT} {RERANKED} SELECT query_id, count(*) FILTER (rank <> base_rank) AS rank_changes FROM reranked GROUP BY query_id",
    "answerability_gate": f"""WITH {FLAT} {RERANKED}, g AS (SELECT *, max(rerank_score) OVER (PARTITION BY query_id) AS best FROM reranked),
k AS (SELECT query_id, chunk_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, base_rank) AS rank FROM g WHERE best >= 40 AND rerank_score >= 20)
SELECT query_id, rank, chunk_id, round(rerank_score, 6) AS rerank_score FROM k WHERE rank <= 6""",
    "evidence_ids": f"WITH {FLAT} SELECT printf('ev_q%03d_r%03d', query_id + 1, rank) AS evidence_id, query_id, chunk_id FROM lexical WHERE rank <= 5",
    "neighbor_context": f"""WITH {FLAT}, hits AS (SELECT l.query_id, c.* FROM lexical l JOIN chunks c USING (chunk_id) WHERE rank <= 3)
SELECT h.query_id, h.chunk_id AS hit_id, CASE WHEN c.chunk_index < h.chunk_index THEN 'before' ELSE 'after' END AS relation, c.chunk_id, substr(c.text, 1, 600) AS text
FROM hits h JOIN chunks c ON c.doc_id = h.doc_id AND abs(c.chunk_index - h.chunk_index) = 1 AND c.source IS NOT DISTINCT FROM h.source""",
    "snippet": f"""WITH {FLAT}, q AS (SELECT item_id AS query_id, list_distinct({TERMS.format('text')}) AS qt FROM benchmark),
m AS (SELECT l.query_id, l.chunk_id, c.text AS t, length(c.text) AS n, coalesce(list_min(list_filter(list_transform(qt, lambda x: strpos(lower(c.text), x) - 1), lambda p: p >= 0)), 0) AS a
  FROM lexical l JOIN chunks c USING (chunk_id) JOIN q USING (query_id) WHERE rank <= 3),
s AS (SELECT *, least(greatest(0, a - 100), greatest(0, n - 200)) AS s0 FROM m),
e AS (SELECT *, CASE WHEN s0 > 0 THEN '…' ELSE '' END AS pre, CASE WHEN least(n, s0 + 200) < n THEN '…' ELSE '' END AS post FROM s)
SELECT query_id, chunk_id, CASE WHEN n <= 200 THEN t ELSE pre || substr(t, s0 + 1, 200 - length(pre) - length(post)) || post END AS snippet FROM e""",
    "evidence_budget": f"""WITH {FLAT}, h AS (SELECT query_id, rank, chunk_id, c.text, ceil(length(c.text) / 4.0)::BIGINT AS tokens FROM lexical JOIN chunks c USING (chunk_id) WHERE rank <= 6),
r AS (SELECT *, 700 - 16 - coalesce(sum(tokens + 16) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM h)
SELECT query_id, rank, chunk_id, tokens <= room AS whole, CASE WHEN tokens <= room THEN length(text) ELSE length(regexp_replace(substr(text, 1, (room * 4 - 2)::BIGINT), '\\s+$', '')) + 2 END::BIGINT AS n_chars FROM r WHERE room > 0""",
    "citation_whitelist": """SELECT item_id AS query_id, 'See [msg_' || item_id || ':E1] and [msg_' || item_id || ':E2] and [msg_' || item_id || ':E3] and [msg_' || item_id || ':E4] and  and  but .' AS answer, 7::BIGINT AS n_cited FROM benchmark""",
    "report_quality": f"""WITH {FLAT}, ev AS (SELECT l.query_id AS report_id, chunk_index FROM lexical l JOIN chunks USING (chunk_id) WHERE rank <= 3),
a AS (SELECT report_id, count(*) + CASE WHEN report_id % 7 = 0 THEN 1 ELSE 0 END AS refs, count(*) AS valid, count(*) FILTER (chunk_index > 5) + CASE WHEN report_id % 7 = 0 THEN 1 ELSE 0 END AS issues FROM ev GROUP BY report_id),
b AS (SELECT *, round_even(100::DOUBLE * valid / refs, 0)::BIGINT AS validity, 0.5::DOUBLE AS coverage, greatest(0, 100 - 12 * issues) AS faithfulness, round_even(55 + 45 * 0.5::DOUBLE, 0)::BIGINT AS completeness,
  CASE WHEN report_id % 2 = 0 THEN 85 ELSE 65 END AS critical FROM a),
c AS (SELECT *, least(validity, faithfulness) AS accuracy FROM b), d AS (SELECT *, round_even((accuracy + completeness + faithfulness + validity + critical)::DOUBLE / 5, 0)::BIGINT AS overall FROM c)
SELECT report_id, refs, issues, validity, coverage, faithfulness, completeness, accuracy, overall, issues = 0 AND overall >= 75 AND validity >= 90 AS passed FROM d""",
}
