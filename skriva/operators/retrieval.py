"""Batch ranked retrieval: many queries at once, scope-local statistics, exact top-k.

Queries: (query_id, query[, scope]). Chunks: (scope, chunk_id, position, text ...). Where no scope is given all chunks are one."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..functions import vectors as V
from ..schemas import DEFAULTS, Params
from ..session import written

#: Scores are compared after rounding, so that ties do not depend on the order of a sum.
PLACES = 9
#: Queries are broadcast up to this many bytes.
BROADCAST_BYTES = 64 << 20


def fits(df: DataFrame, row_bytes: Column) -> bool:
    """Is df, measured row by row, small enough to broadcast?"""
    return (df.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES


def in_scope(section: Column, wanted: Column) -> Column:
    """FLT1: an empty or null section asks for everything."""
    return wanted.isNull() | (wanted == "") | (section == wanted)


def overlaps_pages(start: Column, end: Column, low: Column, high: Column) -> Column:
    """FLT2: a missing end is taken from the other; both missing never match."""
    return F.coalesce((F.coalesce(start, end) <= high) & (F.coalesce(end, start) >= low), F.lit(False))


def scoped(chunks: DataFrame, section: str | None = None, pages: tuple[int, int] | None = None) -> DataFrame:
    """FLT1-2: the chunks of a section and a range of pages; statistics are then those of what is left."""
    out = chunks.where(in_scope(F.col("section"), F.lit(section)))
    return out.where(overlaps_pages(F.col("page_start"), F.col("page_end"), F.lit(pages[0]), F.lit(pages[1]))) if pages else out


class Numbers(dict):
    """Token -> its number, in the order of their first use."""

    def __missing__(self, token: str) -> int:
        n = self[token] = len(self)
        return n


def counted(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key..., doc_len, terms, tfs) from (key..., text): the distinct terms of each row and how often each occurs, cut and counted inside the Arrow batch, so no
    token is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                lists = [T.term_list(t) if t else [] for t in part.column("text").to_pylist()]
                counts = [Counter(x) for x in lists]
                offsets = pa.array(np.cumsum([0, *map(len, counts)]), pa.int32())
                terms = pa.ListArray.from_arrays(offsets, pa.array([t for c in counts for t in c], pa.string()))
                tfs = pa.ListArray.from_arrays(offsets, pa.array([n for c in counts for n in c.values()], pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in key), pa.array([len(x) for x in lists], pa.int64()), terms, tfs], names=[*key, "doc_len", "terms", "tfs"])

    kinds = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key]
    return rows.select(*key, "text").mapInArrow(run, ", ".join([*kinds, "doc_len long, terms array<string>, tfs array<int>"]))


def index(chunks: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """(scope, chunk_id, position, more..., doc_len, terms, tfs) per chunk as a written table: built once, read by every search over the same chunks."""
    return written(counted(chunks, ["scope", "chunk_id", "position", *more]))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, scope, term, times): a repeated query term counts as often as it stands."""
    scope = F.col("scope") if "scope" in queries.columns else F.lit("all")
    q = queries.select("query_id", scope.alias("scope"), F.col("query").alias("text"))
    q = T.normalised(q, "text").select("query_id", "scope", F.explode(T.terms(F.col("text"))).alias("term"))
    return q.groupBy("query_id", "scope", "term").agg(F.count("*").alias("times"))


def document_counts(terms: DataFrame, rows: DataFrame, hint) -> DataFrame:
    """(scope, term, df): in how many rows of the index each of the terms (scope, term) stands."""
    wanted = terms.select("scope", "term").distinct()
    return rows.select("scope", F.explode("terms").alias("term")).join(hint(wanted), ["scope", "term"], "left_semi").groupBy("scope", "term").agg(F.count("*").cast("double").alias("df"))


def bm25(queries: DataFrame, chunks: DataFrame | None, params: Params = DEFAULTS, indexed: DataFrame | None = None, k: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """SC4, AGG1-2, JN2: (query_id, scope, chunk_id, position, score) with score > 0. Statistics come from each scope alone. ``indexed``: the index of
    the chunks, where there is one. With ``k``, at least the k best of each query, for ``ranked`` to choose from. ``counts``: the document counts of
    the queries' terms, where they are known.

    Two passes over the index: one counts the documents of the wanted terms, one scores. While the query set is measured small, its weights are shipped and
    a batch of chunks is scored at once, so of a query's many hits only the best of each batch are shuffled; else all by joins."""
    if params.k1 <= 0 or not 0 <= params.b <= 1:
        raise ValueError("k1 must be positive and b within 0..1")
    rows = index(chunks) if indexed is None else indexed
    q = query_terms(queries)
    small = fits(q, F.octet_length("term") + F.octet_length("scope") + 64)
    hint = F.broadcast if small else (lambda df: df)
    n, length = F.count("*").cast("double"), F.greatest(F.avg("doc_len"), F.lit(1.0))
    stats = rows.groupBy("scope").agg(n.alias("n"), length.alias("avg_len"))
    df = document_counts(q, rows, hint) if counts is None else counts
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = q.join(hint(df), ["scope", "term"]).join(stats, "scope").select("query_id", "scope", "term", (F.col("times") * idf * (params.k1 + 1)).alias("weight"), "avg_len")
    if small:
        return scored(rows, weights, params, k)
    hits = rows.select("scope", "chunk_id", "position", "doc_len", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("*", F.col("x.terms").alias("term"), F.col("x.tfs").cast("double").alias("tf"))
    hits = hits.join(weights, ["scope", "term"])
    part = F.col("weight") * F.col("tf") / (F.col("tf") + params.k1 * (1 - params.b + params.b * F.col("doc_len") / F.col("avg_len")))
    out = hits.groupBy("query_id", "scope", "chunk_id", "position").agg(F.round(F.sum(part), PLACES).alias("score"))
    return out.where("score > 0")


def scored(rows: DataFrame, weights: DataFrame, params: Params, k: int | None, block: int = 2048) -> DataFrame:
    """BM25 by batches: weights (query_id, scope, term, weight, avg_len) of a small query set, a block of queries at a time."""
    found = weights.orderBy("query_id", "scope", "term").toArrow()
    names = np.unique(found.column("query_id").to_numpy()) if len(found) else np.empty(0, np.int64)
    frames = []
    for at in range(0, max(len(names), 1), block):
        ids = names[at : at + block]
        own = found.filter(pc.is_in(found.column("query_id"), pa.array(ids))) if len(ids) else found.slice(0, 0)
        # Per scope: its average length, each term's number, and behind its first entry the queries with that term and their weights.
        table: dict[str, tuple] = {}
        by_scope: dict[str, dict[str, list]] = {}
        lengths: dict[str, float] = {}
        for query, scope, term, weight, length in zip(*(own.column(c).to_pylist() for c in ("query_id", "scope", "term", "weight", "avg_len")), strict=True):
            by_scope.setdefault(scope, {}).setdefault(term, []).append((int(np.searchsorted(ids, query)), weight))
            lengths[scope] = length
        for scope, terms in by_scope.items():
            n = np.array([len(x) for x in terms.values()], np.int64)
            pairs = [p for x in terms.values() for p in x]
            table[scope] = (lengths[scope], {t: i for i, t in enumerate(terms)}, n, np.cumsum(n) - n, np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs]))
        frames.append(scored_block(rows, ids, table, params, k))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def scored_block(rows: DataFrame, ids: np.ndarray, table: dict[str, tuple], params: Params, k: int | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                scopes = batch.column("scope").dictionary_encode()
                for s, scope in enumerate(scopes.dictionary.to_pylist()):
                    if scope not in table:
                        continue
                    part = batch.filter(pc.equal(scopes.indices, s))
                    length, numbers, n, first, query, weight = table[scope]
                    lists = part.column("terms")
                    code = lists.flatten().dictionary_encode()
                    number = np.array([numbers.get(t, -1) for t in code.dictionary.to_pylist()], np.int64)[code.indices.to_numpy()]
                    hit = np.flatnonzero(number >= 0)
                    if not len(hit):
                        continue
                    row, tf, number = pc.list_parent_indices(lists).to_numpy()[hit], part.column("tfs").flatten().to_numpy()[hit].astype(float), number[hit]
                    doc_len = part.column("doc_len").to_numpy().astype(float)[row]
                    share = tf / (tf + params.k1 * (1 - params.b + params.b * doc_len / length))
                    # Every hit once for each query with that term.
                    times = n[number]
                    entry = np.repeat(first[number] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                    cell = np.repeat(row, times).astype(np.int64) * len(ids) + query[entry]
                    scores = np.bincount(cell, weight[entry] * np.repeat(share, times), part.num_rows * len(ids)).reshape(part.num_rows, len(ids))
                    position = part.column("position").to_numpy()
                    i, j = best_of(np.round(scores, PLACES), position, k)
                    take = pa.array(i)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[j], pa.int64()), part.column("scope").take(take), part.column("chunk_id").take(take), pa.array(position[i]), pa.array(np.round(scores[i, j], PLACES))],
                        names=["query_id", "scope", "chunk_id", "position", "score"])

    return rows.mapInArrow(run, "query_id long, scope string, chunk_id string, position long, score double")


def ranked(scored: DataFrame, k: int | None = None, by: str = "score", key: str = "query_id") -> DataFrame:
    """WIN1, TOP1: rank by falling score, ties by position."""
    df = scored.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.col(by).desc(), "position")))
    return df.where(F.col("rank") <= k) if k else df


def best_of(scores: np.ndarray, position: np.ndarray, k: int | None, least: float = 0.0, above: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best rows of each column ``above`` a value (zero) and from ``least`` on, ties by position; of all such rows without k."""
    if k is None:
        return np.nonzero((scores > above) & (scores >= least) & np.isfinite(scores))
    rows, columns = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for j in range(scores.shape[1]):
        s = np.where(np.isfinite(scores[:, j]), scores[:, j], -np.inf)
        some = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > 4 * k else np.arange(len(s))
        best = some[np.lexsort((position[some], -s[some]))[:k]]
        best = best[(s[best] > above) & (s[best] >= least)]
        rows.append(best)
        columns.append(np.full(len(best), j))
    return np.concatenate(rows), np.concatenate(columns)


def vector_hits(queries: DataFrame, vectors: DataFrame, k: int | None = None, threshold: float = 0.0, block: int = 4096, above: float = 0.0, last_first: bool = False) -> DataFrame:
    """JN3, FLT5: (query_id, vec_id, position, score) of a stated set of queries (query_id, q) against every vector, by matrix products over Arrow batches:
    the k best of each batch (of which a rank over the result picks the best of all), or all from the threshold on. The queries are shipped
    ``block`` at a time. Scores must be ``above`` zero or another value; of equal ones the greater position comes first with ``last_first``."""
    names = [r["query_id"] for r in queries.select("query_id").distinct().orderBy("query_id").collect()]
    frames = []
    for at in range(0, max(len(names), 1), block):
        some = names[at : at + block]
        found = {r["query_id"]: r["q"] for r in queries.where(F.col("query_id").between(some[0], some[-1])).collect()} if some else {}
        ids = np.array(sorted(found), np.int64)
        q = np.array([found[i] for i in ids.tolist()], float).reshape(len(ids), -1)
        norms = np.sqrt((q * q).sum(axis=1, keepdims=True))
        frames.append(_vector_block(vectors, ids, (q / np.where(norms == 0, 1, norms)).T, k, threshold, above, last_first))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _vector_block(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, k: int | None, threshold: float, above: float, last_first: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                if not len(ids):
                    continue
                v = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                norms = np.sqrt((v * v).sum(axis=1, keepdims=True))
                scores = np.round((v / np.where(norms == 0, 1, norms)) @ q, PLACES)
                position = batch.column("position").to_numpy(zero_copy_only=False)
                i, j = best_of(scores, -position if last_first else position, k, threshold, above)
                yield pa.RecordBatch.from_arrays([pa.array(ids[j]), batch.column("vec_id").take(pa.array(i)), pa.array(position[i]), pa.array(scores[i, j])], names=["query_id", "vec_id", "position", "score"])

    good = vectors.where(F.col("embedding").isNotNull()).select("vec_id", F.col("position").cast("long").alias("position"), V.doubles(F.col("embedding")).alias("embedding"))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    return good.mapInArrow(run, f"query_id long, vec_id {kind}, position long, score double")


def vector_scores(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """JN3: (query_id, vec_id, position, score) of every query against every vector, in blocks of the query set.

    queries: (query_id, q). The queries are a stated set; they are broadcast while their measured size allows, else split into blocks."""
    q = queries.select("query_id", V.unit(F.col("q")).alias("q"))
    v = vectors.select("vec_id", "position", V.unit(F.col("embedding")).alias("v"))
    if fits(q, 8 * F.size("q") + 64):
        pairs = v.crossJoin(F.broadcast(q))
    else:  # blocks of queries meet blocks of vectors, each pair of blocks in one task
        parts = 64
        v = v.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        pairs = v.join(q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")), "block")
    return pairs.select("query_id", "vec_id", "position", F.round(V.dot(F.col("q"), F.col("v")), PLACES).alias("score"))


def positive(scores: DataFrame, threshold: float = 0.0) -> DataFrame:
    """FLT5: finite, above zero, at least the threshold (inclusive). Spark sorts NaN highest, so it goes first."""
    s = F.col("score")
    return scores.where(s.isNotNull() & ~F.isnan(s) & (s < float("inf")) & (s > 0) & (s >= threshold))


def hashed_vectors(rows: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """SC6 as sparse rows: (key..., slot, weight), L2-normalised."""
    t = rows.select(*key, F.explode(T.eval_tokens(F.coalesce(text, F.lit("")))).alias("token"))
    counts = t.groupBy(*key, V.slot(F.col("token")).alias("slot")).agg(F.count("*").cast("double").alias("c"))
    norms = counts.groupBy(*key).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    return counts.join(norms, key).select(*key, "slot", (F.col("c") / F.col("norm")).alias("weight"))


def sparse_cosine(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, position, score): an equi-join on slots instead of a join of all pairs."""
    hit = queries.select("query_id", "slot", F.col("weight").alias("wq")).join(chunks, "slot")
    return hit.groupBy("query_id", "chunk_id", "position").agg(F.round(F.sum(F.col("wq") * F.col("weight")), PLACES).alias("score")).where("score > 0")


def hashed_topk(queries: DataFrame, chunks: DataFrame, k: int, dimensions: int = 256, block: int = 4096) -> DataFrame:
    """SC6 for a stated set of queries (query_id, query): the k best of every Arrow batch of chunks, scored by matrix products. The best
    k of all are among them, so a rank over the result is exact. The queries' vectors are counted as a table and shipped, ``block`` queries at
    a time (block x dimensions numbers each)."""
    tokens = queries.select("query_id", F.explode(T.eval_tokens(F.coalesce("query", F.lit("")))).alias("t"))
    slots = tokens.groupBy("query_id", V.slot(F.col("t"), dimensions).alias("slot")).agg(F.count("*").cast("double").alias("n"))
    slots = written(slots)
    names = [r["query_id"] for r in slots.select("query_id").distinct().orderBy("query_id").collect()]
    frames = [_hashed_block(slots, chunks, names[i : i + block], k, dimensions) for i in range(0, len(names), block)]
    out = frames[0] if frames else _hashed_block(slots, chunks, [], k, dimensions)
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _hashed_block(slots: DataFrame, chunks: DataFrame, names: list, k: int, dimensions: int) -> DataFrame:
    ids = np.array(names, np.int64)
    q = np.zeros((dimensions, len(ids)))
    some = slots.where(F.col("query_id").between(names[0], names[-1])).toArrow() if names else None
    if some is not None:
        q[some.column("slot").to_numpy(), np.searchsorted(ids, some.column("query_id").to_numpy())] = some.column("n").to_numpy()
        q /= np.sqrt((q * q).sum(axis=0, keepdims=True))

    def dense(texts: list[str | None], memo: dict[str, int]) -> np.ndarray:
        numbers, lists = Numbers(), [T.eval_list(t) if t else [] for t in texts]
        n = np.array([len(x) for x in lists], np.int64)
        code = np.fromiter((numbers[t] for x in lists for t in x), np.int64, int(n.sum()))
        if len(memo) > 500_000:
            memo.clear()
        for t in numbers:
            if t not in memo:
                memo[t] = int(hashlib.sha256(t.encode()).hexdigest()[:8], 16) % dimensions
        slot = np.array([memo[t] for t in numbers], np.int64)
        out = np.bincount(np.repeat(np.arange(len(n)), n) * dimensions + slot[code], minlength=len(n) * dimensions).astype(float).reshape(len(n), dimensions)
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(norms == 0, 1, norms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                scores = np.round(dense(batch.column("text").to_pylist(), memo) @ q, PLACES)
                position = batch.column("position").to_numpy(zero_copy_only=False)
                i, j = best_of(scores, position, k)
                if len(i):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[j], pa.int64()), batch.column("chunk_id").take(pa.array(i)), pa.array(position[i], pa.int64()), pa.array(scores[i, j], pa.float64())],
                        names=["query_id", "chunk_id", "position", "score"])

    return chunks.select("chunk_id", "position", "text").mapInArrow(run, "query_id long, chunk_id string, position long, score double")


def rrf(rankings: list[DataFrame], k: int = DEFAULTS.rrf_k) -> DataFrame:
    """AGG3, JN4, SET1: (query_id, chunk_id, position, score) = sum of 1 / (k + rank); the union form needs one shuffle."""
    all_ = rankings[0].select("query_id", "chunk_id", "position", "rank")
    for r in rankings[1:]:
        all_ = all_.unionByName(r.select("query_id", "chunk_id", "position", "rank"))
    return all_.groupBy("query_id", "chunk_id", "position").agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), PLACES + 3).alias("score"))


def overlap_rerank(queries: DataFrame, candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """TOP6: base score plus the share of query tokens in the passage; (…, base_rank, rerank_score, rank)."""
    q = queries.select("query_id", F.array_distinct(T.eval_tokens(F.col("query"))).alias("qt"))
    j = candidates.join(q, "query_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    coverage = F.size(F.array_intersect("qt", F.array_distinct(T.eval_tokens(F.col("text"))))) / F.greatest(F.size("qt"), F.lit(1))
    out = j.select("query_id", "chunk_id", "position", "score", F.col("rank").alias("base_rank"), F.round(coverage + F.col("score"), PLACES).alias("rerank_score"))
    order = W.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "base_rank")
    return out.withColumn("rank", F.row_number().over(order))


def gate(reranked: DataFrame, answerable: float, evidence: float, mode: str = "enabled", count: int = DEFAULTS.evidence) -> DataFrame:
    """TOP5: disabled and shadow keep the base order; enabled reorders, drops queries whose best score is below ``answerable``,
    then passages below ``evidence``; at most ``count`` stay."""
    if mode != "enabled":
        return reranked.withColumn("rank", F.col("base_rank")).where(F.col("rank") <= count)
    best = F.max("rerank_score").over(W.partitionBy("query_id"))
    kept = reranked.withColumn("best", best).where((F.col("best") >= answerable) & (F.col("rerank_score") >= evidence)).drop("best")
    order = W.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "base_rank")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def rank_changes(reranked: DataFrame) -> DataFrame:
    """WIN13: how many places hold another chunk after reranking."""
    return reranked.groupBy("query_id").agg(F.count_if(F.col("base_rank") != F.col("rank")).alias("rank_changes"))


def search(
    queries: DataFrame, chunks: DataFrame, top_k: int = 8, vectors: list[DataFrame] = (), params: Params = DEFAULTS, section: str | None = None, pages: tuple[int, int] | None = None
) -> DataFrame:
    """The search façade: BM25 over the chunks in scope, fused with vector rankings where given; top_k with snippet."""
    chunks = scoped(chunks, section, pages) if section or pages else chunks
    depth = max(top_k, params.candidates)
    lexical = ranked(bm25(queries, chunks, params, k=depth), depth)
    inside = [v.join(chunks.select("chunk_id"), "chunk_id", "left_semi") for v in vectors] if section or pages else vectors
    scored = rrf([lexical, *inside], params.rrf_k) if vectors else lexical.drop("rank")
    top = ranked(scored, top_k)
    q = queries.select("query_id", "query").withColumn("qt", F.array_distinct(T.terms(F.col("query"))))
    out = top.join(chunks.select("chunk_id", "text"), "chunk_id").join(q, "query_id")
    return out.withColumn("snippet", T.snippet(F.col("text"), F.col("qt"), params.snippet_chars)).drop("qt", "query", "text")
