"""BM25 from postings with block maxima: exact top-k without scoring every chunk that shares a word with the question.

Chunks are numbered off into ranges of RANGE neighbours. A block holds the postings of one term in one range: the chunks' slots, how often the
term occurs, their lengths, and ahead of these the greatest count and the least length. Those bound the term's share of any score in the range, for every k1, b
and average length, so the sum over a question's terms bounds all its scores there.

A search reads the heads of the wanted terms' blocks, scores each question's LEAD most promising ranges, and takes the k-th best score found as its threshold;
of the other ranges only those whose bound reaches the threshold are scored. What is skipped cannot be among the k best, so the result is that of a full scan. Blocks
are stored by buckets of terms, so only the buckets of the wanted terms are opened.

Where a set of questions asks for more postings than the whole index holds (each counted once per question), one scan of the forward index that scores batches of
chunks for all questions at once is less work; the counts in the heads tell. The result is the same. ``best`` asks this of the forward index, before there are postings.

A block never holds more than RANGE postings, so a word that stands in every chunk is many rows that no task has to gather."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schemas import DEFAULTS, Params
from ..session import scratch_path, written
from . import retrieval as R

RANGE, BUCKETS, LEAD = 64, 64, 4
_BLOCK = "scope string, range long, term string, n int, max_tf int, min_len long, slots array<int>, tfs array<int>, lens array<long>, chunk_ids array<string>, positions array<long>"


@dataclass(frozen=True)
class Postings:
    """blocks: (bucket, scope, range, term, n, max_tf, min_len, slots, tfs, lens). ranges: (scope, range, n, postings, lens, chunk_ids, positions), arrays by slot.
    forward: (scope, chunk_id, position, doc_len, terms, tfs)."""

    blocks: DataFrame
    ranges: DataFrame
    forward: DataFrame


def build(forward: DataFrame) -> Postings:
    """Postings of a forward index (scope, chunk_id, position, doc_len, terms, tfs), as written tables. One pass cuts each input partition into ranges; one shuffle
    brings the blocks to their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32  # unique: this job writes the only copy
        for whole in batches:
            for at in range(0, whole.num_rows, RANGE):
                some = whole.slice(at, RANGE)
                for scope in pc.unique(some.column("scope")).to_pylist():
                    part = some.filter(pc.equal(some.column("scope"), scope))
                    number += 1
                    yield _blocks(part, scope, number)

    out = forward.where(F.col("scope").isNotNull()).select("scope", "chunk_id", "position", "doc_len", "terms", "tfs").mapInArrow(run, _BLOCK)
    bucket = F.when(F.col("term").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("scope", "term"), F.lit(BUCKETS)).cast("int"))
    out = out.withColumn("bucket", bucket)
    # Four parts per bucket, so that a bucket is no task of its own.
    out = out.repartition("bucket", F.pmod(F.col("range"), F.lit(4))).sortWithinPartitions("bucket", "scope", "term", "range")
    path = scratch_path(forward.sparkSession, "postings")
    out.write.partitionBy("bucket").parquet(path)
    stored = forward.sparkSession.read.schema(out.schema).parquet(path)
    return Postings(stored.where("bucket >= 0").drop("chunk_ids", "positions"), stored.where("bucket = -1").select("scope", "range", "n", F.col("min_len").alias("postings"), "lens", "chunk_ids", "positions"), forward)


def _blocks(part: pa.RecordBatch, scope: str, number: int) -> pa.RecordBatch:
    """The blocks of one range, and one row without term for the range itself."""
    lens = part.column("doc_len").to_numpy().astype(np.int64)
    lists = part.column("terms")
    code = lists.flatten().dictionary_encode()
    codes, slot = code.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.list_parent_indices(lists).to_numpy()
    order = np.lexsort((slot, codes))
    slot, tf = slot[order], part.column("tfs").flatten().to_numpy()[order]
    n = np.bincount(codes, minlength=len(code.dictionary)).astype(np.int64)
    first = np.cumsum(n) - n
    size = len(n)
    offsets = np.append(np.append(first, len(slot)), len(slot))  # the last row, of the range, has none
    lists_of = lambda values, kind: pa.ListArray.from_arrays(pa.array(offsets[: size + 2], pa.int32()), pa.array(values, kind))
    own = pa.ListArray.from_arrays(pa.array([*(0 for _ in range(size + 1)), part.num_rows], pa.int32()), part.column("chunk_id").cast(pa.string()))
    places = pa.ListArray.from_arrays(own.offsets, part.column("position").cast(pa.int64()))
    # Lengths: of each posting's chunk, then of all chunks of the range.
    of = pa.ListArray.from_arrays(pa.array([*offsets[: size + 1], len(slot) + part.num_rows], pa.int32()), pa.array(np.concatenate([lens[slot], lens]), pa.int64()))
    most = np.maximum.reduceat(tf, first) if size else np.empty(0, np.int64)
    least = np.minimum.reduceat(lens[slot], first) if size else np.empty(0, np.int64)
    columns = [
        pa.array([scope] * (size + 1), pa.string()), pa.array(np.full(size + 1, number), pa.int64()), pa.concat_arrays([code.dictionary.cast(pa.string()), pa.nulls(1, pa.string())]), pa.array(np.append(n, part.num_rows), pa.int32()),
        pa.array(np.append(most, 0), pa.int32()), pa.array(np.append(least, len(slot)), pa.int64()), lists_of(slot, pa.int32()), lists_of(tf, pa.int32()), of, own, places]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _BLOCK.split(", ")])


def share(tf: Column, length: Column, params: Params) -> Column:
    """What BM25 gives a term for its count in a chunk, without its weight; grows with the count and falls with the length."""
    tf = tf.cast("double")
    return tf / (tf + params.k1 * (1 - params.b + params.b * length / F.col("avg_len")))


@dataclass(frozen=True)
class Search:
    """hits: (query_id, scope, chunk_id, position, score), the k best of each query among them. blocks: (query_id, blocks, blocks_read)."""

    hits: DataFrame
    blocks: DataFrame


def search(queries: DataFrame, index: Postings, k: int, params: Params = DEFAULTS, lead: int = LEAD, scan: bool | None = None) -> Search:
    """JN2, AGG1-2, TOP1: the k best chunks of each query (query_id, query[, scope]), exactly as a full scan ranks them. ``scan`` decides between the
    postings and the forward index; by default their counts do."""
    if params.k1 <= 0 or not 0 <= params.b <= 1 or k < 1:
        raise ValueError("k and k1 must be positive and b within 0..1")
    q = written(R.query_terms(queries))
    small = R.fits(q, F.octet_length("term") + F.octet_length("scope") + 64)
    hint = F.broadcast if small else (lambda df: df)
    buckets = [r["bucket"] for r in q.select(F.pmod(F.xxhash64("scope", "term"), F.lit(BUCKETS)).cast("int").alias("bucket")).distinct().collect()]  # BUCKETS at most
    blocks = index.blocks.where(F.col("bucket").isin(buckets)).drop("bucket")
    heads = blocks.select("scope", "term", "range", "n", "max_tf", "min_len").join(hint(q.select("scope", "term").distinct()), ["scope", "term"], "left_semi")
    heads = written(heads)
    total = F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))
    stats = index.ranges.groupBy("scope").agg(F.sum("n").cast("double").alias("docs"), F.greatest(total / F.sum("n"), F.lit(1.0)).alias("avg_len"))
    df = heads.groupBy("scope", "term").agg(F.sum("n").cast("double").alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = written(q.join(df, ["scope", "term"]).join(stats, "scope").select("query_id", "scope", "term", (F.col("times") * idf * (params.k1 + 1)).alias("weight"), "avg_len"))
    if scan is None:
        asked = heads.groupBy("scope", "term").agg(F.sum("n").alias("n")).join(hint(q), ["scope", "term"]).agg(F.sum("n")).first()[0] or 0
        scan = small and asked > (index.ranges.agg(F.sum("postings")).first()[0] or 0)
    if scan:
        met = heads.join(hint(weights), ["scope", "term"]).groupBy("query_id").agg(F.count("*").alias("blocks"))
        return Search(R.scored(index.forward, weights, params, k), met.withColumn("blocks_read", F.col("blocks")))
    top = F.sum(F.col("weight") * share(F.col("max_tf"), F.col("min_len"), params))
    bounds = written(heads.join(hint(weights), ["scope", "term"]).groupBy("query_id", "scope", "range").agg(top.alias("bound"), F.count("*").alias("blocks")))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("bound").desc(), "range"))
    first = written(bounds.withColumn("place", place).where(F.col("place") <= lead).drop("place"))
    some = written(_scores(first, weights, blocks, hint, params))
    # The k-th best score so far, or nothing if there are fewer.
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc()))
    least = some.withColumn("place", best).where(F.col("place") == k).select("query_id", F.col("score").alias("least"))
    least = written(least)
    rest = bounds.join(F.broadcast(first.select("query_id", "range")) if hint is F.broadcast else first.select("query_id", "range"), ["query_id", "range"], "left_anti").join(hint(least), "query_id", "left")
    # Bounds and scores are sums of the same doubles in other orders, and scores are rounded.
    rest = written(rest.where(F.col("least").isNull() | (F.col("bound") * (1 + 1e-9) + 10.0**-R.PLACES >= F.col("least"))).select("query_id", "scope", "range", "bound", "blocks"))
    scored = some.unionByName(_scores(rest, weights, blocks, hint, params)).join(hint(least), "query_id", "left")
    scored = scored.where((F.col("score") > 0) & (F.col("least").isNull() | (F.col("score") >= F.col("least"))))
    named = scored.join(index.ranges.select("scope", "range", "chunk_ids", "positions"), ["scope", "range"])
    hits = named.select("query_id", "scope", F.get("chunk_ids", F.col("slot")).alias("chunk_id"), F.get("positions", F.col("slot")).alias("position"), "score")
    read = first.unionByName(rest).groupBy("query_id").agg(F.sum("blocks").alias("blocks_read"))
    all_ = bounds.groupBy("query_id").agg(F.sum("blocks").alias("blocks"))
    return Search(hits, all_.join(read, "query_id"))


def best(queries: DataFrame, forward: DataFrame, postings: Callable[[], Postings], k: int, params: Params = DEFAULTS) -> DataFrame:
    """The hits of ``search`` for a forward index whose postings need not exist: the counts of the wanted terms, taken from the forward index, tell whether one scan of it is
    less work. Only if it is not are the postings made, which writes and shuffles every one of them."""
    q = written(R.query_terms(queries))
    if R.fits(q, F.octet_length("term") + F.octet_length("scope") + 64):
        counts = written(R.document_counts(q, forward, F.broadcast))
        asked = counts.join(F.broadcast(q), ["scope", "term"]).agg(F.sum("df")).first()[0] or 0
        if asked > (forward.agg(F.sum(F.size("tfs"))).first()[0] or 0):
            return R.bm25(queries, None, params, forward, k, counts)
    return search(queries, postings(), k, params).hits


def _scores(chosen: DataFrame, weights: DataFrame, blocks: DataFrame, hint, params: Params) -> DataFrame:
    """(query_id, scope, range, slot, score) of the chunks in the chosen ranges (query_id, scope, range)."""
    wanted = chosen.select("query_id", "scope", "range").join(hint(weights), ["query_id", "scope"])
    met = blocks.select("scope", "term", "range", "slots", "tfs", "lens").join(hint(wanted) if R.fits(wanted, F.octet_length("scope") + F.octet_length("term") + 64) else wanted, ["scope", "term", "range"])
    each = met.select("query_id", "scope", "range", "weight", "avg_len", F.explode(F.arrays_zip("slots", "tfs", "lens")).alias("x"))
    part = F.col("weight") * share(F.col("x.tfs"), F.col("x.lens"), params)
    return each.groupBy("query_id", "scope", "range", F.col("x.slots").alias("slot")).agg(F.round(F.sum(part), R.PLACES).alias("score"))
