"""Language-model scoring by cross-entropy difference.

Two bigram models of equal form are counted over one shared vocabulary: the target on documents labelled good, the background on
all documents. A document's score is the mean over its words of target loss minus background loss (in nats), lower for texts
like the target. Each loss is that of a bigram model smoothed by the unigram model (Dirichlet prior), and the document's own
counts are taken out of both models first, so no document vouches for itself.

Every word and every (context, word) has a count of its own, so the models grow with the corpus; they are never gathered.
Documents are laid together in chunks of about CHUNK_WORDS words. Each chunk sends its distinct words and bigrams, once each, to the
tasks that add them up, in sorted blocks of the key space; their number grows with the number of chunks. Back come the totals of
those that other chunks have too, and each chunk scores its documents. So a hot word costs one entry a chunk, wherever it stands.

Within a chunk words are numbered exactly. Between chunks words and bigrams are known by 63-bit hashes: among two thousand million
distinct ones, about 0.2 pairs are expected to meet.

Edge cases: a null or wordless text has 0 words and null losses and score; without any good label the target model is empty and
every word has its uniform loss; repeated rows are counted and scored each; a null doc_id has no label; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: The uniform model spreads over this many words, or over the corpus's distinct words if they are more.
WORDS = 1 << 18
CHUNK_WORDS, CHUNK_DOCS = 1_000_000, 50_000
#: Chunks for each task that adds up counts.
PER_TASK = 4
UNIGRAM_PRIOR, BIGRAM_PRIOR = 0.1, 50.0
START = 0


class Numbers(dict):
    """Word -> its number, from 1 on in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


SHARED = Numbers()


def pack(a: np.ndarray) -> bytes:
    """The numbers' bytes, first all lowest ones, compressed behind their count."""
    planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T)
    return len(a).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(raw: bytes, kind: str) -> np.ndarray:
    n, width = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw[8:], n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).reshape(-1).view(kind)


def word_ids(text: str | None, numbers: Numbers = SHARED) -> np.ndarray:
    """The number of every word (A-Z lower-cased, cut at white space)."""
    words = text.encode().lower().split() if text else []
    return np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))


def pair_cells(ids: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """Every word together with the one before it; the first of each text (they begin at ``starts``) stands behind START."""
    left = np.empty(len(ids), np.int64)
    left[1:] = ids[:-1]
    if len(ids):
        left[0 if starts is None else starts] = START
    return left << 32 | ids.astype(np.int64)


CHUNK = "chunk long, doc_id array<long>, target array<boolean>, n array<int>, ids binary, words binary, n_target long, n_all long"


def chunks(docs: DataFrame, target: DataFrame, size: int = CHUNK_WORDS) -> DataFrame:
    """CHUNK: documents laid together, ids their words' numbers (packed) and words the 64-bit hash of each number from 1 on. The
    labels join by shuffle at every size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        names, marks, ids, numbers, total = [], [], [], Numbers(), 0

        def row() -> pa.RecordBatch:
            n = [len(x) for x in ids]
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
            columns = [
                pa.array([at], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([marks], pa.list_(pa.bool_())), pa.array([n], pa.list_(pa.int32())),
                pa.array([pack(np.concatenate(ids).astype("<u4"))], pa.binary()), pa.array([hashes.astype("<u8").tobytes()], pa.binary()),
                pa.array([sum(k for k, mark in zip(n, marks, strict=True) if mark)], pa.int64()), pa.array([sum(n)], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in CHUNK.split(", ")])

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for name, mark, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "target", "text")), strict=True):
                    names.append(name)
                    marks.append(mark)
                    ids.append(word_ids(text, numbers))
                    total += len(ids[-1])
                    if total >= size or len(ids) >= CHUNK_DOCS:
                        yield row()
                        at += 1
                        names, marks, ids, numbers, total = [], [], [], Numbers(), 0
        if ids:
            yield row()

    marked = target.select("doc_id", F.lit(True).alias("target")).distinct().hint("merge")
    rows = docs.select("doc_id", "text").join(marked, "doc_id", "left").select("doc_id", F.coalesce("target", F.lit(False)).alias("target"), "text")
    return rows.mapInArrow(run, CHUNK)


class Chunk:
    """A chunk's words and pairs with their own counts (rows: target, all). ``order`` sorts the keys, words before pairs."""

    def __init__(self, n: list[int], target: list[bool], ids: bytes, words: bytes):
        self.n, self.target = np.array(n, np.int64), np.array(target, bool)
        self.ids, hashes = unpack(ids, "<u4"), np.frombuffer(words, "<u8")
        self.doc = np.repeat(np.arange(len(n)), self.n)
        self.starts = (np.cumsum(self.n) - self.n)[self.n > 0]
        self.word = self.ids.astype(np.int64) - 1
        pairs, self.pair = np.unique(pair_cells(self.ids, self.starts), return_inverse=True)
        self.size = len(hashes)
        mark = self.target[self.doc].astype(np.float64)
        own = [[np.bincount(x, mark, k), np.bincount(x, minlength=k)] for x, k in ((self.word, self.size), (self.pair, len(pairs)))]
        self.counts = np.concatenate([np.array(c, np.int64) for c in own], axis=1)
        known = np.concatenate([np.array([0x9E3779B97F4A7C15], np.uint64), hashes])
        h = known[pairs >> 32] * np.uint64(0xC2B2AE3D27D4EB4F)
        h = ((h ^ (h >> np.uint64(29))) + known[pairs & 0xFFFFFFFF]) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(31)
        # The lowest bit tells words from pairs.
        self.keys = np.concatenate([hashes | np.uint64(1), h & ~np.uint64(1)])
        self.order = np.argsort(self.keys)

    def losses(self, counts: np.ndarray, totals: list[int], vocabulary: int) -> list[np.ndarray]:
        """Each document's mean loss under the target and the background, without its own counts."""
        mine = []
        for x, k in ((self.word, self.size), (self.pair, counts.shape[1] - self.size)):
            _, inverse, times = np.unique(self.doc * k + x, return_inverse=True, return_counts=True)
            mine.append(times[inverse])
        out = []
        for c, total, own in zip(counts, totals, (self.target, np.ones(len(self.n), bool)), strict=True):
            out_of = own[self.doc]
            c1, c2 = (x - out_of * m for x, m in zip((c[self.word], c[self.size + self.pair]), mine, strict=True))
            left = np.empty(len(c1), np.float64)
            left[1:] = c1[:-1]
            left[self.starts] = c2[self.starts]
            rest = (total - own * self.n)[self.doc]
            p1 = (c1 + UNIGRAM_PRIOR) / (rest + UNIGRAM_PRIOR * vocabulary)
            p = (np.minimum(c2, left) + BIGRAM_PRIOR * p1) / (left + BIGRAM_PRIOR)
            out.append(np.bincount(self.doc, -np.log(p), len(self.n)) / np.maximum(self.n, 1))
        return out


FIELDS = ("n", "target", "ids", "words")


def chunk_of(columns: pa.RecordBatch | pa.Table, i: int) -> Chunk:
    return Chunk(*(columns.column(c)[i].as_py() for c in FIELDS))


def totals_of(rows: DataFrame, blocks: int) -> DataFrame:
    """(chunk, at, target, all, words), packed: of the keys at these places of a chunk's order that other chunks have too, the counts of the
    whole corpus; words: how many words were first met in this row, for the size of the vocabulary."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = chunk_of(batch, i)
                keys, counts = c.keys[c.order], c.counts[:, c.order].astype("<u4")
                cuts = np.searchsorted((keys >> np.uint64(32)).astype(np.int64), (np.arange(blocks + 1) << 32) // blocks)
                some = np.flatnonzero(np.diff(cuts))
                parts = [slice(cuts[b], cuts[b + 1]) for b in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([batch.column("chunk")[i].as_py()] * len(some), pa.int64()), pa.array(cuts[some], pa.int64()),
                     pa.array([pack(np.diff(keys[p], prepend=np.uint64(0))) for p in parts], pa.binary()),
                     *(pa.array([pack(x[p]) for p in parts], pa.binary()) for x in counts)],
                    names=["block", "chunk", "base", "keys", "target", "all"])

    def add(rows_: list[tuple]) -> pa.RecordBatch:
        parts = [np.cumsum(unpack(r[2], "<u8")) for r in rows_]  # from sorted steps
        sizes, keys = [len(p) for p in parts], np.concatenate(parts)
        own = np.array([np.concatenate([unpack(r[k], "<u4") for r in rows_]) for k in (3, 4)], np.int64)
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
        sums = np.add.reduceat(own[:, order], first, axis=1)
        whole = np.empty_like(own)
        whole[:, order] = np.repeat(sums, np.diff(first, append=len(keys)), axis=1)
        new = int((keys[order[first]] & np.uint64(1)).sum())
        columns: list[list] = [[], [], [], [], []]
        at = 0
        for (chunk, base, *_), n in zip(rows_, sizes, strict=True):
            w = whole[:, at : at + n]
            more = np.flatnonzero((w != own[:, at : at + n]).any(axis=0))
            values = (chunk, pack(np.diff(more, prepend=-base)), pack(w[0, more]), pack(w[1, more]), new)
            for column, value in zip(columns, values, strict=True):
                column.append(value)
            at, new = at + n, 0
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["chunk", "at", "target", "all", "words"])

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for block, *row in zip(*(batch.column(c).to_pylist() for c in ("block", "chunk", "base", "keys", "target", "all")), strict=True):
                if block != key:
                    if held:
                        yield add(held)
                    key, held = block, []
                held.append(row)
        if held:
            yield add(held)

    sent = rows.mapInArrow(send, "block int, chunk long, base long, keys binary, target binary, all binary")
    sent = sent.repartition(blocks, "block").sortWithinPartitions("block")
    return sent.mapInArrow(sum_up, "chunk long, at binary, target binary, all binary, words long")


def score(docs: DataFrame, target: DataFrame, scratch: Scratch, size: int = CHUNK_WORDS) -> DataFrame:
    """doc_id, n_words, loss_target, loss_background, score, per row of docs. target: the doc_id of the target documents."""
    rows = scratch.keep(chunks(docs, target, size), "chunks")
    n, *totals = rows.agg(F.count("*"), F.coalesce(F.sum("n_target"), F.lit(0)), F.coalesce(F.sum("n_all"), F.lit(0))).first()
    counts = scratch.keep(totals_of(rows, max(1, -(-n // PER_TASK))), "counts")
    vocabulary = max(WORDS, counts.agg(F.sum("words")).first()[0] or 0)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        c = chunk_of(left, 0)
        whole = c.counts.copy()
        for r in right.to_pylist():
            at = c.order[np.cumsum(unpack(r["at"], "<i8"))]
            whole[0, at], whole[1, at] = unpack(r["target"], "<i8"), unpack(r["all"], "<i8")
        empty = c.n == 0
        t, b = c.losses(whole, totals, vocabulary)
        return pa.table([left.column("doc_id")[0].values, pa.array(c.n), pa.array(t, pa.float64(), mask=empty), pa.array(b, pa.float64(), mask=empty)], names=["doc_id", "n_words", "loss_target", "loss_background"])

    both = rows.groupBy("chunk").cogroup(counts.drop("words").groupBy("chunk"))
    scored = both.applyInArrow(run, "doc_id long, n_words long, loss_target double, loss_background double")
    return scored.withColumn("score", F.col("loss_target") - F.col("loss_background"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored; the target is what the labels call good and not toxic."""
    labels = table(spark, sf_dir, "labels").where("quality = 1 AND coalesce(toxic, 0) = 0")
    return score(table(spark, sf_dir, "documents"), labels, Scratch(spark, "op7"))
