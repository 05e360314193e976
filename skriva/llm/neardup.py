"""Near-duplicate detection by b-bit MinHash, from a similarity given in percent on.

A document's set holds its distinct 5-word shingles (A-Z lower-cased; words are runs without white space). 128 minima are taken
per set; bands of them (24 of 5 from 85 percent on, 27 of 4 from 80) give candidates, and the low 4 bits of all minima, packed into eight longs, give a similarity
estimate corrected for chance agreement. Pairs that the estimate does not rule out are confirmed on the full sets.

A pair at the threshold shares no band with a probability below 1e-6, and falls below the estimate's margin (five standard
deviations) about as rarely. A parity sketch of each set (2048 bits, each the parity of the shingles that fall on it) bounds
the symmetric difference of two sets from below, so it rules pairs out without error. Equal sets are one node from the
start, so thousands of copies cost one row. Shingles are known by 64-bit hashes, so sets and their sizes are exact up to collisions.

1. All members of a bucket are compared with the one whose buckets are fullest (a star around the likely original), and components
   are formed. Buckets of one component are done.
2. In the other buckets the members outside the largest component, if they are at most CROWD, are compared with all members; only pairs that
   pass both filters leave the join, and large buckets are split.
3. The members of buckets with more of them, which may have nothing but boilerplate in common, are not paired there. Their sets are ordered by
   rising frequency; two similar sets share one of their first (rarest) shingles, 8 percent of the smaller and 15 percent of the larger
   set at a threshold of 85. So an equi-join on these finds every pair, whatever the bucket's size; its
   frequent keys are split, and what the largest component of a key has in common is left out.

Edge cases: with fewer than five words the whole word sequence is the one shingle; without words, or for a null text, the set
is empty, linked with nothing and kept. Rows that share a doc_id are one document: it is linked if any of its texts is.
A null doc_id is never linked, has a null component and is kept. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small, table
from .components import components

LANES, BITS = 128, 4
#: How often a pair at the threshold may share no band.
MISSED = 1e-6
PER_LONG = 64 // BITS
#: Documents are linked where 100 * intersection >= percent * union.
PERCENT = 85
#: The same for stages that drop near copies.
STAGE_PERCENT = 80
#: Longs of the parity sketch.
PARITY = 32
MEMO = 300_000
#: Buckets with more members outside their largest component than this are not compared member by member.
CROWD = 200
#: Rows of one key that go to one task, before it is split.
SPLIT = 500
#: The most frequent shingles that are ordered by frequency are at most this many (16 bytes each are broadcast).
FREQUENT = 1 << 21


@lru_cache
def layout(percent: int) -> tuple[int, int]:
    """(bands, minima a band): the most minima with which bands within the lanes miss a pair at the threshold rarely enough."""
    p = percent / 100
    for rows in range(LANES, 1, -1):
        bands = math.ceil(math.log(MISSED) / math.log1p(-(p**rows))) if 0 < p**rows < 1 else 1
        if bands * rows <= LANES:
            return bands, rows
    return LANES, 1


def margin(percent: int) -> float:
    """Five standard deviations of the estimate at the threshold."""
    chance = 1 / 2**BITS
    agree = percent / 100 * (1 - chance) + chance
    return 5 * math.sqrt(agree * (1 - agree) / LANES) / (1 - chance)


class WordHashes(dict):
    """Word -> 64-bit hash, with a memo of bounded size."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 48:
            if len(self) >= MEMO:
                self.clear()
            self[word] = h
        return h


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


@lru_cache(maxsize=1)
def multipliers() -> np.ndarray:
    rnd = random.Random(20240229)
    return np.array([rnd.getrandbits(64) | 1 for _ in range(LANES)], np.uint64)


MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def _fold(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> STEP)) * MIX
    h += w
    return h


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    memo = word_hashes()
    w = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    size = min(width, n)
    h = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        h = _fold(h, w[j : n - size + 1 + j])
    h = (h ^ (h >> STEP)) * MIX
    h ^= h >> np.uint64(32)
    return np.unique(h)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The LANES minima, 32 bits each, in blocks that stay in the cache."""
    a = multipliers()
    best = np.full(LANES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 128):
        np.minimum(best, (shingles[i : i + 128, None] * a).min(axis=0), out=best)
    return best >> np.uint64(32)


def parity(shingles: np.ndarray) -> np.ndarray:
    """Each bit is the parity of the shingles that fall on it."""
    counts = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, fp_hi, fp_lo (of the whole set), and arrays of longs sig, bands and odd, null without words."""
    n_bands, n_rows = layout(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(1, n_bands + 1, dtype=np.uint64)
        shifts = np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                n, hi, lo, sig, bands, odd = [], [], [], [], [], []
                for text in part.column("text").to_pylist():
                    s = shingle_set(text)
                    n.append(len(s))
                    d = xxhash.xxh3_128_digest(s.tobytes())
                    hi.append(int.from_bytes(d[:8], "big", signed=True))
                    lo.append(int.from_bytes(d[8:], "big", signed=True))
                    if not len(s):
                        sig.append(None)
                        bands.append(None)
                        odd.append(None)
                        continue
                    odd.append(parity(s))
                    m = minima(s)
                    low = (m & np.uint64((1 << BITS) - 1)).reshape(-1, PER_LONG)
                    sig.append(np.bitwise_or.reduce(low << shifts, axis=1).view(np.int64))
                    rows = m[: n_bands * n_rows].reshape(n_bands, n_rows)
                    h = salt.copy()
                    for j in range(n_rows):
                        h = _fold(h, rows[:, j])
                    h = (h ^ (h >> STEP)) * MIX
                    bands.append((h ^ (h >> np.uint64(32))).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()),
                     pa.array(sig, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64())),
                     pa.array(odd, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "fp_hi", "fp_lo", "sig", "bands", "odd"])

    schema = "doc_id long, n_shingles long, fp_hi long, fp_lo long, sig array<long>, bands array<long>, odd array<long>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def sets(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, shingles array<long>, and the long columns named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [shingle_set(t).view(np.int64) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.list_(pa.int64())), *map(part.column, more)], names=["doc_id", "shingles", *more])

    return docs.select("doc_id", "text", *more).mapInArrow(run, "doc_id long, shingles array<long>" + "".join(f", {c} long" for c in more))


def estimate(x: str, y: str) -> Column:
    """The similarity of two packed signatures: agreeing lanes counted by bits, corrected for the 1 in 2**BITS that agree by
    chance."""
    total = F.lit(0)
    for i in range(LANES // PER_LONG):
        d = F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))
        for shift in (2, 1):  # any differing bit of a lane reaches its lowest one
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
        total = total + F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))
    agree, chance = 1 - total / F.lit(float(LANES)), 1 / 2**BITS
    return (agree - chance) / (1 - chance)


def possible(x: str, y: str, percent: int) -> Column:
    """Neither filter rules out the pair of nodes whose columns end in x and y."""
    n_x, n_y = F.col(f"n_{x}"), F.col(f"n_{y}")
    differ = F.lit(0)
    for i in range(PARITY):
        differ = differ + F.bit_count(F.get(f"odd_{x}", F.lit(i)).bitwiseXOR(F.get(f"odd_{y}", F.lit(i))))
    # intersection / union >= p means: symmetric difference <= (1 - p) / (1 + p) of the sum of sizes.
    sizes = 100 * F.least(n_x, n_y) >= percent * F.greatest(n_x, n_y)
    return sizes & (estimate(f"sig_{x}", f"sig_{y}") >= percent / 100 - margin(percent)) & ((100 + percent) * differ <= (100 - percent) * (n_x + n_y))


def side(nodes: DataFrame, x: str, *more: str) -> DataFrame:
    named = [F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"), F.col("odd").alias(f"odd_{x}")]
    return nodes.select(*named, *(F.col(c).alias(f"{c}_{x}") for c in more))


def near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that neither filter rules out."""
    return pairs.join(side(nodes, "a"), "a").join(side(nodes, "b"), "b").where(possible("a", "b", percent)).select("a", "b").distinct()


def full_sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """node, c, shingles of the wanted nodes (node, c). By shuffle at every size: the documents with candidates grow with the corpus."""
    texts = docs.select("doc_id", "text").join(wanted.select(F.col("node").alias("doc_id"), "c").hint("merge"), "doc_id")
    return sets(texts, "c").select(F.col("doc_id").alias("node"), "c", "shingles")


def confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(full.select(F.col("node").alias("a"), F.col("shingles").alias("s_a")), "a")
    both = both.join(full.select(F.col("node").alias("b"), F.col("shingles").alias("s_b")), "b")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return both.where(100 * shared >= percent * (F.size("s_a") + F.size("s_b") - shared)).select("a", "b").distinct()


def same_id(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): every id whose rows have different sets, with the node of each of these sets."""
    marks = rows.select("doc_id", "fp_hi", "fp_lo").distinct()
    fp = F.struct("fp_hi", "fp_lo")
    several = marks.groupBy("doc_id").agg(F.min(fp).alias("least"), F.max(fp).alias("most")).where("least <> most").select("doc_id")
    named = marks.join(several, "doc_id").join(nodes.select("fp_hi", "fp_lo", "node"), ["fp_hi", "fp_lo"])
    return named.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("c", F.lit(None).cast("long"))


def dealt(rows: DataFrame, n: str = "n") -> DataFrame:
    """rows, one per key with n members, repeated for each part of the key."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / SPLIT).cast("int"))))


def salt(n: str, node: str = "node") -> Column:
    """The part of a key with n members to which a member belongs."""
    return F.pmod(F.xxhash64(node), F.floor((F.col(n) - 1) / SPLIT) + 1).cast("int")


def buckets(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(band, salt, node, n, pivot): the members of all buckets of two nodes or more. A bucket of many members is split by salt."""
    spots = nodes.select("node", F.explode("bands").alias("band"))
    full = scratch.keep(spots.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "full")
    # At most one in SPLIT rows of spots.
    large = full.where(F.col("n") > SPLIT).withColumnRenamed("n", "many")
    spots = spots.join(small(large, large.count(), 16), "band", "left").withColumn("salt", F.when(F.col("many").isNull(), F.lit(0)).otherwise(salt("many")))
    spots = scratch.keep(spots.drop("many").join(dealt(full), ["band", "salt"]), "shared")
    # The original of many near copies shares most buckets with most of them.
    weight = spots.groupBy("node").agg(F.sum("n").alias("weight"))
    centres = spots.join(weight, "node").groupBy("band").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("pivot"), F.max("n").alias("n"))
    spots = scratch.keep(spots.join(dealt(centres).drop("n"), ["band", "salt"]), "spots")
    scratch.drop("shared", "full")
    return spots


def prefixes(full: DataFrame, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(shingle, node, c, size, pos, short): the first shingles of each set (node, c, shingles), the rarest first; short: among those that
    a similar set of this size or more must share."""
    table_ = full.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = table_.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out: list[list[np.ndarray]] = [[], [], [], [], [], []]
                for node, c, s in zip(part.column("node").to_pylist(), part.column("c").to_pylist(), part.column("shingles"), strict=True):
                    s, n = s.values.to_numpy(), len(s)
                    at = np.minimum(np.searchsorted(known, s), max(len(known) - 1, 0))
                    rank = np.where(known[at] == s, times[at], 0) if len(known) else np.zeros(n, np.int64)
                    # Sets of n and m >= n shingles share percent * m or more; of equal size, 2 * percent / (100 + percent) of both.
                    first = n - -(-percent * n // 100) + 1
                    s = s[np.lexsort((s, rank))[:first]]
                    short = np.arange(first) <= n - -(-2 * percent * n // (100 + percent))
                    for column, values in zip(out, (s, np.full(first, node), np.full(first, c), np.full(first, n), np.arange(first), short), strict=True):
                        column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["shingle", "node", "c", "size", "pos", "short"])

    return full.select("node", "c", "shingles").mapInArrow(run, "shingle long, node long, c long, size long, pos long, short boolean")


def crowded_pairs(full: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(a, b): every pair of the sets (node, c, shingles) of different components that may be similar enough, by their rarest shingles."""
    often = full.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("k")).where(F.col("k") > CROWD)
    often = scratch.keep(often, "often")
    # Any order of the shingles finds all pairs; beyond FREQUENT only the most frequent ones are told apart.
    powers = sorted(((r["p"], r["count"]) for r in often.groupBy(F.floor(F.log2("k")).alias("p")).count().collect()), reverse=True)
    total, least = 0, 0
    for p, count in powers:
        total += count
        if total > FREQUENT:
            least = 1 << (p + 1)
            break
    chosen = often.where(F.col("k") >= least).toArrow()
    known, times = chosen.column("shingle").to_numpy(), chosen.column("k").to_numpy()
    order = np.argsort(known)
    rows = scratch.keep(prefixes(full, percent, (known[order], times[order])), "prefixes")
    same = rows.groupBy("shingle", "c").agg(F.count("*").alias("k"))
    keys = same.groupBy("shingle").agg(F.max_by("c", F.struct("k", "c")).alias("major"), F.max("k").alias("most"), F.sum("k").alias("k"))
    keys = scratch.keep(keys.where("k > most").select("shingle", "major", (F.col("k") - F.col("most")).alias("n")), "keys")
    # Members outside the largest component against all members.
    rows = rows.join(keys, "shingle")
    x = rows.where("c <> major").select("shingle", salt("n").alias("salt"), *(F.col(k).alias(f"{k}_x") for k in ("node", "c", "size", "pos", "short")))
    y = dealt(rows).select("shingle", "salt", (F.col("c") == F.col("major")).alias("main"), *(F.col(k).alias(f"{k}_y") for k in ("node", "c", "size", "pos", "short")))
    left, right = F.struct("size_x", "node_x"), F.struct("size_y", "node_y")
    room = F.least(F.col("size_x") - F.col("pos_x"), F.col("size_y") - F.col("pos_y"))
    pairs = x.join(y, ["shingle", "salt"]).where((F.col("c_x") != F.col("c_y")) & (F.col("main") | (F.col("node_x") < F.col("node_y"))))
    pairs = pairs.where(F.when(left < right, F.col("short_x")).otherwise(F.col("short_y")))
    pairs = pairs.where((100 * F.least("size_x", "size_y") >= percent * F.greatest("size_x", "size_y")) & ((100 + percent) * room >= percent * (F.col("size_x") + F.col("size_y"))))
    found = scratch.keep(pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct(), "crowd-pairs")
    scratch.drop("often", "prefixes", "keys")
    return found


def link(docs: DataFrame, scratch: Scratch, percent: int = PERCENT, crowd: int = CROWD) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept. Linked from a similarity of ``percent`` on.

    crowd: buckets with more members outside their largest component go by their rarest shingles."""
    rows = scratch.keep(signatures(docs, percent), "signatures")
    some = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = some.groupBy("fp_hi", "fp_lo").agg(F.min(F.struct("doc_id", "n_shingles", "sig", "bands", "odd")).alias("r"))
    nodes = scratch.keep(nodes.select(F.col("r.doc_id").alias("node"), "r.n_shingles", "r.sig", "r.bands", "r.odd", "fp_hi", "fp_lo"), "nodes")
    spots = buckets(nodes, scratch)
    stars = spots.where("node <> pivot").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
    stars = scratch.keep(near(stars, nodes, percent), "stars")
    edges = confirmed(stars, scratch.keep(full_sets(ends(stars), docs), "sets-0"), percent)
    # Different sets under one id are one document: each is linked with the id's smallest node, and stands for its own node and that id.
    edges = scratch.keep(edges.unionByName(same_id(some, nodes)), "edges-0")
    labels = scratch.keep(components(edges, scratch, "cc-0"), "labels-0")
    scratch.drop("sets-0", "stars")
    mixed = spots.where("n > 2").join(labels, "node", "left").select("band", "salt", "n", "node", "pivot", F.coalesce("component", "node").alias("c"))
    # Buckets of one component need nothing more; of the others what the largest component has in common needs nothing.
    keys = mixed.groupBy("band", "c").agg(F.count("*").alias("k"), F.max("n").alias("n"))
    keys = keys.groupBy("band").agg(F.max_by("c", F.struct("k", "c")).alias("major"), (F.sum("k") - F.max("k")).alias("out"), F.max("n").alias("n")).where("out > 0")
    mixed = scratch.keep(mixed.join(dealt(keys).drop("n"), ["band", "salt"]), "mixed")
    few = mixed.where(F.col("out") <= crowd).join(nodes.select("node", "n_shingles", "sig", "odd"), "node")
    x = side(dealt(few.where("c <> major").drop("salt")), "x", "band", "c", "salt", "pivot")
    y = side(few.withColumn("main", F.col("c") == F.col("major")), "y", "band", "c", "salt", "pivot", "main")
    differ = (F.col("main_y") | (F.col("x") < F.col("y"))) & (F.col("c_x") != F.col("c_y")) & (F.col("x") != F.col("pivot_y")) & (F.col("y") != F.col("pivot_y"))
    pairs = x.join(y, (x["band_x"] == y["band_y"]) & (x["salt_x"] == y["salt_y"]) & differ & possible("x", "y", percent))
    pairs = scratch.keep(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    many = scratch.keep(mixed.where(F.col("out") > crowd).select("node", "c").distinct(), "many")
    wanted = ends(pairs).unionByName(many).groupBy("node").agg(F.max("c").alias("c"))
    full = scratch.keep(full_sets(wanted, docs), "sets-1")
    if not many.isEmpty():
        pairs = pairs.unionByName(near(crowded_pairs(full.where("c IS NOT NULL"), scratch, percent), nodes, percent)).distinct()
    more = scratch.keep(confirmed(pairs, full, percent), "edges-1")
    scratch.drop("sets-1", "mixed", "spots")
    if not more.isEmpty():
        labels = scratch.keep(components(edges.unionByName(more), scratch, "cc-1"), "labels-1")
    sets_ = nodes.select("fp_hi", "fp_lo", "node").join(labels, "node", "left").select("fp_hi", "fp_lo", F.coalesce("component", "node").alias("c"))
    out = rows.select("doc_id", "n_shingles", "fp_hi", "fp_lo").join(scratch.keep(sets_, "classes"), ["fp_hi", "fp_lo"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, scratch: Scratch, percent: int = STAGE_PERCENT) -> DataFrame:
    """docs without the documents that follow another one in their group."""
    gone = link(docs, scratch, percent=percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(scratch.keep(gone, "gone").hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return link(table(spark, sf_dir, "documents"), Scratch(spark, "op3"), percent=PERCENT)
