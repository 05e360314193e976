"""Merkle manifest of a dataset: one tree per source, one over the sources, a proof and a check for every row.

A row's leaf is the hash of its fields, each as its byte count, ``:`` and value (``-`` if null). Leaves of a source ascend by
doc_id; every ``FAN`` consecutive nodes become the hash of their concatenated hashes until one is left. The parents are kept by
their preimages, i.e. the concatenated hashes of their children. A leaf joins the preimages of its ancestors; each preimage
less the 64 characters of the node below is that level's siblings, and with other 64 characters put there it folds to another root.

Levels are built ``DEPTH`` at a time: FAN ** DEPTH neighbours are one block, whose preimages fill one row of bounded size. So a
tree of n leaves takes log(n) / (DEPTH * log(FAN)) rounds, each a FAN ** DEPTH-th of the one before, and no source, however
large, is one group. Positions are dealt by ranges of (source, doc_id), so that a source with most of the rows is spread as well.

Edge cases: null fields count as ``-``; a null source is a source of its own, the first; null doc_ids come first within their source; rows that
share a doc_id are ordered by their leaves, and equal rows are leaves each; null and negative ids and texts of any length are
hashed like all others, but a row without doc_id is never tampered with; missing text stays missing. Extra columns are not read. An empty table has no
rows and no root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, measured, table

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
FAN = 3
#: Levels per block: 3 ** 6 = 729 nodes and at most 364 preimages of 192 characters.
DEPTH = 6
DIGEST = 64


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    """The hash of one row's fields."""
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


def numbered(rows: DataFrame, tree: str, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """rows with ``i``, their position within their tree by the order columns, and ``n``, the tree's size. One sort by ranges;
    the counts of each range then give the offsets, so a tree of any size is numbered by many tasks."""
    by = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    at = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", at)
    placed = scratch.keep(placed.withColumn("__part", F.shiftright("__at", 33)), f"{name}-placed")
    runs = placed.groupBy(tree, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__c"))
    w = Window.partitionBy(tree)
    runs = runs.withColumn("n", F.sum("__c").over(w)).withColumn("__before", F.sum("__c").over(w.orderBy("__part")) - F.col("__c"))
    runs = runs.select(F.col(tree).alias("__tree"), F.col("__part").alias("__p"), F.col("__first"), "__before", "n")
    runs = measured(scratch.keep(runs, f"{name}-runs"), F.coalesce(F.octet_length(F.col("__tree").cast("string")), F.lit(0)) + 64)
    out = placed.join(runs, placed[tree].eqNullSafe(runs["__tree"]) & (placed["__part"] == runs["__p"]))
    return out.select(*rows.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias("i"), "n")


def _depth(n: Column) -> Column:
    """Levels that a block of a tree of n nodes has: all DEPTH if the tree goes on above it, else as many as leave one node."""
    found = F.lit(DEPTH)
    for d in reversed(range(DEPTH)):
        found = F.when(n <= FAN**d, d).otherwise(found)
    return found


def blocks_of(nodes: DataFrame, member: Column) -> DataFrame:
    """(tree, block, n, members, levels, hash): levels[l] are the preimages of the parents l + 1 levels above the block's nodes, hash is what is
    left of the block. nodes: (tree, i, n, hash)."""
    block = F.floor(F.col("i") / FAN**DEPTH)
    df = nodes.groupBy("tree", block.alias("block"), "n").agg(F.array_sort(F.collect_list(member)).alias("members"))
    df = df.withColumn("depth", _depth(F.col("n"))).withColumn("h0", F.transform("members", lambda m: m["hash"]))
    for level in range(1, DEPTH + 1):
        below = f"h{level - 1}"
        runs = F.sequence(F.lit(1), F.size(below), F.lit(FAN))
        made = F.transform(runs, lambda a: F.array_join(F.slice(below, a, FAN), ""))
        df = df.withColumn(f"p{level}", F.when(F.col("depth") >= level, made))
        hashed = F.transform(f"p{level}", lambda p: F.sha2(p, 256))
        df = df.withColumn(f"h{level}", F.when(F.col("depth") >= level, hashed).otherwise(F.col(below)))
    levels = F.filter(F.array(*[F.col(f"p{level}") for level in range(1, DEPTH + 1)]), lambda p: p.isNotNull())
    return df.select("tree", "block", "n", "members", levels.alias("levels"), F.get(f"h{DEPTH}", F.lit(0)).alias("hash"))


def excised(preimage: Column, slot: Column) -> Column:
    """A preimage without one slot: what stands left and right of it."""
    left, right = F.substring(preimage, F.lit(1), slot * DIGEST), F.substring(preimage, (slot + 1) * DIGEST + 1, F.lit(FAN * DIGEST))
    return F.struct(left.alias("left"), right.alias("right"))


def ancestors(i: Column, levels: Column) -> Column:
    """The siblings of node i on each level of its block, from below."""
    at = F.pmod(i, F.lit(FAN**DEPTH)).cast("int")
    part = lambda l: F.floor(at / F.pow(F.lit(FAN), l)).cast("int")
    return F.transform(levels, lambda p, l: excised(F.get(p, part(l + 1)), F.pmod(part(l), F.lit(FAN))))


def folded(start: Column, path: Column) -> Column:
    """The root that a node's hash and its path of siblings give."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def siblings(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def _rounds(nodes: DataFrame, scratch: Scratch, name: str, member: Column) -> list[DataFrame]:
    """The block tables of a forest, from below; in the last one every tree is one block."""
    made = []
    while True:
        made.append(scratch.keep(blocks_of(nodes, member), f"{name}-{len(made)}"))
        if (made[-1].agg(F.max("n")).first()[0] or 0) <= FAN**DEPTH:
            return made
        up = F.ceil(F.col("n") / FAN**DEPTH)
        nodes = made[-1].where(F.col("n") > FAN**DEPTH).select("tree", F.col("block").alias("i"), up.alias("n"), "hash")
        member = F.struct("i", "hash")


def _paths(made: list[DataFrame], scratch: Scratch, name: str) -> DataFrame:
    """For every block of the lowest table: (tree, block, subroot, above), the siblings from the block's hash to its tree's root."""
    none = F.array().cast("array<struct<left:string,right:string>>")
    known = None
    for at, blocks in reversed(list(enumerate(made))):
        roots = blocks.where(F.col("n") <= FAN**DEPTH).select("tree", "block", F.col("hash").alias("subroot"), none.alias("above"))
        if known is not None:
            roots = roots.unionByName(known)
        if at == 0:
            return scratch.keep(roots, f"{name}-paths")
        # One level of blocks below: every member of a block is a block there.
        whole = blocks.join(roots.withColumnRenamed("tree", "__tree").withColumnRenamed("block", "__block"), F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("block") == F.col("__block")))
        each = whole.select("tree", F.explode("members").alias("m"), "levels", "subroot", "above")
        known = each.select("tree", F.col("m.i").alias("block"), "subroot", F.concat(ancestors(F.col("m.i"), F.col("levels")), "above").alias("above"))


def manifest(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(tree, i, doc_id, leaf, other, subroot, root, path): every row's way to the root as its siblings by level.

    rows: (tree, doc_id, hash, other); trees are ordered by their column, rows by (doc_id, hash). ``other`` passes through."""
    leaves = numbered(rows, "tree", ["doc_id", "hash", "other"], scratch, "leaf")
    low = _rounds(leaves, scratch, "source", F.struct("i", "doc_id", "hash", "other"))
    paths = _paths(low, scratch, "source")
    tops = paths.where("block = 0").select(F.lit(0).alias("tree"), F.col("tree").alias("source"), F.col("subroot").alias("hash"))
    tops = numbered(tops, "tree", ["source"], scratch, "top")
    high = _rounds(tops, scratch, "top", F.struct("i", "source", "hash"))
    over = _paths(high, scratch, "top")
    whole = high[0].join(over.select(F.col("block").alias("__block"), F.col("subroot").alias("root"), "above"), F.col("block") == F.col("__block"))
    whole = whole.select(F.explode("members").alias("m"), "levels", "root", "above")
    ends = whole.select(F.col("m.source").alias("__source"), "root", F.concat(ancestors(F.col("m.i"), F.col("levels")), "above").alias("last"))
    size = F.coalesce(F.octet_length("__source"), F.lit(0)) + DIGEST + 150 * F.size("last")
    ends = measured(scratch.keep(ends, "ends"), size)
    paths = paths.join(ends, F.col("tree").eqNullSafe(F.col("__source"))).select(F.col("tree").alias("__tree"), F.col("block").alias("__block"), "subroot", "root", F.concat("above", "last").alias("above"))
    paths = measured(scratch.keep(paths, "over"), 2 * DIGEST + F.coalesce(F.octet_length("__tree"), F.lit(0)) + 150 * F.size("above"))
    out = low[0].join(paths, F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("block") == F.col("__block")))
    out = out.select("tree", F.explode("members").alias("m"), "levels", "subroot", "root", "above")
    path = F.concat(ancestors(F.col("m.i"), F.col("levels")), F.col("above"))
    return out.select("tree", "m.i", "m.doc_id", F.col("m.hash").alias("leaf"), "m.other", "subroot", "root", path.alias("path"))


def checked(docs: DataFrame, scratch: Scratch, tampered: Column | None = None, now: Column | None = None) -> DataFrame:
    """Every row of docs with its proof, and whether what is there ``now`` instead of text, where ``tampered`` holds, still folds to
    the root (nothing is tampered with by default)."""
    fields = [F.col(c) for c in FIELDS]
    mine = leaf(*fields)
    other = leaf(*fields[:-1], now) if now is not None else mine
    rows = docs.select(F.col("source").cast("string").alias("tree"), "doc_id", mine.alias("hash"), (F.when(tampered, other) if tampered is not None else F.lit(None).cast("string")).alias("other"))
    out = manifest(rows, scratch)
    out = out.withColumn("proof_sha256", F.sha2(siblings(F.col("path")), 256))
    out = out.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("path")))
    return out.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), F.col("tree").alias("source"),
        F.col("i").alias("position"), "path")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    out = checked(docs, Scratch(spark, "op13"), even, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
