"""Line dedup: lines that many documents share stay in one of them.

The lines of a text are exploded under their key, the line without white space at its ends and with A-Z lower-cased. Keys travel as
128-bit hashes. Distinct documents are counted per hash (rows that share a doc_id are one document), first per hash and document, then per
hash, each with map-side combining, so that a line in most documents is no hot key. Lines over the threshold are
dropped wherever they stand but in the document with the largest id, and the others are put together again by their position.

Only hashes are shuffled for the counts. The shared keys are broadcast if their measured size allows it, else joined by a shuffle, which
adaptive execution splits at hot keys. Lines to drop are gathered per text, bounded by the text's own lines. Texts move only if the
list of lines to drop is too large to broadcast.

Edge cases: a null or empty text is one empty line; keys shorter than ``min_chars`` code points are never dropped; all rows without doc_id
are one document, with the smallest id of all; rows that share the largest id all keep the line; equal lines within the keeping document all
stay; an empty table gives an empty result. Columns other than text and n_chars pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, measured, table

MIN_CHARS = 40
MIN_DOCS = 5
#: Lines per batch handed back to Spark.
BATCH = 8192
_LINES = pa.schema([("id", pa.int64()), ("body", pa.int64()), ("at", pa.int32()), ("key", pa.binary())])


def keys_of(text: str | None, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """(position, hash of the key) of every line whose key is long enough."""
    for at, line in enumerate((text or "").encode().split(b"\n")):
        key = line.strip().lower()  # of bytes: both know ASCII alone
        if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
            yield at, xxhash.xxh3_128_digest(key)


def exploded(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, body, at, key), one row per line that may be dropped; body is the hash of the text that it stands in."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: tuple[list, ...] = ([], [], [], [])
        for batch in batches:
            for i, body, text in zip(*(batch.column(c) for c in ("id", "body", "text"))):
                i, body = i.as_py(), body.as_py()
                for at, key in keys_of(text.as_py(), min_chars):
                    for column, value in zip(made, (i, body, at, key)):
                        column.append(value)
                    if len(made[0]) >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, _LINES)], schema=_LINES)
                        made = ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, _LINES)], schema=_LINES)

    ready = docs.select(F.col("doc_id").cast("long").alias("id"), _body().alias("body"), "text")
    return ready.mapInArrow(explode, "id long, body long, at int, key binary")


def _body() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def shared(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, n_docs, last): the keys that stand in at least min_docs documents, and the largest of these."""
    n = F.count_distinct("id") + F.max(F.col("id").isNull().cast("long"))
    return lines.groupBy("key").agg(n.alias("n_docs"), F.max("id").alias("last")).where(F.col("n_docs") >= min_docs)


def mask_of(at: str) -> Column:
    """For sorted positions, one flag per position up to the last: false at these, true between them."""
    gap = lambda p, j: p - F.when(j > 0, F.get(at, j - 1)).otherwise(F.lit(-1)) - 1
    return F.flatten(F.transform(at, lambda p, j: F.concat(F.array_repeat(F.lit(True), gap(p, j)), F.array(F.lit(False)))))


def marked(docs: DataFrame, scratch: Scratch, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with ``__n``, how many lines to drop (null: none), and ``__mask``, a flag per line up to the last of these."""
    lines = scratch.keep(exploded(docs, min_chars), "lines")
    over = scratch.keep(shared(lines, min_docs), "shared")
    away = lines.join(measured(over, 40), "key").where(~F.col("id").eqNullSafe(F.col("last")))
    # Rows that agree in id and text lose the same lines. The mask is written, so that nothing later makes it again for every line.
    sets = away.groupBy("id", "body").agg(F.sort_array(F.collect_set("at")).alias("at"))
    drops = scratch.keep(sets.select("id", "body", F.size("at").alias("__n"), mask_of("at").alias("__mask")), "drops")
    scratch.drop("lines")
    drops = measured(drops, 32 + F.size("__mask"))
    ready = docs.withColumn("__body", _body())
    out = ready.join(drops, ready["doc_id"].eqNullSafe(drops["id"]) & (ready["__body"] == drops["body"]), "left")
    return out.select(*[ready[c] for c in docs.columns], "__n", "__mask")


def kept_text() -> Column:
    """The text without the masked lines."""
    left = F.filter(F.split("text", "\n"), lambda x, i: F.coalesce(F.get("__mask", i), F.lit(True)))
    return F.when(F.col("__n").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))


def drop_lines(docs: DataFrame, scratch: Scratch, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with their shared lines dropped; n_chars, if there, follows the text."""
    out = marked(docs, scratch, min_chars, min_docs).withColumn("text", kept_text())
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__n").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    docs = marked(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op12"))
    text = F.coalesce("text", F.lit(""))
    n_lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return docs.select(
        "doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce("__n", F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(F.coalesce(kept_text(), F.lit("")), 256).alias("kept_sha256"))
