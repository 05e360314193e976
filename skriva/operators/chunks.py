"""Document ETL: chunks, lines, sections, offsets, margins, reading order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import text as T
from ..schemas import DEFAULTS


def spans_of(text: str, size: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, text) of the spans of a stripped text that are not blank."""
    n, step = len(text), size - overlap
    for start in range(0, 1 if n <= size else n - size + step, step):
        part = text[start : start + size].strip(T.SPACES)
        if part:
            yield start, min(start + size, n), part


def chunk_spans(pages: DataFrame, key: str = "doc_id", text: str = "text", size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap) -> DataFrame:
    """SC13-15, WIN15: one row per span (key, chunk_index from 1, char_start, char_end, text), plus all other columns of pages.

    Spans of ``size`` characters start every size - overlap; blank spans are skipped and numbering closes up. All of a page's
    spans come from one row in an Arrow batch, where a place in a text is found at once however long it is; nothing is shuffled."""
    others = [c for c in pages.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = [(r, k, *s) for r, t in enumerate(part.column(len(others)).to_pylist()) if t for k, s in enumerate(spans_of(t.replace("\0", "").strip(T.SPACES), size, overlap), 1)]
                at, number, start, end, texts = zip(*rows, strict=True) if rows else ((), (), (), (), ())
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(j).take(take) for j in range(len(others))), pa.array(number, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(texts, pa.string())],
                    names=[*(f"c{j}" for j in range(len(others))), "chunk_index", "char_start", "char_end", "text"])

    inner = pages.select(*others, text).toDF(*(f"c{j}" for j in range(len(others))), "text")
    schema = StructType([*inner.schema.fields[:-1], StructField("chunk_index", IntegerType()), StructField("char_start", IntegerType()), StructField("char_end", IntegerType()), StructField("text", StringType())])
    return inner.mapInArrow(run, schema).toDF(*others, "chunk_index", "char_start", "char_end", text)


def chunk_id(paper: Column, page: Column, index: Column) -> Column:
    """SC14."""
    return F.format_string("%s_page_%d_chunk_%d", F.coalesce(paper.cast("string"), F.lit("paper_unknown")), page, index)


def position(document: Column, index: Column) -> Column:
    """The order of chunks over all documents. A text of the greatest size that a row can hold has fewer than 2 ** 21 chunks; document numbers go up to
    2 ** 42 (others are to be numbered first)."""
    return document.cast("long") * (1 << 21) + index


LINE = "line int, text string, char_start long, char_end long, n_lines int"


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines as blocks: key, line (from 0), text, char_start and char_end inside the document, n_lines. Offsets follow from the text alone, so
    they are running sums inside an Arrow batch and nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                keys, texts = (c.slice(i, 256) for c in batch.columns)
                parts = pc.split_pattern(pc.fill_null(texts, ""), "\n")
                flat, row = parts.flatten(), pc.list_parent_indices(parts).to_numpy()
                counts = pc.list_value_length(parts).to_numpy()
                first = np.cumsum(counts) - counts
                size = pc.utf8_length(flat).to_numpy().astype(np.int64)
                before = np.cumsum(size + 1) - size - 1
                start = before - before[first][row]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(row)), pa.array((np.arange(len(row)) - first[row]).astype(np.int32)), flat, pa.array(start), pa.array(start + size), pa.array(counts[row].astype(np.int32))],
                    names=[key, "line", "text", "char_start", "char_end", "n_lines"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, {LINE}")


def running_offsets(blocks: DataFrame, key: list[str], order: str, text: str = "text", separator: int = 2) -> DataFrame:
    """WIN6: char_start / char_end of blocks joined by a separator."""
    before = W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + separator).over(before), F.lit(0)).cast("long")
    return blocks.withColumn("char_start", start).withColumn("char_end", (start + F.length(text)).cast("long"))


def repeated_margins(blocks: DataFrame, page: str, zone: Column, text: str = "text", least: int = 3, share: float = 0.3) -> DataFrame:
    """AGG12: (zone, signature, pages) that recur on at least ``least`` pages and ``share`` of all."""
    total = blocks.agg(F.count_distinct(page).alias("total"))
    found = blocks.select(page, zone.alias("zone"), T.margin_signature(F.col(text)).alias("signature")).where("zone IS NOT NULL AND signature IS NOT NULL")
    found = found.groupBy("zone", "signature").agg(F.count_distinct(page).alias("pages")).where(F.col("pages") >= least)
    n = total.first()["total"]
    return found.where(F.col("pages") >= share * n)


def without_margins(blocks: DataFrame, repeated: DataFrame, zone: Column, text: str = "text") -> DataFrame:
    """FLT17."""
    marked = blocks.withColumn("zone", zone).withColumn("signature", T.margin_signature(F.col(text)))
    return marked.join(repeated.select("zone", "signature"), ["zone", "signature"], "left_anti")


def headings(lines_: DataFrame, key: str = "doc_id", page: str = "page") -> DataFrame:
    """SC21, WIN4: heading lines in order, without repeats that follow each other on a page."""
    name = F.regexp_replace(F.trim(F.regexp_extract("text", T.HEADING_LINE, 1)), r"(?U)\s+", " ")
    found = lines_.where(F.col("text").rlike(T.HEADING_LINE)).withColumn("name", name)
    order = W.partitionBy(key).orderBy("line")
    same = (F.lag("name").over(order) == F.col("name")) & (F.lag(page).over(order) == F.col(page))
    return found.withColumn("__same", F.coalesce(same, F.lit(False))).where("NOT __same").drop("__same")


def section_ranges(heads: DataFrame, pages: DataFrame, key: str = "doc_id", page: str = "page") -> DataFrame:
    """WIN3: (key, section_index, name, page_start, page_end). pages: (key, n_pages)."""
    order = W.partitionBy(key).orderBy("line")
    df = heads.withColumn("section_index", F.row_number().over(order)).withColumn("next", F.lead(page).over(order)).join(pages, key)
    end = F.when(F.col("next").isNull(), F.col("n_pages")).when(F.col("next") > F.col(page), F.col("next") - 1).otherwise(F.col("next"))
    return df.select(key, "section_index", "name", F.col(page).alias("page_start"), F.greatest(F.col(page), end).alias("page_end"))


#: Levels of dyadic ranges: page numbers below 2 ** LEVELS.
LEVELS = 31


def dyadic_cover(first: Column, last: Column) -> Column:
    """The ranges [node * 2 ** level, (node + 1) * 2 ** level) that make up first..last, at most two per level, as structs (level, node)."""
    start = F.struct(first.cast("long").alias("a"), last.cast("long").alias("b"), F.array().cast("array<struct<level:int,node:bigint>>").alias("nodes"))

    def up(state: Column, level: Column) -> Column:
        a, b = state["a"], state["b"]
        left, right = (a <= b) & (a % 2 == 1), (a <= b) & (b % 2 == 0)
        own = F.array_compact(F.array(
            F.when(left, F.struct(level.alias("level"), a.alias("node"))), F.when(right & ~(left & (a == b)), F.struct(level.alias("level"), b.alias("node")))))
        return F.struct(
            F.when(a > b, a).otherwise(F.floor((a + left.cast("int")) / 2)).alias("a"), F.when(a > b, b).otherwise(F.floor((b - right.cast("int")) / 2)).alias("b"),
            F.concat(state["nodes"], own).alias("nodes"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, up, lambda s: s["nodes"])


def first_section(pages: DataFrame, sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """JN5: the first section whose pages hold the page; null if none.

    A section stands at the few dyadic ranges that make up its pages, and each range keeps its first section. A page looks at the one range per level that holds it. So a
    document with many pages and sections that overlap costs their sum times the logarithm of its pages, and its ranges are keys of their own."""
    nodes = sections.where("page_start <= page_end").select(F.col(key).alias("__key"), "section_index", "name", F.explode(dyadic_cover(F.col("page_start"), F.col("page_end"))).alias("x"))
    first = nodes.groupBy("__key", "x.level", "x.node").agg(F.min(F.struct("section_index", "name")).alias("s"))
    asked = pages.select(key, "page").distinct()
    levels = F.sequence(F.lit(0), F.lit(LEVELS))
    above = F.transform(levels, lambda l: F.struct(l.alias("level"), F.floor(F.col("page") / F.pow(F.lit(2), l)).alias("node")))
    each = asked.select(key, "page", F.explode(above).alias("y"))
    found = each.join(first, (each[key] == first["__key"]) & (F.col("y.level") == first["level"]) & (F.col("y.node") == first["node"]))
    best = found.groupBy(F.col(key).alias("__key"), F.col("page").alias("__page")).agg(F.min("s").alias("s"))
    return asked.join(best, (F.col(key) == F.col("__key")) & (F.col("page") == F.col("__page")), "left").select(key, "page", F.col("s.name").alias("section"))


def chunk_blocks(chunks: DataFrame, blocks: DataFrame, key: str = "doc_id", width: int = 1024) -> DataFrame:
    """JN6: for each chunk the blocks whose half-open span overlaps, in order, distinct.

    Spans meet in the bins of ``width`` characters that they touch, so that the work goes with the spans' lengths and what overlaps, and a long document
    is many keys. A pair counts in the bin where the later of the two begins."""

    def binned(rows: DataFrame, *columns: str) -> DataFrame:
        place = lambda at: F.floor(at / width)
        bins = F.sequence(place(F.col("char_start")), place(F.greatest(F.col("char_end") - 1, F.col("char_start"))))
        return rows.select(key, *columns, "char_start", "char_end", place(F.col("char_start")).alias("begins"), F.explode(bins).alias("bin"))

    c, b = binned(chunks, "chunk_index").alias("c"), binned(blocks, "line").alias("b")
    hit = (F.col(f"c.{key}") == F.col(f"b.{key}")) & (F.col("c.bin") == F.col("b.bin")) & (F.col("c.bin") == F.greatest("c.begins", "b.begins"))
    hit = hit & (F.col("b.char_start") < F.col("c.char_end")) & (F.col("b.char_end") > F.col("c.char_start"))
    return c.join(b, hit).groupBy(f"c.{key}", "c.chunk_index").agg(F.array_sort(F.collect_set("b.line")).alias("lines"))


def unknown_sections(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """FLT3: requested (scope, section) that no chunk has."""
    known = chunks.select("scope", "section").distinct()
    return requests.where("section IS NOT NULL AND section <> ''").join(known, ["scope", "section"], "left_anti")


def page_count(chunks: DataFrame, pages: DataFrame, configured: DataFrame, key: str = "doc_id") -> DataFrame:
    """AGG33: the greatest of the configured number, the number of pages and the last page of any chunk."""
    a = chunks.groupBy(key).agg(F.max(F.greatest("page_start", "page_end")).alias("a"))
    b = pages.groupBy(key).agg(F.count("*").cast("int").alias("b"))
    j = a.join(b, key, "full_outer").join(configured.select(key, F.col("page_count").alias("c")), key, "full_outer")
    return j.select(key, F.coalesce(F.greatest("a", "b", "c"), F.lit(0)).alias("page_count"))


def reading_order(blocks: DataFrame, width: Column, key: list[str]) -> DataFrame:
    """WIN16: blocks (x0, y0, x1, y1, source_index) in reading order per page.

    Blocks of at least 70 % of the width separate regions. A region is read column by column if its blocks all lie left or right of the
    middle and the columns' vertical spans overlap by more than 5; else from top to bottom."""
    page = W.partitionBy(*key)
    by_y = page.orderBy(F.round("y0", 2), F.round("x0", 2), "source_index")
    df = blocks.withColumn("__wide", (F.col("x1") - F.col("x0")) >= 0.7 * width).withColumn("__before", F.count_if(F.col("__wide")).over(by_y.rowsBetween(W.unboundedPreceding, -1)))
    df = df.withColumn("__region", 2 * F.coalesce("__before", F.lit(0)) + F.when(F.col("__wide"), 1).otherwise(0))
    middle = width / 2
    side = F.when(F.col("x1") <= middle + 0.02 * width, "left").when(F.col("x0") >= middle - 0.02 * width, "right")
    df = df.withColumn("__side", side)
    region = W.partitionBy(*key, "__region")
    span = {s: (F.min(F.when(F.col("__side") == s, F.col("y0"))).over(region), F.max(F.when(F.col("__side") == s, F.col("y1"))).over(region)) for s in ("left", "right")}
    overlap = F.least(span["left"][1], span["right"][1]) - F.greatest(span["left"][0], span["right"][0])
    both = span["left"][1].isNotNull() & span["right"][1].isNotNull()  # least and greatest pass over nulls
    two = (F.count_if(F.col("__side").isNull()).over(region) == 0) & both & (overlap > 5)
    df = df.withColumn("__two", two).withColumn("__column", F.when(F.col("__two") & (F.col("__side") == "right"), 1).otherwise(0))
    order = page.orderBy("__region", "__column", F.round("y0", 2), F.round("x0", 2), "source_index")
    df = df.withColumn("reading_order", F.row_number().over(order) - 1).withColumn("two_columns", F.max("__two").over(page))
    return df.drop("__wide", "__before", "__region", "__side", "__two", "__column")


def kept_lines(raw: DataFrame) -> DataFrame:
    """SRC4: text lines whose direction is horizontal (dx, dy), with merged boxes per block."""
    flat = raw.where((F.abs(F.col("dx") - 1) < 0.05) & (F.abs(F.col("dy")) < 0.05) & (F.col("kind") == "text"))
    sizes = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line", "text", "size"))), lambda r: F.array_repeat(r["size"], F.length(r["text"]))))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda r: r["text"]), "\n")
    return flat.groupBy("page_number", "source_index").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), T.dehyphenated(texts).alias("text"), sizes.alias("font_sizes"))


def body_font(blocks: DataFrame, key: str) -> DataFrame:
    """AGG13: the median font size over characters."""
    each = blocks.select(key, F.explode("font_sizes").alias("size")).where("size > 0").groupBy(key, "size").count()
    return each.groupBy(key).agg(F.percentile("size", 0.5, F.col("count")).alias("body_size"))


def title_lines(lines_: DataFrame, key: str) -> DataFrame:
    """WIN5: of lines with at least 92 % of the greatest size, the first island without a gap above 1.8 sizes, three at most."""
    doc = W.partitionBy(key)
    big = lines_.withColumn("top", F.max("size").over(doc)).where("size >= 0.92 * top")
    order = doc.orderBy("y", "x")
    gap = F.coalesce(F.col("y") - F.lag("y").over(order), F.lit(0.0))
    big = big.withColumn("gap", gap)
    big = big.withColumn("island", F.sum(F.when(F.col("gap") > 1.8 * F.col("top"), 1).otherwise(0)).over(order)).withColumn("n", F.row_number().over(order))
    return big.where("island = 0 AND n <= 3").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda r: r["text"]), " ").alias("title"))


def parsing_summary(pages: DataFrame) -> DataFrame:
    """AGG14."""
    method = lambda m: F.count_if(F.col("extraction_method") == m)
    return pages.agg(
        F.count("*").alias("total_pages"), method("layout").alias("layout_pages"), method("legacy").alias("legacy_pages"), method("legacy_fallback").alias("fallback_pages"),
        method("empty").alias("empty_pages"), F.count_if(F.col("column_layout") == "single_column").alias("single_column_pages"),
        F.count_if(F.col("column_layout") == "double_column").alias("double_column_pages"), F.sum("n_blocks").alias("blocks_retained"), F.sum("n_removed").alias("header_footer_blocks_removed"))


def page_texts(layout: DataFrame, legacy: DataFrame) -> DataFrame:
    """SRC3: layout text, with the plain text of a page where layout failed or is empty."""
    j = legacy.join(layout.withColumnRenamed("text", "layout_text"), ["doc_id", "page"], "left")
    good = F.col("layout_text").isNotNull() & (F.trim("layout_text") != "")
    return j.select("doc_id", "page", F.when(good, F.col("layout_text")).otherwise(F.col("text")).alias("text"),
                    F.when(good, "layout").when(F.trim("text") == "", "empty").otherwise("legacy_fallback").alias("extraction_method"))


def metadata_winner(candidates: DataFrame, keep_from: float = 0.7) -> DataFrame:
    """AGG29: per (paper_id, field) an ordered fold: a value of at least keep_from stays, unless a later one is forced."""
    seq = F.array_sort(F.collect_list(F.struct("seq", "value", "source", "confidence", F.coalesce("force", F.lit(False)).alias("force"))))
    none = F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("double").alias("confidence"))

    def step(a: Column, c: Column) -> Column:
        stay = a["value"].isNotNull() & (a["confidence"] >= keep_from) & ~c["force"]
        return F.when(stay | c["value"].isNull(), a).otherwise(F.struct(c["value"].alias("value"), c["source"].alias("source"), c["confidence"].alias("confidence")))

    return candidates.groupBy("paper_id", "field").agg(F.aggregate(seq, none, step).alias("w")).select("paper_id", "field", "w.*")


def sections(toc: DataFrame, heads: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """SC21: section ranges from a document's table of contents (key, position, title, page) where it has one, else from its headings. Entries without
    a title or a page are dropped; pages beyond the last are the last. pages: (key, n_pages)."""
    t = toc.withColumn("name", T.strip(F.coalesce("title", F.lit("")))).where("name <> '' AND page >= 1").join(pages, key)
    t = t.select(key, F.col("position").alias("line"), F.least("page", "n_pages").alias("page"), "name")
    rest = heads.join(t.select(key).distinct(), key, "left_anti").select(key, "line", "page", "name")
    return section_ranges(t.unionByName(rest), pages, key)


def section_catalogue(sections_: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """SET8: (key, names): a document's section names in order, then those that only chunks have, each once. sections_: (key, section_index, name);
    chunks: (key, chunk_index, section)."""
    named = sections_.select(key, F.struct(F.lit(0).alias("kind"), F.col("section_index").cast("long").alias("place")).alias("at"), F.col("name"))
    more = chunks.select(key, F.struct(F.lit(1).alias("kind"), F.col("chunk_index").cast("long").alias("place")).alias("at"), F.col("section").alias("name"))
    first = named.unionByName(more).where("name IS NOT NULL AND name <> ''").groupBy(key, "name").agg(F.min("at").alias("at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda r: r["name"]).alias("names"))


def scope_problems(requests: DataFrame, catalogue: DataFrame, page_counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """FLT3: (request_id, rule): the section must exist, bounds come in pairs and in order, and the last page lies within the document."""
    j = requests.join(catalogue, key, "left").join(page_counts, key, "left")
    low, high, section = F.col("page_start"), F.col("page_end"), F.coalesce("section", F.lit(""))
    rules = {
        "section_exists": (section == "") | F.coalesce(F.array_contains("names", section), F.lit(False)), "paired_bounds": low.isNull() == high.isNull(),
        "ordered_bounds": F.coalesce((low >= 1) & (low <= high), F.lit(True)), "within_document": F.coalesce(high <= F.coalesce("page_count", F.lit(0)), F.lit(True))}
    return j.select("request_id", F.explode(F.array_compact(F.array(*[F.when(~ok, F.lit(n)) for n, ok in rules.items()]))).alias("rule"))


def hierarchical(depth: Column, pages: Column, chars: Column, page_limit: int = 20, char_limit: int = 60_000) -> Column:
    """FLT23: is a document analysed in parts?"""
    return F.coalesce(depth == "deep", F.lit(False)) | (pages > page_limit) | (chars > char_limit)
