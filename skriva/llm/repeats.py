"""Repeated byte strings by a common-prefix interval tree over a sparse enhanced suffix array.

A byte is removed if a LENGTH-byte string over it also starts earlier (in a smaller doc_id, or earlier in the same document).

Sparse: of the GRAM-byte strings inside any LENGTH-byte window the one with the least hash (the leftmost of equals) is the window's
anchor. Equal windows have equal anchors at equal offsets, so all occurrences of a repeated window meet at one anchor hash, and only
the suffixes that start at anchors need sorting: about one position in 35. An anchor with the neighbouring windows that it
serves is one row with its bytes around it (at most 2 * LENGTH - GRAM).

1. All anchors are counted in hashed slots (one bit table per answer, of fixed size SLOTS / 8 bytes each, the proven bound of
   what is broadcast). A slot met once holds no repeat. Crowded slots only cost extra rows later, never results.
2. Anchors in slots met more than once go, with their bytes, to the task of their hash.
3. There the suffixes of an anchor's rows are sorted, and a stack scan of the common prefixes of neighbours yields the tree of
   prefix intervals. The members of an interval are scanned likewise by their left extensions: where these differ the interval
   splits. Each pair of a right and a left interval is a maximal repeat group with all its occurrences; all but the first
   occurrence are marked. Rows with wholly equal bytes count as one, so thousands of copies do not enlarge the tree.
4. Marked ranges join their documents (by shuffle at every size) and are cut out.

An anchor met more than HOT times is split by its context before it is gathered: the windows that start lo to hi bytes before it are equal
only where the lo bytes before it and the LENGTH - hi bytes from it on are. So a hot anchor's rows become parts (a band of window starts, and the
hash of that context), each of which holds all its equal windows and gets a tree of its own; parts that are still hot are split
again, down to bands of one window, whose rows are all equal and need only the first of them. The result does not depend on HOT.

Edge cases: null counts as empty; texts under LENGTH bytes lose nothing and count as no source; rows that share a doc_id and the
text are one place, so that equal ones do not mark each other; other texts under the same doc_id are documents of their own, in the order of
their hashes; a null doc_id is neither cut nor a source. Very long texts are cut into overlapping spans. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, measured, table

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1  # anchors' candidates in a window; offsets run from 0 to SPAN - 1
SLOT_BITS, BLOCK_BITS = 28, 20
HOT = 50_000
#: Parts of a hot anchor's window starts.
BANDS = 4
PLACE_BITS = 24
#: Bytes handled at once: their hashes stay in the processor's cache. Positions must fit into PLACE_BITS.
CHUNK = 1 << 17
M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """The 64-bit hash of the GRAM bytes from each position on."""
    n = len(raw) - GRAM + 1
    words = np.ndarray((len(raw) - 7,), "<u8", raw.data, 0, (1,))
    h = words[:n] * M[0]
    for i in (1, 2, 3):
        h ^= (h >> np.uint64(29)) + words[8 * i : 8 * i + n] * M[i]
        h *= M[4]
    h ^= h >> np.uint64(32)
    h *= M[0]
    h ^= h >> np.uint64(29)
    return h


def anchors(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: hash, place, first and last window start of every anchor. ends: where each text ends."""
    empty = np.empty(0, np.int64)
    if len(raw) < LENGTH:
        return np.empty(0, np.uint64), empty, empty, empty
    h = gram_hashes(raw)
    low = np.uint64((1 << PLACE_BITS) - 1)
    best = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while 2 * step <= SPAN:  # the least of 2, 4, ... neighbours
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    best = np.minimum(best[: len(h) - SPAN + 1], best[SPAN - step :])
    place = (best & low).astype(np.int64)
    # A window must not run over the end of its text.
    lengths = np.diff(ends, prepend=0)
    valid = np.zeros(len(place) + 1, np.int32)
    starts, good = ends - lengths, lengths >= LENGTH
    np.add.at(valid, starts[good], 1)
    np.add.at(valid, ends[good] - LENGTH + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    at = np.flatnonzero(valid)
    if not len(at):
        return np.empty(0, np.uint64), empty, empty, empty
    p = place[at]
    # A run of windows with one anchor ends where the place or the text changes.
    cut = np.flatnonzero((np.diff(p) != 0) | (np.diff(at) != 1)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
    return h[p[first]], p[first], at[first], at[last]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text's hash, key; together they tell which rows are one document."""
    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text")


def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts laid end to end in chunks: bytes, ends, doc ids, keys, offsets in the text. Longer texts overlap by LENGTH - 1 bytes."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def chunk() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(x[3] for x in held), np.uint8)
        return raw, np.cumsum([len(x[3]) for x in held]), *(np.array([x[i] for x in held], np.int64) for i in range(3))

    for batch in batches:
        ids, keys, texts = batch.column("doc_id"), batch.column("key"), batch.column("text").cast(pa.binary())
        for i in range(batch.num_rows):
            doc, text = ids[i].as_py(), texts[i].as_py()
            if doc is None or text is None or len(text) < LENGTH:
                continue
            key = keys[i].as_py()
            for at in range(0, len(text) - LENGTH + 1, CHUNK):
                part = text[at : at + CHUNK + LENGTH - 1]
                held.append((doc, key, at, part))
                size += len(part)
                if size >= CHUNK:
                    yield chunk()
                    held, size = [], 0
    if held:
        yield chunk()


def slots(h: np.ndarray) -> np.ndarray:
    """Mixed once more: anchors are minima, so their hashes crowd at the low end."""
    h = (h ^ (h >> np.uint64(23))) * M[2]
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def survey(docs: DataFrame, scratch: Scratch, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed bits per slot: met more than once, met more than ``hot`` times."""
    block, width = 1 << (SLOT_BITS - BLOCK_BITS), 1 << BLOCK_BITS

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            s = np.sort(np.concatenate(held))
            cuts = np.searchsorted(s, np.arange(block + 1) << BLOCK_BITS)
            some = np.flatnonzero(np.diff(cuts))
            values = [(s[cuts[b] : cuts[b + 1]] & (width - 1)).astype("<u4").tobytes() for b in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(values, pa.binary())], names=["block", "slots"])

        for raw, ends, *_ in spans(batches):
            held.append(slots(anchors(raw, ends)[0]))
            size += len(held[-1])
            if size > 2_000_000:
                yield from rows()
                held, size = [], 0
        if size:
            yield from rows()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column("block").to_pylist(), batch.column("slots").to_pylist(), strict=True):
                if b not in counts:
                    counts[b] = np.zeros(width, np.uint32)
                np.add.at(counts[b], np.frombuffer(raw, "<u4"), 1)
        for b, c in counts.items():
            bits = [np.packbits(c > k).tobytes() for k in (1, hot)]
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array(bits[:1], pa.binary()), pa.array(bits[1:], pa.binary())], names=["block", "twice", "hot"])

    sent = keyed(docs).mapInArrow(send, "block int, slots binary").repartition("block")
    found = scratch.keep(sent.mapInArrow(merge, "block int, twice binary, hot binary"), "slots")
    out = np.zeros((2, block, width // 8), np.uint8)
    for r in found.collect():  # at most one row per block: 2 * SLOTS / 8 bytes
        out[0, r["block"]], out[1, r["block"]] = np.frombuffer(r["twice"], np.uint8), np.frombuffer(r["hot"], np.uint8)
    return out[0].reshape(-1), out[1].reshape(-1)


def marked(bits: np.ndarray, s: np.ndarray) -> np.ndarray:
    return (bits[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 > 0


ROW = "h long, doc long, key long, place long, back int, bytes binary"
NAMES = [c.split()[0] for c in ROW.split(", ")]


def gathered(docs: DataFrame, tables: Broadcast, any_hot: bool, only_hot: bool = False) -> DataFrame:
    """ROW: anchors that may repeat and stand in no hot slot, or in one if only_hot; bytes start ``back`` before the anchor and end with the last window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, hot = tables.value
        for raw, ends, docs_, keys, offsets in spans(batches):
            h, place, first, last = anchors(raw, ends)
            s = slots(h)
            keep = marked(twice, s)
            if any_hot:
                keep &= marked(hot, s) == only_hot
            h, place, first, last = h[keep], place[keep], first[keep], last[keep]
            text = np.searchsorted(ends, first, side="right")
            base = offsets[text] - (ends - np.diff(ends, prepend=0))[text]
            size = last + LENGTH - first
            for i in range(0, len(h), 50_000):
                cut = slice(i, i + 50_000)
                bounds = np.concatenate([[0], np.cumsum(size[cut])])
                data = raw[np.repeat(first[cut] - bounds[:-1], size[cut]) + np.arange(bounds[-1])]
                column = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype("<i4")), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[cut].view(np.int64)), pa.array(docs_[text[cut]]), pa.array(keys[text[cut]]), pa.array(place[cut] + base[cut]),
                     pa.array((place - first)[cut].astype(np.int32)), column], names=NAMES)

    return keyed(docs).mapInArrow(run, ROW)


def parted(rows: DataFrame) -> DataFrame:
    """ROW with lo and hi: each row in BANDS parts of its window starts lo..hi before the anchor. h becomes the hash of the anchor and of all bytes
    that equal windows of the band share, and the bytes are cut to those of the band's windows; rows without a window there go."""
    wide = F.col("hi") + 1 - F.col("lo")
    cut = lambda i: F.col("lo") + F.floor(wide * i / BANDS).cast("int")
    bands = F.filter(F.array(*[F.struct(cut(i).alias("a"), (cut(i + 1) - 1).alias("b")) for i in range(BANDS)]), lambda x: x["a"] <= x["b"])
    x = rows.withColumn("x", F.explode(bands)).select("h", "doc", "key", "place", "back", "bytes", "x.*")
    right = F.octet_length("bytes") - F.col("back")
    x = x.withColumn("left", F.least("back", "b")).withColumn("ahead", F.least(right, LENGTH - F.col("a")))
    x = x.where((F.col("back") >= F.col("a")) & (right >= LENGTH - F.col("b")) & (F.col("left") + F.col("ahead") >= LENGTH))
    shared = F.substring("bytes", F.col("back") - F.col("a") + 1, LENGTH + F.col("a") - F.col("b"))
    return x.select(F.xxhash64("h", "a", shared).alias("h"), "doc", "key", "place", F.col("left").alias("back"),
                    F.substring("bytes", F.col("back") - F.col("left") + 1, F.col("left") + F.col("ahead")).alias("bytes"), F.col("a").alias("lo"), F.col("b").alias("hi"))


def hot_parts(docs: DataFrame, tables: Broadcast, scratch: Scratch, hot: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The rows of anchors in hot slots, as ROW: parts of at most ``hot`` rows each, for the tree; and the rows of single windows that are
    still hotter. One level of parts after the other, at most as many as it takes to come down to one window."""
    rows, cool, single, level = gathered(docs, tables, True, only_hot=True).withColumn("lo", F.lit(0)).withColumn("hi", F.lit(SPAN - 1)), [], [], 0
    while True:
        rows = scratch.keep(rows, f"part-{level}")
        # At most one in ``hot`` rows.
        crowded = scratch.keep(rows.groupBy("h").count().where(F.col("count") > hot).select("h"), f"crowded-{level}")
        done = crowded.isEmpty()
        crowded = measured(crowded, 16)
        cool.append(rows.join(crowded, "h", "left_anti").select(*NAMES))
        if done:
            return cool, single
        rest = rows.join(crowded, "h", "left_semi")
        single.append(rest.where("lo = hi").select(*NAMES))
        rows, level = parted(rest.where("lo < hi")), level + 1


# --- The interval tree of one anchor hash -------------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def intervals(common: list[int], floor: int) -> Iterator[tuple[int, int, int, int]]:
    """Stack scan: (value, parent's value, first, last) of every interval of sorted strings whose neighbours share ``value``
    bytes or more and that cannot be widened. common[i]: shared by i and i + 1. Values up to floor are no interval."""
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*common, floor]):
        first = i
        while stack and stack[-1][0] > value:
            top, first = stack.pop()
            yield top, max(value, stack[-1][0] if stack else floor), first, i
        if value > floor and (not stack or stack[-1][0] < value):
            stack.append((value, first))


Row = tuple[int, int, int, int, bytes]  # doc, key, place, back, bytes


def repeat_groups(rows: list[Row]) -> Iterator[tuple[int, int, int, list[Row]]]:
    """(right, least offset, greatest offset, occurrences) of each maximal repeat group of different rows of one anchor hash: windows
    that start so many bytes before the anchor are equal in all of its rows, and in no others."""
    rights = [r[4][r[3] :] for r in rows]
    lefts = [r[4][r[3] - 1 :: -1] if r[3] else b"" for r in rows]
    order = sorted(range(len(rows)), key=rights.__getitem__)
    by_left = sorted(range(len(rows)), key=lefts.__getitem__)
    rank = [0] * len(rows)
    for k, i in enumerate(by_left):
        rank[i] = k
    common = [common_prefix(rights[a], rights[b]) for a, b in zip(order, order[1:], strict=False)]
    for right, above, i, j in intervals(common, GRAM - 1):
        least, most = LENGTH - right, LENGTH - 1 - above
        members = sorted(order[i : j + 1], key=rank.__getitem__)
        shared = [common_prefix(lefts[a], lefts[b]) for a, b in zip(members, members[1:], strict=False)]
        for left, below, k, m in intervals(shared, -1):
            low, high = max(least, below + 1), min(most, left)
            if low <= high:
                yield right, low, high, [rows[x] for x in members[k : m + 1]]


def later(rows: list[Row]) -> Iterator[tuple[int, int, int, int]]:
    """(doc, key, start, end) of bytes under windows that an earlier place has too; rows: all of one anchor hash. All windows of a row
    hold its anchor, so those marked make up one range."""
    first: dict[tuple[int, bytes], Row] = {}
    marks: dict[tuple[int, int, int], tuple[int, int]] = {}
    for row in sorted(rows):
        if first.setdefault((row[3], row[4]), row)[:3] != row[:3]:
            doc, key, place, back, data = row
            marks[row[:3]] = (place - back, place - back + len(data))
    if len(first) > 1:
        for _, low, high, found in repeat_groups(list(first.values())):
            least = min(found)[:3]
            for row in found:
                if row[:3] != least:
                    a, b = marks.get(row[:3], (row[2], row[2]))
                    marks[row[:3]] = (min(a, row[2] - high), max(b, row[2] - low + LENGTH))
    for (doc, key, _), (a, b) in marks.items():
        yield doc, key, a, b


def by_hash(batches: Iterator[pa.RecordBatch], least: int = 2) -> Iterator[tuple[int, list[Row]]]:
    """The rows of each hash with ``least`` or more; they arrive sorted by it."""
    key, rows = None, []
    for batch in batches:
        for h, *row in zip(*(batch.column(c).to_pylist() for c in NAMES), strict=True):
            if h != key:
                if len(rows) >= least:
                    yield key, rows
                key, rows = h, []
            rows.append(tuple(row))
    if key is not None and len(rows) >= least:
        yield key, rows


def sorted_by_hash(rows: DataFrame) -> DataFrame:
    return rows.repartition("h").sortWithinPartitions("h")


def ranges(rows: DataFrame) -> DataFrame:
    """(doc, key, start, end): marked ranges, overlapping."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []
        for _, group in by_hash(batches):
            out += later(group)
            if len(out) > 50_000:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    def batch_of(out: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "key", "start", "end"])

    return sorted_by_hash(rows).mapInArrow(run, "doc long, key long, start long, end long")


def later_windows(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The same for rows of hot single windows: the first of each comes from an aggregate with map-side combining."""
    place = F.struct("doc", "key", "place")
    firsts = scratch.keep(rows.groupBy("h", "bytes").agg(F.min(place).alias("first")), "firsts")
    both = rows.join(measured(firsts, 2 * LENGTH), ["h", "bytes"]).where(place > F.col("first"))
    start = F.col("place") - F.col("back")
    # The windows of one anchor make up one range.
    return both.groupBy("doc", "key", "place").agg(F.min(start).alias("start"), (F.max(start) + LENGTH).alias("end")).drop("place")


def every(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def all_rows(docs: DataFrame, scratch: Scratch, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """ROW of all anchors that may repeat, hot ones in parts; and the rows of hot single windows, if any."""
    twice, crowded = survey(docs, scratch, hot)
    tables = docs.sparkSession.sparkContext.broadcast((twice, crowded))
    rows = gathered(docs, tables, bool(crowded.any()))
    if not crowded.any():
        return rows, None
    cool, single = hot_parts(docs, tables, scratch, hot)
    return every([rows, *cool]), every(single) if single else None


def groups(rows: DataFrame) -> DataFrame:
    """(h, repeat, length, doc, key, start): the maximal repeat groups of each anchor hash with all of their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, group in by_hash(batches):
            places: dict[tuple[int, bytes], list[Row]] = {}
            for row in sorted(set(group)):
                places.setdefault((row[3], row[4]), []).append(row)
            found = [(len(same[0][4]), [(r[0], r[1], r[2] - r[3]) for r in same]) for same in places.values() if len(same) > 1]
            for right, _, high, members in repeat_groups([same[0] for same in places.values()]):
                found.append((high + right, [(r[0], r[1], r[2] - high) for m in members for r in places[m[3], m[4]]]))
            for i, (size, where) in enumerate(found):
                columns = [np.full(len(where), h), np.full(len(where), i), np.full(len(where), size), *np.array(where, np.int64).T]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["h", "repeat", "length", "doc", "key", "start"])

    return sorted_by_hash(rows).mapInArrow(run, "h long, repeat long, length long, doc long, key long, start long")


def maximal_repeats(docs: DataFrame, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """(repeat, length, doc, key, start): groups of equal strings of LENGTH bytes and more with all of their occurrences, none of which can be made
    longer without losing one. Groups of neighbouring anchors that have the same occurrences and overlap are one repeat, however
    long; no group is gathered for that (its occurrences are compared by a sum of hashes)."""
    rows, single = all_rows(docs, scratch, hot)
    found = groups(rows)
    if single is not None:
        windows = single.distinct().select("h", F.xxhash64("bytes").alias("repeat"), F.lit(LENGTH).cast("long").alias("length"), "doc", "key", (F.col("place") - F.col("back")).alias("start"))
        found = found.unionByName(windows)
    found = scratch.keep(found, "groups")
    group, at = ["h", "repeat", "length"], F.struct("doc", "key", "start")
    firsts = found.groupBy(*group).agg(F.min(at).alias("first"), F.count("*").alias("n"))
    shift = F.xxhash64("doc", "key", F.col("start") - F.col("first.start"))
    told = found.join(firsts, group).groupBy(*group).agg(
        F.first("first").alias("first"), F.first("n").alias("n"), F.sum(shift.cast("decimal(38,0)")).alias("sum"), F.bit_xor(shift).alias("xor"))
    same = ["first.doc", "first.key", "n", "sum", "xor"]
    # Of groups alike in place and occurrences the windows follow each other, so a gap ends a repeat.
    end = F.col("first.start") + F.col("length")
    order = Window.partitionBy(*same).orderBy("first.start", F.col("length").desc(), "h", "repeat")
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # Overlapping by all but one byte of a window, so that no window between them is left out.
    told = told.withColumn("new", F.coalesce(F.col("first.start") > reach - LENGTH + 1, F.lit(True)).cast("int"))
    told = told.withColumn("island", F.sum("new").over(order))
    whole = told.groupBy(F.col("first.doc").alias("d"), F.col("first.key").alias("k"), "n", "sum", "xor", "island").agg(
        F.min(F.struct(F.col("first.start").alias("start"), (-F.col("length")).alias("length"), "h", "repeat")).alias("head"), F.max(end).alias("end"))
    heads = whole.select(
        F.col("head.h").alias("h"), F.col("head.repeat").alias("repeat"), (-F.col("head.length")).alias("length"), (F.col("end") - F.col("head.start")).alias("whole"),
        F.xxhash64("d", "k", "n", "sum", "xor", "island").alias("name"))
    out = found.join(heads, group).select(F.col("name").alias("repeat"), F.col("whole").alias("length"), "doc", "key", "start")
    return out


def marked_ranges(docs: DataFrame, scratch: Scratch, hot: int = HOT) -> DataFrame:
    rows, single = all_rows(docs, scratch, hot)
    found = ranges(rows)
    return found if single is None else found.unionByName(later_windows(single, scratch))


def union(pieces: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(pieces):
        a, b = max(a, 0), min(b, n)
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut(docs: DataFrame, scratch: Scratch, hot: int = HOT, kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of docs; with ``kept`` also the bytes kept and the spans."""
    found = marked_ranges(docs, scratch, hot)
    # At most one range per anchor (and part of a hot one), so a document's ranges are bounded by its own length.
    per_doc = found.groupBy(F.col("doc").alias("doc_id"), "key").agg(F.collect_set(F.struct("start", "end")).alias("pieces"))
    rows = keyed(docs).join(per_doc.hint("merge"), ["doc_id", "key"], "left")
    starts, ends = F.transform("pieces", lambda x: x["start"]), F.transform("pieces", lambda x: x["end"])
    rows = rows.select("doc_id", "text", starts.alias("starts"), ends.alias("ends"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<array<long>>" * kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                columns: list[list] = [[] for _ in range(4 + 2 * kept)]
                for text, a, b in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("starts").to_pylist(), part.column("ends").to_pylist(), strict=True):
                    text = text or b""
                    gone = union(list(zip(a or (), b or (), strict=True)), len(text))
                    rest, at = [], 0
                    for x, y in gone:
                        rest.append(text[at:x])
                        at = y
                    left = b"".join([*rest, text[at:]])
                    values = (len(text), len(text) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left, [list(x) for x in gone])
                    for column, value in zip(columns, values, strict=False):
                        column.append(value)
                kinds = [pa.int64()] * 3 + [pa.string(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"][: 5 + 2 * kept])

    return rows.mapInArrow(run, schema)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return cut(table(spark, sf_dir, "documents"), Scratch(spark, "op10"))
