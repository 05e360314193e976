"""Token-id output: best-fit-decreasing packing into fixed-length sequences.

Every document's ids (with an end-of-text id behind them) are split losslessly into segments of at most ``length`` ids. A task
gathers segments until a pool is full, sorts them by falling length, and puts each into the fullest open sequence that still has
room. A segment tree over the free capacities finds that sequence in logarithmic time. A row of the result is one sequence: its ids as
a little-endian matrix row (two bytes each while the vocabulary allows, else four), the cumulative segment lengths, the
places where positions restart, and for every segment the document and offset it comes from.

Nothing is shuffled; a pool is bounded by POOL ids, so memory does not depend on the input. Pools follow the order of the rows
in a file split, so a rerun after a lost executor gives the same sequences. Only the last pool of a split is less than full.

Edge cases: null and empty texts have no segments; a document of exactly ``length`` ids is one segment; repeated rows are
packed each; equal lengths keep the order of the rows; extra columns are ignored; an empty table gives no sequences.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import bpe
from .common import table

LENGTH, POOL = 2048, 4_000_000
SCHEMA = "part int, pack long, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, offsets array<long>, used int"


class Capacities:
    """Open sequences by free capacity. Inner nodes of the tree tell whether any leaf below holds a sequence."""

    def __init__(self, length: int):
        self.base = 1 << length.bit_length()
        self.some = bytearray(2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, free: int, pack: int) -> None:
        self.open[free].append(pack)
        i = self.base + free
        while i and not self.some[i]:
            self.some[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(pack, free) of the sequence with the least free capacity of at least need; of these the one opened last."""
        i = self.base + need
        if not self.some[i]:
            # Climb until a right sibling holds something, then go down its leftmost branch.
            while i > 1 and (i & 1 or not self.some[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if self.some[2 * i] else 2 * i + 1
        free = i - self.base
        pack = self.open[free].pop()
        if not self.open[free]:
            while i and not (i < self.base and (self.some[2 * i] or self.some[2 * i + 1])):
                self.some[i] = 0
                i >>= 1
        return pack, free


def best_fit_decreasing(lengths: list[int], length: int) -> list[list[int]]:
    """The members of each sequence, as indices into lengths."""
    open_, packs = Capacities(length), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = open_.take(lengths[i])
        pack, free = found or (len(packs), length)
        if found is None:
            packs.append([])
        packs[pack].append(i)
        if free > lengths[i]:
            open_.put(free - lengths[i], pack)
    return packs


def split(ids: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    return [(i, ids[i : i + length]) for i in range(0, len(ids), length)]


@lru_cache(maxsize=2)
def library_encoding(path: str, pattern: str):
    """The compiled encoder; op1's tests hold both encoders against each other."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=bpe.load(path).ranks, special_tokens={})


def pack(docs: DataFrame, path: str, pattern: str, end: int | None = None, pad: int = 0, length: int = LENGTH, pool: int = POOL) -> DataFrame:
    """One row per packed sequence. end: the id appended to every document; pad: the id that fills the rest of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = library_encoding(path, pattern)
        kind = np.dtype("<u2") if max(encoding.n_vocab, end or 0, pad) < 1 << 16 else np.dtype("<u4")
        part, done = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, int, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal done
            packs = best_fit_decreasing([len(x) for _, _, x in held], length)
            for at in range(0, len(packs), 256):
                rows: dict[str, list] = {k.split()[0]: [] for k in SCHEMA.split(", ")}
                for members in packs[at : at + 256]:
                    ends = np.cumsum([0, *(len(held[i][2]) for i in members)], dtype=np.int32)
                    row = np.full(length, pad, kind)
                    row[: ends[-1]] = np.concatenate([held[i][2] for i in members])
                    values = (part, done, row.tobytes(), ends, ends[:-1], [held[i][0] for i in members], [held[i][1] for i in members], int(ends[-1]))
                    for column, value in zip(rows.values(), values, strict=True):
                        column.append(value)
                    done += 1
                kinds = [pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))

        for batch, texts in bpe.texts(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                if not text:
                    continue
                ids = encoding.encode_to_numpy(text, disallowed_special=()).astype(kind)
                if end is not None:
                    ids = np.append(ids, kind.type(end))
                for offset, segment in split(ids, length):
                    held.append((doc, offset, segment))
                    size += len(segment)
            if size >= pool:
                yield from flush()
                held, size = [], 0
        yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def write(packed: DataFrame, path: str) -> None:
    """The id matrix and its indexes as Parquet, one binary row per sequence."""
    packed.write.mode("overwrite").parquet(path)


def matrix(rows: list, wide: bool = False) -> np.ndarray:
    """Rows of the result as an id matrix."""
    return np.stack([np.frombuffer(r["ids"], "<u4" if wide else "<u2") for r in rows])


def positions(cu_seqlens: list[int], length: int = LENGTH) -> np.ndarray:
    """Position ids of one sequence: they restart at every segment; the padding counts on as one more."""
    out = np.arange(length, dtype=np.int32)
    for a, b in zip(cu_seqlens, [*cu_seqlens[1:], length], strict=True):
        out[a:b] -= a
    return out


def op2_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text tokenised and packed into rows of 2,048 ids."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return pack(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, end=50256, pad=50256)
