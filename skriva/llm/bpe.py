"""Byte-level BPE by prefix dynamic programming.

For a fixed vocabulary every byte prefix of a piece has exactly one encoding, so it has one last token. That token is the only one
that ends at the prefix's end and fits behind the last token of the shorter prefix; whether two tokens fit is decided by
undoing their merges along the seam. The table of last tokens takes one entry per byte, appends extend it without looking back, and
an edit re-encodes only the pieces that it touches. A piece takes time proportional to its length, however long it is.

Texts are first cut into pieces by a pattern; pieces never share tokens. A piece that is itself a token is that token, as in the
tiktoken library. Edge cases: null counts as the empty text, which has no tokens; lone surrogates cannot occur in Spark strings;
repeated rows are encoded row by row; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import table

#: Entries of the per-worker memo tables; beyond that they start anew. They only save time.
MEMO = 500_000
PAIR_MEMO = 1_000_000


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


class Vocabulary:
    """Token bytes and ids, with the questions that the prefix tables ask."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token_bytes: dict[int, bytes] = {i: b for b, i in ranks.items()}
        #: Every ending of a token, with its id if it is a token itself, else -1.
        self.tails = {t: ranks.get(t, -1) for b in ranks for t in (b[i:] for i in range(len(b)))}
        self._last_merge: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, bool] = {}
        self.first = lru_cache(maxsize=None)(self.reachable)  # at most one entry per token

    def merged(self, piece: bytes) -> tuple[list[int], tuple[int, int] | None]:
        """Plain merging, for single tokens: the ids, and the last pair that was merged."""
        parts, last = [piece[i : i + 1] for i in range(len(piece))], None
        while len(parts) > 1:
            best = min(((self.ranks.get(a + b, sys.maxsize), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == sys.maxsize:
                break
            i = best[1]
            last = (self.ranks[parts[i]], self.ranks[parts[i + 1]])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts], last

    def last_merge(self, token: int) -> tuple[int, int] | None:
        """The two tokens that merge into this one; None for single bytes and for tokens that merging never reaches."""
        found = self._last_merge.get(token, 0)
        if found == 0:
            ids, last = self.merged(self.token_bytes[token])
            found = self._last_merge[token] = last if ids == [token] else None
        return found

    def reachable(self, token: int) -> bool:
        return len(self.token_bytes[token]) == 1 or self.last_merge(token) is not None

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens."""
        key = left << 32 | right
        found = self._fits.get(key)
        if found is None:
            if len(self._fits) >= PAIR_MEMO:
                self._fits.clear()
            found = self._fits[key] = self.reachable(right) and self._seam_holds(left, right)
        return found

    def _seam_holds(self, left: int, right: int) -> bool:
        """Go back in time: undo the later of the two merges beside the seam. While two tokens stood at the seam, their union
        must not have had a rank below that of the merge which next took one of them away."""
        text, ranks, before = self.token_bytes, self.ranks, sys.maxsize
        while True:
            union = ranks.get(text[left] + text[right])
            if union is not None and union < before:
                return False
            made_left, made_right = self.last_merge(left), self.last_merge(right)
            if made_left is None and made_right is None:
                return True
            # Of equal merges the one further left comes first; so the seam itself beats an equal merge on its right.
            if made_right is None or (made_left is not None and left > right):
                before, left = left, made_left[1]
            else:
                before, right = right + 1, made_right[0]


class PrefixTable:
    """The last token of every byte prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", array("I")
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Extend the piece; no earlier entry changes."""
        v, piece, last = self.vocabulary, self.piece + more, self.last
        tails, known, first = v.tails.get, v._fits.get, v.first
        for end in range(len(last) + 1, len(piece) + 1):
            ends, start = [], end - 1  # the tokens that end here, short ones first
            while start >= 0:
                token = tails(piece[start:end])
                if token is None:
                    break
                ends.append(token)
                start -= 1
            for token in reversed(ends):
                start += 1
                if token < 0:
                    continue
                if start == 0:
                    if first(token):
                        break
                    continue
                fits = known(last[start - 1] << 32 | token)
                if fits is None:
                    fits = v.fits(last[start - 1], token)
                if fits:
                    break
            else:
                raise ValueError("the vocabulary lacks a byte of this piece")
            last.append(token)
        self.piece = piece

    def cut(self, length: int) -> None:
        """Keep the first bytes only; their table holds."""
        self.piece = self.piece[:length]
        del self.last[length:]

    def tokens(self) -> list[int]:
        whole = self.vocabulary.ranks.get(self.piece)
        if whole is not None:
            return [whole]
        out, end = [], len(self.piece)
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(self.vocabulary.token_bytes[token])
        return out[::-1]


class Splitter:
    """Cuts texts into pieces by a pattern whose \\s is Unicode's White_Space, as in the tiktoken library."""

    def __init__(self, pattern: str):
        self.exact = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.pieces = self.exact.findall


class Encoder(dict):
    """Piece -> packed ids (little-endian unsigned 32-bit), with a memo of bounded size."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        super().__init__()
        self.vocabulary, self.splitter = vocabulary, Splitter(pattern)

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.vocabulary.ranks.get(raw)
        ids = array("I", PrefixTable(self.vocabulary, raw).tokens() if whole is None else [whole])
        if sys.byteorder == "big":
            ids.byteswap()
        packed = ids.tobytes()
        if len(raw) <= 64:  # long pieces would fill the memo and hardly come back
            if len(self) >= MEMO:
                self.clear()
            self[piece] = packed
        return packed

    def packed(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.splitter.pieces(text))) if text else b""

    def encode(self, text: str | None) -> array:
        return unpack(self.packed(text))

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.token_bytes.__getitem__, ids))


def unpack(packed: bytes) -> array:
    ids = array("I", packed)
    if sys.byteorder == "big":
        ids.byteswap()
    return ids


class EditableText:
    """A text with its pieces and their prefix tables. Appends and edits re-encode only what they touch.

    A piece depends on its own characters and at most two behind it (a white-space run gives one back, a contraction looks for
    two letters). So an edit at position x leaves all pieces that end before x - 1 alone, and cutting anew stops where it meets an old boundary behind the edit."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.starts: list[int] = []
        self.tables: list[PrefixTable] = []
        self.touched = 0
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put new in the place of text[start:end]."""
        text = self.text[:start] + new + self.text[end:]
        shift, behind = len(new) - (end - start), start + len(new)
        first = 0
        while first < len(self.starts) and self._end(first) + 1 < start:
            first += 1
        at = self.starts[first] if first < len(self.starts) else (self._end(len(self.starts) - 1) if self.starts else 0)
        old = {s + shift: i for i, s in enumerate(self.starts) if s >= end}
        fresh: list[tuple[int, PrefixTable]] = []
        keep_from = len(self.starts)
        # Its table can serve again unless the piece itself may stay.
        spare = self.tables[first] if first < len(self.starts) and self.starts[first] < start else None
        while at < len(text):
            if at >= behind and at in old:
                keep_from = old[at]
                break
            piece = self.encoder.splitter.exact.match(text, at).group()
            raw = piece.encode()
            if spare is not None:  # the first piece often only grows or shrinks at its end
                common = _common(spare.piece, raw)
                spare.cut(common)
                spare.append(raw[common:])
                fresh.append((at, spare))
                spare = None
            else:
                fresh.append((at, PrefixTable(self.encoder.vocabulary, raw)))
            at += len(piece)
        self.touched = len(fresh)
        tail_starts = [s + shift for s in self.starts[keep_from:]]
        self.starts = self.starts[:first] + [s for s, _ in fresh] + tail_starts
        self.tables = self.tables[:first] + [t for _, t in fresh] + self.tables[keep_from:]
        self.text = text

    def _end(self, i: int) -> int:
        return self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text)

    def tokens(self) -> list[int]:
        return [t for x in self.tables for t in x.tokens()]


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One per Python worker."""
    return Encoder(load(path), pattern)


def texts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Small slices, so that memory follows the slice and not the batch."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            yield part, part.column("text").to_pylist()


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, per row of docs; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for part, column in texts(batches):
            n, ids_sha, text_sha = [], [], []
            for text in column:
                packed = e.packed(text)
                n.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(e.decode_bytes(unpack(packed))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, pattern: str, column: str = "tokens") -> DataFrame:
    """docs with an array<int> column of token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for part, texts_ in texts(batches):
            packed = [e.packed(t) for t in texts_]
            offsets = array("i", [0])
            for p in packed:
                offsets.append(offsets[-1] + len(p) // 4)
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(packed))]))
            yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*names, column])

    docs = docs.drop(column)
    names = docs.columns
    schema = StructType([*docs.schema.fields, StructField(column, ArrayType(IntegerType()))])
    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, pattern: str, column: str = "tokens") -> DataFrame:
    """tokens with its ids turned back into a string column ``decoded`` (one of that name is replaced); ids that are no tokens raise."""
    tokens = tokens.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            out = [e.decode_bytes(x or []).decode("utf-8", "replace") for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*names, "decoded"])

    names = tokens.columns
    return tokens.mapInArrow(run, StructType([*tokens.schema.fields, StructField("decoded", StringType())]))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by the public multi-language ranks and decoded again."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
