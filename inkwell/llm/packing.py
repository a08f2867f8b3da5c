"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bounded-space online best fit: at most ``open_bins`` sequences are open, found through a bitset whose bit f is
set while some open sequence has f free places, so that the tightest fit is one shift and one lowest-bit step.
When one more sequence must be opened, the fullest closes. Pieces arrive in windows and the longest of a window are placed first. Tokenising gives a narrow table of pieces (no texts),
written to the shared folder; each packing task then takes some tens of thousands of pieces and packs on its
own, so that only the last few sequences of a task stay partly empty.

A document's ids are those of the tokenizer, then the end id; only a longer document than a sequence is cut,
into full pieces after a first one that may be shorter. Defined cases: null text is empty (its end id alone);
rows with equal or null ids are packed each on its own; an empty table gives an empty result; extra columns are
ignored.

Tokenising splits a text at single spaces between two characters that are not white space. The pre-tokenizer
begins a new token at each such space whatever stands around, so the parts can be encoded one by one, and
frequent parts are remembered (a bounded memo); every id comes from the tokenizers library. The library's defaults hold, so the string of a special token
in a text becomes that token's id; such strings have no space.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, bounded, load, saved, sole_memo, with_fields, work_dir

LENGTH = 1024
END_ID = 2
OPEN_BINS = 1024
#: Pieces that wait for each other before they are placed.
WINDOW = 2000
#: Pieces that one packing task takes, about.
TASK_PIECES = 50_000
#: Parts that a worker remembers, about 200 bytes each.
MEMO = 800_000
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PACKED = PIECES + ", sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteIds:
    """Ids of a text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.inner = Memo(self._inner, MEMO)
        self.signs = Memo(self._ids, 100)
        self.word = self.tokenizer.model.tokenize
        self.byte_chars = {b: c for c, b in _byte_alphabet().items()}

    def _ids(self, s: str) -> bytes:
        ids = self.tokenizer.encode(s, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _inner(self, part: str) -> bytes | None:
        """Of a part after a space; None if that space isn't a single one."""
        if not part or part[0].isspace() or part[-1].isspace():
            return None
        stem, sign = part[:-1], part[-1]
        if sign in ".,;:!?" and stem.isalpha() and max(stem) < "\u0250":  # a match of letters, then one of signs
            return self.inner[stem] + self.signs[sign]
        if part.isalpha() and max(part) < "\u0250":  # one match: straight to the model, in its alphabet of bytes
            ids = [t.id for t in self.word("".join(map(self.byte_chars.__getitem__, (" " + part).encode())))]
            return struct.pack(f"<{len(ids)}I", *ids)
        return self._ids(" " + part)

    def encode(self, text: str) -> bytes:
        parts = text.split(" ")
        head = parts[0]
        if head and not head[-1].isspace():
            try:
                return b"".join([self._ids(head), *map(self.inner.__getitem__, parts[1:])])
            except TypeError:
                pass
        parts = _SINGLE_SPACE.split(text)
        if len(parts) == 1:
            return self._ids(text)
        return b"".join([self._ids(parts[0]), *map(self.inner.__getitem__, parts[1:-1]), self._ids(" " + parts[-1])])


def _byte_alphabet() -> dict[str, int]:
    """{character: byte} of a byte-level vocabulary: printable Latin-1 stands for itself, other bytes follow from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


@lru_cache(2)
def byte_ids(path: str) -> ByteIds:
    return ByteIds(path)


def _cut(ids: bytes, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids."""
    n = len(ids) // 4
    start, piece = 0, 0
    end = n % length or min(n, length)
    while start < n:
        yield piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end])
        piece, start, end = piece + 1, end, end + length


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text) to one row per piece of at most ``length`` ids."""
    tail = struct.pack("<I", end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memo("packing", byte_ids.cache_clear)
        encoder = byte_ids(tokenizer)
        for b in batches:
            rows = [(i, *p) for i, t in zip(b["doc_id"].to_pylist(), b["text"], strict=True) for p in _cut((encoder.encode(t.as_py()) if t.is_valid else b"") + tail, length)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)] if rows else [pa.array([], f.type) for f in _PIECES], schema=_PIECES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


class BestFit:
    """Open sequences by free space; ``place`` gives (sequence, offset)."""

    def __init__(self, length: int, open_bins: int):
        self.length, self.most, self.open, self.next = length, open_bins, 0, 0
        self.bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        got = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.open -= 1
        return got

    def place(self, size: int) -> tuple[int, int]:
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            seq = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            seq, free = self.next, self.length
            self.next += 1
        left = free - size
        if left:
            if not self.by_free[left]:
                self.bits |= 1 << left
            self.by_free[left].append(seq)
            self.open += 1
        return seq, self.length - free


def pack(pieces: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """Add sequence_id and offset. Each partition is packed on its own, in windows of WINDOW pieces, the longest of a window first; windows don't depend on the batches that pieces come in."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b)
            while size >= WINDOW:
                table = pa.Table.from_batches(held).combine_chunks()
                yield table.slice(0, WINDOW).to_batches()[0]
                held, size = table.slice(WINDOW).to_batches(), size - WINDOW
        if size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = BestFit(length, open_bins), TaskContext.get().partitionId() << 36
        for b in windows(batches):
            lengths = b["length"].to_numpy()
            placed = np.zeros((len(b), 2), np.int64)
            for i in np.argsort(-lengths, kind="stable").tolist():
                placed[i] = bins.place(int(lengths[i]))
            seq, offset = (placed + [base, 0]).T
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq), pa.array(offset)], names=[*b.schema.names, "sequence_id", "offset"])

    return pieces.mapInArrow(fit, with_fields(pieces, "sequence_id long, offset long"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    cut = saved(pieces(docs, tokenizer or default_tokenizer()), work_dir(spark, "pieces"))
    tasks = max(1, -(-cut.count() // TASK_PIECES))
    return pack(cut.coalesce(tasks))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: one row per packed piece."""
    bounded(spark)
    return pack_documents(docs.select("doc_id", "text"))
