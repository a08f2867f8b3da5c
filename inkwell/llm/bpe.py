"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is encoded by halves: a short piece directly, a longer one by encoding both halves and joining them.
The monoid's elements are lists of units (text, ids), a unit being one or more whole matches of the pattern.

Joining looks at a window around the seam that grows until what lies outside is provably stable:

* left of it, a match that ended at least LOOKAHEAD characters before the seam was decided by characters that
  all stand in the left half, so it stays;
* right of it, matching is memoryless: once the scan over the seam stops where a unit of the right half
  begins, all later units follow unchanged.

Where one match spans the seam (a very long run of letters, say), its bytes are joined in the same way:
a window of k ids on each side is merged anew, with k doubling, until the pair of ids on each border of the window
encodes to itself. A sequence of ids is the encoding of its bytes if every id encodes to itself and so does
every pair of neighbours: the first merge that crossed a border in the whole would also occur in the pair alone.

Decoding concatenates up the tree. Defined cases: null text is empty (no ids, empty bytes); an empty table gives
an empty result; every row is encoded on its own, so ties and repeats are kept; extra columns pass through.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, load, sole_memo, with_fields

#: Characters of a text that are encoded directly, and bytes of one match.
LEAF_CHARS, LEAF_BYTES = 4096, 256
#: Characters that deciding a match can look at beyond its end (the longest contraction).
LOOKAHEAD = 3
#: Longer space-free parts are kept match by match, so that a window need not hold them whole.
UNIT_CHARS = 64


class TreeBpe:
    """Encoder and decoder of one rank file. The pattern must decide a match by at most LOOKAHEAD characters beyond it."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.regex = regex.compile(pattern)
        self.short = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})._core_bpe.encode_ordinary
        self.unit, self.spaced = Memo(self._unit, 50_000), Memo(self._spaced, 450_000)
        self.decimal = {v: b"%d" % v for v in self.bytes_of}
        self.pair = Memo(lambda p: self.merge(self.bytes_of[p[0]] + self.bytes_of[p[1]]) == [*p], 100_000)

    # -- one match ---------------------------------------------------------------------------------------------

    def merge(self, piece: bytes) -> list[int]:
        """Merges of the lowest rank first, leftmost of equals, with a heap over a linked list."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that begins at i
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def join_ids(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left or right
        k = 1
        while True:
            l, r = left[-k:], right[:k]
            new = self.merge(b"".join(map(self.bytes_of.__getitem__, l + r)))
            if (k >= len(left) or self.pair[left[-k - 1], new[0]]) and (k >= len(right) or self.pair[new[-1], right[k]]):
                return left[:-k] + new + right[k:]
            k *= 2

    def _tree(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF_BYTES:
            return self.merge(piece)
        half = len(piece) // 2
        return self.join_ids(self._tree(piece[:half]), self._tree(piece[half:]))

    def match_ids(self, match: str) -> list[int]:
        piece = match.encode("utf-8", "surrogatepass")
        if (one := self.ranks.get(piece)) is not None:
            return [one]
        return self._tree(piece)

    # -- a text ------------------------------------------------------------------------------------------------

    def _unit(self, unit: str) -> bytes:
        ids = self.short(unit) if len(unit) <= UNIT_CHARS else [i for m in self.regex.findall(unit) for i in self.match_ids(m)]
        return np.array(ids, np.uint32).tobytes()

    def _spaced(self, unit: str) -> bytes | None:
        """Ids of a unit that was cut at spaces alone; None if it isn't sure to be whole matches, or is long."""
        inner = unit[1:] if unit[:1] == " " else unit
        if not inner or inner[0].isspace() or inner[-1].isspace() or len(unit) > UNIT_CHARS:
            return None
        return self._unit(unit)

    def _leaf(self, text: str, by_match: bool) -> list[str]:
        """Units of a short text: cut before every space, or by match."""
        return self.regex.findall(text) if by_match else text.replace(" ", "\0 ").split("\0")

    def _join(self, left: list[str], right: list[str], ids: dict[str, bytes]) -> list[str]:
        if not left or not right:
            return left or right
        # left units that end at least LOOKAHEAD characters before the seam, stay
        keep, tail = len(left), 0
        while keep and tail < LOOKAHEAD + 1:
            keep -= 1
            tail += len(left[keep])
        window, new, taken = "".join(left[keep:]), [], 0
        at = seam = 0
        seam = len(window)
        ends: dict[int, int] = {seam: 0}
        step = 4
        while True:
            # grow the window by some units of the right half; its last match may go on, so it is only used at the end
            more = right[taken : taken + step]
            for u in more:
                window += u
                taken += 1
                ends[len(window)] = taken
            step *= 2
            final = taken == len(right)
            while at < len(window):
                m = self.regex.match(window, at)
                if not final and m.end() > len(window) - LOOKAHEAD - 1:
                    break
                new.append(m.group())
                at = m.end()
                if at >= seam and at in ends:
                    self._glue(left, right, new, keep, ids)
                    return left[:keep] + new + right[ends[at] :]
            if final and at >= len(window):
                return left[:keep] + new

    def _glue(self, left: list[str], right: list[str], new: list[str], keep: int, ids: dict[str, bytes]) -> None:
        """A long match over the seam gets its ids from those of its two parts."""
        for m in new:
            if len(m) > LEAF_BYTES and m not in ids and m == left[-1] + right[0]:
                parts = [np.frombuffer(ids.get(x) or np.array(self.match_ids(x), np.uint32).tobytes(), np.uint32).tolist() for x in (left[-1], right[0])]
                ids[m] = np.array(self.join_ids(*parts), np.uint32).tobytes()

    def units(self, text: str, ids: dict[str, bytes], by_match: bool) -> list[str]:
        if len(text) <= LEAF_CHARS:
            return self._leaf(text, by_match)
        half = len(text) // 2
        return self._join(self.units(text[:half], ids, by_match), self.units(text[half:], ids, by_match), ids)

    def encode(self, text: str) -> np.ndarray:
        """A text whose spaces all stand alone between other characters is cut at its spaces, any other by match."""
        if text and "\0" not in text:
            try:
                return np.frombuffer(b"".join(map(self.spaced.__getitem__, self.units(text, {}, False))), np.uint32)
            except TypeError:
                pass
        ids: dict[str, bytes] = {}  # of long matches of this text
        units = self.units(text, ids, True)
        return np.frombuffer(b"".join([ids[u] if u in ids else self.unit[u] for u in units]), np.uint32)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_CHARS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(2)
def codec(ranks_path: str, pattern: str) -> TreeBpe:
    return TreeBpe(ranks_path, pattern)


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(…, text) to the other columns and ``ids array<int>``."""
    rest = [c for c in docs.columns if c not in ("text", "ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memo("bpe", codec.cache_clear)
        bpe = codec(ranks_path, pattern)
        for b in batches:
            got = [bpe.encode(t.as_py()) if t.is_valid else np.zeros(0, np.uint32) for t in b["text"]]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
            values = pa.array(np.concatenate([*got, np.zeros(0, np.uint32)]).view(np.int32) if got else np.zeros(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in rest), pa.ListArray.from_arrays(pa.array(offsets), values)], names=[*rest, "ids"])

    return docs.select(*rest, "text").mapInArrow(run, with_fields(docs.select(*rest), "ids array<int>"))


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(…, ids) to all columns and ``decoded binary``."""
    names = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memo("bpe", codec.cache_clear)
        bpe = codec(ranks_path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(map(bpe.decode, _lists(b["ids"])), pa.binary())], names=[*names, "decoded"])

    return encoded.select(*names).mapInArrow(run, with_fields(encoded.select(*names), "decoded binary"))


def _lists(column: pa.ListArray) -> Iterator[list[int]]:
    """Each row's ids; null has none."""
    values, at = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield values[a:b].tolist()


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = default_ranks()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memo("bpe", codec.cache_clear)
        bpe = codec(*at)
        for b in batches:
            n, a, d = [], [], []
            for ids in _lists(b["ids"]):
                n.append(len(ids))
                a.append(hashlib.sha256(b",".join(map(bpe.decimal.__getitem__, ids))).hexdigest())
                d.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return encode(docs, *at).mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
