"""Document fingerprints by content-defined chunking.

A gear hash over the last WINDOW bytes proposes boundaries; chunk sizes are normalised, that is, a stricter mask holds below
the normal size and a looser one above. Chunks have at least WINDOW bytes, so a boundary depends on bytes of its own
chunk only and the same passage is cut alike wherever it stands. A fingerprint is the set of a text's chunk digests
(48 bits) with their lengths, as hex in order of the digests. Likeness is containment: the length of the chunks of one text that the other
has too, by the length of all its (distinct) chunks.

``with_next`` pairs each document with the one that follows in ascending id without sorting the table in one place: ids
are cut into buckets at quantiles, a bucket is sorted within its task, and the first row of each bucket is
also sent to the bucket before, so every text is shuffled once (compressed).

Defined cases: null text is empty, its fingerprint is empty and like only empty ones; null ids come first; rows of one id
are ordered by their texts; the last row is followed by the first, a single row by itself; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, load, mix, slices

#: Bytes that a boundary depends on, which is also the least size; normal and largest size.
WINDOW, NORMAL, LARGEST = 32, 64, 256
#: Bits that must be 0 below and above the normal size; the latter are some of the former.
STRICT, LOOSE = 7, 4
#: Bytes of text that one step works on.
STEP_BYTES = 2 << 20

_rng = np.random.default_rng(41)
GEAR = _rng.integers(0, 2**32, 256, dtype=np.uint32)
_TABLE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_K = U(0x9E3779B97F4A7C15)
_K_INVERSE = U(pow(int(_K), -1, 2**64))
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * STEP_BYTES)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, k, U)]), dtype=U) for k in (_K, _K_INVERSE)]
    return _powers[0], _powers[1]


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, start, end) of every chunk, by text and place; starts and ends in the joined bytes."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    h = GEAR[data]
    span = 1
    while span < WINDOW:  # h over 2 * span bytes from h over span bytes
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    loose = np.flatnonzero(h >> np.uint32(32 - LOOSE) == 0) + 1
    strict = loose[h[loose - 1] >> np.uint32(32 - STRICT) == 0]
    never = np.array([len(data) + LARGEST + 1])
    loose, strict = np.concatenate([loose, never]), np.concatenate([strict, never])
    who = np.flatnonzero(np.diff(ends, prepend=0) > 0)
    at = (ends - np.diff(ends, prepend=0))[who]
    out = []
    while len(who):
        end = ends[who]
        cut = strict[np.searchsorted(strict, at + WINDOW)]
        later = cut >= at + NORMAL
        cut = np.where(later, loose[np.searchsorted(loose, at + NORMAL)], cut)
        cut = np.minimum(np.minimum(cut, at + LARGEST), end)
        out.append(np.stack([who, at, cut]))
        more = cut < end
        who, at = who[more], cut[more]
    if not out:
        return (np.zeros(0, np.int64),) * 3
    all_ = np.concatenate(out, 1)
    return tuple(all_[:, np.argsort(all_[1], kind="stable")])


def digest_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digests below 2^48, lengths, offsets by text): each text's distinct chunk digests in order. At most 65,536 texts at once."""
    who, start, end = chunks(texts)
    n = len(texts)
    if not len(who):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    up, down = _power(len(data))
    sums = np.add.reduceat(_TABLE[data] * up[: len(data)], start)
    digest = mix(sums * down[start] ^ (end - start).astype(U)) >> U(16)
    both = (who.astype(U) << U(48)) | digest
    both, first = np.unique(both, return_index=True)
    return both & U(2**48 - 1), (end - start)[first], np.searchsorted(both >> U(48), np.arange(n + 1).astype(U))


def containment(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """For each pair of texts at the same index: the share of a's weight whose digests b has; 1 if both are empty, 0 if only a is."""

    def keyed(x):
        return (np.repeat(np.arange(len(x[2]) - 1), np.diff(x[2])).astype(U) << U(48)) | x[0]

    ka, kb = keyed(a), keyed(b)
    place = np.searchsorted(kb, ka)
    shared = np.zeros(len(ka), bool)
    inside = place < len(kb)
    shared[inside] = kb[place[inside]] == ka[inside]
    sums = np.stack([np.concatenate([[0], np.cumsum(w)])[a[2]] for w in (a[1], a[1] * shared)])
    total, common = np.diff(sums, axis=1)
    return np.where(total > 0, common / np.maximum(total, 1), (np.diff(b[2]) == 0).astype(float))


def as_hex(sets: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[str]:
    """14 hex digits a chunk: digest, length less one."""
    digest, length, at = sets
    raw = np.empty((len(digest), 7), np.uint8)
    raw[:, :6] = digest.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    raw[:, 6] = length - 1
    text = raw.tobytes().hex()
    return [text[14 * a : 14 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or "").encode() for t in b["text"].to_pylist()]
            for lo, hi in _steps(texts):
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(lo, hi - lo), pa.array(as_hex(digest_sets(texts[lo:hi])), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def _steps(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    return slices(np.fromiter(map(len, texts), np.int64, len(texts)), STEP_BYTES)


# -- each document and the next one ----------------------------------------------------------------------------

_LEAST = -(2**63)


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, guest, k, doc_id, packed) rows in order within their partitions; a guest is the first row of the next bucket."""
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("k"))
    cuts = ids.select(F.percentile_approx("k", [i / buckets for i in range(1, buckets)], 20 * buckets)).first()[0] or [] if buckets > 1 else []
    cuts = np.unique(np.array(cuts, np.int64))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for b in batches:
            k = b["doc_id"].fill_null(_LEAST).to_numpy()
            raw = [(t or "").encode() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, k, "right"), pa.int64()), pa.array(k), b["doc_id"], pa.array(map(len, raw), pa.int64()), pa.array([codec.compress(t, asbytes=True) for t in raw], pa.binary())], names=["bucket", "k", "doc_id", "bytes", "packed"])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b["k"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, k, "right"), pa.int64()), b["k"]], names=["bucket", "k"])

    first = ids.mapInArrow(heads, "bucket long, k long").groupBy("bucket").agg(F.min("k").alias("k")).orderBy("bucket").collect()  # a row for each bucket
    host = {r["k"]: first[i - 1]["bucket"] for i, r in enumerate(first)}
    guests = F.broadcast(spark.createDataFrame(list(host.items()), "k long, host long"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(spread, "bucket long, k long, doc_id long, bytes long, packed binary")
    places = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest")))
    both = F.when(F.col("host").isNull(), places).otherwise(F.concat(places, F.array(F.struct(F.col("host").alias("bucket"), F.lit(True).alias("guest")))))
    out = rows.join(guests, "k", "left").select(F.explode(both).alias("at"), "k", "doc_id", "bytes", "packed").select("at.*", "k", "doc_id", "bytes", "packed")
    return out.repartition("bucket").sortWithinPartitions("bucket", "guest", "k", "packed")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd", 1)
    names = [x.split()[0] for x in _OUT.split(", ")]
    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]

    def step(pairs: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        own = [p[1].encode() for p in pairs]
        edited = [(t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode() for _, t, n in pairs]
        sets, changed, following = digest_sets(own), digest_sets(edited), digest_sets([p[2].encode() for p in pairs])
        cols = [[p[0] for p in pairs], [len(p[1]) for p in pairs], [hashlib.sha256(e).hexdigest() for e in edited], as_hex(sets), as_hex(changed), containment(sets, changed), containment(sets, following)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    pairs, size = [], 0
    last: tuple[int, int | None, str] | None = None  # the bucket, id and text of a row that waits for the next one
    for b in batches:
        for bucket, guest, doc_id, length, packed in zip(b["bucket"].to_pylist(), b["guest"].to_pylist(), b["doc_id"].to_pylist(), b["bytes"].to_pylist(), b["packed"], strict=True):
            text = codec.decompress(packed.as_buffer(), length).to_pybytes().decode() if length else ""
            if last is not None and last[0] == bucket:
                pairs.append((last[1], last[2], text))
                size += len(last[2]) + len(text)
            last = None if guest else (bucket, doc_id, text)
            if size >= STEP_BYTES or len(pairs) >= 60_000:
                yield step(pairs)
                pairs, size = [], 0
    if pairs:
        yield step(pairs)


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return with_next(load(spark, sf_dir, "documents"), buckets).mapInArrow(_compare, _OUT)
