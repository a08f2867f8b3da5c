"""Exact similarity self-join of documents on the Jaccard coefficient of their 5-word shingles, with its components.

Method: the universe of shingles is hashed into segments. Two sets of s <= l elements link when their symmetric difference
has at most (s + l) / 9 elements (Jaccard 0.8), hence l <= 5 s / 4. Sizes are cut into bands [2^b, 2^(b+1)); a
pair is looked for under the scheme of its smaller set's band, so a set takes part in its own band's scheme and, if
a partner of its can be that small, in the scheme below. With H the largest possible difference of a
set X in a scheme, cost-based allocation gives each band one of two indexes:

* subsets: m > H segments; at least m - H of them are equal in both sets. Signatures (segment, hash of the subset) are
  put in one global order, largest subsets first, and X is indexed under its H + 1 first ones. Two
  lists of m signatures that share m - H have one in common among their first H + 1.
* subsets and one-deletion neighbourhoods: segments with weight 2 (a difference of at most 1 is found: a subset
  or a subset less one element of one set equals a subset of the other) and, if H is even, one of weight 1; the
  weights sum to H + 1, so one segment differs by less than its weight. Segments that say nothing (empty ones; of weight 2,
  those of fewer than two elements) are not indexed, unless the rest of X's weights would sum to less than H + 1.
  A pair with one set whose rest suffices is found through that rest; two sets whose rests don't, index all.

The second index takes about five times as many signatures of twice as many elements each. The cost of a band is its signatures
plus the candidate pairs expected from the share of its shingles that are frequent, as those of passages are; both are measured over the
whole table and the cheaper index is taken. Deletions pay once chance meetings in segments of frequent shingles outweigh their signatures,
which grows with the square of a table's sets.

Equal sets form a class beforehand. Sets under one signature form a run; equal runs count once. In a run, pairs are
cleared by a sketch (parities of hash bins, which never differ in more bits than the sets in elements) before any set is looked at. First each set
is paired with the nearest of its run's pivots by sketch. Pivots are the sets with the smallest keys: that order is the same in every run, so the many runs of a family name the
same pivots, and a family of near copies gives a number of pairs linear in its size. They are verified on the whole sets, and links give components. Then runs that still hold
several components give all pairs across components that the sketch can't clear, in blocks of BLOCK sets; these are verified too, and no link between components is lost.
Links are then counted inside the components, exactly: where all pairs of a component are verified links, from these; else its sets
are brought together in blocks of at most about BLOCK sets and ELEMENTS shingles, and postings of shingles give what each two have in common.

Links are exact up to 64-bit hashes of shingles. A class goes by a 64-bit key; different sets with one key are told apart by a second
digest and get keys of their own. Defined cases: null or wordless text has an empty set and links with nothing;
null ids take part but are never the smallest id (a component of null ids only has a null component_id); rows that repeat an id
are linked as any other rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, bounded, drop_dir, load, maybe_rows, mix, saved, slices, sole_memo, text_bytes, with_fields, without, work_dir
from .components import components
from .exact_dedup import PLACE, located
from .shingles import Sketches, by_set, forget, keys, shingle_sets, sketches

#: Bands of sizes up to 2^BANDS.
BANDS = 40
#: Sets of a run that are compared in one block.
BLOCK = 4096
#: Shingles of a component's sets that are counted in one block.
ELEMENTS = 1 << 19
#: Pivots of a run in the first step.
PIVOTS = 16
#: Partners of one pivot that are verified in one group.
FAN = 2000
#: Equal signatures in one chunk of a task from which on they bypass the bucket as rows of their own.
HOT = 256
#: Bytes of text that one numpy step works on.
STEP_BYTES = 2 << 20
#: Signatures that a task gathers before it hands them out.
CHUNK = 1_000_000
#: Signatures that meet in one task, about, and buckets that it takes.
MEETING, TASK_BUCKETS = 2_000_000, 4
#: One in so many shingles is counted over the whole table to measure how many are shared.
PROBE = 1024
#: A shingle is frequent if at least this share of all sets has it: a passage of the whole corpus, not of a family of copies.
FREQUENT = 1 / 1000
#: Costs of a signature and of a candidate pair, in the same unit.
SIGNATURE_COST, PAIR_COST = 1.0, 0.2

_K1, _K2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
DESCRIBED = "key long, check long, n long, sketch binary, probe array<long>"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Names:
    """Keys of sets. ``moved`` names those sets, by key and check, whose key another set has too; ``bits`` is weakened by tests to force that."""

    def __init__(self, bits: int = 64, moved: dict[tuple[int, int], int] | None = None):
        self.mask, self.moved = U(2**bits - 1), moved or {}

    def of(self, sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key, check = keys(sets, at)
        key &= self.mask
        if self.moved:
            both = zip(key.tolist(), check.tolist(), strict=True)
            key = np.array([self.moved.get(x, x[0]) for x in both], U)
        return key, check

    def apart(self, shared: list[tuple[int, int]]) -> Names:
        """``shared``: (key, check) of all sets whose key isn't theirs alone. The first of each key keeps it; the others go by their check."""
        first: dict[int, int] = {}
        for key, check in sorted(shared):
            first.setdefault(key, check)
        return Names(int(self.mask).bit_length(), {(k, c): int(mix(np.array([c], U) + U(len(shared)))[0]) for k, c in shared if first[k] != c})


def _describe(names: Names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document: digests of its set, size, sketch, and the probe shingles."""
        sole_memo("shingles", forget)
        for b in batches:
            texts = text_bytes(b["text"])
            for lo, hi in slices(np.fromiter(map(len, texts), np.int64, len(texts)), STEP_BYTES):
                sets, at = shingle_sets(texts[lo:hi])
                n = np.diff(at)
                key, check = names.of(sets, at)
                probe = sets % U(PROBE) == 0
                probe_at = np.concatenate([[0], np.cumsum(probe)])[at].astype(np.int32)
                sk = sketches(sets, at)
                rest = [c for c in b.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(b[c].slice(lo, hi - lo) for c in rest), pa.array(_signed(key), mask=n == 0), pa.array(_signed(check)), pa.array(n), pa.array(sk, pa.binary()), pa.ListArray.from_arrays(pa.array(probe_at), pa.array(_signed(sets[probe])))],
                    names=[*rest, "key", "check", "n", "sketch", "probe"],
                )

    return run


# -- allocation ------------------------------------------------------------------------------------------------


def most_different(band: int) -> int:
    """The largest symmetric difference of a linked pair whose smaller set is in the band."""
    return (2 ** (band + 1) - 1) // 4


def allocate(bands: dict[int, tuple[int, float, float]]) -> dict[int, tuple[int, int]]:
    """{band: (segments, of them with weight 2)}; weight 2 nowhere means subsets only. ``bands``: sets, mean size and share of frequent shingles of each."""
    plan = {}
    for band, (sets, size, shared) in bands.items():
        h = most_different(band)
        m = h + 1 + (h + 1) // 4
        twos = (h + 1) // 2
        two = twos + (h + 1) % 2

        def cost(signatures: float, elements: float, segments: int) -> float:
            # a pair of sets meets by chance in a segment whose elements are all frequent ones
            return SIGNATURE_COST * sets * signatures + PAIR_COST * segments * (sets * shared ** max(elements, 1)) ** 2 / 2

        subsets, deletions = cost(h + 1, size / m, m), cost(size + two, size / two, two)
        plan[band] = (m, 0) if subsets <= deletions or not twos else (two, twos)
    return plan


def signatures(sets: np.ndarray, at: np.ndarray, plan: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of its set) of many sets. The lowest bit of a signature is 0."""
    n = np.diff(at)
    band = np.where(n > 0, np.frexp(n.astype(np.float64))[1] - 1, -1)
    lower = (band > 0) & (4 * n <= 5 * (2 ** np.maximum(band, 0) - 1))
    who = np.concatenate([np.flatnonzero(n > 0), np.flatnonzero(lower)])
    scheme = np.concatenate([band[n > 0], band[lower] - 1])
    h = np.concatenate([((n + 5 * n // 4) // 9)[n > 0], ((n + 2 ** np.maximum(band, 0) - 1) // 9)[lower]])
    known = np.array([b in plan for b in scheme.tolist()], bool)  # a scheme without a set of its own band can't have a pair
    who, scheme, h = who[known], scheme[known], h[known]
    if not len(who):
        return np.zeros(0, U), np.zeros(0, np.int64)
    m = np.array([plan[b][0] for b in scheme.tolist()])
    twos = np.array([plan[b][1] for b in scheme.tolist()])
    salt = mix(scheme.astype(U) + U(77))
    # elements of every (set, scheme), its segment, and sums of the elements' hashes by segment
    size = n[who]
    owner = np.repeat(np.arange(len(who)), size)
    el = sets[np.arange(len(owner)) + np.repeat(at[who] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)]
    base = np.concatenate([[0], np.cumsum(m)])
    seg = base[owner] + (((mix(el ^ salt[owner]) >> U(32)) * m[owner].astype(U)) >> U(32)).astype(np.int64)
    g = mix(el + U(0xABCDEF))
    lo, hi = (g & U(0xFFFFFFFF)), g >> U(32)
    total = int(base[-1])
    lows = np.bincount(seg, lo.astype(np.float64), total).astype(U)
    highs = np.bincount(seg, hi.astype(np.float64), total).astype(U)
    count = np.bincount(seg, minlength=total)
    pair = np.repeat(np.arange(len(who)), m)
    index = np.arange(total) - base[pair]
    place = mix(index.astype(U) ^ salt[pair])
    sig = mix(lows * _K1 + highs * _K2 + place) & ~U(1)

    plain = twos[pair] == 0
    out_sig, out_who = [], []
    # subsets: the H + 1 first signatures, largest subsets first
    own = np.flatnonzero(plain)
    if len(own):
        order = own[np.lexsort((sig[own], -count[own], pair[own]))]
        first = np.concatenate([[True], pair[order][1:] != pair[order][:-1]])
        start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        take = order[np.arange(len(order)) - start <= h[pair[order]]]
        out_sig.append(sig[take])
        out_who.append(who[pair[take]])
    # subsets and one-deletion neighbourhoods
    own = np.flatnonzero(~plain)
    if len(own):
        weight = np.where(index < twos[pair], 2, 1)
        tells = count >= weight
        rest = np.bincount(pair[own], (weight * tells)[own], len(who))
        used = ~plain & (tells | (rest < h + 1)[pair])
        out_sig.append(sig[used])
        out_who.append(who[pair[used]])
        less = used[seg] & (weight[seg] == 2)
        s = seg[less]
        out_sig.append(mix((lows[s] - lo[less]) * _K1 + (highs[s] - hi[less]) * _K2 + place[s]) & ~U(1))
        out_who.append(who[owner[less]])
    return np.concatenate(out_sig), np.concatenate(out_who)


# -- runs of sets under one signature --------------------------------------------------------------------------


def _runs_of(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of runs of equal values in a sorted array."""
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    return start, np.diff(np.concatenate([start, [len(sig)]]))


def _expand(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))


#: Bytes of a signature within its bucket. Equal ones stay equal; unequal ones that become so only make runs longer.
SHORT = 5


def _emitter(plan: dict[int, tuple[int, int]], buckets: int, names: Names):
    """Signatures of a task's sets, handed out by bucket as packed arrays (p >= 0); those that are frequent within a chunk go as rows of their own (p < 0), and one flagged signature to the bucket."""

    def flush(sig: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(sig)
        sig, key = sig[order], key[order]
        start, length = _runs_of(sig)
        hot = length >= HOT
        if hot.any():
            rows = _expand(start[hot], length[hot])
            for i in range(0, len(rows), 1 << 18):
                r = rows[i : i + (1 << 18)]
                yield _packed([-1 - int(sig[r[0]] >> U(1)) % buckets], [_cut_off(sig[r])], [key[r]])
            flagged = start[hot]
            cold = np.ones(len(sig), bool)
            cold[rows] = False
            sig, key = np.concatenate([sig[cold], sig[flagged] | U(1)]), np.concatenate([key[cold], key[flagged]])
        p = ((sig >> U(1)) % U(buckets)).astype(np.uint16 if buckets < 65536 else np.int64)
        order = np.argsort(p, kind="stable")
        sig, key, p = sig[order], key[order], p[order]
        start, length = _runs_of(p)
        for i in range(0, len(start), 64):  # a few MB a batch
            part = list(zip(start[i : i + 64].tolist(), length[i : i + 64].tolist(), strict=True))
            yield _packed([int(p[s]) for s, _ in part], [_cut_off(sig[s : s + n]) for s, n in part], [key[s : s + n] for s, n in part])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memo("shingles", forget)
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            texts = text_bytes(b["text"])
            for lo, hi in slices(np.fromiter(map(len, texts), np.int64, len(texts)), STEP_BYTES):
                sets, at = shingle_sets(texts[lo:hi])
                key, _ = names.of(sets, at)
                new = np.zeros(len(key), bool)
                for i, k in enumerate(key.tolist()):
                    if k not in seen:
                        seen.add(k)
                        new[i] = True
                n = np.diff(at) * new
                sets = sets[np.repeat(new, np.diff(at))]
                sig, who = signatures(sets, np.concatenate([[0], np.cumsum(n)]), plan)
                held.append((sig, key[who]))
                size += len(sig)
                if size >= CHUNK:
                    yield from flush(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if size:
            yield from flush(*map(np.concatenate, zip(*held, strict=True)))

    return emit


_PACKED = "p long, sigs binary, keys binary"


def _cut_off(sig: np.ndarray) -> np.ndarray:
    """The lowest SHORT bytes of signatures, with the flag."""
    return np.ascontiguousarray(sig).view(np.uint8).reshape(-1, 8)[:, :SHORT]


def _filled_up(raw: bytes, bucket: int) -> np.ndarray:
    """Signatures of a bucket, told apart from those of other buckets."""
    wide = np.zeros((len(raw) // SHORT, 8), np.uint8)
    wide[:, :SHORT] = np.frombuffer(raw, np.uint8).reshape(-1, SHORT)
    return wide.view(U)[:, 0] + (U(bucket) << U(8 * SHORT))


def _packed(p: list[int], sigs: list[np.ndarray], keys: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array([x.tobytes() for x in sigs], pa.binary()), pa.array([x.tobytes() for x in keys], pa.binary())], names=["p", "sigs", "keys"])


def _members(run: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(_signed(run)), pa.array(_signed(key))], names=["run", "key"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed signatures of some buckets to (run, key) rows of all runs of several sets."""
    sole_memo("runs", lambda: None)
    sigs, ks = [], []
    for b in batches:
        for p, s, k in zip(b["p"].to_pylist(), b["sigs"].to_pylist(), b["keys"].to_pylist(), strict=True):
            s, k = _filled_up(s, p if p >= 0 else -1 - p), np.frombuffer(k, U)
            if p < 0:
                yield _members(s, k)
            else:
                sigs.append(s)
                ks.append(k)
    if not sigs:
        return
    sig, key = np.concatenate(sigs), np.concatenate(ks)
    sigs.clear()
    ks.clear()
    order = np.argsort(sig >> U(1), kind="stable")
    _, length = _runs_of((sig >> U(1))[order])
    order = order[np.repeat(length > 1, length) | (sig[order] & U(1) == 1)]
    sig, key = sig[order], key[order]
    order = np.lexsort((key, sig >> U(1)))
    sig, key = sig[order], key[order]
    flag, sig = sig & U(1), sig & ~U(1)
    start, length = _runs_of(sig)
    if not len(start):
        return
    big = np.maximum.reduceat(flag, start) == 1
    rows = _expand(start[big], length[big])
    if len(rows):
        yield _members(sig[rows], key[rows])
    # equal runs count once: a run is named by its distinct keys
    fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])]) & ~np.repeat(big, length)
    sig, key = sig[fresh], key[fresh]
    start, length = _runs_of(sig)
    several = length > 1
    start, length = start[several], length[several]
    if not len(start):
        return
    rows = _expand(start, length)
    key = key[rows]
    at = np.concatenate([[0], np.cumsum(length)])
    name = mix(by_set(mix(key), at) + length.astype(U))
    _, one = np.unique(name, return_index=True)
    yield _members(np.repeat(name[one], length[one]), key[_expand(at[:-1][one], length[one])])


def _grouped(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole groups, which stand together, with (start, length) of each group."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table, last: bool):
        cols = [table[c].to_numpy() for c in by]
        new = np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in cols])])
        start = np.flatnonzero(new)
        end = len(cols[0]) if last else int(start[-1])
        start = start if last else start[:-1]
        return table.slice(0, end), start, np.diff(np.concatenate([start, [end]])), table.slice(end)

    size = 0
    for b in batches:
        held.append(b)
        size += len(b)
        if size >= 100_000:
            done, start, length, rest = cut(pa.Table.from_batches(held), False)
            if len(start):
                yield done, start, length
            held, size = rest.to_batches(), 0
    if sum(map(len, held)):
        done, start, length, _ = cut(pa.Table.from_batches(held), True)
        yield done, start, length


def _uncleared(sk: Sketches, n: np.ndarray, left: np.ndarray, right: np.ndarray, allowed) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of left and right that may link: of sizes near enough, allowed, and whose sketches differ in few enough bits, first a quarter of them."""
    left, right = left[np.argsort(n[left], kind="stable")], right[np.argsort(n[right], kind="stable")]
    sizes, quarter = n[right], sk.quarter
    for s in range(0, len(left), 64):
        some = left[s : s + 64]
        first, last = np.searchsorted(sizes, -(-4 * n[some[0]] // 5)), np.searchsorted(sizes, 5 * n[some[-1]] // 4, "right")
        for r in range(first, last, 2048):
            other = right[r : min(r + 2048, last)]
            p, q = some[:, None], other[None, :]
            ok = (4 * np.maximum(n[p], n[q]) <= 5 * np.minimum(n[p], n[q])) & allowed(p, q)
            if ok.any():
                ok &= 9 * np.bitwise_count(quarter[some][:, None, :] ^ quarter[other][None, :, :]).sum(2, dtype=np.int64) <= n[p] + n[q]
                i, j = np.nonzero(ok)
                x, y = some[i], other[j]
                close = 9 * sk.differ(x, y) <= n[x] + n[y]
                yield x[close], y[close]


_PAIRS = "a long, b long"


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    a, b = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (a, b))
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set of a run with that one of the run's pivots before it whose sketch is nearest, if it doesn't clear the pair. Pivots are the sets with the smallest keys; rows come in order of their keys."""
    for table, starts, lengths in _grouped(batches, ["run", "block"]):
        key, n, sk = table["key"].to_numpy(), table["n"].to_numpy(), Sketches(table["sketch"].to_pylist())
        a, b = [], []
        # rows after the first of their runs, and how far back the pivots stand
        start, place = np.repeat(starts, lengths), _expand(np.zeros_like(lengths), lengths)
        for lo in range(0, len(place), 1 << 14):
            rows = np.arange(lo, min(lo + (1 << 14), len(place)))
            hi = lo + len(rows)
            best, near = np.full(hi - lo, np.iinfo(np.int64).max), np.full(hi - lo, -1)
            for k in range(PIVOTS):
                who = np.flatnonzero(place[lo:hi] > k)
                x, y = start[lo:hi][who] + k, rows[who]
                ok = 4 * np.maximum(n[x], n[y]) <= 5 * np.minimum(n[x], n[y])
                who, x, y = who[ok], x[ok], y[ok]
                differ = sk.differ(x, y)
                better = (9 * differ <= n[x] + n[y]) & (differ < best[who])
                best[who[better]], near[who[better]] = differ[better], x[better]
            a.append(key[near[near >= 0]])
            b.append(key[rows[near >= 0]])
        yield _pairs(a, b)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of a block whose sets are in different components and that the sketch can't clear."""
    for table, starts, lengths in _grouped(batches, ["run", "i", "j"]):
        key, n, sk, label = table["key"].to_numpy(), table["n"].to_numpy(), Sketches(table["sketch"].to_pylist()), table["label"].to_numpy()
        block, i_, j_ = (table[c].to_numpy() for c in ("block", "i", "j"))
        a, b = [], []
        for s, length in zip(starts.tolist(), lengths.tolist(), strict=True):
            rows = np.arange(s, s + length)
            within = i_[s] == j_[s]
            left, right = (rows, rows) if within else (rows[block[rows] == i_[s]], rows[block[rows] == j_[s]])
            for x, y in _uncleared(sk, n, left, right, lambda p, q, within=within: (label[p] != label[q]) & ((key[p] < key[q]) | (not within))):
                a.append(key[x])
                b.append(key[y])
        yield _pairs(a, b)


# -- verification ----------------------------------------------------------------------------------------------


def _keyed(names: Names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts by key, compressed for the shuffle."""
        sole_memo("shingles", forget)
        codec = pa.Codec("zstd", 1)
        for b in batches:
            texts = text_bytes(b["text"])
            for lo, hi in slices(np.fromiter(map(len, texts), np.int64, len(texts)), STEP_BYTES):
                key, _ = names.of(*shingle_sets(texts[lo:hi]))
                yield pa.RecordBatch.from_arrays([pa.array(_signed(key)), b["doc_id"].slice(lo, hi - lo), pa.array(map(len, texts[lo:hi]), pa.int64()), pa.array([codec.compress(t, asbytes=True) for t in texts[lo:hi]], pa.binary())], names=["key", "found", "bytes", "packed"])

    return run


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, shingles, offsets) of some rows at a time."""
    codec = pa.Codec("zstd", 1)
    size, packed = batch["bytes"].to_numpy(), batch["packed"]
    for lo, hi in slices(size, STEP_BYTES):
        yield lo, hi, *shingle_sets([codec.decompress(packed[k].as_buffer(), int(size[k]), asbytes=True) for k in range(lo, hi)])


def texts_of(docs: DataFrame, wanted: DataFrame, names: Names) -> DataFrame:
    """Rows of ``wanted`` (with key and rep) with the text of the class's representative, compressed."""
    found = maybe_rows(docs, ["doc_id"], wanted.select(F.col("rep").alias("doc_id"))).select("doc_id", "text").mapInArrow(_keyed(names), "key long, found long, bytes long, packed binary")
    return found.join(wanted, (found["key"] == wanted["key"]) & found["found"].eqNullSafe(wanted["rep"])).drop(found["key"]).drop("found", "rep")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a pivot's group, its own set first: pairs of the pivot and each other set that link."""
    sole_memo("shingles", forget)
    group, pivot = None, np.zeros(0, U)
    for batch in batches:
        a, b = [], []
        at, salt, first, key = (batch[c].to_pylist() for c in ("a", "salt", "pivot", "key"))
        for lo, hi, sets, place in _unpacked(batch):
            for k in range(lo, hi):
                elements = sets[place[k - lo] : place[k - lo + 1]]
                if first[k]:
                    group, pivot = (at[k], salt[k]), elements.copy()
                elif group == (at[k], salt[k]):
                    both = np.concatenate([pivot, elements])
                    both.sort(kind="stable")  # merges two sorted runs
                    common = int((both[1:] == both[:-1]).sum())
                    if 100 * common >= 80 * (len(both) - common):
                        a.append(at[k])
                        b.append(key[k])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, base: str, names: Names) -> DataFrame:
    """Pairs of keys whose sets link. Texts are read again and go to the groups of their pivots; a pivot with many partners has several groups."""
    groups = F.ceil(F.col("c") / FAN)
    salted = pairs.join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")), "a").withColumn("salt", F.pmod(F.xxhash64("b"), groups))
    pivots = salted.select(F.col("a").alias("key"), "a", "salt", F.lit(True).alias("pivot")).distinct()
    places = salted.select(F.col("b").alias("key"), "a", "salt", F.lit(False).alias("pivot")).union(pivots)
    places = saved(places.join(classes.select("key", "rep"), "key"), f"{base}/places")
    rows = texts_of(docs, places, names).repartition("a", "salt").sortWithinPartitions("a", "salt", F.desc("pivot"))
    links = saved(rows.select("a", "salt", "pivot", "key", "bytes", "packed").mapInArrow(_verify, _PAIRS).distinct(), f"{base}/links")
    drop_dir(docs.sparkSession, f"{base}/places")
    return links


# -- number of links -------------------------------------------------------------------------------------------


def _linked(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Of each set of left, which sets of right link with it."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in left])])
    size = np.array([len(x) for x in right])
    elements = np.concatenate(right)
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], np.repeat(np.arange(len(right)), size)[order]
    start, length = _runs_of(elements)
    known = elements[start]
    wanted = np.concatenate(left)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    hit = known[at] == wanted
    for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        own = at[lo:hi][hit[lo:hi]]
        common = np.bincount(owner[_expand(start[own], length[own])], minlength=len(right))
        yield np.flatnonzero(100 * common >= 80 * (hi - lo + size - common))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two blocks of a component, by key: documents that each set links with in the other block (or in its own, if both are the same), its own copies left out."""
    sole_memo("shingles", forget)
    group, held = None, []

    def count() -> pa.RecordBatch:
        key, block, copies, sets = zip(*held, strict=True) if held else [()] * 4
        total, weight = np.zeros(len(key), np.int64), np.array(copies, np.int64)
        if held:
            _, i, j = group
            left, right = (np.flatnonzero(np.array(block) == x) for x in (i, j))
            if len(left) and len(right):
                for x, near in zip(left, _linked([sets[x] for x in left], [sets[x] for x in right]), strict=True):
                    near = right[near]
                    total[x] += weight[near[near != x]].sum()
                    if i != j:
                        total[near] += weight[x]
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(total)], names=["key", "links"])

    for b in batches:
        done = []
        label, i, j, block, key, copies = (b[c].to_pylist() for c in ("label", "i", "j", "block", "key", "copies"))
        for lo, hi, sets, at in _unpacked(b):
            for k in range(lo, hi):
                if group != (own := (label[k], i[k], j[k])):
                    done.append(count())
                    group, held = own, []
                if not held or held[-1][0] != key[k]:  # a class may be read from several rows
                    held.append((key[k], block[k], copies[k], sets[at[k - lo] : at[k - lo + 1]].copy()))
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0] if sum(map(len, done)) else done[0]
    yield count()


def link_counts(links: DataFrame, labels: DataFrame, docs: DataFrame, classes: DataFrame, base: str, names: Names) -> DataFrame:
    """(key, links): with how many documents of other classes a class links. ``labels`` are the components of ``links``."""
    members = labels.join(classes.select("key", "rep", "n", "copies"), "key")
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("elements"))
    known = links.join(labels.select(F.col("key").alias("a"), "label"), "a").groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    blocks = F.ceil(F.greatest(F.col("k") / BLOCK, F.col("elements") / ELEMENTS)).alias("blocks")
    shapes = sizes.join(known, "label").select("label", (2 * F.col("c") == F.col("k") * (F.col("k") - 1)).alias("whole"), blocks)
    members = saved(members.join(shapes, "label").drop("n").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks"))), f"{base}/parts")

    both = links.select(F.col("a").alias("key"), F.col("b").alias("other")).union(links.select("b", "a"))
    direct = both.join(members.filter("whole").select(F.col("key").alias("other"), "copies"), "other").select("key", F.col("copies").alias("links"))

    part = members.filter("NOT whole")
    grid = part.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    rows = texts_of(docs, grid.select("key", "rep", "label", "i", "j", "block", "copies"), names).repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "key")
    tallied = rows.select("label", "i", "j", "block", "key", "copies", "bytes", "packed").mapInArrow(_tally, "key long, links long")
    return saved(tallied.union(direct).groupBy("key").agg(F.sum("links").alias("links")), f"{base}/counts")


# -- the operator ----------------------------------------------------------------------------------------------


def _classes(described: DataFrame) -> DataFrame:
    of = (F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.min("check").alias("c0"), F.max("check").alias("c1"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"))
    return described.filter("key IS NOT NULL").groupBy("key").agg(*of)


def _meeting(docs: DataFrame, plan: dict[int, tuple[int, int]], names: Names, signatures: float, base: str) -> DataFrame:
    """(run, key, block, blocks): sets that have a signature in common. There are as many buckets as the signatures need."""
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(signatures / MEETING))
    packed = docs.select("text").mapInArrow(_emitter(plan, tasks * TASK_BUCKETS, names), _PACKED)
    met = packed.repartition(tasks, "p").mapInArrow(_meet, "run long, key long")
    runs = saved(met.distinct(), f"{base}/runs")
    runs = runs.join(runs.groupBy("run").agg(F.count(F.lit(1)).alias("k")), "run").filter("k > 1")
    runs = saved(runs.withColumn("blocks", F.ceil(F.col("k") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks"))).drop("k"), f"{base}/members")
    drop_dir(docs.sparkSession, f"{base}/runs")
    return runs


def jaccard_components(docs: DataFrame, plan: dict[int, tuple[int, int]] | None = None, carried: tuple[str, ...] = (), counted: bool = True, key_bits: int = 64) -> DataFrame:
    """(doc_id, text) to doc_id, n_shingles, component_id, group, links. ``group`` names the component, null for an empty set; ``links`` is the
    number of other documents that the document links with, which is left out if not ``counted``. Columns in ``carried`` stay. ``plan`` overrides the allocation and ``key_bits`` the length of keys, for tests.
    """
    spark = docs.sparkSession
    base = work_dir(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carried, F.col("text").cast("string").alias("text"))
    names = Names(key_bits)
    described = saved(docs.mapInArrow(_describe(names), with_fields(docs.drop("text"), DESCRIBED)), f"{base}/described")
    classes = saved(_classes(described), f"{base}/classes")
    if (clash := classes.filter("c0 <> c1").select("key")).limit(1).count():
        # different sets with one 64-bit key: three expected among 10^10 sets
        unsigned = [(r["key"] % 2**64, r["check"] % 2**64) for r in described.join(F.broadcast(clash), "key").select("key", "check").distinct().collect()]
        names = names.apart(unsigned)
        described = saved(docs.mapInArrow(_describe(names), with_fields(docs.drop("text"), DESCRIBED)), f"{base}/described-again")
        classes = saved(_classes(described), f"{base}/classes-again")
        if classes.filter("c0 <> c1").limit(1).count():
            raise ArithmeticError("two different shingle sets have both digests in common")
    measured = _measure(described, classes)
    if plan is None:
        plan = allocate(measured)
    runs = _meeting(docs, plan, names, signature_count(described, plan), base)
    shapes = classes.select("key", "n", "sketch")

    # a run in several blocks has its smallest key in each, so that one pivot serves all
    least = runs.filter("blocks > 1").groupBy("run").agg(F.min("key").alias("key"), F.first("blocks").alias("blocks"))
    guests = least.select("run", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    dealt = runs.select("run", "key", "block").union(guests).distinct()
    stars = dealt.join(shapes, "key").repartition("run", "block").sortWithinPartitions("run", "block", "key").select("run", "block", "key", "n", "sketch").mapInArrow(_pivots, _PAIRS)
    first = verified(saved(stars.distinct(), f"{base}/stars"), docs, classes, f"{base}/first", names)
    labels = components(first, f"{base}/first/components").select(F.col("node").alias("key"), "label")

    # sketches join last, so that only one exchange carries them
    labelled = runs.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    mixed = labelled.groupBy("run").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1").select("run")
    open_ = saved(labelled.join(mixed, "run", "left_semi"), f"{base}/open")
    drop_dir(spark, f"{base}/members", f"{base}/stars")
    grid = open_.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")
    across = grid.join(shapes, "key").repartition("run", "i", "j").sortWithinPartitions("run", "i", "j", "key").select("run", "i", "j", "block", "key", "n", "sketch", "label").mapInArrow(_across, _PAIRS)
    second = verified(saved(across.distinct(), f"{base}/across"), docs, classes, f"{base}/second", names)
    links = first.union(second).distinct()
    labels = components(links, f"{base}/second/components").select(F.col("node").alias("key"), "label")

    ends = link_counts(links, labels, docs, classes, base, names) if counted else None
    named = classes.select("key", "rep").join(labels, "key")
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    place = named.join(smallest, "label").select("key", "label", "component_id")
    number = []
    if counted:
        place, number = place.join(ends, "key", "left"), [(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")]
    place = saved(place, f"{base}/place")
    drop_dir(spark, *(f"{base}/{x}" for x in ("open", "across", "first", "second", "parts", "counts")))
    by_class = classes.select("key", "rep", "copies").join(place, "key", "left").select("key", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("label", "key").alias("group"), *number)
    result = described.select("doc_id", *carried, "n", "key").join(by_class, "key", "left")
    return result.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "group", *([F.coalesce("links", F.lit(0).cast("long")).alias("links")] if counted else []), *carried)


def signature_count(described: DataFrame, plan: dict[int, tuple[int, int]]) -> float:
    """Signatures of all rows under the plan, at most about: each set in its own scheme and in the one below."""
    band = F.floor(F.log2(F.col("n") + 0.5)).cast("int").alias("band")
    of_band = described.filter("n > 0").groupBy(band).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("elements")).collect()  # at most BANDS rows
    return sum(2 * (r["rows"] + (r["elements"] + r["rows"] if plan.get(r["band"], (0, 0))[1] else r["elements"] / 4)) for r in of_band)


def _measure(described: DataFrame, classes: DataFrame) -> dict[int, tuple[int, float, float]]:
    """{band: (sets, mean size, share of frequent shingles)}, at most BANDS rows."""
    band = F.floor(F.log2(F.col("n") + 0.5)).cast("int").alias("band")
    sizes = {r["band"]: r for r in classes.groupBy(band).agg(F.count(F.lit(1)).alias("sets"), F.avg("n").alias("size")).collect()}
    often = max(2, FREQUENT * sum(r["sets"] for r in sizes.values()))
    probe = described.filter("key IS NOT NULL").groupBy("key").agg(F.first("n").alias("n"), F.first("probe").alias("probe")).select(band, F.explode("probe").alias("h"))
    by = probe.groupBy("h", "band").agg(F.count(F.lit(1)).alias("c"))
    df = by.groupBy("h").agg(F.sum("c").alias("df"))
    shared = {r["band"]: r["s"] for r in by.join(df, "h").groupBy("band").agg((F.sum(F.when(F.col("df") >= often, F.col("c")).otherwise(0)) / F.sum("c")).alias("s")).collect()}
    return {b: (r["sets"], r["size"], shared.get(b, 0.0)) for b, r in sizes.items()}


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents")).drop("group")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays (of rows with one id the first by place); columns unchanged. ``docs`` is read from files."""
    bounded(spark)
    base = work_dir(spark, "near-stage")
    placed = located(docs)
    found = saved(jaccard_components(placed.select("doc_id", "text", *PLACE), carried=tuple(PLACE), counted=False), f"{base}/components").filter("`group` IS NOT NULL")
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *PLACE)).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    dropped = found.join(first, "group").filter(F.struct(*PLACE) != F.struct(*(F.col(f"first.{c}") for c in PLACE))).select(*PLACE)
    dropped = saved(dropped, f"{base}/dropped")
    drop_dir(spark, f"{base}/components")
    return without(placed, PLACE, dropped).select(*docs.columns)
