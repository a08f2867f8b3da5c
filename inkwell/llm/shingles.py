"""Sets of hashed 5-word shingles, built for whole slices of a table in numpy."""

from __future__ import annotations

from hashlib import blake2b
from itertools import chain

import numpy as np

from .common import LOWER, Memo, U, mix

WORDS = 5
#: Fixed odd multipliers, one for each place in a shingle; drawn once from a seeded generator.
_PLACES = np.random.default_rng(20).integers(1, 2**63, WORDS, dtype=np.uint64) * U(2) + U(1)
_SHORT = U(0x5851F42D4C957F2D)
#: Bits of a sketch, and those of sets with at least LONG elements.
BITS, FINE, LONG = 1024, 4096, 1024


def _word(w: bytes) -> int:
    return int.from_bytes(blake2b(w, digest_size=8).digest(), "little")


_words = Memo(_word, 250_000)


def forget() -> None:
    _words.clear()


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 64-bit shingle hashes of each text, one after another; offsets).

    Words are runs of other bytes than ``\\x20 \\x09-\\x0D`` after lowering A-Z; a text of fewer than 5 words has its
    whole sequence as one shingle, a text without words none.
    """
    split = [t.translate(LOWER).split() for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    total = int(n.sum())
    w = np.fromiter(map(_words.__getitem__, chain.from_iterable(split)), U, total)
    ends = np.cumsum(n)
    if total >= WORDS:
        h = np.zeros(total - WORDS + 1, U)
        for k in range(WORDS):
            h += w[k : k + len(h)] * _PLACES[k]
        at = np.arange(len(h))
        whole = at + WORDS <= np.repeat(ends, n)[: len(h)]
        h = mix(h[whole])
    else:
        h = np.zeros(0, U)
    count = np.maximum(n - WORDS + 1, 0)
    short = np.flatnonzero((n > 0) & (n < WORDS))
    if len(short):
        starts = ends - n
        own = np.array([(w[starts[i] : ends[i]] * _PLACES[: n[i]]).sum(dtype=U) for i in short], U) + _SHORT * n[short].astype(U)
        h = np.insert(h, np.cumsum(count)[short], mix(own))
        count[short] = 1
    offsets = np.concatenate([[0], np.cumsum(count)])
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        h[a:b].sort()
    if len(h):
        new = np.concatenate([[True], h[1:] != h[:-1]])
        new[offsets[:-1][count > 0]] = True
        kept = np.concatenate([[0], np.cumsum(new)])
        return h[new], kept[offsets]
    return h, offsets


def by_set(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values (uint64, wrapping) over each set; 0 for an empty one."""
    return np.diff(np.concatenate([[U(0)], np.cumsum(values, dtype=U)])[offsets])


def keys(sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set."""
    return mix(by_set(mix(sets ^ U(0xA5A5)), offsets)), mix(by_set(mix(sets + U(0x1234567)), offsets) + U(1))


def sketches(sets: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Bits of each set: whether an odd number of its elements falls on the bit. Two sketches differ in at most as many bits as the sets' symmetric
    difference has elements. Sets of LONG elements have FINE bits, others BITS; a fine sketch folds to a coarse one.
    """
    n = np.diff(offsets)
    out: list[bytes] = [b""] * len(n)
    for long, bits in ((False, BITS), (True, FINE)):
        who = np.flatnonzero((n >= LONG) == long)
        for lo in range(0, len(who), 500):
            some = who[lo : lo + 500]
            mine = np.concatenate([sets[offsets[i] : offsets[i + 1]] for i in some.tolist()])
            owner = np.repeat(np.arange(len(some)), n[some])
            odd = np.bincount(owner * bits + (mine >> U(65 - bits.bit_length())).astype(np.int64), minlength=len(some) * bits) & 1
            for i, row in zip(some.tolist(), np.packbits(odd.astype(np.uint8).reshape(-1, bits), axis=1), strict=True):
                out[i] = row.tobytes()
    return out


class Sketches:
    """Sketches of many sets, ready to be compared."""

    def __init__(self, raw: list[bytes]):
        fine = [i for i, r in enumerate(raw) if len(r) > BITS // 8]
        self.fine = np.full(len(raw), -1)
        self.fine[fine] = np.arange(len(fine))
        self.full = np.frombuffer(b"".join(raw[i] for i in fine), np.uint8).reshape(-1, FINE // 8)
        folded = np.packbits(np.unpackbits(self.full, axis=1).reshape(len(fine), BITS, FINE // BITS).sum(2, dtype=np.uint8) & 1, axis=1) if fine else None
        short = list(raw)
        for k, i in enumerate(fine):
            short[i] = folded[k].tobytes()
        self.coarse = np.frombuffer(b"".join(short), U).reshape(-1, BITS // 64)
        self.quarter = np.ascontiguousarray(self.coarse[:, : BITS // 256])
        self.full = self.full.view(U) if fine else self.full

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Differing bits of pairs of rows, in the finest sketches that both have."""
        out = np.bitwise_count(self.coarse[x] ^ self.coarse[y]).sum(1, dtype=np.int64)
        both = np.flatnonzero((self.fine[x] >= 0) & (self.fine[y] >= 0))
        for lo in range(0, len(both), 4096):
            b = both[lo : lo + 4096]
            out[b] = np.bitwise_count(self.full[self.fine[x[b]]] ^ self.full[self.fine[y[b]]]).sum(1, dtype=np.int64)
        return out
