"""Glyphs of upright strings as runs: what they share is kept once, what each has in arrays. Batches of columns are built from many runs at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa

from inkwell.functions.fonts import Font

#: Glyphs that leave a task together, about; strings of more are added up at once and leave in parts.
LONG = BATCH_GLYPHS = 16_384


class Advances:
    """Advances of one-byte codes at one size, worked out as codes occur; ``steps`` have the space between words."""

    def __init__(self, font: Font, size: float, scaling: float, space: float):
        self.of = lambda cid: font.width(cid) * size * scaling
        self.space, self.seen = space, b""
        self.table, self.steps = [0.0] * 256, [0.0] * 256

    def learn(self, raw: bytes) -> None:
        if new := {*raw.translate(None, self.seen)}:
            for cid in new:
                self.table[cid] = adv = self.of(cid)
                self.steps[cid] = adv + self.space if cid == 32 else adv
            self.seen += bytes(new)


class Run(NamedTuple):
    """Glyphs one after another on an upright line. ``base`` takes a place on the line to the page.

    A string in one piece has its bytes, the first place and the advances of codes; other runs have ids, places, advances of each glyph and the place after them.
    """

    seq: int
    count: int
    shared: dict[str, Any]
    base: tuple[float, float]
    font: Font
    cids: bytes | np.ndarray
    xs: float | np.ndarray
    advances: Advances | np.ndarray
    end: float | None

    def settled(self) -> Run:
        """The run with places of its own, added up one by one."""
        if not isinstance(self.cids, bytes):
            return self
        cids = np.frombuffer(self.cids, np.uint8)
        xs = np.add.accumulate(np.concatenate(([self.xs], np.array(self.advances.steps)[cids])))
        return self._replace(cids=cids, xs=xs[:-1], advances=np.array(self.advances.table)[cids], end=float(xs[-1]))

    def part(self, at: int, stop: int) -> Run:
        cids = self.cids[at:stop]
        return self._replace(seq=self.seq + at, count=len(cids), cids=cids, xs=self.xs[at:stop], advances=self.advances[at:stop])


class Pen(NamedTuple):
    """Where the pen is after a run, worked out if anyone asks."""

    run: Run
    y: float

    def place(self) -> tuple[float, float]:
        return self.run.settled().end, self.y


def parts(run: Run, limit: int) -> Iterator[Run]:
    if run.count <= limit:
        return iter((run,))
    run = run.settled()
    return (run.part(at, at + limit) for at in range(0, run.count, limit))


def _of_codes(runs: list[Run], cids: np.ndarray, counts: np.ndarray, table: str) -> np.ndarray:
    """What a table of codes has for each glyph; 0 where runs have no tables."""
    index: dict[int, int] = {}
    values: list[list[float]] = []
    which = []
    for r in runs:
        if r.end is not None:
            which.append(-1)
            continue
        k = index.setdefault(id(r.advances), len(values))
        if k == len(values):
            values.append(getattr(r.advances, table))
        which.append(k)
    flat = np.array([*values, [0.0] * 256]).reshape(-1)
    places = np.repeat(np.array(which, np.int64) % (len(values) + 1) << 8, counts)
    return flat[places + np.where(places == len(values) << 8, 0, cids) if -1 in which else places + cids]


def _places(runs: list[Run], cids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of all glyphs. Strings are added up side by side, with others of half to all their length, each in its order."""
    steps, out = _of_codes(runs, cids, counts, "steps"), np.empty(len(cids))
    starts = np.cumsum(counts) - counts
    sized: dict[int, list[int]] = {}
    for k, r in enumerate(runs):
        if r.end is None:
            sized.setdefault(r.count.bit_length(), []).append(k)
        else:
            out[starts[k] : starts[k] + r.count] = r.xs
    for some in sized.values():
        mine = counts[some]
        longest = int(mine.max())
        inside = np.arange(longest) < mine[:, None]
        at = (starts[some][:, None] + np.arange(longest))[inside]
        grid = np.zeros((len(some), longest + 1))
        grid[:, 0] = [runs[k].xs for k in some]
        grid[:, 1:][inside] = steps[at]
        np.add.accumulate(grid, axis=1, out=grid)
        out[at] = grid[:, :-1][inside]
    return out


class _Columns:
    """Columns of (doc_id, page_no, run) rows, each built when it is asked for."""

    def __init__(self, held: list[tuple[str, int, Run]], text: Callable[[Font, int], str], color: Callable[[Any], str | None]):
        self.docs, self.pages, self.runs = zip(*held, strict=True)
        self.text_of, self.color = text, color
        self.counts = np.fromiter((r.count for r in self.runs), np.int64, len(self.runs))
        self.cids = np.concatenate([np.frombuffer(r.cids, np.uint8) if isinstance(r.cids, bytes) else r.cids for r in self.runs]).astype(np.int64)

    def _each(self, values: list, dtype) -> np.ndarray:
        return np.repeat(np.array(values, dtype), self.counts)

    def _shared(self, name: str, kind: pa.DataType, f: Callable = lambda x: x) -> pa.Array:
        """A column of what runs share; equal values are put down once."""
        return self._taken([f(r.shared[name]) for r in self.runs], kind)

    def _taken(self, values: list, kind: pa.DataType) -> pa.Array:
        places: dict = {}
        codes = np.repeat(np.fromiter((places.setdefault(v, len(places)) for v in values), np.int64, len(values)), self.counts)
        return pa.array(list(places), kind).take(pa.array(codes))

    @cached_property
    def xs(self) -> np.ndarray:
        """Places on the page, where the pen is."""
        return _places(self.runs, self.cids, self.counts) * self._each([r.base[0] for r in self.runs], float) + self._each([r.base[1] for r in self.runs], float)

    @cached_property
    def advs(self) -> np.ndarray:
        out = _of_codes(self.runs, self.cids, self.counts, "table")
        for r, stop in zip(self.runs, np.cumsum(self.counts).tolist(), strict=True):
            if r.end is not None:
                out[stop - r.count : stop] = r.advances
        return out

    def _ends(self) -> tuple[np.ndarray, np.ndarray]:
        return self.xs, self.advs * self._each([r.base[0] for r in self.runs], float) + self.xs

    def _forward(self) -> bool:
        """No glyph goes back."""
        return all((min(r.advances.table) >= 0) if r.end is None else bool((r.advances >= 0).all()) for r in {id(r.advances): r for r in self.runs}.values())

    def _texts(self) -> pa.Array:
        fonts: dict[int, Font] = {id(r.font): r.font for r in self.runs}
        index = {k: i for i, k in enumerate(fonts)}
        keys, codes = np.unique(self._each([index[id(r.font)] for r in self.runs], np.int64) << 32 | self.cids, return_inverse=True)
        known = list(fonts.values())
        return pa.array([self.text_of(known[k >> 32], k & 0xFFFFFFFF) for k in keys.tolist()], pa.string()).take(pa.array(codes.reshape(-1)))

    def column(self, name: str, kind: pa.DataType) -> pa.Array:
        total = int(self.counts.sum())
        if name == "doc_id":
            return self._taken(list(self.docs), kind)
        if name == "page_no":
            return pa.array(self._each(list(self.pages), np.int32), kind)
        if name == "error":
            return pa.nulls(total, kind)
        if name == "seq":
            before = np.cumsum(self.counts) - self.counts
            return pa.array(np.arange(total) - np.repeat(before, self.counts) + self._each([r.seq for r in self.runs], np.int64), kind)
        if name == "cid":
            return pa.array(self.cids, kind)
        if name == "text":
            return self._texts()
        if name == "x0":
            if self._forward():
                return pa.array(self.xs, kind)
            near, far = self._ends()
            return pa.array(np.where(far < near, far, near), kind)
        if name == "x1":
            near, far = self._ends()
            return pa.array(np.where(far > near, far, near), kind)
        if name == "adv":
            return pa.array(self.advs, kind)
        if name == "matrix":
            flat = np.empty((total, 6))
            for k in (0, 1, 2, 3, 5):
                flat[:, k] = self._each([r.shared["matrix"][k] for r in self.runs], float)
            flat[:, 4] = self.xs
            return pa.ListArray.from_arrays(pa.array(np.arange(0, 6 * total + 1, 6, dtype=np.int32)), pa.array(flat.reshape(-1))).cast(kind)
        if name in ("y0", "y1", "fontsize", "size"):
            return pa.array(self._each([r.shared[name] for r in self.runs], float), kind)
        return self._shared(name, kind, self.color if name in ("ncolor", "scolor") else lambda x: x)


def batch(held: list[tuple[str, int, Run]], schema: pa.Schema, text: Callable[[Font, int], str], color: Callable[[Any], str | None]) -> pa.RecordBatch:
    """Rows of the table of glyphs, with the schema's columns only."""
    of = _Columns(held, text, color)
    return pa.RecordBatch.from_arrays([of.column(f.name, f.type) for f in schema], schema=schema)
