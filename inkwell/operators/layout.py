"""Layout analysis of a page: glyph rows to lines, boxes and reading order.

Three forms of line building are here. ``fold_lines`` takes a glyph table as the parser gives it, with each page's glyphs together and in order, and folds them in their task: only
lines leave it, nothing is shuffled. ``glyph_lines`` is a window, for glyphs in any order. Both are exact for horizontal text. ``layout`` analyses one page
in memory, with vertical text and the greedy reading order, which are sequential; it is what the sinks and the grouped map use.
Ties that depend on nothing in the page go by drawing order.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions import geometry as G


@dataclass(frozen=True)
class Params:
    line_overlap: float = 0.5
    char_margin: float = 2.0
    line_margin: float = 0.5
    word_margin: float = 0.1
    boxes_flow: float | None = 0.5
    detect_vertical: bool = False
    all_texts: bool = False

    def __post_init__(self):
        f = self.boxes_flow
        if f is not None and not (isinstance(f, (int, float)) and not isinstance(f, bool) and -1 <= f <= 1):
            raise ValueError("boxes_flow is None or a number from -1 to 1")


# -- windows over a glyph table --------------------------------------------------------------------------------


def glyph_lines(glyphs: DataFrame, keys: list[str], p: Params = Params()) -> DataFrame:
    """Add ``line`` (from 0, by drawing order) and ``gap`` (a space comes before the glyph) to glyphs with x0, y0, x1, y1 and seq.

    A glyph goes on with the line of the one before it if both overlap vertically by enough and stand close; this is
    exact for horizontal text. ``keys`` name a container (a page or a figure).
    """
    w = Window.partitionBy(*keys).orderBy("seq")
    before = {c: F.lag(c).over(w) for c in ("x0", "y0", "x1", "y1")}
    g = glyphs.withColumns({f"_{c}": v for c, v in before.items()})
    a, b = G.Box("_x0", "_y0", "_x1", "_y1"), G.Box("x0", "y0", "x1", "y1")
    joined = G.overlaps_v(a, b) & (F.least(a.height, b.height) * p.line_overlap < G.overlap_v(a, b)) & (G.distance_h(a, b) < F.greatest(a.width, b.width) * p.char_margin)
    g = g.withColumn("_new", F.when(joined, 0).otherwise(1)).withColumn("line", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    margin = F.greatest(b.width, b.height) * p.word_margin
    gap: Column = (F.col("_new") == 0) & (F.col("_x1") < F.col("x0") - margin) if p.word_margin else F.lit(False)
    return g.withColumn("gap", gap).drop("_new", "_x0", "_y0", "_x1", "_y1")


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole containers, with a flag where one begins. A container that goes on in the next batch waits for it."""

    def begins(t: pa.Table) -> np.ndarray:
        out = np.zeros(len(t), bool)
        out[0] = True
        for k in keys:
            a, b = t[k].slice(0, len(t) - 1), t[k].slice(1)
            differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
            out[1:] |= differ.to_numpy(zero_copy_only=False) if isinstance(differ, pa.Array) else differ.to_numpy()
        return out

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        table = pa.Table.from_batches(held)
        flags = begins(table)
        if last := int(np.flatnonzero(flags)[-1]):
            yield table.slice(0, last), flags[:last]
            held = table.slice(last).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, begins(table)


_BOX = ("x0", "y0", "x1", "y1")
_LINE = "line long, x0 double, y0 double, x1 double, y1 double, text string, glyphs long, seq long"


def _runs(table: pa.Table, keys: list[str], first: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: pa.Array, number: np.ndarray) -> pa.RecordBatch:
    """A row for each run of glyphs, with its box and text."""
    at = pa.array(starts)
    bounds = np.stack([starts, np.append(starts[1:], len(first))], 1)  # reduceat goes on to the next start; runs that end before it are cut by a neutral copy
    used = np.zeros(len(first) + 1, np.int64)
    np.add.at(used, starts, 1)
    np.add.at(used, ends, -1)
    inside = np.cumsum(used)[:-1] > 0
    lows = [np.minimum.reduceat(np.where(inside, table[c].to_numpy(), np.inf), bounds[:, 0]) for c in ("x0", "y0")]
    highs = [np.maximum.reduceat(np.where(inside, table[c].to_numpy(), -np.inf), bounds[:, 0]) for c in ("x1", "y1")]
    kept = pc.filter(text, pa.array(inside))
    lengths = ends - starts
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)])), kept), "")
    columns = [*(table[k].combine_chunks().take(at) for k in keys), pa.array(number), *map(pa.array, (*lows, *highs)), joined, pa.array(lengths), table["seq"].combine_chunks().take(at).cast(pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=[*keys, "line", *_BOX, "text", "glyphs", "seq"])


def _folded(glyphs: DataFrame, keys: list[str], fold) -> DataFrame:
    """``fold`` gives (starts, ends, texts) of the runs of a table of whole containers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in _whole(batches, keys):
            starts, ends, text = fold(table, first)
            if len(starts):
                before = np.searchsorted(starts, np.flatnonzero(first))  # runs before each container
                number = np.arange(len(starts)) - before[np.cumsum(first)[starts] - 1]
                yield _runs(table, keys, first, starts, ends, text, number)

    narrow = glyphs.select(*keys, "seq", "text", *(F.col(c).cast("double").alias(c) for c in _BOX))
    return narrow.mapInArrow(run, T.StructType([*narrow.select(*keys).schema.fields, *T.StructType.fromDDL(_LINE).fields]))


def fold_lines(glyphs: DataFrame, keys: list[str], p: Params = Params()) -> DataFrame:
    """What ``text_lines(glyph_lines(...))`` gives, without a shuffle: rows of one container (``keys``) must stand together in one partition, in drawing order, as the parser and other narrow steps leave them."""

    def fold(table: pa.Table, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        x0, y0, x1, y1 = (table[c].to_numpy() for c in _BOX)
        ax0, ay0, ax1, ay1 = (np.concatenate([v[:1], v[:-1]]) for v in (x0, y0, x1, y1))
        wide, high = x1 - x0, y1 - y0
        over = np.minimum(np.abs(ay0 - y1), np.abs(ay1 - y0))
        apart = np.where((x0 <= ax1) & (ax0 <= x1), 0, np.minimum(np.abs(ax0 - x1), np.abs(ax1 - x0)))
        joined = ~first & (y0 <= ay1) & (ay0 <= y1) & (np.minimum(ay1 - ay0, high) * p.line_overlap < over) & (apart < np.maximum(ax1 - ax0, wide) * p.char_margin)
        text = table["text"].combine_chunks()
        if p.word_margin:
            gap = joined & (ax1 < x0 - np.maximum(wide, high) * p.word_margin)
            text = pc.binary_join_element_wise(pa.array(np.where(gap, " ", "")), text, "")
        starts = np.flatnonzero(~joined)
        return starts, np.append(starts[1:], len(table)), text

    return _folded(glyphs, keys, fold)


def fold_words(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """Words of each container: runs of glyphs that are not blank and on one baseline; rows as for ``fold_lines``, ``line`` being the word's number."""

    def fold(table: pa.Table, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        text = table["text"].combine_chunks()
        blank = pc.equal(pc.utf8_trim(text, " "), "").to_numpy(zero_copy_only=False)
        y0 = table["y0"].to_numpy()
        new = first | blank
        new[1:] |= blank[:-1] | (y0[1:] != y0[:-1])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(table))
        words = ~blank[starts]
        return starts[words], ends[words], text

    return _folded(glyphs, keys, fold)


def text_lines(lined: DataFrame, keys: list[str]) -> DataFrame:
    """One row per line: its box, its text with spaces, the number of glyphs and the first seq."""
    text = F.concat(F.when(F.col("gap"), " ").otherwise(""), F.col("text"))
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", text.alias("t")))), lambda x: x["t"]), "")
    return lined.groupBy(*keys, "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), ordered.alias("text"), F.count(F.lit(1)).alias("glyphs"), F.min("seq").alias("seq"))


def line_neighbors(lines: DataFrame, keys: list[str], p: Params = Params(), cell: float = 50.0) -> DataFrame:
    """Pairs (line, other) of neighbours: an equi-join on grid cells, then the exact test. A long line is in several cells; a pair is kept where both boxes' first common cell is."""

    def cells(lo: Column, hi: Column) -> Column:
        return F.sequence(F.floor(lo / cell), F.floor(hi / cell))

    d = (F.col("y1") - F.col("y0")) * p.line_margin
    left = lines.select(*keys, F.col("line"), *(F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")), F.explode(cells(F.col("y0") - d, F.col("y1") + d)).alias("cell"))
    right = lines.select(*keys, F.col("line").alias("other"), *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")), F.explode(cells(F.col("y0"), F.col("y1"))).alias("cell"))
    a, b = G.Box("a_x0", "a_y0", "a_x1", "a_y1"), G.Box("b_x0", "b_y0", "b_x1", "b_y1")
    d = a.height * p.line_margin
    first = F.greatest(F.floor((a.y0 - d) / cell), F.floor(b.y0 / cell))
    close = (b.x0 < a.x1) & (a.x0 < b.x1) & (b.y0 < a.y1 + d) & (a.y0 - d < b.y1)
    aligned = (F.abs(a.x0 - b.x0) <= d) | (F.abs(a.x1 - b.x1) <= d) | (F.abs((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) <= d)
    return left.join(right, [*keys, "cell"]).filter((F.col("line") != F.col("other")) & (F.col("cell") == first) & close & (F.abs(a.height - b.height) <= d) & aligned).select(*keys, "line", "other")


# -- one page in memory ----------------------------------------------------------------------------------------


@dataclass
class Line:
    vertical: bool
    glyphs: list[dict] = field(default_factory=list)
    spaces: set[int] = field(default_factory=set)  # a space before the glyph of this index

    def add(self, g: dict, margin: float) -> None:
        if self.glyphs and margin:
            last, reach = self.glyphs[-1], margin * max(g["x1"] - g["x0"], g["y1"] - g["y0"])
            if (g["y1"] + reach < last["y0"]) if self.vertical else (last["x1"] < g["x0"] - reach):
                self.spaces.add(len(self.glyphs))
        self.glyphs.append(g)

    @cached_property
    def box(self) -> tuple[float, float, float, float]:
        """The hull of all glyphs; asked for when the line is whole."""
        g = self.glyphs
        return (min([x["x0"] for x in g]), min([x["y0"] for x in g]), max([x["x1"] for x in g]), max([x["y1"] for x in g]))

    @cached_property
    def text(self) -> str:
        if not self.spaces:
            return "".join([g["text"] for g in self.glyphs])
        return "".join((" " if i in self.spaces else "") + g["text"] for i, g in enumerate(self.glyphs))

    @property
    def empty(self) -> bool:
        return self.box[2] <= self.box[0] or self.box[3] <= self.box[1] or self.text.isspace()


@dataclass
class Node:
    """A text box (with lines) or a group (with parts)."""

    box: tuple[float, float, float, float]
    vertical: bool
    lines: list[Line] = field(default_factory=list)
    parts: list[Node] = field(default_factory=list)
    index: int = -1

    @property
    def text(self) -> str:
        return "".join(line.text + "\n" for line in self.lines)


@dataclass
class Layout:
    boxes: list[Node]
    others: list[dict]
    empties: list[Line]
    groups: list[Node]
    glyphs: list[dict]  # when nothing was analysed


def _meets(a: dict, b: dict, p: Params, across: bool) -> bool:
    """b goes on with a's line; ``across`` for vertical lines, where the axes change places."""
    lo, hi, near, far = ("x0", "x1", "y0", "y1") if across else ("y0", "y1", "x0", "x1")
    if not (b[lo] <= a[hi] and a[lo] <= b[hi]):
        return False
    overlap = min(abs(a[lo] - b[hi]), abs(a[hi] - b[lo]))
    apart = 0 if b[near] <= a[far] and a[near] <= b[far] else min(abs(a[near] - b[far]), abs(a[far] - b[near]))
    return min(a[hi] - a[lo], b[hi] - b[lo]) * p.line_overlap < overlap and apart < max(a[far] - a[near], b[far] - b[near]) * p.char_margin


def build_lines(glyphs: list[dict], p: Params) -> list[Line]:
    """A three-state walk over neighbouring glyphs: no line, a horizontal one, a vertical one. A glyph that ends a line opens the next only with its successor."""
    lines: list[Line] = []
    line: Line | None = None

    def put(vertical: bool, *some: dict) -> Line:
        new = Line(vertical)
        for g in some:
            new.add(g, p.word_margin)
        return new

    least, most = p.line_overlap, p.char_margin
    for a, b in zip(glyphs, glyphs[1:]):
        ay0, ay1, by0, by1, ax1, bx0 = a["y0"], a["y1"], b["y0"], b["y1"], a["x1"], b["x0"]
        if ay0 == by0 and ay1 == by1 and ax1 == bx0 and least < 1 and most > 0 and ay0 < ay1 and (a["x0"] < ax1 or bx0 < b["x1"]):
            h = True  # the next glyph of a run on one baseline
        else:
            h = _meets(a, b, p, False)
        v = p.detect_vertical and _meets(a, b, p, True)
        if line is not None and (v if line.vertical else h):
            line.add(b, p.word_margin)
        elif line is not None:
            lines.append(line)
            line = None
        elif h != v:
            line = put(v, a, b)
        else:
            lines.append(put(False, a))
    if glyphs:
        lines.append(line if line is not None else put(False, glyphs[-1]))
    return lines


def group_lines(lines: list[Line], page: tuple[float, float, float, float], p: Params) -> list[Node]:
    """Boxes are the connected components of neighbouring lines; lines outside the page have no neighbours."""
    root = list(range(len(lines)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    inside = [b[2] > page[0] and b[0] < page[2] and b[3] > page[1] and b[1] < page[3] for b in (x.box for x in lines)]
    for axis in (False, True):
        some = sorted((i for i, x in enumerate(lines) if x.vertical == axis and inside[i]), key=lambda i: lines[i].box[0 if axis else 1])
        lo, hi, near, far = (0, 2, 1, 3) if axis else (1, 3, 0, 2)
        tallest = max((lines[i].box[hi] - lines[i].box[lo] for i in some), default=0)
        starts = [lines[i].box[lo] for i in some]
        from bisect import bisect_left

        for i in some:
            a = lines[i].box
            d = p.line_margin * (a[hi] - a[lo])
            for j in some[bisect_left(starts, a[lo] - d - tallest) : bisect_left(starts, a[hi] + d)]:
                b = lines[j].box
                if j == i or not (b[lo] < a[hi] + d and a[lo] - d < b[hi] and b[near] < a[far] and a[near] < b[far]):
                    continue
                if abs((a[hi] - a[lo]) - (b[hi] - b[lo])) <= d and (abs(a[near] - b[near]) <= d or abs(a[far] - b[far]) <= d or abs((a[near] + a[far]) - (b[near] + b[far])) / 2 <= d):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    members: dict[int, list[Line]] = defaultdict(list)
    for i, line in enumerate(lines):
        members[find(i)].append(line)
    boxes = []
    for _, some in sorted(members.items()):
        vertical = some[0].vertical
        some.sort(key=lambda x: -x.box[2] if vertical else -x.box[3])
        xs0, ys0, xs1, ys1 = zip(*(x.box for x in some), strict=True)
        box = (min(xs0), min(ys0), max(xs1), max(ys1))
        if box[2] > box[0] and box[3] > box[1]:
            boxes.append(Node(box, vertical, some))
    return boxes


def _area(b: tuple) -> float:
    return (b[2] - b[0]) * (b[3] - b[1])


def _hull(a: tuple, b: tuple) -> tuple:
    return (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))


def merge_boxes(boxes: list[Node], page: tuple[float, float, float, float]) -> list[Node]:
    """The two nearest nodes become a group until one is left. A pair that has another node between its two waits until all that haven't are done."""
    nodes = dict(enumerate(boxes))
    heap = [(False, _area(_hull(a.box, b.box)) - _area(a.box) - _area(b.box), i, j) for i, a in nodes.items() for j, b in nodes.items() if i < j]
    heapq.heapify(heap)
    count = len(boxes)

    def between(i: int, j: int) -> bool:
        h = _hull(nodes[i].box, nodes[j].box)
        h = (max(h[0], page[0]), max(h[1], page[1]), min(h[2], page[2]), min(h[3], page[3]))
        return any(k not in (i, j) and n.box[0] < h[2] and h[0] < n.box[2] and n.box[1] < h[3] and h[1] < n.box[3] for k, n in nodes.items())

    while heap:
        waited, d, i, j = heapq.heappop(heap)
        if i not in nodes or j not in nodes:
            continue
        if not waited and between(i, j):
            heapq.heappush(heap, (True, d, i, j))
            continue
        a, b = nodes.pop(i), nodes.pop(j)
        group = Node(_hull(a.box, b.box), a.vertical or b.vertical, parts=[a, b])
        for k, n in nodes.items():
            heapq.heappush(heap, (False, _area(_hull(group.box, n.box)) - _area(group.box) - _area(n.box), k, count))
        nodes[count] = group
        count += 1
    return list(nodes.values())


def number_boxes(groups: list[Node], flow: float) -> None:
    """Sort each group's parts by the flow and number the boxes depth first."""
    count = 0
    stack = list(reversed(groups))
    while stack:
        n = stack.pop()
        if not n.parts:
            n.index = count
            count += 1
            continue
        if n.vertical:
            n.parts.sort(key=lambda m: -(1 + flow) * (m.box[0] + m.box[2]) - (1 - flow) * m.box[3])
        else:
            n.parts.sort(key=lambda m: (1 - flow) * m.box[0] - (1 + flow) * (m.box[1] + m.box[3]))
        stack.extend(reversed(n.parts))


def layout(rows: list[dict], page: tuple[float, float, float, float], p: Params | None) -> Layout:
    """Of the rows of one container (a page, or a figure when ``all_texts`` is set); without parameters nothing is analysed."""
    glyphs = [r for r in rows if r["kind"] == "glyph"]
    others = [r for r in rows if r["kind"] != "glyph"]
    if p is None or not glyphs:
        return Layout([], others, [], [], rows if p is None else [])
    lines = build_lines(glyphs, p)
    empties = [x for x in lines if x.empty]
    boxes = group_lines([x for x in lines if not x.empty], page, p)
    groups: list[Node] = []
    if p.boxes_flow is None:
        boxes.sort(key=lambda b: (0, -b.box[2], -b.box[1]) if b.vertical else (1, -b.box[1], b.box[0]))
    else:
        groups = merge_boxes(boxes, page)
        number_boxes(groups, p.boxes_flow)
        boxes.sort(key=lambda b: b.index)
    return Layout(boxes, others, empties, groups, [])


def containers(rows: list[dict]) -> dict[int | None, list[dict]]:
    """Rows by the figure that holds them directly; None is the page."""
    out: dict[int | None, list[dict]] = defaultdict(list)
    for r in rows:
        out[r["figure"][-1] if r["figure"] else None].append(r)
    return out


def page_text(rows: list[dict], page: tuple[float, float, float, float], p: Params | None) -> str:
    """The page's text as the text sink writes it: boxes, each followed by a line feed, then figures and what else there is, then empty lines; a form feed at the end."""
    held = containers(rows)

    def write(which: int | None, params: Params | None, box: tuple) -> str:
        out = layout(held.get(which, []), box, params)
        parts = [b.text + "\n" for b in out.boxes]
        for r in out.others if params is not None else out.glyphs:
            if r["kind"] == "glyph":
                parts.append(r["text"])
            elif r["kind"] == "figure":
                parts.append(write(r["seq"], p if p is not None and p.all_texts else None, (r["x0"], r["y0"], r["x1"], r["y1"])))
        parts += [line.text + "\n" for line in out.empties]
        return "".join(parts)

    return write(None, p, page) + "\f"
