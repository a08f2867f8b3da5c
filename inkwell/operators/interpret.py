"""Page content to rows: glyphs, paths, images, figures and tags, in drawing order.

A page is one fold over its operators. Operands wait on a stack; an operator takes its last ones and acts only if there were enough.
"""

from __future__ import annotations

import math
import re
from copy import copy
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from inkwell.functions.fonts import Font, load_font
from inkwell.functions.syntax import Name, Op, Stream, values
from inkwell.operators.runs import LONG, Advances, Pen, Run
from inkwell.sources.document import Document, text_string

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1, 0, 0, 1, 0, 0)
# Colour spaces with a fixed number of components.
SPACES = {"DeviceGray": 1, "CalRGB": 3, "CalGray": 1, "Lab": 3, "DeviceRGB": 3, "DeviceCMYK": 4, "Separation": 1, "Indexed": 1, "Pattern": 1}


def compose(first: Matrix, then: Matrix) -> Matrix:
    a, b, c, d, e, f = first
    p, q, r, s, t, u = then
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def shifted(m: Matrix, x: float, y: float) -> Matrix:
    return (*m[:4], x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5])


def point(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return (x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5])


def hull(m: Matrix, x0: float, y0: float, x1: float, y1: float) -> tuple[float, float, float, float]:
    xs, ys = zip(*(point(m, x, y) for x in (x0, x1) for y in (y0, y1)), strict=True)
    return (min(xs), min(ys), max(xs), max(ys))


@dataclass
class State:
    ctm: Matrix = IDENTITY
    matrix: Matrix = IDENTITY
    pen: tuple[float, float] = (0.0, 0.0)
    font: Font | None = None
    size: float = 0.0
    charspace: float = 0.0
    wordspace: float = 0.0
    scaling: float = 100.0
    leading: float = 0.0
    render: int = 0
    rise: float = 0.0
    linewidth: float = 0
    cap: Any = None
    join: Any = None
    miter: Any = None
    dash: Any = None
    intent: Any = None
    flatness: Any = None
    spaces: tuple[tuple[str, int], tuple[str, int]] = (("DeviceGray", 1), ("DeviceGray", 1))  # stroke, fill
    colors: tuple[Any, Any] = (0, 0)


@dataclass
class Subpath:
    """Where a pen was put down, and the operators that moved it from there, in user space."""

    start: tuple[float, float]
    moves: list[tuple[str, list[float]]] = field(default_factory=list)

    def figure(self, m: Matrix) -> dict:
        """Kind, box and points on the page, and the operators with all their points."""
        home = point(m, *self.start)
        stops = [point(m, *n[-2:]) if n else home for _, n in self.moves]
        corners = [home, *stops]
        straight = len(self.moves) == sum(op == "l" or (op == "h" and k == len(self.moves) - 1) for k, (op, _) in enumerate(self.moves))
        closed = bool(self.moves) and self.moves[-1][0] == "h"
        if closed and len(self.moves) > 2 and self.moves[-2][0] == "l" and stops[-2] == home:
            corners.pop()  # the last edge came home already
        edges = [(q[0] - p[0], q[1] - p[1]) for p, q in zip(corners, corners[1:])]
        pts, kind = corners, "curve"
        if straight and len(self.moves) - closed == 1:
            pts, kind = corners[:2], "line"
        elif straight and len(edges) == 4 and corners[4] == home and square(edges):
            (ax, ay), (cx, cy) = corners[0], corners[2]
            pts, kind = [(ax, ay), (cx, ay), (cx, cy), (ax, cy)], "rect"
        xs, ys = zip(*corners, strict=True)
        original = [("m", [home]), *((op, [point(m, x, y) for x, y in zip(n[::2], n[1::2], strict=True)]) for op, n in self.moves)]
        return {"kind": kind, "x0": min(xs), "y0": min(ys), "x1": max(xs), "y1": max(ys), "pts": pts, "original": original}


def square(edges: list[tuple[float, float]]) -> bool:
    """Edges run along the axes, by turns."""
    return any(all(edge[(k + turn) % 2] == 0 for k, edge in enumerate(edges)) for turn in (0, 1))


class Path:
    """Subpaths since the last painting operator. One that doesn't begin with a starting point draws nothing."""

    def __init__(self):
        self.subpaths: list[Subpath] = []
        self.astray = False

    def take(self, op: str, n: list[float]) -> None:
        if op == "m":
            self.subpaths.append(Subpath((n[0], n[1])))
        elif op == "re":
            x, y, w, h = n
            self.subpaths.append(Subpath((x, y), [("l", [x + w, y]), ("l", [x + w, y + h]), ("l", [x, y + h]), ("h", [])]))
        elif self.subpaths:
            self.subpaths[-1].moves.append((op, n))
        else:
            self.astray = True

    def figures(self, m: Matrix) -> list[dict]:
        """Figures of all subpaths; a bare starting point counts only if it is all there is."""
        if self.astray:
            return []
        return [p.figure(m) for p in self.subpaths if p.moves or len(self.subpaths) == 1]


@dataclass
class PageItems:
    box: tuple[float, float, float, float]
    rows: list[dict] = field(default_factory=list)
    tags: list[dict] = field(default_factory=list)


def page_box(doc: Document, page: dict, rotation: int = 0) -> tuple[tuple[float, float, float, float], int, Matrix]:
    """(page box from 0, 0; rotation; page matrix) of the MediaBox; without one, US Letter."""
    x0, y0, x1, y1 = doc.box(page.get("MediaBox")) or (0.0, 0.0, 612.0, 792.0)
    turn = (doc.int(page.get("Rotate")) + rotation) % 360
    ctm: Matrix = {90: (0, -1, 1, 0, -y0, x1), 180: (-1, 0, 0, -1, x1, y1), 270: (0, 1, -1, 0, y1, -x0)}.get(turn, (1, 0, 0, 1, -x0, -y0))
    a, b, c, d = hull(ctm, x0, y0, x1, y1)
    return (0, 0, abs(c - a), abs(d - b)), turn, ctm


def drawn_text(font: Font, cid: int, undefined: str | None) -> tuple[str, bool]:
    """A glyph's text, and whether another stands for it."""
    text = font.text(cid)
    return (text, False) if text is not None else (f"(cid:{cid})" if undefined is None else undefined, True)


class Interpreter:
    """``undefined`` stands for glyphs without a character; without it, their ids do. With ``packed``, the glyphs of an upright string are one Run among the rows."""

    def __init__(self, doc: Document, undefined: str | None = None, packed: bool = False):
        self.doc, self.fonts, self.undefined, self.packed = doc, {}, undefined, packed
        self.advances: dict[tuple, Advances] = {}

    @property
    def _seq(self) -> int:
        """Number of the next thing drawn; each glyph of a run has its own."""
        return len(self.items.rows) + self.inside

    def _text(self, font: Font, cid: int) -> tuple[str, bool]:
        return drawn_text(font, cid, self.undefined)

    def page(self, page: dict, rotation: int = 0) -> PageItems:
        box, _, ctm = page_box(self.doc, page, rotation)
        self.items, self.inside = PageItems(box), 0
        self.figures: list[int] = []
        self.device = ctm
        self._run(self.doc.dict(page.get("Resources")), self.doc.contents(page), ctm, frozenset())
        return self.items

    # -- resources ---------------------------------------------------------------------------------------------

    def _font(self, resources: dict, name: Any) -> Font:
        spec = self.doc.dict(resources.get("Font")).get(str(name)) if isinstance(name, str) else None
        key = spec.num if hasattr(spec, "num") else (id(resources), str(name))
        if key not in self.fonts:
            self.fonts[key] = (load_font(self.doc, self.doc.dict(spec) if spec is not None else {}), resources)
        return self.fonts[key][0]

    def _space(self, resources: dict, name: Any) -> tuple[str, int] | None:
        spec = self.doc.value(self.doc.dict(resources.get("ColorSpace")).get(str(name)))
        if spec is None:
            return (str(name), SPACES[name]) if name in SPACES else None
        kind = str(self.doc.value(spec[0]) if isinstance(spec, list) and spec else spec)
        if kind == "ICCBased" and isinstance(spec, list) and len(spec) > 1:
            return kind, self.doc.int(self.doc.dict(spec[1]).get("N"))
        if kind == "DeviceN" and isinstance(spec, list) and len(spec) > 1:
            return kind, len(self.doc.list(spec[1]))
        return (kind, SPACES[kind]) if kind in SPACES else None

    # -- running content ---------------------------------------------------------------------------------------

    def _run(self, resources: dict, streams: list[Stream], ctm: Matrix, above: frozenset) -> None:
        inside = above | {s.key for s in streams if s.key}
        streams = [s for s in streams if s.key not in above or s.key is None]
        data = b"\n".join(self.doc.decoded(s) for s in streams)
        state, saved, operands = State(ctm=ctm), [], []
        path = Path()
        self.device = ctm
        for given, op, extra in statements(data):
            operands += given
            if op == "EI":
                self._image(f"inline{self._seq}", self._inline(extra, resources))
                continue
            if op in ("SC", "SCN", "sc", "scn"):
                self._components(state, 0 if op[0] == "S" else 1, operands)
                continue
            known = ARITY.get(op)
            if known is None:
                continue
            args = operands[len(operands) - known :] if known else []
            if known:
                del operands[max(0, len(operands) - known) :]
            if len(args) < known:
                continue
            if op in SHOWN:
                self._set(op, args, state, resources)
            elif op == "q":
                saved.append(copy(state))
            elif op == "Q":
                if saved:
                    state = saved.pop()
                    self.device = state.ctm
            elif op == "cm":
                if (m := numbers(args)) is not None:
                    state.ctm = self.device = compose(m, state.ctm)
            elif op in PATH_OPS:
                if (n := numbers(args)) is not None:
                    path.take(op, n)
            elif op in PAINT:
                stroke, fill, evenodd, close = PAINT[op]
                if close:
                    path.take("h", [])
                for figure in path.figures(self.device):
                    self._add(linewidth=state.linewidth, stroke=stroke, fill=fill, evenodd=evenodd, scolor=state.colors[0], ncolor=state.colors[1], dash=state.dash, **figure)
                path = Path()
            elif op == "n":
                path = Path()
            elif op == "Do":
                self._object(args[0], resources, state, inside)
            elif op in TAG_OPS:
                self._tag(op, args, resources)
            else:
                self._set(op, args, state, resources)

    def _set(self, op: str, args: list, s: State, resources: dict) -> None:
        if op == "Tj":
            self._show(s, args)
            return
        n = numbers(args)
        if op == "Tm":
            if n is not None:
                s.matrix, s.pen = tuple(n), (0.0, 0.0)
            return
        if op in NUMERIC:
            if n is not None:
                setattr(s, *NUMERIC[op](n[0]))
        elif op == "w":
            if n is not None:
                s.linewidth = n[0] * math.hypot(s.ctm[0], s.ctm[1])
        elif op in PLAIN:
            setattr(s, PLAIN[op], args[0])
        elif op == "d":
            s.dash = (args[0], args[1])
        elif op in GRAY_RGB_CMYK:
            if n is not None:
                at, name = GRAY_RGB_CMYK[op]
                self._color(s, at, (name, len(n)), n[0] if len(n) == 1 else tuple(n))
        elif op in ("CS", "cs"):
            if (space := self._space(resources, args[0])) is not None:
                at = 0 if op == "CS" else 1
                s.spaces = (space, s.spaces[1]) if at == 0 else (s.spaces[0], space)
        elif op == "BT":
            s.matrix, s.pen = IDENTITY, (0.0, 0.0)
        elif op == "Tf":
            s.font = self._font(resources, args[0])
            if (size := numbers(args[1:])) is not None:
                s.size = size[0]
        elif op in ("Td", "TD"):
            if n is not None:
                s.matrix, s.pen = shifted(s.matrix, *n), (0.0, 0.0)
                if op == "TD":
                    s.leading = n[1]
        elif op in ("T*", "'"):
            s.matrix, s.pen = shifted(s.matrix, 0, s.leading), (0.0, 0.0)
            if op == "'":
                self._show(s, [args[0]])
        elif op == '"':
            if (two := numbers(args[:2])) is not None:
                s.wordspace, s.charspace = two
            self._show(s, [args[2]])
        elif op == "TJ" and isinstance(args[0], list):
            self._show(s, args[0])

    @staticmethod
    def _color(s: State, at: int, space: tuple[str, int], color: Any) -> None:
        s.spaces = (space, s.spaces[1]) if at == 0 else (s.spaces[0], space)
        s.colors = (color, s.colors[1]) if at == 0 else (s.colors[0], color)

    def _components(self, s: State, at: int, operands: list) -> None:
        name, count = s.spaces[at]
        args = operands[len(operands) - count :] if count and len(operands) >= count else []
        del operands[max(0, len(operands) - count) :]
        if len(args) != count or not count:
            return
        if name == "Pattern":
            if not isinstance(args[-1], Name):
                return
            base = numbers(args[:-1])
            if base is None:
                return
            color: Any = str(args[-1]) if not base else (base[0] if len(base) == 1 else tuple(base), str(args[-1]))
        else:
            n = numbers(args)
            if n is None or len(n) not in (1, 3, 4):
                return
            color = n[0] if len(n) == 1 else tuple(n)
        self._color(s, at, s.spaces[at], color)

    # -- what is drawn -----------------------------------------------------------------------------------------

    def _add(self, kind: str, **row) -> dict:
        item = {"kind": kind, "seq": self._seq, "figure": tuple(self.figures)} | row
        self.items.rows.append(item)
        return item

    def _show(self, s: State, parts: list) -> None:
        font = s.font
        if font is None:
            return
        scaling = s.scaling * 0.01
        gap, space = s.charspace * scaling, s.wordspace * scaling if font.simple else 0
        unit = 0.001 * s.size * scaling
        base = compose(s.matrix, s.ctm)
        if self.device is not s.ctm:
            base = compose(s.matrix, self.device)
        if type(s.pen) is not tuple:
            s.pen = s.pen.place()
        x, y = s.pen
        drawn = False
        if not font.vertical and base[1] == 0 == base[2] and base[0] > 0 < base[3] and s.size > 0 and scaling > 0:
            if self.packed:
                self._pack(s, font, parts, base, gap, space, unit, scaling)
                return
            s.pen = (self._upright(s, font, parts, base, gap, space, unit, scaling), y)
            return
        for part in parts:
            if isinstance(part, (int, float)) and not isinstance(part, bool):
                x, y = (x, y - part * unit) if font.vertical else (x - part * unit, y)
                drawn = True
            elif isinstance(part, bytes):
                for cid in font.ids(part):
                    move = gap if drawn else 0
                    x, y = (x, y + move) if font.vertical else (x + move, y)
                    adv = self._glyph(s, font, cid, shifted(base, x, y), scaling)
                    adv += space if cid == 32 else 0
                    x, y = (x, y + adv) if font.vertical else (x + adv, y)
                    drawn = True
        s.pen = (x, y)

    def _upright(self, s: State, font: Font, parts: list, base: Matrix, gap: float, space: float, unit: float, scaling: float) -> float:
        """``_show`` for upright text on a line, the common case: what all glyphs share is worked out once. Gives the pen's place on the line."""
        a, b, c, d, e, f = map(float, base)
        x, y = s.pen
        size, rows, figure = s.size, self.items.rows, tuple(self.figures)
        bottom = y * base[3] + base[5]
        low = font.descent * font.scale[1] * size + s.rise
        y0, y1 = low * base[3] + bottom, (low + size) * base[3] + bottom
        shared = {"kind": "glyph", "figure": figure, "y0": y0, "y1": y1, "font": font.name, "fontsize": float(size), "size": y1 - y0, "upright": True, "vertical": False, "ncs": s.spaces[1][0], "scolor": s.colors[0], "ncolor": s.colors[1]}
        known: dict[int, tuple[str, bool, float]] = {}
        drawn, bottom = False, float(bottom)
        for part in parts:
            if isinstance(part, (int, float)) and not isinstance(part, bool):
                x -= part * unit
                drawn = True
            elif isinstance(part, bytes):
                for cid in font.ids(part):
                    if cid not in known:
                        known[cid] = (*self._text(font, cid), font.width(cid) * size * scaling)
                    text, undefined, adv = known[cid]
                    if drawn:
                        x += gap
                    x0 = x * base[0] + base[4]
                    x1 = adv * base[0] + x0
                    rows.append({**shared, "seq": len(rows), "cid": cid, "text": text, "undefined": undefined, "x0": min(x0, x1), "x1": max(x0, x1), "matrix": (a, b, c, d, float(x0), bottom), "adv": adv})
                    x += adv + space if cid == 32 else adv
                    drawn = True
        return x

    def _pack(self, s: State, font: Font, parts: list, base: Matrix, gap: float, space: float, unit: float, scaling: float) -> None:
        """The glyphs of ``_upright`` as a run, with the same places. Those of a string in one piece are added up later, together with others."""
        x, y = s.pen
        size, bottom = s.size, y * base[3] + base[5]
        low = font.descent * font.scale[1] * size + s.rise
        y0, y1 = low * base[3] + bottom, (low + size) * base[3] + bottom
        shared = {"figure": tuple(self.figures), "y0": y0, "y1": y1, "matrix": (*base[:4], 0.0, bottom), "font": font.name, "fontsize": size, "size": y1 - y0, "upright": True, "vertical": False, "ncs": s.spaces[1][0], "scolor": s.colors[0], "ncolor": s.colors[1]}
        if not gap and len(parts) == 1 and type(parts[0]) is bytes and font.cmap is None and font.code_bytes == 1:
            key, raw = (id(font), size, scaling, space), parts[0]
            advances = self.advances.get(key)
            if advances is None:
                advances = self.advances[key] = Advances(font, size, scaling, space)
            advances.learn(raw)
            run = Run(self._seq, len(raw), shared, (base[0], base[4]), font, raw, x, advances, None)
            if run.count > LONG:
                run = run.settled()
            s.pen = Pen(run, y)
        else:
            known: dict[int, float] = {}
            drawn, ids, places = False, [], []
            for part in parts:
                if isinstance(part, (int, float)) and not isinstance(part, bool):
                    x -= part * unit
                    drawn = True
                elif isinstance(part, bytes):
                    for cid in font.ids(part):
                        if cid not in known:
                            known[cid] = font.width(cid) * size * scaling
                        if drawn:
                            x += gap
                        ids.append(cid)
                        places.append(x)
                        x += known[cid] + space if cid == 32 else known[cid]
                        drawn = True
            run = Run(self._seq, len(ids), shared, (base[0], base[4]), font, np.array(ids, np.int64), np.array(places, float), np.array([known[cid] for cid in ids], float), x)
            s.pen = (x, y)
        if run.count:
            self.items.rows.append(run)
            self.inside += run.count - 1

    def _glyph(self, s: State, font: Font, cid: int, m: Matrix, scaling: float) -> float:
        text, undefined = self._text(font, cid)
        size = s.size
        adv = font.width(cid) * size * scaling
        if font.vertical:
            vx, vy = font.shifts.get(cid, font.default_shift)
            vx, vy = size * 0.5 if vx is None else vx * size * 0.001, (1000 - vy) * size * 0.001
            box = (-vx, vy + s.rise + adv, -vx + size, vy + s.rise)
        else:
            low = font.descent * font.scale[1] * size + s.rise
            box = (0, low, adv, low + size)
        if m[1] == 0 == m[2] and m[0] > 0 < m[3] and box[2] >= box[0]:  # upright text, the common case
            x0, y0, x1, y1 = box[0] * m[0] + m[4], box[1] * m[3] + m[5], box[2] * m[0] + m[4], box[3] * m[3] + m[5]
        else:
            x0, y0, x1, y1 = hull(m, *box)
        self._add("glyph", cid=cid, text=text, x0=x0, y0=y0, x1=x1, y1=y1, matrix=tuple(map(float, m)), font=font.name, fontsize=float(size), size=x1 - x0 if font.vertical else y1 - y0, adv=adv, upright=m[0] * m[3] * scaling > 0 and m[1] * m[2] <= 0, vertical=font.vertical, undefined=undefined, ncs=s.spaces[1][0], scolor=s.colors[0], ncolor=s.colors[1])
        return adv

    def _figure(self, name: str, box: tuple, m: Matrix) -> None:
        x, y, w, h = box
        x0, y0, x1, y1 = hull(m, x, y, x + w, y + h)  # the box is read as origin and size
        row = self._add("figure", name=name, x0=x0, y0=y0, x1=x1, y1=y1, matrix=tuple(map(float, m)))
        self.figures.append(row["seq"])

    def _image(self, name: str, stream: Stream | None) -> None:
        if stream is None:
            return
        self._figure(name, (0, 0, 1, 1), self.device)
        f = self.items.rows[-1]
        a, doc = stream.attrs, self.doc
        width, height = (doc.int(a.get(k, a.get(k[0]))) for k in ("Width", "Height"))
        space = doc.value(a.get("ColorSpace", a.get("CS")))
        space = space if isinstance(space, list) else [space] if space is not None else []
        self._add("image", name=name, x0=f["x0"], y0=f["y0"], x1=f["x1"], y1=f["y1"], width=width, height=height, bits=doc.int(a.get("BitsPerComponent", a.get("BPC", 1))), imagemask=bool(doc.value(a.get("ImageMask", a.get("IM")))), colorspace=[str(x) for x in map(doc.value, space) if isinstance(x, str)], filters=[n for n, _ in doc.chain(a)], stream=stream)
        self.figures.pop()

    def _inline(self, stream: Stream, resources: dict) -> Stream | None:
        return stream if {"W", "H"} <= stream.attrs.keys() or {"Width", "Height"} <= stream.attrs.keys() else None

    def _object(self, name: Any, resources: dict, s: State, inside: frozenset) -> None:
        stream = self.doc.value(self.doc.dict(resources.get("XObject")).get(str(name)))
        if not isinstance(stream, Stream):
            return
        kind = self.doc.value(stream.attrs.get("Subtype"))
        if kind == "Form" and "BBox" in stream.attrs:
            m = numbers([self.doc.value(x) for x in self.doc.list(stream.attrs.get("Matrix"))])
            m = tuple(m) if m and len(m) == 6 else IDENTITY
            box = self.doc.box(stream.attrs["BBox"]) or (0, 0, 0, 0)
            self._figure(str(name), box, compose(m, self.device))
            own = self.doc.value(stream.attrs.get("Resources"))
            if stream.key not in inside:
                self._run(self.doc.dict(own) if own else resources, [stream], compose(m, s.ctm), inside)
            self.figures.pop()
        elif kind == "Image" and {"Width", "Height"} <= stream.attrs.keys():
            self._image(str(name), stream)

    def _tag(self, op: str, args: list, resources: dict) -> None:
        props = None
        if op in ("DP", "BDC"):
            props = self.doc.value(args[1])
            if isinstance(props, Name):
                props = self.doc.dict(self.doc.dict(resources.get("Properties")).get(str(props)))
            props = {k: text_string(v) if isinstance(v, bytes) else str(v) for k, v in (props if isinstance(props, dict) else {}).items()}
        self.items.tags.append({"seq": self._seq, "event": {"EMC": "end", "MP": "point", "DP": "point"}.get(op, "begin"), "tag": str(args[0]) if args else None, "props": props or {}})


_NUMERIC = {int, float}


def numbers(args: list) -> list[float] | None:
    return list(map(float, args)) if {*map(type, args)} <= _NUMERIC else None


# Operators by what they do, with the number of their operands.
PATH_OPS = {"m": 2, "l": 2, "c": 6, "v": 4, "y": 4, "h": 0, "re": 4}
#: stroke, fill, even-odd, close first
PAINT = {"S": (True, False, False, False), "s": (True, False, False, True), "f": (False, True, False, False), "f*": (False, True, True, False), "B": (True, True, False, False), "B*": (True, True, True, False), "b": (True, True, False, True), "b*": (True, True, True, True)}
SHOWN = {"Tj", "Tm"}  # the most frequent ones
TAG_OPS = {"MP": 1, "DP": 2, "BMC": 1, "BDC": 2, "EMC": 0}
PLAIN = {"J": "cap", "j": "join", "M": "miter", "ri": "intent", "i": "flatness", "Tr": "render"}
NUMERIC = {"Tc": lambda x: ("charspace", x), "Tw": lambda x: ("wordspace", x), "Tz": lambda x: ("scaling", x), "TL": lambda x: ("leading", -x), "Ts": lambda x: ("rise", x)}
GRAY_RGB_CMYK = {"G": (0, "DeviceGray"), "g": (1, "DeviceGray"), "RG": (0, "DeviceRGB"), "rg": (1, "DeviceRGB"), "K": (0, "DeviceCMYK"), "k": (1, "DeviceCMYK")}
#: Operators without effect take their operands too; F keeps the path.
IDLE = {"gs": 1, "F": 0, "W": 0, "W*": 0, "sh": 1, "ET": 0, "BX": 0, "EX": 0, "BI": 0, "ID": 0}
ARITY = {"q": 0, "Q": 0, "cm": 6, "w": 1, "d": 2, "n": 0, "CS": 1, "cs": 1, "G": 1, "g": 1, "RG": 3, "rg": 3, "K": 4, "k": 4, "BT": 0, "Tf": 2, "Td": 2, "TD": 2, "Tm": 6, "T*": 0, "TJ": 1, "Tj": 1, "'": 1, '"': 3, "Do": 1} | PATH_OPS | {k: 0 for k in PAINT} | TAG_OPS | {k: 1 for k in (*PLAIN, *NUMERIC)} | IDLE


_NUMBER = rb"[+-]?(?:[0-9]++\.?[0-9]*+|\.[0-9]++)"
_GAP = rb"[\t\n\f\r ]"
#: Numbers, or one string with its parentheses and backslashes escaped, and an operator. It ends where tokens end.
_PLAIN = re.compile(rb"%(g)s*+(?:((?:%(n)s%(g)s++)*+)|\(([^()\\\r]*+(?:\\[()\\][^()\\\r]*+)*+)\)%(g)s*+)([A-Za-z'\"][A-Za-z0-9*'\"]*+)(?=[\x00\t\n\f\r ()<>\[\]{}/%%]|$)" % {b"n": _NUMBER, b"g": _GAP})
_ESCAPED = re.compile(rb"\\([()\\])")
# Words that are no operators, or change how what follows is read.
_NOT_PLAIN = {b"true", b"false", b"null", b"R", b"BI", b"ID"}


def statements(data: bytes):
    """(operands, operator, None) of a content stream; an inline image comes as (operands, "EI", stream), operands after the last operator as (operands, None, None).

    Between operators nothing is held back, so that each statement can be read alone: plain ones by one expression, others by ``values``.
    """
    at = 0
    plain = _PLAIN.match
    while True:
        while (m := plain(data, at)) and m[3] not in _NOT_PLAIN:
            found, text, op = m.groups()
            at = m.end()
            if text is not None:
                yield [_ESCAPED.sub(rb"\1", text) if b"\\" in text else text], op.decode(), None
            else:
                yield [float(x) if "." in x else int(x) for x in found.decode().split()], op.decode(), None
        image = None
        held: list = []
        operands: list = []
        for _, value, stop in values(data, at):
            if type(value) is Op:
                if value == "BI":
                    image = held = []
                    continue
                if value == "ID" and image is not None:
                    attrs = {str(k): v for k, v in zip(held[::2], held[1::2], strict=False)}
                    body, at = _inline_data(data, stop + 1, attrs)
                    yield operands, "EI", Stream(attrs, body)
                    break
                yield operands, str(value), None
                operands = []
                if image is None:
                    at = stop
                    break
            elif image is not None:
                held.append(value)
            else:
                operands.append(value)
        else:
            if operands:
                yield operands, None, None
            return


def operators(data: bytes):
    """(None, operand) or (operator, None) of a content stream; an inline image comes as ("EI", stream)."""
    for operands, op, extra in statements(data):
        yield from ((None, x) for x in operands)
        if op is not None:
            yield op, extra


def _inline_data(data: bytes, at: int, attrs: dict) -> tuple[bytes, int]:
    """Bytes up to EI between white space, or up to the end mark of ASCII base-85 data."""
    filters = attrs.get("F", attrs.get("Filter"))
    first = filters[0] if isinstance(filters, list) and filters else filters
    if first in ("A85", "ASCII85Decode"):
        end = data.find(b"~>", at)
        end = len(data) if end < 0 else end + 2
        m = re.compile(rb"\s*EI(?=\s|$)").match(data, end)
        return data[at:end], m.end() if m else end
    m = re.compile(rb"(?:\r\n|\r|\n|(?<=[\x00-\xff]))EI(?=\s|$)").search(data, at)
    if m is None:
        return data[at:], len(data)
    return data[at : m.start()], m.end()
