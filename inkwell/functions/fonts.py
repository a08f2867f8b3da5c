"""Fonts as look-ups: bytes to character ids, ids to text, widths and vertical displacements."""

from __future__ import annotations

import gzip
import json
import os
import re
import struct
from dataclasses import dataclass, field
from typing import Any

from .encodings import base_metrics, encoding, with_differences
from .syntax import Name, Op, Stream, tokens, values

# Identity maps, and other names of the same.
TWO_BYTE = {"Identity-H": False, "Identity-V": True, "DLIdent-H": False, "DLIdent-V": True}
ONE_BYTE = {"OneByteIdentityH": False, "OneByteIdentityV": True}


@dataclass
class Font:
    name: str = "unknown"
    ascent: float = 0.0
    descent: float = 0.0
    scale: tuple[float, float] = (0.001, 0.001)
    widths: dict[Any, float] = field(default_factory=dict)
    default_width: float = 0.0
    unicode: dict[int, str] = field(default_factory=dict)
    simple: bool = True
    vertical: bool = False
    code_bytes: int = 1
    cmap: dict[bytes, int] | None = None
    shifts: dict[int, tuple[float | None, float]] = field(default_factory=dict)
    default_shift: tuple[float | None, float] = (None, 880.0)

    def ids(self, data: bytes) -> list[int]:
        """Character ids of a string; a byte that no longer code begins with is dropped, as is an odd tail of two-byte codes."""
        if self.cmap is not None:
            out, code = [], b""
            starts = {k[:i] for k in self.cmap for i in range(1, len(k))}
            for i in range(len(data)):
                code += data[i : i + 1]
                if code in self.cmap:
                    out.append(self.cmap[code])
                    code = b""
                elif code not in starts:
                    code = b""
            return out
        if self.code_bytes == 2:
            return list(struct.unpack(f">{len(data) // 2}H", data[: len(data) // 2 * 2]))
        return list(data)

    def width(self, cid: int) -> float:
        w = self.widths.get(cid)
        if w is None and cid in self.unicode:
            w = self.widths.get(self.unicode[cid])
        return (self.default_width if w is None else w) * self.scale[0]

    def string_width(self, data: bytes) -> float:
        """Advance of a string at size 1, without spacing."""
        return sum(map(self.width, self.ids(data)))

    def text(self, cid: int) -> str | None:
        return self.unicode.get(cid)


def _number(x: Any) -> float | None:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


def expand_widths(items: list) -> dict[int, float]:
    """``c [w …]`` and ``first last w`` runs."""
    out: dict[int, float] = {}
    held: list = []
    for x in items:
        if isinstance(x, list):
            if held:
                out.update({held[-1] + i: w for i, w in enumerate(map(_number, x)) if w is not None})
                held = []
        elif _number(x) is not None:
            held.append(x)
            if len(held) == 3:
                out.update(dict.fromkeys(range(int(held[0]), int(held[1]) + 1), float(held[2])))
                held = []
    return out


def expand_vertical(items: list) -> dict[int, tuple[float, tuple[float, float]]]:
    """``c [w vx vy …]`` and ``first last w vx vy`` runs."""
    out: dict[int, tuple[float, tuple[float, float]]] = {}
    held: list = []
    for x in items:
        if isinstance(x, list):
            if held:
                out.update({held[-1] + i // 3: (x[i], (x[i + 1], x[i + 2])) for i in range(0, len(x) - 2, 3)})
                held = []
        elif _number(x) is not None:
            held.append(x)
            if len(held) == 5:
                out.update(dict.fromkeys(range(int(held[0]), int(held[1]) + 1), (held[2], (held[3], held[4]))))
                held = []
    return out


def _utf16(x: Any) -> str | None:
    if isinstance(x, bytes):
        return x.decode("utf-16-be", "ignore")
    if isinstance(x, Name):
        from .encodings import glyph_text

        return glyph_text(x)
    return chr(x) if isinstance(x, int) and 0 <= x < 0x110000 else None


def unicode_map(data: bytes) -> dict[int, str]:
    """ToUnicode: bfchar and bfrange sections, and cid ranges read as code points. A no-break space never replaces a space."""
    out: dict[int, str] = {}

    def put(cid: int, text: str | None):
        if text is not None and not (text == " " and out.get(cid) == " "):
            out[cid] = text

    section, items = None, []
    for _, value, _ in values(data):
        if type(value) is Op and value.startswith("begin"):
            section, items = str(value)[5:], []
        elif type(value) is Op and value.startswith("end") and section is not None:
            if section == "bfchar":
                for code, text in zip(items[::2], items[1::2], strict=False):
                    if isinstance(code, bytes):
                        put(int.from_bytes(code, "big"), _utf16(text))
            elif section in ("bfrange", "cidrange"):
                for lo, hi, first in zip(items[::3], items[1::3], items[2::3], strict=False):
                    if not (isinstance(lo, bytes) and isinstance(hi, bytes)) or len(lo) != len(hi):
                        continue
                    start, stop = int.from_bytes(lo, "big"), int.from_bytes(hi, "big")
                    if isinstance(first, list):
                        for i, text in enumerate(first[: stop - start + 1]):
                            put(start + i, _utf16(text))
                    elif isinstance(first, bytes):
                        tail = first[-4:]
                        for i in range(min(stop - start, 0xFFFF) + 1):
                            put(start + i, _utf16(first[:-4] + ((int.from_bytes(tail, "big") + i) & (1 << 8 * len(tail)) - 1).to_bytes(len(tail), "big")))
                    elif isinstance(first, int) and section == "cidrange":
                        for i in range(min(stop - start, 0xFFFF) + 1):
                            put(first + i, _utf16(start + i))
            section = None
        elif section is not None:
            items.append(value)
    return out


def header_encoding(data: bytes) -> dict[int, str]:
    """``dup N /name put`` of a Type 1 font program's clear part."""
    from .encodings import glyph_text

    held, out = [], {}
    for _, value, _ in tokens(data):
        if type(value) is Op and value == "put":
            if len(held) >= 2 and isinstance(held[-1], Name) and isinstance(held[-2], int):
                text = glyph_text(held[-1])
                if text is not None:
                    out[held[-2]] = text
            held = []
        else:
            held = [*held[-3:], value]
    return out


def truetype_map(data: bytes) -> dict[int, str] | None:
    """Glyph index to character from the font program's character map (formats 0, 2, 4, 6, 10, 12); None if it has none."""
    try:
        count = struct.unpack(">H", data[4:6])[0]
        tables = {data[12 + 16 * i : 16 + 16 * i]: struct.unpack(">II", data[20 + 16 * i : 28 + 16 * i]) for i in range(count)}
        base, _ = tables[b"cmap"]
        out: dict[int, str] = {}
        for i in range(struct.unpack(">H", data[base + 2 : base + 4])[0]):
            platform, kind, at = struct.unpack(">HHI", data[base + 4 + 8 * i : base + 12 + 8 * i])
            if platform == 0 or (platform == 3 and kind in (1, 10)):
                for code, glyph in _subtable(data, base + at):
                    if glyph:
                        out.setdefault(glyph, chr(code))
        return out or None
    except (struct.error, KeyError, ValueError, IndexError):
        return None


def _subtable(data: bytes, at: int):
    def words(start: int, n: int) -> tuple[int, ...]:
        return struct.unpack(f">{n}H", data[start : start + 2 * n])

    kind = words(at, 1)[0]
    if kind == 0:
        yield from enumerate(data[at + 6 : at + 262])
    elif kind == 2:
        keys = words(at + 6, 256)
        for high, key in enumerate(keys):
            head = at + 518 + key
            first, n, delta, offset = struct.unpack(">HHhH", data[head : head + 8])
            for j in range(n):
                glyph = words(head + 6 + offset + 2 * j, 1)[0]
                yield (high << 8 if key else 0) | (first + j), (glyph + delta) & 0xFFFF if glyph else 0
    elif kind == 4:
        n = words(at + 6, 1)[0] // 2
        ends, starts, deltas, offsets = (words(at + 14 + 2 * n * k + 2 * (k > 0), n) for k in range(4))
        for i in range(n):
            for code in range(starts[i], min(ends[i], 0xFFFE) + 1):
                if offsets[i]:
                    glyph = words(at + 16 + 6 * n + 2 * i + offsets[i] + 2 * (code - starts[i]), 1)[0]
                    yield code, (glyph + deltas[i]) & 0xFFFF if glyph else 0
                else:
                    yield code, (code + deltas[i]) & 0xFFFF
    elif kind == 6:
        first, n = words(at + 6, 2)
        yield from enumerate(words(at + 10, n), first)
    elif kind == 10:
        first, n = struct.unpack(">II", data[at + 12 : at + 20])
        yield from enumerate(words(at + 20, n), first)
    elif kind == 12:
        n = struct.unpack(">I", data[at + 12 : at + 16])[0]
        for i in range(n):
            lo, hi, glyph = struct.unpack(">III", data[at + 16 + 12 * i : at + 28 + 12 * i])
            yield from ((c, glyph + c - lo) for c in range(lo, min(hi, lo + 0xFFFF) + 1))


def cmap_resource(name: str) -> dict | None:
    """A predefined map as JSON from the folder in CMAP_PATH; names with path separators are refused."""
    folder = os.environ.get("CMAP_PATH")
    if not folder or not re.fullmatch(r"[A-Za-z0-9_.-]+", name):
        return None
    for path in (os.path.join(folder, f"{name}.json.gz"), os.path.join(folder, f"{name}.json")):
        if os.path.exists(path):
            with (gzip.open if path.endswith(".gz") else open)(path, "rt") as f:
                return json.load(f)
    return None


def code_map(found: dict | None, depth: int = 0) -> dict[bytes, int]:
    """Codes of a predefined map over those of the map that it uses, if it names one."""
    if not found or depth > 10:
        return {}
    below = code_map(cmap_resource(found["USECMAP"]), depth + 1) if isinstance(found.get("USECMAP"), str) else {}
    return below | _flat(found.get("CODE2CID", {}))


def _flat(tree: dict, before: bytes = b"") -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for k, v in tree.items():
        code = before + bytes([int(k)])
        out.update(_flat(v, code) if isinstance(v, dict) else {code: v})
    return out


def load_font(doc, spec: dict) -> Font:
    """A font of a resource dictionary, whatever its subtype; an unknown one reads as Type 1."""
    kind = doc.value(spec.get("Subtype"))
    if kind == "Type0":
        below = doc.list(spec.get("DescendantFonts"))
        own = dict(doc.dict(below[0])) if below else {}
        own |= {k: spec[k] for k in ("Encoding", "ToUnicode") if k in spec}
        return _cid_font(doc, own)
    if kind in ("CIDFontType0", "CIDFontType2"):
        return _cid_font(doc, spec)
    return _simple_font(doc, spec, kind)


def _describe(doc, font: Font, descriptor: dict) -> None:
    font.ascent, font.descent = float(doc.number(descriptor.get("Ascent"))), -abs(float(doc.number(descriptor.get("Descent"))))
    name = doc.value(descriptor.get("FontName"))
    if name is not None:
        font.name = name.decode("latin-1") if isinstance(name, bytes) else str(name)


def _simple_font(doc, spec: dict, kind: Any) -> Font:
    base = str(doc.value(spec.get("BaseFont", "unknown")))
    font = Font()
    descriptor = doc.dict(spec.get("FontDescriptor"))
    metrics = base_metrics(base) if kind != "Type3" else None
    if metrics:
        font.widths, font.ascent, font.descent = dict(metrics[0]), metrics[1], metrics[2]
        font.name = base
    else:
        first = doc.int(spec.get("FirstChar"))
        listed = doc.list(spec.get("Widths")) if "Widths" in spec else [0] * 256
        font.widths = {first + i: w for i, w in enumerate(_number(doc.value(x)) for x in listed) if w is not None}
        font.default_width = float(doc.number(descriptor.get("MissingWidth")))
        _describe(doc, font, descriptor)
    if kind == "Type3":
        matrix = [float(doc.number(x)) for x in doc.list(spec.get("FontMatrix"))]
        box = doc.box(descriptor.get("FontBBox", spec.get("FontBBox"))) or (0, 0, 0, 0)
        font.descent, font.ascent = box[1], box[3]
        if len(matrix) == 6:
            font.scale = (matrix[0] + matrix[2], matrix[1] + matrix[3])
    enc = doc.value(spec.get("Encoding"))
    default = "WinAnsiEncoding" if kind == "TrueType" else "StandardEncoding"
    if isinstance(enc, dict):
        font.unicode = with_differences(str(doc.value(enc.get("BaseEncoding", default))), [doc.value(x) for x in doc.list(enc.get("Differences"))])
    else:
        font.unicode = dict(encoding(str(enc) if enc is not None else default))
    program = doc.value(descriptor.get("FontFile"))
    if enc is None and not metrics and isinstance(program, Stream):
        font.unicode = header_encoding(doc.decoded(program)[: doc.int(program.attrs.get("Length1")) or None])
    extra = doc.value(spec.get("ToUnicode"))
    if isinstance(extra, Stream):
        font.unicode = font.unicode | unicode_map(doc.decoded(extra))
    return font


def _cid_font(doc, spec: dict) -> Font:
    font = Font(simple=False, code_bytes=2)
    system = doc.dict(spec.get("CIDSystemInfo"))
    part = [v.decode("latin-1").strip() if isinstance(v := doc.value(system.get(k)), bytes) else "unknown" for k in ("Registry", "Ordering")]
    enc = doc.value(spec.get("Encoding"))
    name = str(doc.value(enc.attrs.get("CMapName"))) if isinstance(enc, Stream) else str(doc.value(enc.get("CMapName"))) if isinstance(enc, dict) else str(enc)
    if name in TWO_BYTE:
        font.vertical = TWO_BYTE[name]
    elif name in ONE_BYTE:
        font.vertical, font.code_bytes = ONE_BYTE[name], 1
    else:
        found = cmap_resource(name)
        font.cmap = code_map(found)
        font.vertical = bool(found.get("IS_VERTICAL")) if found else False
    descriptor = doc.dict(spec.get("FontDescriptor"))
    _describe(doc, font, descriptor)
    extra, ordering = doc.value(spec.get("ToUnicode")), "-".join(part)
    if isinstance(extra, Stream):
        font.unicode = unicode_map(doc.decoded(extra))
    elif isinstance(extra, str):
        if any("Identity" in x for x in (part[1], extra, name)):
            font.unicode = _Identity()
    elif ordering in ("Adobe-Identity", "Adobe-UCS"):
        program = doc.value(descriptor.get("FontFile2"))
        font.unicode = (truetype_map(doc.decoded(program)) if isinstance(program, Stream) else None) or {}
    elif found := cmap_resource(f"to-unicode-{ordering}"):
        table = found.get("CID2UNICHR_V" if font.vertical else "CID2UNICHR_H", {})
        font.unicode = {int(k): v for k, v in table.items()}
    if font.vertical:
        runs = expand_vertical(doc.plain(doc.list(spec.get("W2"))))
        dw = doc.list(spec.get("DW2")) or [880, -1000]
        font.widths = {c: w for c, (w, _) in runs.items()}
        font.shifts = {c: v for c, (_, v) in runs.items()}
        font.default_shift, font.default_width = (None, doc.number(dw[0])), float(doc.number(dw[1]))
    else:
        font.widths = expand_widths(doc.plain(doc.list(spec.get("W"))))
        font.default_width = float(doc.number(spec["DW"])) if "DW" in spec else 1000.0
    return font


class _Identity(dict):
    def get(self, cid, default=None):
        return chr(cid) if 0 <= cid < 0x110000 else default

    def __contains__(self, cid):
        return 0 <= cid < 0x110000

    def __getitem__(self, cid):
        return chr(cid)
