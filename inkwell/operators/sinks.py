"""Text sinks: a page's rows to XML, HTML, hOCR, tagged text; images to files. Strings per page, so that a writer only has to put them in order."""

from __future__ import annotations

import html
import re
import struct
from dataclasses import dataclass

from inkwell.functions.filters import KEPT
from inkwell.functions.syntax import Stream

from .layout import Layout, Line, Node, Params, containers, layout

#: Characters below the blank that XML doesn't allow: all but tab, line feed and carriage return.
_CONTROL = re.compile(f"[{re.escape(''.join(chr(c) for c in range(32) if chr(c) not in '\t\n\r'))}]")


def box_text(b: tuple) -> str:
    return ",".join(f"{v:.3f}" for v in b)


def esc(s: str) -> str:
    return html.escape(s, True)


@dataclass
class PageTree:
    """A page and its figures, analysed; figures only where ``all_texts`` is set."""

    rows: list[dict]
    box: tuple
    number: int
    params: Params | None
    rotate: int = 0

    def __post_init__(self):
        self.held = containers(self.rows)

    def of(self, figure: dict | None) -> Layout:
        if figure is None:
            return layout(self.held.get(None, []), self.box, self.params)
        p = self.params if self.params is not None and self.params.all_texts else None
        return layout(self.held.get(figure["seq"], []), _box(figure), p)


def _box(r: dict) -> tuple:
    return (r["x0"], r["y0"], r["x1"], r["y1"])


# -- XML -------------------------------------------------------------------------------------------------------


def xml_page(page: PageTree, strip_control: bool = False, image_names: dict[int, str] | None = None) -> str:
    def glyph(g: dict) -> str:
        text = _CONTROL.sub("", g["text"]) if strip_control else g["text"]
        return f'<text font="{esc(g["font"])}" bbox="{box_text(_box(g))}" colourspace="{g["ncs"]}" ncolour="{g["ncolor"]}" size="{g["size"]:.3f}">{esc(text)}</text>\n'

    def line(x: Line) -> str:
        inner = "".join(("<text> </text>\n" if i in x.spaces else "") + glyph(g) for i, g in enumerate(x.glyphs))
        return f'<textline bbox="{box_text(x.box)}">\n{inner}<text>\n</text>\n</textline>\n'

    def item(r: dict) -> str:
        kind = r["kind"]
        if kind == "glyph":
            return glyph(r)
        if kind in ("line", "rect"):
            return f'<{kind} linewidth="{r["linewidth"]}" bbox="{box_text(_box(r))}" />\n'
        if kind == "curve":
            return f'<curve linewidth="{r["linewidth"]}" bbox="{box_text(_box(r))}" pts="{",".join("%.3f,%.3f" % tuple(p) for p in r["pts"])}"/>\n'
        if kind == "figure":
            return f'<figure name="{r["name"]}" bbox="{box_text(_box(r))}">\n{content(page.of(r))}</figure>\n'
        source = f'src="{esc(image_names[r["seq"]])}" ' if image_names and r["seq"] in image_names else ""
        return f'<image {source}width="{r["width"]}" height="{r["height"]}" />\n'

    def content(c: Layout) -> str:
        boxes = "".join(f'<textbox id="{b.index}" bbox="{box_text(b.box)}"{" wmode=" + chr(34) + "vertical" + chr(34) if b.vertical else ""}>\n' + "".join(map(line, b.lines)) + "</textbox>\n" for b in c.boxes)
        rest = c.glyphs if c.glyphs else c.others
        return boxes + "".join(map(item, rest)) + "".join(map(line, c.empties))

    def group(n: Node) -> str:
        if not n.parts:
            return f'<textbox id="{n.index}" bbox="{box_text(n.box)}" />\n'
        return f'<textgroup bbox="{box_text(n.box)}">\n{"".join(map(group, n.parts))}</textgroup>\n'

    top = page.of(None)
    groups = f"<layout>\n{''.join(map(group, top.groups))}</layout>\n" if top.groups else ""
    return f'<page id="{page.number}" bbox="{box_text(page.box)}" rotate="{page.rotate}">\n{content(top)}{groups}</page>\n'


def xml_document(pages: list[str], codec: str | None = "utf-8") -> str:
    encoding = f' encoding="{codec}"' if codec else ""
    return f'<?xml version="1.0"{encoding} ?>\n<pages>\n{"".join(pages)}</pages>\n'


# -- HTML ------------------------------------------------------------------------------------------------------

# Colours of borders and of text by what they belong to, in debugging output too.
BORDERS, DEBUG_BORDERS = {"curve": "black", "page": "gray"}, {"figure": "yellow", "textline": "magenta", "textbox": "cyan", "textgroup": "red", "curve": "black", "page": "gray"}
TEXTS, DEBUG_TEXTS = {"char": "black"}, {"textbox": "blue", "char": "black"}


def html_page(page: PageTree, top: float, scale: float = 1.0, fontscale: float = 1.0, mode: str = "normal", debug: bool = False, compat: bool = False, image_names: dict[int, str] | None = None) -> str:
    """``top``: where the page begins in the whole document. ``compat`` keeps a placeholder that was never filled in."""
    out: list[str] = []
    base = top + page.box[3]
    borders, colors = (BORDERS | DEBUG_BORDERS, TEXTS | DEBUG_TEXTS) if debug else (BORDERS, TEXTS)
    font: list[tuple | None] = [None]

    def place(b: tuple) -> str:
        return f"left:{b[0] * scale}px; top:{(base - b[3]) * scale}px; width:{(b[2] - b[0]) * scale}px; height:{(b[3] - b[1]) * scale}px;"

    def border(kind: str, b: tuple) -> None:
        if kind in borders:
            out.append(f'<span style="position:absolute; border: {borders[kind]} 1px solid; {place(b)}"></span>\n')

    def label(kind: str, text: str, x: float, y: float, size: float) -> None:
        if kind in colors:
            out.append(f'<span style="position:absolute; color:{colors[kind]}; left:{x * scale}px; top:{(base - y) * scale}px; font-size:{size * scale * fontscale}px;">{esc(text)}</span>\n')

    def division(kind: str, b: tuple, inside, writing: str = "False") -> None:
        font.append(None)
        out.append(f'<div style="position:absolute; border: {kind} 1px solid; writing-mode:{writing}; {place(b)}">')
        inside()
        out.append("</span>" if font.pop() is not None else "")
        out.append("</div>")

    def glyph(g: dict) -> None:
        if mode == "exact":
            border("char", _box(g))
            label("char", g["text"], g["x0"], g["y1"], g["size"])
            return
        mine = (g["font"], g["size"])
        if mine != font[-1]:
            out.append("</span>" if font[-1] is not None else "")
            out.append(f'<span style="font-family: {g["font"].split("+")[-1]}; font-size:{g["size"] * scale * fontscale}px">')
            font[-1] = mine
        out.append(esc(g["text"]))

    def line(x: Line) -> None:
        if mode == "exact":
            border("textline", x.box)
        for i, g in enumerate(x.glyphs):
            if i in x.spaces and mode != "exact":
                out.append(" ")
            glyph(g)
        if mode != "exact":
            out.append("\n")
        if mode == "normal":
            out.append("<br>")

    def item(r: dict) -> None:
        if r["kind"] == "glyph":
            glyph(r)
        elif r["kind"] in ("line", "rect", "curve"):
            border("curve", _box(r))
        elif r["kind"] == "figure":
            division("figure", _box(r), lambda: content(page.of(r)))
        elif image_names and r["seq"] in image_names:
            out.append(f'<img src="{esc(image_names[r["seq"]])}" border="1" style="position:absolute; left:{r["x0"] * scale}px; top:{(base - r["y1"]) * scale}px;" width="{(r["x1"] - r["x0"]) * scale}" height="{(r["y1"] - r["y0"]) * scale}" />\n')

    def content(c: Layout) -> None:
        for b in c.boxes:
            if mode == "exact":
                border("textbox", b.box)
                label("textbox", str(b.index + 1), b.box[0], b.box[3], 20)
                for x in b.lines:
                    line(x)
            else:
                division("textbox", b.box, lambda b=b: [line(x) for x in b.lines], "tb-rl" if b.vertical else "lr-tb")
        for r in c.glyphs or c.others:
            item(r)
        for x in c.empties:
            line(x)

    def group(n: Node) -> None:
        if n.parts:
            border("textgroup", n.box)
            for p in n.parts:
                group(p)

    border("page", page.box)
    offset = "%d" if compat else f"{(base - page.box[3]) * scale:g}"
    out.append(f'<div style="position:absolute; top:{offset}px;"><a name="{page.number}">Page {page.number}</a></div>\n')
    whole = page.of(None)
    content(whole)
    for n in whole.groups:
        group(n)
    return "".join(out)


def html_document(pages: list[str], codec: str | None = "utf-8") -> str:
    charset = f"; charset={codec}" if codec else ""
    links = ", ".join(f'<a href="#{i}">{i}</a>' for i in range(1, len(pages) + 1))
    return f'<html><head>\n<meta http-equiv="Content-Type" content="text/html{charset}">\n</head><body>\n{"".join(pages)}<div style="position:absolute; top:0px;">Page: {links}</div>\n</body></html>\n'


# -- hOCR ------------------------------------------------------------------------------------------------------


def words(x: Line) -> list[tuple[str, tuple, str, float, str]]:
    """(text, box, font, size, white space after it) of a line: a word ends at white space, an inserted space, or another baseline, font or size."""
    out: list[list] = []
    open_ = False
    for i, g in enumerate(x.glyphs):
        if i in x.spaces:
            open_ = False
        if open_ and not g["text"].strip():
            out[-1][4] += g["text"]
            open_ = False
            continue
        same = open_ and out[-1][1][1] == g["y0"] and out[-1][2] == g["font"] and out[-1][3] == g["size"]
        if same:
            w = out[-1]
            w[0] += g["text"]
            w[1] = (w[1][0], w[1][1], g["x1"], w[1][3])
        else:
            out.append([g["text"], _box(g), g["font"], g["size"], ""])
        open_ = True
    return [tuple(w) for w in out]


def hocr_page(page: PageTree) -> str:
    high = page.box[3]

    def title(b: tuple) -> str:
        return f"bbox {int(b[0])} {int(high - b[3])} {int(b[2])} {int(high - b[1])}"

    def word(w: tuple) -> str:
        text, b, font, size, after = w
        style = ("font-style: italic; " if "Italic" in font else "") + ("font-weight: bold; " if "Bold" in font else "")
        return f"<span style='font:\"{font}\"; font-size:{size}; {style}' class='ocrx_word' title='{title(b)}; x_font {font}; x_fsize {size}'>{text.strip()}</span>{after}"

    def line(x: Line) -> str:
        return f"<span class='ocr_line' title='{title(x.box)}'>{''.join(map(word, words(x)))}</span>\n"

    c = page.of(None)
    blocks = "".join(f"<div class='ocr_block' id='{b.index}' title='{title(b.box)}'>\n{''.join(map(line, b.lines))}</div>\n" for b in c.boxes)
    return f"<div class='ocr_page' id='{page.number}' title='{title(page.box)}'>\n{blocks}{''.join(map(line, c.empties))}</div>\n"


def hocr_document(pages: list[str], codec: str | None = "utf-8") -> str:
    charset = f" charset='{codec}'" if codec else ""
    head = f"<html xmlns='http://www.w3.org/1999/xhtml' xml:lang='en' lang='en'{charset}>\n<head>\n<title></title>\n<meta http-equiv='Content-Type' content='text/html;charset=utf-8' />\n<meta name='ocr-system' content='inkwell' />\n<meta name='ocr-capabilities' content='ocr_page ocr_block ocr_line ocrx_word'/>\n</head>\n<body>\n"
    return head + "".join(pages) + "</body></html>\n"


# -- tagged text -----------------------------------------------------------------------------------------------


def tag_page(rows: list[dict], tags: list[dict], number: int, media: tuple, rotate: int) -> str:
    """Text between marks of the content; glyphs without a character are left out."""
    out, open_, at = [f'<page id="{number}" bbox="{box_text(media)}" rotate="{rotate}">'], [], 0

    def text(stop: int) -> str:
        return esc("".join(r["text"] for r in rows[at:stop] if r["kind"] == "glyph" and not r["undefined"]))

    for t in sorted(tags, key=lambda t: t["seq"]):
        out.append(text(t["seq"]))
        at = t["seq"]
        if t["event"] == "end":
            if open_:
                out.append(f"</{esc(open_.pop())}>")
        else:
            props = "".join(f' {esc(k)}="{v}"' for k, v in sorted(t["props"].items()))
            out.append(f"<{esc(t['tag'] or '')}{props}>")
            if t["event"] == "begin":
                open_.append(t["tag"] or "")
    out.append(text(len(rows)))
    return "".join(out) + "</page>\n"


# -- images ----------------------------------------------------------------------------------------------------


def bitmap(bits: int, width: int, height: int, data: bytes) -> bytes:
    """A BMP file of 1, 8 or 24 bits a pixel, rows from the bottom up, each filled to four bytes."""
    line = (width * bits + 7) // 8
    padded = -(-line // 4) * 4
    colors = {1: 2, 8: 256, 24: 0}[bits]
    start = 14 + 40 + 4 * colors
    head = struct.pack("<2sIHHI", b"BM", start + padded * height, 0, 0, start) + struct.pack("<IiiHHIIIIII", 40, width, height, 1, bits, 0, padded * height, 0, 0, colors, 0)
    palette = b"".join(bytes([v, v, v, 0]) for v in ((0, 255) if bits == 1 else range(256))) if colors else b""
    rows = [data[y * line : (y + 1) * line].ljust(padded, b"\0") for y in range(height)]
    return head + palette + b"".join(reversed(rows))


def _swap(data: bytes) -> bytes:
    out = bytearray(data)
    out[0::3], out[2::3] = data[2::3], data[0::3]
    return bytes(out)


# Fixed values of the format: the head of a JBIG2 file with sequential organisation and one page.
JBIG2_HEAD = b"\x97JB2\r\n\x1a\n\x01" + struct.pack(">L", 1)


def jbig2_segments(data: bytes) -> list[tuple[int, int, bytes, bytes]]:
    """(number, type, header, data) of each segment."""
    out, at = [], 0
    while at + 6 <= len(data):
        begin = at
        number, flags = struct.unpack(">LB", data[at : at + 5])
        at += 5
        refs = data[at] >> 5
        if refs == 7:
            refs = struct.unpack(">L", data[at : at + 4])[0] & 0x1FFFFFFF
            at += 4 + (refs + 8) // 8
        else:
            at += 1
        at += refs * (1 if number <= 256 else 2 if number <= 65536 else 4) + (4 if flags & 0x40 else 1)
        length = struct.unpack(">L", data[at : at + 4])[0]
        at += 4
        length = len(data) - at if length == 0xFFFFFFFF else length
        out.append((number, flags & 63, data[begin:at], data[at : at + length]))
        at += length
    return out


def jbig2_file(data: bytes, shared: bytes = b"") -> bytes:
    """A file of the shared segments and a page's, with an end of page if it lacks one, and an end of file."""
    segments = jbig2_segments(shared) + jbig2_segments(data)
    last = max((s[0] for s in segments), default=-1)
    body = b"".join(s[2] + s[3] for s in segments)
    if not any(s[1] == 49 for s in segments):
        last += 1
        body += struct.pack(">LBBBL", last, 49, 0, 1, 0)
    return JBIG2_HEAD + body + struct.pack(">LBBBL", last + 1, 51, 0, 0, 0)


def image_file(doc, row: dict) -> tuple[str, bytes]:
    """(extension, bytes) of an image row. JPEG and JPEG 2000 stay as they are."""
    stream: Stream = row["stream"]
    filters = row["filters"]
    data = doc.decoded(stream)
    last = filters[-1] if filters else None
    if last in ("DCTDecode", "DCT"):
        return ".jpg", data
    if last == "JPXDecode":
        return ".jp2", data
    if last == "JBIG2Decode":
        params = [p for n, p in doc.chain(stream.attrs) if n == "JBIG2Decode"]
        shared = doc.value(params[0].get("JBIG2Globals")) if params else None
        return ".jb2", jbig2_file(data, doc.decoded(shared) if isinstance(shared, Stream) else b"")
    assert last not in KEPT
    width, height, bits, space = row["width"], row["height"], row["bits"], row["colorspace"]
    if bits == 1:
        return ".bmp", bitmap(1, width, height, data)
    if bits == 8 and "DeviceRGB" in space:
        return ".bmp", bitmap(24, width, height, _swap(data))
    if bits == 8 and "DeviceGray" in space:
        return ".bmp", bitmap(8, width, height, data)
    return f".{bits}.{width}x{height}.img", data
