"""PDF files as tables.

``read_pdf`` scans a path with Spark's binary file reader (any store that Spark can read) and parses each file in one Arrow-batched
function; page numbers, page limits and the tables' columns are applied while parsing. ``PdfSource`` is the same as a
registered data source, ``spark.read.format("pdf")``. Parsing is permissive: what can't be read gives a row whose ``error`` says why, unless ``strict``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, fields
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from inkwell.functions.syntax import Stream
from inkwell.operators import runs, sinks
from inkwell.operators.interpret import Interpreter, drawn_text, page_box
from inkwell.operators.layout import Params, containers, layout, page_text
from inkwell.sources.document import Document, tagged, text_string

_BOX = "x0 double, y0 double, x1 double, y1 double"
#: Columns of each table after doc_id; the last one of all is ``error``.
TABLES = {
    "docs": "pages int, objects int, encrypted boolean, printable boolean, modifiable boolean, extractable boolean, info string, catalog string",
    "xref": "section int, kind string, objid long, container long, pos long, gen int",
    "trailers": "section int, kind string, value string",
    "objects": "objid long, gen int, value string, raw binary, data binary",
    "pages": "page_no int, objid long, label string, width double, height double, rotate int, mediabox array<double>, cropbox array<double>, resources string, annots string, contents binary",
    "glyphs": f"page_no int, seq long, figure array<int>, cid int, text string, {_BOX}, matrix array<double>, font string, fontsize double, size double, adv double, upright boolean, vertical boolean, ncs string, ncolor string, scolor string",
    "paths": f"page_no int, seq long, figure array<int>, kind string, {_BOX}, linewidth double, pts array<array<double>>, stroke boolean, fill boolean, evenodd boolean, ncolor string, scolor string, original string, dash string",
    "figures": f"page_no int, seq long, figure array<int>, name string, {_BOX}, matrix array<double>",
    "images": f"page_no int, seq long, figure array<int>, name string, {_BOX}, width int, height int, bits int, imagemask boolean, colorspace array<string>, filters array<string>, extension string, data binary",
    "tags": "page_no int, seq long, event string, tag string, props map<string,string>",
    "text_lines": f"page_no int, box_id int, line_id int, vertical boolean, {_BOX}, text string",
    "text_boxes": f"page_no int, box_id int, vertical boolean, {_BOX}, text string",
    "text_groups": f"page_no int, group_id int, parent_id int, vertical boolean, box_id int, {_BOX}",
    "outlines": "seq int, level int, title string, dest string, action string, page_no int",
    "labels": "start int, style string, prefix string, first int",
    "names": "name string, value string, page_no int",
    "fields": "name string, value string",
    "attachments": "objid long, name string, data binary",
    "text": "page_no int, text string",
    "xml": "page_no int, text string",
    "html": "page_no int, text string",
    "hocr": "page_no int, text string",
    "tagged": "page_no int, text string",
}


@dataclass(frozen=True)
class Options:
    password: str = ""
    page_numbers: tuple[int, ...] = ()
    maxpages: int = 0
    rotation: int = 0
    layout: bool = True
    line_overlap: float = 0.5
    char_margin: float = 2.0
    line_margin: float = 0.5
    word_margin: float = 0.1
    boxes_flow: float | None = 0.5
    detect_vertical: bool = False
    all_texts: bool = False
    strip_control: bool = False
    scale: float = 1.0
    layoutmode: str = "normal"
    check_extractable: bool = False
    strict: bool = False
    compat: bool = False
    page_block: int = 0
    image_names: bool = False
    undefined: str | None = None

    @property
    def params(self) -> Params | None:
        return Params(self.line_overlap, self.char_margin, self.line_margin, self.word_margin, self.boxes_flow, self.detect_vertical, self.all_texts) if self.layout else None

    @staticmethod
    def parse(given: dict[str, Any]) -> Options:
        """From option strings or values; unknown names are refused."""
        known = {f.name.lower(): f for f in fields(Options)}
        out = {}
        for k, v in given.items():
            f = known.get(k.lower())
            if f is None:
                raise ValueError(f"unknown option {k}")
            if isinstance(v, str) and f.name not in ("password", "undefined"):
                if f.name == "page_numbers":
                    v = tuple(int(x) for x in v.split(",") if x.strip())
                elif f.name == "boxes_flow":
                    v = None if v.lower() in ("none", "disabled") else float(v)
                elif f.name != "layoutmode":
                    v = v.lower() == "true" if isinstance(f.default, bool) else type(f.default)(v)
            out[f.name] = tuple(v) if f.name == "page_numbers" else v
        return Options(**out)


def ddl_of(table: str) -> str:
    return f"doc_id string, {TABLES[table]}, error string"


def columns_of(table: str) -> list[str]:
    """Columns between doc_id and error."""
    return [c.split()[0] for c in re.sub(r"<[^ ]*>", "", TABLES[table]).split(",")]


def width_of(table: str) -> int:
    return len(columns_of(table))


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(ddl_of(table))


def selected(numbers: Iterator[int], o: Options) -> Iterator[int]:
    """Page indices asked for. The limit counts pages of the file and is looked at after a page that was taken."""
    for i in numbers:
        if o.page_numbers and i not in o.page_numbers:
            continue
        yield i
        if o.maxpages and o.maxpages <= i + 1:
            return


def _json(x: Any) -> str | None:
    return None if x is None else json.dumps(tagged(x))


def _color(x: Any) -> str | None:
    return None if x is None else json.dumps(x)


class _Rows:
    """Rows of a table from one file, or from a block of its pages that begins at ``start``."""

    def __init__(self, data: bytes, o: Options, start: int | None = None):
        self.block = None if start is None else range(start, start + o.page_block)
        self.o, self.doc = o, Document(data, o.password, o.strict, o.compat)
        if o.check_extractable and self.doc.handler is not None and not self.doc.handler.extractable:
            raise PermissionError("text extraction is not allowed")

    def _pages(self) -> Iterator[tuple[int, int | None, dict]]:
        pages = list(self.doc.pages())
        for i in selected(iter(range(len(pages))), self.o):
            if self.block is None or i in self.block:
                yield i, *pages[i]

    def _items(self, packed: bool = False):
        interpreter = Interpreter(self.doc, self.o.undefined, packed)
        for i, _, page in self._pages():
            yield i, page, interpreter.page(page, self.o.rotation)

    def docs(self):
        h = self.doc.handler
        info = [{k: text_string(v) if isinstance(v, bytes) else str(v) for k, v in self.doc.plain(d).items()} for d in self.doc.info]
        allowed = (h.printable, h.modifiable, h.extractable) if h else (True, True, True)
        yield sum(1 for _ in self.doc.pages()), len(self.doc.numbers()), h is not None, *allowed, json.dumps(info), _json(self.doc.root)

    def xref(self):
        for n, s in enumerate(self.doc.sections):
            for num, (container, pos, gen) in sorted(s.entries.items()):
                yield n, s.kind, num, container, pos, gen

    def trailers(self):
        for n, s in enumerate(self.doc.sections):
            yield n, s.kind, _json(s.trailer)

    def objects(self):
        for num in self.doc.numbers():
            value = self.doc.get(num)
            gen = next(s.entries[num][2] for s in self.doc.sections if num in s.entries)
            stream = isinstance(value, Stream)
            yield num, gen, _json(value), value.raw if stream else None, self.doc.decoded(value) if stream else None

    def pages(self):
        ranges = self.doc.label_ranges()
        for i, num, page in self._pages():
            box, turn, _ = page_box(self.doc, page, self.o.rotation)
            mine = [r for r in ranges if r[0] <= i]
            label = label_text(*mine[-1][1:], i - mine[-1][0]) if mine else None
            boxes = [list(b) if b else None for b in (self.doc.box(page.get("MediaBox")), self.doc.box(page.get("CropBox")))]
            yield i, num, label, float(box[2]), float(box[3]), turn, *boxes, _json(page.get("Resources")), _json(page.get("Annots")), b"\n".join(map(self.doc.decoded, self.doc.contents(page)))

    def _drawn(self, *kinds: str):
        for i, _, items in self._items():
            for r in items.rows:
                if r["kind"] in kinds:
                    yield i, r

    def glyphs(self):
        for i, r in self._drawn("glyph"):
            yield self._glyph(i, r)

    def packed_glyphs(self):
        """(page, row of glyphs() or Run), for batches of columns."""
        for i, _, items in self._items(packed=True):
            for r in items.rows:
                if type(r) is runs.Run:
                    if r.count <= runs.BATCH_GLYPHS:
                        yield i, r
                    else:
                        yield from ((i, part) for part in runs.parts(r, runs.BATCH_GLYPHS))
                elif r["kind"] == "glyph":
                    yield i, self._glyph(i, r)

    @staticmethod
    def _glyph(i: int, r: dict) -> tuple:
        return i, r["seq"], list(r["figure"]), r["cid"], r["text"], r["x0"], r["y0"], r["x1"], r["y1"], list(r["matrix"]), r["font"], r["fontsize"], r["size"], r["adv"], r["upright"], r["vertical"], r["ncs"], _color(r["ncolor"]), _color(r["scolor"])

    def paths(self):
        for i, r in self._drawn("line", "rect", "curve"):
            yield i, r["seq"], list(r["figure"]), r["kind"], r["x0"], r["y0"], r["x1"], r["y1"], float(r["linewidth"]), [list(map(float, p)) for p in r["pts"]], r["stroke"], r["fill"], r["evenodd"], _color(r["ncolor"]), _color(r["scolor"]), json.dumps(r["original"]), _json(list(r["dash"])) if r["dash"] else None

    def figures(self):
        for i, r in self._drawn("figure"):
            yield i, r["seq"], list(r["figure"]), r["name"], r["x0"], r["y0"], r["x1"], r["y1"], list(r["matrix"])

    def _image_names(self):
        """Gives an image a name that no other image of the file has."""
        used: dict[str, int] = {}  # names, with the number that the next image of the name gets

        def name(r: dict) -> str:
            given = r["name"]
            while given in used:
                n = used[r["name"]]
                used[r["name"]], given = n + 1, f"{r['name']}.{n}"
            used[given] = 0
            return given

        return name

    def images(self):
        name = self._image_names()
        for i, r in self._drawn("image"):
            extension, data = sinks.image_file(self.doc, r)
            yield i, r["seq"], list(r["figure"]), name(r), r["x0"], r["y0"], r["x1"], r["y1"], r["width"], r["height"], r["bits"], r["imagemask"], r["colorspace"], r["filters"], extension, data

    def tags(self):
        for i, _, items in self._items():
            for t in items.tags:
                yield i, t["seq"], t["event"], t["tag"], t["props"]

    def _layouts(self):
        """(page, layouts): of the page and, with ``all_texts``, of its figures in drawing order."""
        for i, _, items in self._items():
            held = containers(items.rows)
            found = [layout(held.get(None, []), items.box, self.o.params)]
            if self.o.all_texts:
                found += [layout(held.get(r["seq"], []), (r["x0"], r["y0"], r["x1"], r["y1"]), self.o.params) for r in items.rows if r["kind"] == "figure"]
            yield i, found

    def text_lines(self):
        for i, found in self._layouts():
            n = before = 0
            for page in found:
                for b, lines in [*((before + k, box.lines) for k, box in enumerate(page.boxes)), (None, page.empties)]:
                    for x in lines:
                        yield i, b, n, x.vertical, *map(float, x.box), x.text + "\n"
                        n += 1
                before += len(page.boxes)

    def text_boxes(self):
        for i, found in self._layouts():
            for k, b in enumerate(b for page in found for b in page.boxes):
                yield i, k, b.vertical, *map(float, b.box), b.text

    def text_groups(self):
        for i, found in self._layouts():
            count = before = 0
            for page in found:
                stack: list[tuple] = [(g, None) for g in reversed(page.groups)]
                while stack:
                    node, parent = stack.pop()
                    yield i, count, parent, node.vertical, before + node.index if not node.parts else None, *map(float, node.box)
                    stack.extend((p, count) for p in reversed(node.parts))
                    count += 1
                before += len(page.boxes)

    def outlines(self):
        numbers = {num: i for i, (num, _) in enumerate(self.doc.pages()) if num is not None}
        names = dict(self.doc.destinations())
        for n, (level, title, dest, action, _) in enumerate(self.doc.outline()):
            yield n, level, title, _json(dest), _json(action), self.doc.page_of(dest if dest is not None else action, numbers, names)

    def labels(self):
        yield from self.doc.label_ranges()

    def names(self):
        numbers = {num: i for i, (num, _) in enumerate(self.doc.pages()) if num is not None}
        for name, value in self.doc.destinations():
            yield text_string(name), _json(self.doc.value(value)), self.doc.page_of(value, numbers)

    def fields(self):
        for name, value in self.doc.form_fields():
            yield name, value if isinstance(value, str) or value is None else json.dumps(tagged(value))

    def attachments(self):
        yield from self.doc.attachments()

    def text(self):
        for i, _, items in self._items():
            yield i, page_text(items.rows, items.box, self.o.params)

    def _trees(self):
        """(page, its tree, names of its images as files where ``image_names`` asks for them)."""
        name = self._image_names()
        for n, (i, _, items) in enumerate(self._items()):
            images = {r["seq"]: name(r) + sinks.image_file(self.doc, r)[0] for r in items.rows if r["kind"] == "image"} if self.o.image_names else None
            yield i, sinks.PageTree(items.rows, items.box, n + 1, self.o.params), images

    def xml(self):
        for i, tree, images in self._trees():
            yield i, sinks.xml_page(tree, self.o.strip_control, images)

    def html(self):
        top = 50.0
        for i, tree, images in self._trees():
            yield i, sinks.html_page(tree, top, self.o.scale, mode=self.o.layoutmode, compat=self.o.compat, image_names=images)
            top += tree.box[3] + 50.0

    def hocr(self):
        for i, tree, _ in self._trees():
            yield i, sinks.hocr_page(tree)

    def tagged(self):
        for n, (i, page, items) in enumerate(self._items()):
            yield i, sinks.tag_page(items.rows, items.tags, n, self.doc.box(page.get("MediaBox")) or (0, 0, 612, 792), self.doc.int(page.get("Rotate")))


def label_text(style: str | None, prefix: str, first: int, step: int) -> str:
    """A page label, the ``step``-th of its range."""
    n = first + step
    if style == "D":
        body = str(n)
    elif style in ("R", "r"):
        body = ""
        for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            body, n = body + sign * (n // value), n % value
    elif style in ("A", "a"):
        body = ""
        while n > 0:
            n, digit = divmod(n - 1, 26)
            body = chr(97 + digit) + body
    else:
        body = ""
    return prefix + (body.upper() if style in ("R", "A") else body)


#: Tables whose rows may be as large as a page or an image, and bytes of them that leave a task together, about.
WIDE, BATCH_BYTES = ("objects", "pages", "images", "attachments", "text", "xml", "html", "hocr", "tagged"), 8 << 20
#: Tables whose rows are of single pages, which blocks of pages can share out.
BY_PAGE = ("pages", "glyphs", "paths", "figures", "tags", "text_lines", "text_boxes", "text_groups", "text")


def rows_of(doc_id: str, data: bytes, table: str, o: Options, start: int | None = None) -> Iterator[tuple]:
    """Rows of one file; the last one holds an error if something can't be read."""
    width = width_of(table)
    try:
        for row in getattr(_Rows(data, o, start), table)():
            yield doc_id, *row, None
    except Exception as fault:
        if o.strict:
            raise
        yield doc_id, *[None] * width, f"{type(fault).__name__}: {fault}"


class _Glyphs:
    """Batches of the table of glyphs, from runs where glyphs stand in them, with the schema's columns. Short files share a batch."""

    def __init__(self, o: Options, schema: pa.Schema):
        self.o, self.schema = o, schema
        names = ["doc_id", *columns_of("glyphs"), "error"]
        self.places = [names.index(f.name) for f in schema]
        self.held: list = []  # (doc_id, page, Run) or rows of the table
        self.done: list[pa.RecordBatch] = []
        self.count = 0

    def add(self, doc_id: str, data: bytes, start: int | None) -> Iterator[pa.RecordBatch]:
        try:
            for i, found in _Rows(data, self.o, start).packed_glyphs():
                yield from self._put((doc_id, i, found) if type(found) is runs.Run else (doc_id, *found, None))
        except Exception as fault:
            if self.o.strict:
                raise
            yield from self._put((doc_id, *[None] * width_of("glyphs"), f"{type(fault).__name__}: {fault}"))

    def _put(self, row: tuple) -> Iterator[pa.RecordBatch]:
        packed = type(row[-1]) is runs.Run
        if self.held and packed != (type(self.held[-1][-1]) is runs.Run):
            self._close()
        self.held.append(row)
        self.count += row[-1].count if packed else 1
        if self.count >= runs.BATCH_GLYPHS:
            yield from self.rest()

    def _close(self) -> None:
        """Rows of one kind become columns."""
        if self.held and isinstance(self.held[-1][-1], runs.Run):
            self.done.append(runs.batch(self.held, self.schema, lambda font, cid: drawn_text(font, cid, self.o.undefined)[0], _color))
        elif self.held:
            columns = list(zip(*self.held, strict=True))
            self.done.append(pa.RecordBatch.from_arrays([pa.array(columns[k], f.type) for k, f in zip(self.places, self.schema, strict=True)], schema=self.schema))
        self.held = []

    def rest(self) -> Iterator[pa.RecordBatch]:
        self._close()
        if self.done:
            yield from pa.Table.from_batches(self.done).combine_chunks().to_batches()
        self.done, self.count = [], 0


def parse_files(files: DataFrame, table: str, options: Options = Options(), id_col: str = "path", content: str = "content", columns: tuple[str, ...] = ()) -> DataFrame:
    """Parse a binary column: one row of files to many rows of a table, with all of its columns or those asked for, and the error. With ``page_block``, each task takes that many pages of a file, so that a huge file is shared out."""
    whole = schema_of(table)
    schema = T.StructType([f for f in whole if not columns or f.name in ("doc_id", "error", *columns)])
    arrow = to_arrow_schema(schema)
    files = files.select(files[id_col].cast("string").alias("doc_id"), files[content].alias("content"))
    blocks = options.page_block > 0 and table in BY_PAGE
    wide, limit = table in WIDE, BATCH_BYTES
    if blocks:
        shares = max(files.sparkSession.sparkContext.defaultParallelism, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        files = files.mapInArrow(_blocks(options, shares), "doc_id string, content binary, starts array<int>").repartition(shares, "doc_id", F.col("starts")[0])

    def glyphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Glyphs(options, arrow)
        for b in batches:
            starts = b["starts"].to_pylist() if blocks else [[None]] * len(b)
            for doc_id, data, some in zip(b["doc_id"].to_pylist(), b["content"], starts, strict=True):
                for start in some:
                    yield from out.add(doc_id, data.as_py() or b"", start)
        yield from out.rest()

    if table == "glyphs":
        return files.mapInArrow(glyphs, schema)
    arrow = to_arrow_schema(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts = b["starts"].to_pylist() if blocks else [[None]] * len(b)
            for doc_id, data, some in zip(b["doc_id"].to_pylist(), b["content"], starts, strict=True):
                rows: list[tuple] = []
                raw, held = data.as_py() or b"", 0
                for row in (row for start in some for row in rows_of(doc_id, raw, table, options, start)):
                    rows.append(row)
                    held += sum(len(x) for x in row if isinstance(x, (bytes, str))) if wide else 0
                    if len(rows) == 5000 or held > limit:
                        yield _batch(rows, arrow)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, arrow)

    return files.mapInArrow(run, whole).select(*schema.names)


def _blocks(options: Options, shares: int):
    """Rows (doc_id, content, first pages of blocks): a file's blocks dealt out to at most ``shares`` rows; an unreadable file is one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, data in zip(b["doc_id"].to_pylist(), b["content"], strict=True):
                raw = data.as_py() or b""
                try:
                    pages = sum(1 for _ in Document(raw, options.password).pages())
                except Exception:  # the parse itself reports it
                    pages = 1
                starts = range(0, max(pages, 1), options.page_block)
                for k in range(min(shares, len(starts))):
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id]), pa.array([raw], pa.binary()), pa.array([list(starts[k::shares])], pa.list_(pa.int32()))], names=["doc_id", "content", "starts"])

    return run


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def read_pdf(spark: SparkSession, path: str | list[str], table: str = "text", **options: Any) -> DataFrame:
    """A table of all files at a path, folder or pattern."""
    return parse_files(spark.read.format("binaryFile").load(path), table, Options.parse(options))


def register_functions(spark: SparkSession) -> None:
    """Table functions for SQL, one for each table: ``SELECT t.* FROM files, LATERAL pdf_text(path, content, map('layout', 'false')) t``. The last argument, options by name, may be left out."""
    for table in TABLES:
        spark.udtf.register(f"pdf_{table}", _table_function(table))


def _table_function(table: str):
    class Parsed:
        def eval(self, doc_id, content, options=None):
            yield from rows_of(doc_id, bytes(content or b""), table, Options.parse(options or {}))

    return F.udtf(Parsed, returnType=schema_of(table))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        given = dict(options)
        self.path, self.table = given.pop("path"), given.pop("table", "text")
        self.options = Options.parse(given)

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        path = self.path.removeprefix("file://")
        found = sorted(glob.glob(os.path.join(path, "**", "*.pdf"), recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path))
        if not found:
            raise FileNotFoundError(path)
        return [_File(p) for p in found]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            yield from rows_of(partition.path, f.read(), self.table, self.options)


class PdfSource(DataSource):
    """``spark.dataSource.register(PdfSource)``; files must be on a path that all executors can open. Elsewhere use ``read_pdf``."""

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return ddl_of(self.options.get("table", "text"))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options))
