"""A small typesetter and PDF writer: turns table rows into files, for queries and tests over the driver's tables."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a line, lines of a page, size, left edge, first baseline and distance of baselines in points.
COLUMNS, ROWS, SIZE, LEFT, TOP, STEP = 90, 60, 10, 36, 756, 12


def wrapped(text: str) -> list[str]:
    """Lines of at most COLUMNS characters; an empty line stays."""
    return [line[i : i + COLUMNS] for line in text.split("\n") for i in range(0, max(len(line), 1), COLUMNS)]


def escaped(raw: bytes) -> bytes:
    return raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r")


def write_pdf(objects: list[bytes], trailer: bytes = b"", version: bytes = b"1.4") -> bytes:
    """A file of numbered objects with a classic cross-reference table; object 1 is the catalog."""
    out, places = bytearray(b"%PDF-" + version + b"\n"), []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1)
    out += b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer\n<< /Size %d /Root 1 0 R %s >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, trailer, start)
    return bytes(out)


def stream(data: bytes, attrs: bytes = b"", compress: bool = True) -> bytes:
    if compress:
        data, attrs = zlib.compress(data, 1), attrs + b" /Filter /FlateDecode"
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), attrs, data)


def typeset(text: str, info: dict[str, str] | None = None) -> bytes:
    """A document in Courier and WinAnsi encoding, the catalog, its page tree with inherited resources, and page labels in two ranges."""
    lines = wrapped(text)
    pages = [lines[i : i + ROWS] for i in range(0, len(lines), ROWS)]
    kids = b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages)))
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R /PageLabels << /Nums [0 << /S /r >> 2 << /S /D /P (p-) >>] >> >>",
        b"<< /Type /Pages /Count %d /Kids [%s] /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> >>" % (len(pages), kids),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>",
    ]
    for i, page in enumerate(pages):
        body = b"BT /F1 %d Tf\n" % SIZE + b"".join(b"1 0 0 1 %d %d Tm (%s) Tj\n" % (LEFT, TOP - STEP * k, escaped(line.encode("cp1252", "replace"))) for k, line in enumerate(page) if line) + b"ET"
        objects += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (5 + 2 * i), stream(body)]
    trailer = b""
    if info:
        objects.append(b"<< " + b" ".join(b"/%s (%s)" % (k.encode(), escaped(v.encode("latin-1", "replace"))) for k, v in info.items()) + b" >>")
        trailer = b"/Info %d 0 R" % len(objects)
    return write_pdf(objects, trailer)


def typeset_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, source, lang) rows to (path, content), one file a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, sources, langs = (c.to_pylist() for c in b.columns)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([typeset(t or "", {"Title": s or "", "Lang": g or ""}) for t, s, g in zip(texts, sources, langs, strict=True)], pa.binary())], names=["path", "content"])

    return docs.select(F.col(doc_id).cast("string"), text, "source", "lang").mapInArrow(run, "path string, content binary")


def numbered_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, row, line) of the same typesetting with DataFrame functions only; numbered within each document through an array, without a window over the table."""
    whole = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    cut = F.flatten(F.transform(whole, lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(w) / COLUMNS) - 1, F.lit(0))), lambda i: F.substring(w, (i * COLUMNS + 1).cast("int"), F.lit(COLUMNS)))))
    rows = docs.select("doc_id", F.posexplode(cut).alias("n", "line"))
    return rows.select("doc_id", F.floor(F.col("n") / ROWS).cast("int").alias("page_no"), (F.col("n") % ROWS).cast("int").alias("row"), "line")


def glyph_table(lines: DataFrame, keep: Column | None = None) -> DataFrame:
    """Glyph boxes of numbered lines in draw order, as the fixed-pitch font gives them; ``keep`` filters characters."""
    chars = lines.filter("line <> ''").select("doc_id", "page_no", "row", F.posexplode(F.split("line", "", -1)).alias("col", "text")).filter("text <> ''")
    chars = chars if keep is None else chars.filter(keep)
    pitch = 0.6 * SIZE
    y0 = F.lit(float(TOP)) - F.col("row") * STEP - 0.194 * SIZE
    return chars.select("doc_id", "page_no", (F.col("row") * 1000 + F.col("col")).cast("long").alias("seq"), "text", (F.lit(float(LEFT)) + F.col("col") * pitch).alias("x0"), y0.alias("y0"), (F.lit(float(LEFT)) + (F.col("col") + 1) * pitch).alias("x1"), (y0 + SIZE).alias("y1"), "row")
