"""Queries over files with one feature each: storage, encryption, structure, fonts, drawing, layout and sinks, with the SQL of what was put in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell import api
from inkwell.plans import codecs
from inkwell.plans.books import COURIER, HELVETICA, Book, compact_file, locked, made, one_page, stored, updated
from inkwell.plans.queries import query
from inkwell.plans.synth import stream
from inkwell.sources.pdf import Options, PdfSource, parse_files, register_functions
from inkwell.sources.shared import shared_dir

NAME, KEY = ["s_suppkey", "s_name"], ["s_suppkey", "s_nationkey"]


def _suppliers(spark: SparkSession, d: str, make, columns: list[str] = NAME) -> DataFrame:
    return made(spark, d, "supplier", columns, make)


def _shown(text: str, at: bytes = b"36 700") -> bytes:
    return b"BT /F1 10 Tf %s Td (%s) Tj ET" % (at, (text or "").encode("cp1252", "replace"))


def _key(df: DataFrame, *columns) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("s_suppkey"), *columns)


def _long(c: str) -> F.Column:
    return F.col(c).cast("long").alias(c)


def _milli(c: F.Column, name: str) -> F.Column:
    return F.round(c * 1000).cast("long").alias(name)


_SUPPLIER = "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, "


def _values(columns: str, rows: list[tuple]) -> str:
    """A table of rows beside each supplier."""
    cells = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"FROM supplier CROSS JOIN (VALUES {cells}) AS v({columns})"


# -- storage ---------------------------------------------------------------------------------------------------


@query(_SUPPLIER + "s_name || chr(12) AS text FROM supplier")
def pdf_compact_storage(spark: SparkSession, d: str) -> DataFrame:
    """Objects in object streams, found through a reference stream."""
    files = _suppliers(spark, d, lambda k, name: compact_file(one_page(_shown(name)).bodies()))
    return _key(parse_files(files, "text", Options(layout=False)), "text")


@query(_SUPPLIER + """kind, objects, inside """ + _values("kind, objects, inside", [("stream", 7, 4)]))
def pdf_reference_streams(spark: SparkSession, d: str) -> DataFrame:
    """Entries of reference streams: all in use, and those within an object stream."""
    x = parse_files(_suppliers(spark, d, lambda k, name: compact_file(one_page(_shown(name)).bodies())), "xref")
    return x.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("objects"), F.count("container").alias("inside")).transform(lambda g: _key(g, "kind", "objects", "inside"))


def _damaged(k: int, name: str) -> bytes:
    whole = one_page(_shown(name)).file()
    at = whole.rindex(b"startxref")
    if k % 4 == 0:  # cut off
        return whole[:at]
    if k % 4 == 1:  # the reference table isn't where it should be
        return whole[:at] + b"startxref\n7\n%%EOF\n"
    if k % 4 == 2:  # no trailer
        return whole[: whole.rindex(b"xref\n0 ")]
    return whole.replace(b"%PDF-1.4\n", b"%PDF-1.4\n%" + b"x" * 30 + b"\n")  # all places are off


@query(_SUPPLIER + "s_name || chr(12) AS text FROM supplier")
def pdf_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Files whose reference table is missing, misplaced or wrong are scanned for objects."""
    return _key(parse_files(_suppliers(spark, d, _damaged), "text", Options(layout=False)), "text")


def _twice(k: int, name: str) -> bytes:
    book = one_page(_shown("old text"))
    return updated(book.file(), 4, stream(_shown(name)))


@query(_SUPPLIER + "s_name || chr(12) AS text, CAST(2 AS BIGINT) AS sections FROM supplier")
def pdf_updates(spark: SparkSession, d: str) -> DataFrame:
    """A later section's object hides the earlier one."""
    files = _suppliers(spark, d, _twice)
    sections = parse_files(files, "trailers").groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"))
    return _key(parse_files(files, "text", Options(layout=False)).join(sections, "doc_id"), "text", "sections")


@query(_SUPPLIER + "section, kind, root, prev " + _values("section, kind, root, prev", [(0, "table", "true", "true"), (1, "table", "true", "false")]).replace("'true'", "true").replace("'false'", "false"))
def pdf_trailers(spark: SparkSession, d: str) -> DataFrame:
    t = parse_files(_suppliers(spark, d, _twice), "trailers")
    has = lambda k: F.get_json_object("value", f"$.d.{k}").isNotNull()
    return _key(t, "section", "kind", has("Root").alias("root"), has("Prev").alias("prev"))


_FILTERS = [
    lambda t: stream(t, compress=False),
    lambda t: stream(codecs.ascii85(codecs.flate(t))[2:], b"/Filter [/ASCII85Decode /FlateDecode]", compress=False),
    lambda t: stream(codecs.lzw(t), b"/Filter /LZWDecode", compress=False),
    lambda t: stream(codecs.run_length(t), b"/Filter /RL", compress=False),
    lambda t: stream(t.hex().encode() + b">", b"/Filter [/AHx]", compress=False),
    lambda t: stream(codecs.flate(codecs.png(t, 8)), b"/Filter /FlateDecode /DecodeParms << /Predictor 15 /Columns 8 >>", compress=False),
    lambda t: stream(codecs.flate(codecs.tiff(t, 8)), b"/Filter /Fl /DecodeParms [<< /Predictor 2 /Columns 8 >>]", compress=False),
    lambda t: stream(codecs.flate(t)[:-4], b"/Filter /FlateDecode", compress=False),
]


def _filtered(k: int, name: str) -> bytes:
    book = Book()
    book.resource("Font", "F1", COURIER)
    at = book.add(_FILTERS[k % len(_FILTERS)](_shown(name).ljust(80)))
    book.pages.append(book.add(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % at))
    return book.file()


@query(_SUPPLIER + "s_name || chr(12) AS text FROM supplier")
def pdf_filter_chains(spark: SparkSession, d: str) -> DataFrame:
    """Content behind each filter, by its long and short name, in chains, with predictors, and with a damaged end."""
    return _key(parse_files(_suppliers(spark, d, _filtered), "text", Options(layout=False)), "text")


# -- encryption ------------------------------------------------------------------------------------------------

_LOCKS = [(1, 2, "V2"), (2, 3, "V2"), (4, 4, "V2"), (4, 4, "AESV2"), (4, 4, "Identity"), (5, 5, "AESV3")]


def _lock(k: int, name: str) -> bytes:
    # the newest revision takes seconds in Python: one file
    version, revision, method = (5, 6, "AESV3") if k == 6 else _LOCKS[k % len(_LOCKS)]
    user, owner = (b"secret", b"other") if k % 2 else (b"other", b"secret")
    return locked(name.encode(), b"T-%d" % k, version, revision, method, user, owner)


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name || chr(12) AS text, 'T-' || n_nationkey AS title, true AS encrypted, true AS printable, false AS modifiable, true AS extractable FROM nation".replace("true AS printable", "true AS printable"))
def pdf_encryption(spark: SparkSession, d: str) -> DataFrame:
    """Files of revisions 2 to 6, with RC4 and AES, opened with the user's or the owner's password."""
    files, o = made(spark, d, "nation", ["n_nationkey", "n_name"], _lock), Options(layout=False, password="secret")
    docs = parse_files(files, "docs", o).select("doc_id", F.from_json("info", "array<map<string,string>>")[0]["Title"].alias("title"), "encrypted", "printable", "modifiable", "extractable")
    return parse_files(files, "text", o).join(docs, "doc_id").select(F.col("doc_id").cast("long").alias("n_nationkey"), "text", "title", "encrypted", "printable", "modifiable", "extractable")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, 'PasswordFault' AS error FROM nation WHERE n_nationkey <> 6")
def pdf_wrong_password(spark: SparkSession, d: str) -> DataFrame:
    """A wrong password gives a row that says so. Revision 6 is left to ``pdf_encryption``: its key takes seconds."""
    files = made(spark, d, "nation", ["n_nationkey", "n_name"], lambda k, name: locked(name.encode(), b"", *_LOCKS[k % len(_LOCKS)], b"user", b"owner")).filter("path <> '6'")
    return parse_files(files, "docs", Options(password="guess")).select(F.col("doc_id").cast("long").alias("n_nationkey"), F.split("error", ":")[0].alias("error"))


# -- structure -------------------------------------------------------------------------------------------------


def _structured(k: int, name: str) -> bytes:
    book = Book()
    book.resource("Font", "F1", COURIER)
    title = name.encode()
    pages = [book.page(_shown(name)), book.page(_shown("second")), book.page(_shown("third"))]
    root = len(book.objects) + 1
    book.add(b"<< /First %d 0 R /Last %d 0 R >>" % (root + 1, root + 3))
    book.add(b"<< /Title (%s) /Dest [%d 0 R /Fit] /First %d 0 R /Last %d 0 R /Next %d 0 R >>" % (title, pages[0], root + 2, root + 2, root + 3))
    book.add(b"<< /Title <FEFF%s> /A << /S /GoTo /D (deep) >> >>" % name.encode("utf-16-be").hex().encode())
    book.add(b"<< /Title (end) /Dest /old >>")
    f1, f2 = book.add(b"<< /T (name) /V (%s) >>" % title), book.add(b"<< /T (size) /V /Big >>")
    data = book.add(stream(title + b" attached"))
    book.add(b"<< /Type /Filespec /F (n.txt) /UF (n-%d.txt) /EF << /F %d 0 R >> >>" % (k, data))
    tree = b"<< /Kids [<< /Names [(a) [%d 0 R /Fit] (b) << /D [%d 0 R /XYZ 0 0 0] >>] >> << /Names [(deep) [%d 0 R /Fit]] >>] >>" % (pages[0], pages[1], pages[1])
    labels = b"<< /Kids [<< /Nums [1 << /S /D /St %d >>] >> << /Nums [0 << /S /R /P (x-) >>] >>] >>" % (5 + k)
    book.catalog = b"/Outlines %d 0 R /Dests << /old [%d 0 R /Fit] >> /Names << /Dests %s >> /AcroForm << /Fields [%d 0 R %d 0 R] >> /PageLabels %s" % (root, pages[2], tree, f1, f2, labels)
    return book.file()


@query(_SUPPLIER + "seq, level, coalesce(title, s_name) AS title, page_no " + _values("seq, level, title, page_no", [(0, 1, None, 0), (1, 2, None, 1), (2, 1, "end", 2)]))
def pdf_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Entries of two levels with destinations of all kinds: pages, names in the tree through an action, names in the old dictionary."""
    return _key(parse_files(_suppliers(spark, d, _structured), "outlines"), "seq", "level", "title", "page_no")


@query(_SUPPLIER + "name, page_no " + _values("name, page_no", [("old", 2), ("a", 0), ("b", 1), ("deep", 1)]))
def pdf_destinations(spark: SparkSession, d: str) -> DataFrame:
    return _key(parse_files(_suppliers(spark, d, _structured), "names"), "name", "page_no")


@query(_SUPPLIER + "name, coalesce(value, s_name) AS value " + _values("name, value", [("name", None), ("size", "Big")]))
def pdf_form_fields(spark: SparkSession, d: str) -> DataFrame:
    return _key(parse_files(_suppliers(spark, d, _structured), "fields"), "name", "value")


@query(_SUPPLIER + "'n-' || s_suppkey || '.txt' AS name, s_name || ' attached' AS data FROM supplier")
def pdf_attachments(spark: SparkSession, d: str) -> DataFrame:
    return _key(parse_files(_suppliers(spark, d, _structured), "attachments"), "name", F.col("data").cast("string").alias("data"))


@query(_SUPPLIER + "page_no, coalesce(label, CAST(5 + s_suppkey + page_no - 1 AS VARCHAR)) AS label " + _values("page_no, label", [(0, "x-I"), (1, None), (2, None)]))
def pdf_page_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of a number tree whose leaves are out of order."""
    return _key(parse_files(_suppliers(spark, d, _structured), "pages"), "page_no", "label")


def _tree(k: int, n: int) -> bytes:
    """Pages below nested nodes; boxes and rotation come from above unless a page has its own."""
    book = Book((0, 0, 300, 400))
    book.resource("Font", "F1", COURIER)
    content = book.add(stream(_shown("x")))
    inner = len(book.objects) + 3
    book.pages.append(book.add(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % content))
    leaf = book.add(b"<< /Type /Page /Parent %d 0 R /Contents %d 0 R /MediaBox [10 20 %d 220] >>" % (inner, content, 110 + n))
    book.pages.append(book.add(b"<< /Type /Pages /Parent 2 0 R /Kids [%d 0 R %d 0 R] /Count 2 /Rotate 90 /CropBox [1 2 3 4] >>" % (leaf, inner + 1)))
    book.add(b"<< /Type /Page /Parent %d 0 R /Contents %d 0 R /Rotate 180 >>" % (inner, content))
    return book.file()


@query(_SUPPLIER + "page_no, width + by_n * s_nationkey AS width, height + high_n * s_nationkey AS height, rotate, crop " + _values("page_no, width, by_n, height, high_n, rotate, crop", [(0, 300.0, 0, 400.0, 0, 0, None), (1, 200.0, 0, 100.0, 1, 90, 1.0), (2, 300.0, 0, 400.0, 0, 180, 1.0)]).replace("300.0", "300.0::DOUBLE"))
def pdf_page_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Inherited and own boxes and rotations; a turned page changes its sides."""
    return _key(parse_files(_suppliers(spark, d, _tree, KEY), "pages"), "page_no", "width", "height", "rotate", F.col("cropbox")[0].alias("crop"))


# -- text state and fonts --------------------------------------------------------------------------------------


def _glyphs(files: DataFrame, *columns, options: Options = Options()) -> DataFrame:
    return _key(parse_files(files, "glyphs", options), "seq", "text", *columns)


def _moves(k: int, n: int) -> bytes:
    return one_page(b"BT /F1 10 Tf 20 TL %d 100 Td (a) Tj T* (b) Tj 5 -7 TD (c) Tj T* (d) Tj ET BT 1 0 0 1 %d 300 Tm (e) Tj 12 TL (f) ' ET BT 0 50 Td 1 2 (gh) \" ET" % (n, n)).file()


@query(_SUPPLIER + "CAST(seq AS BIGINT) AS seq, text, CAST(x + 1000 * by_n * s_nationkey AS BIGINT) AS x, CAST(y AS BIGINT) AS y " + _values("seq, text, x, by_n, y", [(0, "a", 0, 1, 100000), (1, "b", 0, 1, 80000), (2, "c", 5000, 1, 73000), (3, "d", 5000, 1, 66000), (4, "e", 0, 1, 300000), (5, "f", 0, 1, 288000), (6, "g", 0, 0, 50000), (7, "h", 8000, 0, 50000)]))
def pdf_text_moves(spark: SparkSession, d: str) -> DataFrame:
    """Td, TD, Tm, T*, TL and the two quote operators; the double quote shows on the line where it stands."""
    return _glyphs(_suppliers(spark, d, _moves, KEY), _milli(F.col("matrix")[4], "x"), _milli(F.col("matrix")[5], "y"))


def _spaced(k: int, n: int) -> bytes:
    return one_page(b"BT /F1 10 Tf 3 Tc 5 Tw 50 Tz 2 Ts %d 20 Td [(a b) -100 (c)] TJ ET" % n).file()


@query(_SUPPLIER + "CAST(seq AS BIGINT) AS seq, text, CAST(x + 1000 * s_nationkey AS BIGINT) AS x0, CAST(x + 3000 + 1000 * s_nationkey AS BIGINT) AS x1, CAST(20060 AS BIGINT) AS y0 " + _values("seq, text, x", [(0, "a", 0), (1, " ", 4500), (2, "b", 11500), (3, "c", 16500)]))
def pdf_text_spacing(spark: SparkSession, d: str) -> DataFrame:
    """Spacing of characters and words, horizontal scaling, rise and adjustments in a shown array."""
    return _glyphs(_suppliers(spark, d, _spaced, KEY), _milli(F.col("x0"), "x0"), _milli(F.col("x1"), "x1"), _milli(F.col("y0"), "y0"))


def _wide(k: int, n: int) -> bytes:
    text = "£" * (1 + k % 3) + "©" * (1 + n % 4) + "Æ°±§¶™†×AWé"
    return one_page(_shown(text), HELVETICA).file()


@query(_SUPPLIER + "CAST(10 * (556 * (1 + s_suppkey % 3) + 737 * (1 + s_nationkey % 4) + 1000 + 400 + 584 + 556 + 537 + 1000 + 556 + 584 + 667 + 944 + 556) AS BIGINT) AS width, CAST(13 + s_suppkey % 3 + s_nationkey % 4 AS BIGINT) AS glyphs FROM supplier")
def pdf_base_font_widths(spark: SparkSession, d: str) -> DataFrame:
    """Advances of signs beyond ASCII in a font that isn't embedded."""
    g = parse_files(_suppliers(spark, d, _wide, KEY), "glyphs")
    return _key(g.groupBy("doc_id").agg(F.sum(F.round(F.col("adv") * 1000)).cast("long").alias("width"), F.count(F.lit(1)).alias("glyphs")), "width", "glyphs")


_DIGITS = "zero one two three four five six seven eight nine".split()


def _named(k: int, name: str) -> bytes:
    chars = "".join(dict.fromkeys(name))
    glyph = lambda c: "numbersign" if c == "#" else _DIGITS[int(c)] if c.isdigit() else c
    names = ["uni20AC", "afii10017", "f_i", "Aacute.alt", *map(glyph, chars)]
    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding << /Differences [1 %s] >> >>" % b" ".join(b"/" + x.encode() for x in names)
    codes = bytes([1, 2, 3, 4, *(5 + chars.index(c) for c in name)])
    return one_page(b"BT /F1 10 Tf 36 700 Td <%s> Tj ET" % codes.hex().encode(), font).file()


@query(_SUPPLIER + "'€АfiÁ' || s_name || chr(12) AS text FROM supplier")
def pdf_glyph_names(spark: SparkSession, d: str) -> DataFrame:
    """Characters by glyph names in an encoding of differences."""
    return _key(parse_files(_suppliers(spark, d, _named), "text", Options(layout=False)), "text")


def _unknown(k: int, name: str) -> bytes:
    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding << /Differences [1 /nosuchglyph] >> >>"
    return one_page(b"BT /F1 10 Tf 36 700 Td <%s01> Tj ET" % name.encode().hex().encode(), font).file()


@query(_SUPPLIER + "s_name || mark || chr(12) AS text FROM supplier CROSS JOIN (VALUES ('(cid:1)'), ('?')) AS v(mark)")
def pdf_undefined_glyphs(spark: SparkSession, d: str) -> DataFrame:
    """Glyphs without a character give their id, or what the option names."""
    files = _suppliers(spark, d, _unknown)
    both = [_key(parse_files(files, "text", Options(layout=False, undefined=u)), "text") for u in (None, "?")]
    return both[0].unionByName(both[1])


def _composite(k: int, name: str, vertical: bool = False) -> bytes:
    book = Book()
    pairs = b" ".join(b"<%04X> <%s>" % (256 + ord(c), c.encode("utf-16-be").hex().encode()) for c in dict.fromkeys(name))
    to_unicode = book.add(stream(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 9 beginbfchar %s endbfchar" % pairs))
    below = book.add(b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /F /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) >> /DW 500 /W [%d [250] %d %d 700] >>" % (256 + ord("#"), 256 + ord("0"), 256 + ord("9")))
    book.resource("Font", "F1", b"<< /Type /Font /Subtype /Type0 /BaseFont /F /Encoding /Identity-%s /DescendantFonts [%d 0 R] /ToUnicode %d 0 R >>" % (b"V" if vertical else b"H", below, to_unicode))
    book.page(b"BT /F1 10 Tf 100 700 Td <%s> Tj ET" % b"".join(b"%04X" % (256 + ord(c)) for c in name))
    return book.file()


@query(_SUPPLIER + "s_name AS text, CAST(5000 * length(regexp_replace(s_name, '[#0-9]', '', 'g')) + 2500 + 7000 * length(regexp_replace(s_name, '[^0-9]', '', 'g')) AS BIGINT) AS width FROM supplier")
def pdf_composite_fonts(spark: SparkSession, d: str) -> DataFrame:
    """Two-byte codes, a map to characters, and widths by list, by range and by default."""
    g = parse_files(_suppliers(spark, d, _composite), "glyphs").groupBy("doc_id")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    return _key(g.agg(text.alias("text"), F.sum(F.round(F.col("adv") * 1000)).cast("long").alias("width")), "text", "width")


@query(_SUPPLIER + "s_name || chr(10) AS text, true AS vertical, CAST(10000 AS BIGINT) AS width, CAST(10000 * length(s_name) AS BIGINT) AS height FROM supplier")
def pdf_vertical_text(spark: SparkSession, d: str) -> DataFrame:
    """Glyphs below each other make one vertical line."""
    lines = parse_files(_suppliers(spark, d, lambda k, name: _composite(k, name, True)), "text_lines", Options(detect_vertical=True))
    return _key(lines, "text", "vertical", _milli(F.col("x1") - F.col("x0"), "width"), _milli(F.col("y1") - F.col("y0"), "height"))


# -- drawing ---------------------------------------------------------------------------------------------------


def _drawing(k: int, n: int) -> bytes:
    return one_page(b"q 2 0 0 2 %d 0 cm 3 w 0.5 g 0 0 m 10 0 l S q 1 0 0 rg 0 1 0 RG 1 1 5 5 re B Q 0 0 m 4 4 l 8 0 l h f Q 0.1 0.2 0.3 0.4 k /DeviceRGB cs 1 1 0 sc 0 0 m 0 9 l s 0 0 m 1 1 2 2 3 0 c b* 9 9 m n 5 5 l S" % n).file()


@query(
    _SUPPLIER + "CAST(seq AS BIGINT) AS seq, kind, CAST(x0 + by_n * s_nationkey AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, CAST(x1 + by_n * s_nationkey AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, CAST(lw AS BIGINT) AS lw, stroke = 1 AS stroke, fill = 1 AS fill, evenodd = 1 AS evenodd, ncolor, scolor "
    + _values(
        "seq, kind, x0, by_n, y0, x1, y1, lw, stroke, fill, evenodd, ncolor, scolor",
        [
            (0, "line", 0, 1, 0, 20, 0, 6, 1, 0, 0, "0.5", "0"),
            (1, "rect", 2, 1, 2, 12, 12, 6, 1, 1, 0, "[1.0, 0.0, 0.0]", "[0.0, 1.0, 0.0]"),
            (2, "curve", 0, 1, 0, 16, 8, 6, 0, 1, 0, "0.5", "0"),
            (3, "line", 0, 0, 0, 0, 9, 0, 1, 0, 0, "[1.0, 1.0, 0.0]", "0"),
            (4, "curve", 0, 0, 0, 3, 0, 0, 1, 1, 1, "[1.0, 1.0, 0.0]", "0"),
        ],
    )
)
def pdf_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of all kinds under q, Q, cm and w, in colours of all device spaces."""
    p = parse_files(_suppliers(spark, d, _drawing, KEY), "paths")
    return _key(p, "seq", "kind", *map(_long, ("x0", "y0", "x1", "y1")), F.col("linewidth").cast("long").alias("lw"), "stroke", "fill", "evenodd", "ncolor", "scolor")


def _colored(k: int, name: str) -> bytes:
    book = Book()
    book.resource("Font", "F1", COURIER)
    profile = book.add(stream(b"", b"/N 3"))
    book.resource("ColorSpace", "Icc", b"[/ICCBased %d 0 R]" % profile, direct=True)
    book.resource("ColorSpace", "Spot", b"[/Separation /X /DeviceGray 9 0 R]", direct=True)
    book.resource("ColorSpace", "Many", b"[/DeviceN [/A /B /C /D] /DeviceCMYK 9 0 R]", direct=True)
    book.page(b"BT /F1 10 Tf (a) Tj /Icc cs 0.1 0.2 0.3 scn (b) Tj /Spot cs 0.7 scn (c) Tj /Pattern cs /P1 scn (d) Tj 0 0 0 1 k (e) Tj /Many cs 1 2 3 4 sc (f) Tj /Nope cs 0.25 G (g) Tj ET")
    return book.file()


@query(_SUPPLIER + "CAST(seq AS BIGINT) AS seq, text, ncs, ncolor, scolor " + _values("seq, text, ncs, ncolor, scolor", [(0, "a", "DeviceGray", "0", "0"), (1, "b", "ICCBased", "[0.1, 0.2, 0.3]", "0"), (2, "c", "Separation", "0.7", "0"), (3, "d", "Pattern", '"P1"', "0"), (4, "e", "DeviceCMYK", "[0.0, 0.0, 0.0, 1.0]", "0"), (5, "f", "DeviceN", "[1.0, 2.0, 3.0, 4.0]", "0"), (6, "g", "DeviceN", "[1.0, 2.0, 3.0, 4.0]", "0.25")]))
def pdf_color_spaces(spark: SparkSession, d: str) -> DataFrame:
    return _glyphs(_suppliers(spark, d, _colored), "ncs", "ncolor", "scolor")


def _pictures(k: int, n: int) -> bytes:
    raw = stream(bytes(range(12)), b"/Type /XObject /Subtype /Image /Width 2 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceRGB")
    jpeg = stream(b"\xff\xd8jpeg", b"/Type /XObject /Subtype /Image /Width 3 /Height 4 /BitsPerComponent 8 /Filter /DCTDecode", compress=False)
    bits = stream(b"\x80\x40", b"/Type /XObject /Subtype /Image /Width 2 /Height 2 /BitsPerComponent 1 /ImageMask true")
    return one_page(b"q %d 0 0 30 5 6 cm /I Do Q /J Do /I Do /M Do BI /W 2 /H 1 /BPC 8 /CS /DeviceGray ID ab\nEI" % (20 + n), XObject={"I": raw, "J": jpeg, "M": bits}).file()


@query(_SUPPLIER + "name, CAST(x0 AS BIGINT) AS x0, CAST(x1 + by_n * s_nationkey AS BIGINT) AS x1, width, height, bits, extension, CAST(size AS BIGINT) AS size " + _values("name, x0, x1, by_n, width, height, bits, extension, size", [("I", 5, 25, 1, 2, 2, 8, ".bmp", 70), ("J", 0, 1, 0, 3, 4, 8, ".jpg", 6), ("I.0", 0, 1, 0, 2, 2, 8, ".bmp", 70), ("M", 0, 1, 0, 2, 2, 1, ".bmp", 70), (None, 0, 1, 0, 2, 1, 8, ".bmp", 1082)]))
def pdf_images(spark: SparkSession, d: str) -> DataFrame:
    """Images of the page and in line, as files; names are told apart, those of inline images are the engine's own."""
    i = parse_files(_suppliers(spark, d, _pictures, KEY), "images")
    return _key(i, F.when(~F.col("name").startswith("inline"), F.col("name")).alias("name"), _long("x0"), _long("x1"), "width", "height", "bits", "extension", F.length("data").cast("long").alias("size"))


def _form(k: int, name: str) -> bytes:
    inner = b"/Type /XObject /Subtype /Form /BBox [0 0 10 20] /Matrix [1 0 0 1 50 60] /Resources << /Font << /F1 3 0 R >> >>"
    return one_page(_shown("page") + b" /X Do", XObject={"X": stream(_shown(name, b"0 0"), inner)}).file()


@query(_SUPPLIER + "kind, text, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0 FROM (SELECT s_suppkey, 'figure' AS kind, 'X' AS text, 50 AS x0, 60 AS y0 FROM supplier UNION ALL SELECT s_suppkey, 'line', 'page' || chr(10), 36, 698 FROM supplier UNION ALL SELECT s_suppkey, 'line', s_name || chr(10), 50, 58 FROM supplier)")
def pdf_figures(spark: SparkSession, d: str) -> DataFrame:
    """A form with its own matrix and resources; with ``all_texts`` its lines are found too."""
    files = _suppliers(spark, d, _form)
    figures = _key(parse_files(files, "figures"), F.lit("figure").alias("kind"), F.col("name").alias("text"), _long("x0"), _long("y0"))
    lines = _key(parse_files(files, "text_lines", Options(all_texts=True)), F.lit("line").alias("kind"), "text", _long("x0"), _long("y0"))
    return figures.unionByName(lines)


@query(_SUPPLIER + "CASE WHEN with_figures THEN 'page' || chr(10) || chr(10) || s_name || chr(10) || chr(10) || chr(12) ELSE 'page' || chr(10) || chr(10) || s_name || chr(12) END AS text, with_figures FROM supplier CROSS JOIN (VALUES (true), (false)) AS v(with_figures)")
def pdf_figure_text(spark: SparkSession, d: str) -> DataFrame:
    """Text of figures is analysed only where that is asked for."""
    files = _suppliers(spark, d, _form)
    both = [_key(parse_files(files, "text", Options(all_texts=x)), "text", F.lit(x).alias("with_figures")) for x in (True, False)]
    return both[0].unionByName(both[1])


def _turned(k: int, n: int) -> bytes:
    book = Book((0, 0, 200, 300))
    book.resource("Font", "F1", COURIER)
    book.page(b"BT /F1 10 Tf %d 30 Td (r) Tj ET" % (20 + n), b"/Rotate 90")
    book.page(b"BT /F1 10 Tf %d 30 Td (s) Tj ET" % (20 + n), b"/Rotate 180")
    return book.file()


@query(_SUPPLIER + "page_no, CAST(CASE WHEN page_no = 0 THEN 30 ELSE 180 - s_nationkey END AS BIGINT) AS e, CAST(CASE WHEN page_no = 0 THEN 180 - s_nationkey ELSE 270 END AS BIGINT) AS f, page_no = 1 AS upright FROM supplier CROSS JOIN (VALUES (0), (1)) AS v(page_no)")
def pdf_rotation(spark: SparkSession, d: str) -> DataFrame:
    """Pages turned by their own entry: where glyphs stand, and whether they stand upright."""
    g = parse_files(_suppliers(spark, d, _turned, KEY), "glyphs")
    return _key(g, "page_no", F.col("matrix")[4].cast("long").alias("e"), F.col("matrix")[5].cast("long").alias("f"), "upright")


# -- layout and sinks ------------------------------------------------------------------------------------------


def _columns(k: int, name: str) -> bytes:
    at = lambda x, y, t: b"1 0 0 1 %d %d Tm (%s) Tj " % (x, y, t.encode())
    return one_page(b"BT /F1 10 Tf " + at(330, 688, "R2") + at(40, 676, "L2") + at(40, 760, "Heading of both columns " + name) + at(330, 700, "R1") + at(40, 700, "L1") + at(40, 640, "L3") + at(330, 640, "R3") + b"ET").file()


@query(_SUPPLIER + "'Heading of both columns ' || s_name || chr(10) || chr(10) || replace(texts, '|', chr(10)) || chr(12) AS text, flow " + _values("flow, texts", [("0.5", "L1||L2||L3||R1|R2||R3||"), ("none", "L1||R1|R2||L2||L3||R3||")]))
def pdf_reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of two columns: nearest ones are joined first, then read from the top left; without flow by their lower edges."""
    files = _suppliers(spark, d, _columns)
    both = [_key(parse_files(files, "text", Options(boxes_flow=f)), "text", F.lit(n).alias("flow")) for f, n in ((0.5, "0.5"), (None, "none"))]
    return both[0].unionByName(both[1])


def _marked(k: int, name: str) -> bytes:
    return one_page(b"/Span << /Lang (en) /A 1 >> BDC " + _shown(name) + b" EMC /M MP /D << /K /V >> DP /Art BMC " + _shown("a<b") + b" EMC").file()


@query(_SUPPLIER + "CAST(seq AS BIGINT) AS seq, event, tag, lang " + _values("seq, event, tag, lang", [("0", "begin", "Span", "en"), ("1", "end", None, None), ("1", "point", "M", None), ("1", "point", "D", None), ("1", "begin", "Art", None), ("2", "end", None, None)]).replace("'0'", "0").replace("('1'", "(length(s_name)").replace("('2'", "(length(s_name) + 3").replace("FROM supplier CROSS JOIN (VALUES", "FROM supplier CROSS JOIN LATERAL (VALUES"))
def pdf_marked_content(spark: SparkSession, d: str) -> DataFrame:
    return _key(parse_files(_suppliers(spark, d, _marked), "tags"), "seq", "event", "tag", F.col("props")["Lang"].alias("lang"))


@query(_SUPPLIER + """'<page id="0" bbox="0.000,0.000,612.000,792.000" rotate="0"><Span A="1" Lang="en">' || s_name || '</Span><M><D K="V"><Art>a&lt;b</Art></page>' || chr(10) AS text FROM supplier""")
def pdf_tagged_text(spark: SparkSession, d: str) -> DataFrame:
    return _key(parse_files(_suppliers(spark, d, _marked), "tagged"), "text")


def _sunk(k: int, name: str) -> bytes:
    return one_page(b"BT /F1 10 Tf 36 700 Td (%s & co) Tj ET 0 0 5 5 re S 2 w 1 2 m 3 4 l S" % name.encode()).file()


_XML_BOX = "format('{:.3f},698.060,{:.3f},708.060', 36.0, 36.0 + 6 * length(t))"


@query(
    f"""WITH s AS (SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name || ' & co' AS t FROM supplier),
c AS (SELECT s_suppkey, t, i, replace(substr(t, i, 1), '&', '&amp;') AS ch FROM s, LATERAL (SELECT unnest(range(1, length(t) + 1)) AS i)),
g AS (SELECT s_suppkey, t, string_agg('<text font="Courier" bbox="' || format('{{:.3f}},698.060,{{:.3f}},708.060', 30.0 + 6 * i, 36.0 + 6 * i) || '" colourspace="DeviceGray" ncolour="0" size="10.000">' || ch || '</text>' || chr(10), '' ORDER BY i) AS glyphs FROM c GROUP BY ALL)
SELECT s_suppkey, '<page id="1" bbox="0.000,0.000,612.000,792.000" rotate="0">' || chr(10) || '<textbox id="0" bbox="' || {_XML_BOX} || '">' || chr(10) || '<textline bbox="' || {_XML_BOX} || '">' || chr(10) || glyphs
|| '<text>' || chr(10) || '</text>' || chr(10) || '</textline>' || chr(10) || '</textbox>' || chr(10) || '<rect linewidth="0" bbox="0.000,0.000,5.000,5.000" />' || chr(10) || '<line linewidth="2.0" bbox="1.000,2.000,3.000,4.000" />' || chr(10)
|| '<layout>' || chr(10) || '<textbox id="0" bbox="' || {_XML_BOX} || '" />' || chr(10) || '</layout>' || chr(10) || '</page>' || chr(10) AS xml FROM g"""
)
def pdf_xml(spark: SparkSession, d: str) -> DataFrame:
    return _key(parse_files(_suppliers(spark, d, _sunk), "xml"), F.col("text").alias("xml"))


@query(
    _SUPPLIER
    + """'Page 1' || chr(10) || s_name || ' &amp; co' || chr(10) AS shown, CAST(36 AS BIGINT) AS x, CAST(50 + 792 - 708 AS BIGINT) AS y, CAST(6 * (length(s_name) + 5) AS BIGINT) AS w, 'Courier' AS font, '10px' AS size FROM supplier"""
)
def pdf_html(spark: SparkSession, d: str) -> DataFrame:
    """What a browser shows of the page, and where its text box stands."""
    t = F.col("text")
    box = lambda i: F.regexp_extract(t, r'border: textbox 1px solid; writing-mode:lr-tb; left:([\d.]+)px; top:([\d.]+)px; width:([\d.]+)px', i).cast("double").cast("long")
    style = lambda i: F.regexp_extract(t, r'<span style="font-family: ([^;]+); font-size:(\d+)', i)
    shown = F.regexp_replace(F.regexp_replace(t, r'<span style="position[^>]*></span>\n', ""), "<[^>]*>", "")
    return _key(parse_files(_suppliers(spark, d, _sunk), "html"), shown.alias("shown"), box(1).alias("x"), F.ceil(F.regexp_extract(t, r'lr-tb; left:[\d.]+px; top:([\d.]+)px', 1).cast("double")).cast("long").alias("y"), box(3).alias("w"), style(1).alias("font"), F.concat(style(2), F.lit("px")).alias("size"))


@query(
    """WITH w AS (SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, unnest([s_name, '&', 'co']) AS word, unnest([36, 36 + 6 * (length(s_name) + 1), 36 + 6 * (length(s_name) + 3)]) AS x0 FROM supplier)
SELECT s_suppkey, word, CAST(x0 AS BIGINT) AS x0, CAST(83 AS BIGINT) AS y0, CAST(x0 + 6 * length(word) AS BIGINT) AS x1, CAST(93 AS BIGINT) AS y1 FROM w"""
)
def pdf_hocr(spark: SparkSession, d: str) -> DataFrame:
    """Words with their boxes, from the upper left corner of the page."""
    pattern = r"class='ocrx_word' title='bbox (\d+) (\d+) (\d+) (\d+); x_font Courier; x_fsize [\d.]+'>([^<]*)</span>"
    words = F.explode(F.arrays_zip(*(F.regexp_extract_all("text", F.lit(pattern), F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1", "word"), 1))))
    w = parse_files(_suppliers(spark, d, _sunk), "hocr").select("doc_id", words.alias("w"))
    return _key(w, F.col("w.word").alias("word"), *(F.col(f"w.{c}").cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")))


# -- files in a store ------------------------------------------------------------------------------------------


def _nations(spark: SparkSession, d: str) -> str:
    """A folder with a file for each nation, a fixed table: two pages, an outline, and a page mark."""

    def make(k: int, name: str) -> bytes:
        book = Book()
        book.resource("Font", "F1", COURIER)
        first, second = book.page(_shown(name)), book.page(_shown("page two"))
        root = len(book.objects) + 1
        book.add(b"<< /First %d 0 R /Last %d 0 R >>" % (root + 1, root + 2))
        book.add(b"<< /Title (%s) /Dest [%d 0 R /Fit] /Next %d 0 R >>" % (name.encode(), first, root + 2))
        book.add(b"<< /Title (two) /Dest [%d 0 R /Fit] >>" % second)
        book.catalog = b"/Outlines %d 0 R" % root
        return book.file()

    return stored(made(spark, d, "nation", ["n_nationkey", "n_name"], make))


def _nation(df: DataFrame, *columns) -> DataFrame:
    return df.select(F.regexp_extract("doc_id", r"(\d+)\.pdf$", 1).cast("long").alias("n_nationkey"), *columns)


_NATION = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, "


@query(_NATION + "n_name || repeat(chr(10), 2) || chr(12) || 'page two' || repeat(chr(10), 2) || chr(12) AS text FROM nation")
def api_extract_text(spark: SparkSession, d: str) -> DataFrame:
    return _nation(api.extract_text(spark, _nations(spark, d)), "text")


@query(_NATION + "'page two' || chr(10) AS text, 1 AS page_no, CAST(36 AS BIGINT) AS x0 FROM nation")
def api_extract_pages(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the chosen page."""
    pages = api.extract_pages(spark, _nations(spark, d), page_numbers=(1,))
    return _nation(pages.select("doc_id", "page_no", F.explode("lines").alias("x")), "page_no", F.col("x.text").alias("text"), F.col("x.x0").cast("long").alias("x0"))


@query(_NATION + "seq, level, coalesce(title, n_name) AS title, page_no FROM nation CROSS JOIN (VALUES (0, 1, NULL, 0), (1, 1, 'two', 1)) AS v(seq, level, title, page_no)")
def api_outline(spark: SparkSession, d: str) -> DataFrame:
    return _nation(api.toc(spark, _nations(spark, d)), "seq", "level", "title", "page_no")


@query(
    _NATION
    + """kind, head, foot, CAST(pages AS BIGINT) AS pages FROM nation CROSS JOIN (VALUES ('xml', '<?xml version="1.0" encoding="utf-8" ?>', '</pages>', 2), ('hocr', '<html xmlns=''http://www.w3.org/1999/xhtml'' xml:lang=''en'' lang=''en'' charset=''utf-8''>', '</body></html>', 2), ('html', '<html><head>', '</body></html>', 2), ('tag', '<page id="0" bbox="0.000,0.000,612.000,792.000" rotate="0">NATION', '</page>', 2), ('text', 'NATION', chr(12), 2)) AS v(kind, head, foot, pages)"""
)
def api_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents of every output type: their first and last lines, and how many pages they hold."""
    folder, out = _nations(spark, d), None
    marks = {"xml": '<page id="', "hocr": "class='ocr_page'", "html": '<a name="', "tag": '<page id="', "text": "\f"}
    for kind, mark in marks.items():
        t = F.col("text")
        foot = F.lit("\f") if kind == "text" else F.element_at(F.split(F.rtrim(F.regexp_replace(t, r"\n$", "")), "\n"), -1)
        head = F.regexp_replace(F.split(t, "\n")[0], "NATION.*$", "NATION")
        foot = F.regexp_extract(foot, "(</[a-z]+>)+$", 0) if kind != "text" else foot
        one = _nation(api.documents(spark, folder, kind), F.lit(kind).alias("kind"), head.alias("head"), foot.alias("foot"), ((F.length(t) - F.length(F.replace(t, F.lit(mark), F.lit("")))) / len(mark)).cast("long").alias("pages"))
        out = one if out is None else out.unionByName(one)
    return out


@query(_NATION + "name, CAST(size + by_n * n_nationkey AS BIGINT) AS size, head FROM nation CROSS JOIN (VALUES ('I.bmp', 70, 0, '424D'), ('I.0.bmp', 70, 0, '424D'), ('J.jpg', 6, 1, 'FFD8'), ('a%2Fb.jp2', 5, 0, '6A70')) AS v(name, size, by_n, head)")
def api_write_images(spark: SparkSession, d: str) -> DataFrame:
    """Images as files in a folder, read back; a picture that is drawn twice is there twice, and no name leaves its folder."""

    def make(k: int) -> bytes:
        image = b"/Type /XObject /Subtype /Image /Width 2 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceRGB"
        named = {"I": stream(bytes(range(12)), image), "J": stream(b"\xff\xd8jpeg" + bytes(k), image + b" /Filter /DCTDecode", compress=False), "a#2Fb": stream(b"jp2..", image + b" /Filter /JPXDecode", compress=False)}
        return one_page(b"/I Do /J Do /I Do /a#2Fb Do", XObject=named).file()

    folder = shared_dir(spark, "pictures").removeprefix("file://").removeprefix("file:")
    written = api.write_images(spark, stored(made(spark, d, "nation", ["n_nationkey"], make)), folder)
    files = spark.read.format("binaryFile").load(f"file://{folder}/*/*").select(F.regexp_replace("path", "^file:/*", "/").alias("file"), F.hex(F.substring("content", 1, 2)).alias("head"), F.length("content").cast("long").alias("size"))
    return _nation(written.drop("size", "name").join(files, "file"), F.element_at(F.split("file", "/"), -1).alias("name"), "size", "head")


@query(_SUPPLIER + "s_name || chr(12) AS text, CAST(612 AS BIGINT) AS width FROM supplier")
def pdf_table_functions(spark: SparkSession, d: str) -> DataFrame:
    """The tables as table functions of SQL, with options and without."""
    register_functions(spark)
    files = _suppliers(spark, d, lambda k, name: one_page(_shown(name)).file())
    sql = "SELECT f.path AS doc_id, t.text, p.width FROM {files} f, LATERAL pdf_text(f.path, f.content, map('layout', 'false')) t, LATERAL pdf_pages(f.path, f.content) p"
    return _key(spark.sql(sql, files=files), "text", _long("width"))


@query(_NATION + "page_no, 612.0::DOUBLE AS width FROM nation CROSS JOIN (VALUES (0), (1)) AS v(page_no)")
def pdf_data_source(spark: SparkSession, d: str) -> DataFrame:
    """The same tables as a registered source."""
    spark.dataSource.register(PdfSource)
    return _nation(spark.read.format("pdf").option("table", "pages").load(_nations(spark, d)), "page_no", "width")
