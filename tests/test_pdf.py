import pytest

from inkwell.functions.encodings import base_metrics, encoding, glyph_text, with_differences
from inkwell.functions.fonts import expand_vertical, expand_widths, unicode_map
from inkwell.operators import sinks
from inkwell.operators.interpret import Interpreter, operators
from inkwell.operators.layout import Line, Params, build_lines, group_lines, layout, page_text
from inkwell.plans.synth import stream, typeset, write_pdf
from inkwell.sources.document import Document, text_string
from inkwell.sources.pdf import TABLES, Options, PdfSource, label_text, read_pdf, rows_of, selected


def one_page(content: bytes, resources: bytes = b"/Font << /F1 5 0 R >>", more: list[bytes] = (), page: bytes = b"") -> bytes:
    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"
    return write_pdf([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count 1 /Kids [3 0 R] >>", b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 200 200] /Contents 4 0 R /Resources << %s >> %s >>" % (resources, page), stream(content), font, *more])


def items(data: bytes):
    doc = Document(data)
    return Interpreter(doc).page(next(doc.pages())[1])


def rows(data: bytes, table: str, **o):
    return list(rows_of("x", data, table, Options(**o)))


SPACED = one_page(
    b"BT /F1 24 Tf 1 0 0 1 100 700 Tm [(Hello ) -4166 (World)] TJ 1 0 0 1 100 600 Tm 100 Tw (Hello World) Tj 0 Tw 1 0 0 1 100 500 Tm 10 Tc (Hello ) Tj ET 0 0 9 9 re S",
    page=b"/MediaBox [0 0 612 792]",
)


@pytest.mark.parametrize("data", [SPACED, SPACED[: SPACED.rindex(b"startxref")]], ids=["whole", "without its reference table"])
@pytest.mark.parametrize("flow", [0.5, None])
def test_gaps_make_boxes_and_spaces(data, flow):
    assert [r[2] for r in rows(data, "text", boxes_flow=flow)] == ["Hello \n\nWorld\n\nHello \n\nWorld\n\nH e l l o  \n\n\f"]
    assert [r[2] for r in rows(data, "text", layout=False)] == ["Hello WorldHello WorldHello \f"]
    for table in TABLES:
        assert [r[-1] for r in rows(data, table) if r[-1]] == []


def test_line_widths_scale():
    got = items(one_page(b"2 w 0 0 m 9 9 l S 2 0 0 2 0 0 cm 2 w 0 0 m 9 9 l S")).rows
    assert [r["linewidth"] for r in got] == [2, 4]


def test_page_selection():
    assert list(selected(iter(range(10)), Options())) == list(range(10))
    assert list(selected(iter(range(10)), Options(page_numbers=(0, 9), maxpages=5))) == [0, 9]
    assert list(selected(iter(range(10)), Options(maxpages=3))) == [0, 1, 2]


def test_labels():
    assert [label_text(s, "", n, 0) for s, n in (("D", 12), ("r", 1994), ("R", 4), ("a", 28), ("A", 703), (None, 5))] == ["12", "mcmxciv", "IV", "ab", "AAA", ""]


def test_text_state_and_operand_rules():
    got = items(one_page(b"BT /F1 10 Tf 20 TL 10 100 Td (A) Tj T* (B) Tj 5 -7 TD (C) Tj T* (D) Tj 3 (E) Tj ET Q Q 1 0 Tz"))
    ys = {r["text"]: r["matrix"][5] for r in got.rows}
    assert (ys["A"], ys["B"], ys["C"], ys["D"]) == (100, 80, 73, 66)
    assert items(one_page(b"BT (no font) Tj /F1 10 Tf (x) Tj ET")).rows[0]["text"] == "x"


def test_quote_operators():
    got = items(one_page(b"BT /F1 10 Tf 12 TL 0 50 Td (a) ' 1 2 (bc) \" ET")).rows
    assert [r["matrix"][5] for r in got] == [38, 38, 38]
    assert got[2]["x0"] - got[1]["x1"] == pytest.approx(2)


def test_positions_and_advances():
    got = items(one_page(b"BT /F1 10 Tf 3 Tc 5 Tw 50 Tz 10 20 Td [(a b) -100 (c)] TJ ET")).rows
    a, space, b, c = got
    assert a["x0"] == 10 and a["adv"] == pytest.approx(5.56 * 0.5)
    assert space["x0"] == pytest.approx(a["x1"] + 1.5) and b["x0"] == pytest.approx(space["x1"] + 2.5 + 1.5)
    assert c["x0"] == pytest.approx(b["x1"] + 0.5 + 1.5)
    assert a["y0"] == pytest.approx(20 - 2.07) and a["size"] == pytest.approx(10)


def test_paths():
    got = items(one_page(b"1 0 0 RG 0 0 m 10 0 l S 0 0 10 20 re f 0 0 m 5 5 l 9 0 l h S 1 1 m 2 2 l 3 3 m 4 4 l S n 5 5 l S 0 0 m 1 1 l F 2 2 l S")).rows
    assert [r["kind"] for r in got] == ["line", "rect", "curve", "line", "line", "curve"]
    assert got[0]["scolor"] == (1, 0, 0) and got[1]["fill"] and not got[1]["stroke"]


@pytest.mark.parametrize(
    ("path", "kinds"),
    [
        (b"0 0 m 5 0 l 5 5 l 0 5 l 0 0 l", ["rect"]),  # comes home by itself
        (b"0 0 m 5 0 l 5 5 l 0 5 l 0 0 l h", ["rect"]),  # and is closed as well
        (b"0 0 m 5 5 l 5 5 l 0 5 l 0 0 l", ["curve"]),
        (b"0 0 m 5 0 l 5 5 l 0 5 l 0 1 l", ["curve"]),  # doesn't come home
        (b"0 0 m 5 0 l 5 5 l 0 0 l h", ["curve"]),  # a triangle
        (b"0 0 m 3 4 l h", ["line"]),
        (b"0 0 m 0 0 l h", ["line"]),
        (b"0 0 m 5 0 l h 1 1 l", ["curve"]),
        (b"0 0 m 5 0 l 5 5 l 0 5 l h 2 2 m 3 3 l 4 4 m", ["rect", "line"]),
        (b"4 4 m", ["curve"]),
        (b"1 1 l 0 0 m 2 2 l", []),
        (b"0 0 m 1 1 2 2 3 0 c h", ["curve"]),
        (b"0 0 m 0 5 l 1 5 l 1 0 l h", ["rect"]),
        (b"0 0 m 1 5 l 2 5 l 1 0 l h", ["curve"]),
    ],
)
def test_kinds_of_paths(path, kinds):
    assert [r["kind"] for r in items(one_page(path + b" S")).rows] == kinds


def test_points_of_paths():
    line, curve = items(one_page(b"2 0 0 2 1 1 cm 3 4 m 5 6 l h S 0 0 m 1 1 2 2 3 0 c 4 4 5 5 v 6 6 7 7 y h f")).rows
    assert line["pts"] == [(7, 9), (11, 13)] and line["original"] == [("m", [(7, 9)]), ("l", [(11, 13)]), ("h", [])]
    assert curve["pts"] == [(1, 1), (7, 1), (11, 11), (15, 15), (1, 1)] and curve["original"][1] == ("c", [(3, 3), (5, 5), (7, 1)])


def test_graphics_state_and_colors():
    got = items(one_page(b"q 2 0 0 2 0 0 cm 3 w 0.5 g q 1 0 0 rg 0 0 m 1 1 l B Q 0 0 m 1 1 l B Q 0 0 m 1 1 l B /Pattern cs /P1 scn 0 0 m 1 1 l B", b"/X 1")).rows
    assert [r["linewidth"] for r in got] == [6, 6, 0, 0] and [r["ncolor"] for r in got] == [(1, 0, 0), 0.5, 0, "P1"]


def test_inline_image_and_tags():
    got = items(one_page(b"/Span << /Lang (en) >> BDC BT /F1 10 Tf (t) Tj ET EMC /M MP q 20 0 0 20 5 5 cm BI /W 2 /H 1 /BPC 8 /CS /G ID ab\nEI Q"))
    image = [r for r in got.rows if r["kind"] == "image"][0]
    assert (image["width"], image["height"], image["x0"], image["x1"]) == (2, 1, 5, 25) and image["stream"].raw == b"ab"
    assert [(t["event"], t["tag"]) for t in got.tags] == [("begin", "Span"), ("end", None), ("point", "M")]
    assert "<Span Lang=\"en\">t</Span><M>" in sinks.tag_page(got.rows, got.tags, 0, (0, 0, 1, 1), 0)


def test_forms_and_cycles():
    form = b"/Type /XObject /Subtype /Form /BBox [0 0 10 10] /Matrix [1 0 0 1 50 50] /Resources << /Font << /F1 5 0 R >> /XObject << /X 6 0 R >> >>"
    got = items(one_page(b"/X Do", b"/XObject << /X 6 0 R >>", [stream(b"BT /F1 10 Tf (f) Tj ET /X Do", form)]))
    kinds = [r["kind"] for r in got.rows]
    assert kinds == ["figure", "glyph", "figure"] and got.rows[1]["x0"] == 50 and got.rows[1]["figure"] == (0,)


def test_rotation():
    data = one_page(b"BT /F1 10 Tf 20 30 Td (r) Tj ET", page=b"/Rotate 90")
    r = items(data).rows[0]
    assert not r["upright"] and r["matrix"] == (0, -1, 1, 0, 30, 180)


def test_objects_sections_and_recovery():
    data = typeset("one\ntwo", {"Title": "t"})
    assert Document(data).sections[0].kind == "table"
    broken = data[: data.rindex(b"startxref")]
    doc = Document(broken)
    assert doc.sections[0].kind == "scan" and len(list(doc.pages())) == 1
    assert rows(broken, "text", layout=False)[0][2] == "onetwo\f"
    assert rows(b"%PDF-1.4 junk", "text") == [] and rows(b"", "pages") == []


def test_object_and_reference_streams():
    members = b"1 0 2 34 " + b"<< /Type /Catalog /Pages 2 0 R >>".ljust(34) + b"<< /Type /Pages /Kids [] /Count 0 >>"
    body = bytearray(b"%PDF-1.5\n")
    at3 = len(body)
    body += b"3 0 obj\n" + stream(members, b"/Type /ObjStm /N 2 /First 9") + b"\nendobj\n"
    at4 = len(body)
    entries = b"".join(bytes([k]) + a.to_bytes(2, "big") + bytes([b]) for k, a, b in ((0, 0, 0), (2, 3, 0), (2, 3, 1), (1, at3, 0), (1, at4, 0)))
    body += b"4 0 obj\n" + stream(entries, b"/Type /XRef /W [1 2 1] /Size 5 /Root 1 0 R") + b"\nendobj\nstartxref\n%d\n%%%%EOF" % at4
    doc = Document(bytes(body))
    assert doc.sections[0].kind == "stream" and doc.get(2) == {"Type": "Pages", "Kids": [], "Count": 0} and doc.root["Type"] == "Catalog"


def test_outline_names_fields_attachments():
    data = write_pdf(
        [
            b"<< /Type /Catalog /Pages 2 0 R /Outlines 4 0 R /Dests << /d [3 0 R /Fit] >> /Names << /Dests << /Names [(n) [3 0 R /XYZ 0 0 0]] >> >> /AcroForm << /Fields [7 0 R] >> >>",
            b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
            b"<< /Type /Page /Parent 2 0 R >>",
            b"<< /First 5 0 R /Last 5 0 R >>",
            b"<< /Title (Top) /Dest /d /First 6 0 R /Last 6 0 R >>",
            b"<< /Title <FEFF00E9> /A << /S /GoTo /D (n) >> /Next 5 0 R >>",
            b"<< /T (name) /V (value) >>",
            b"<< /Type /Filespec /F (a.txt) /EF << /F 9 0 R >> >>",
            stream(b"attached"),
        ]
    )
    assert [(r[2], r[3], r[6]) for r in rows(data, "outlines")] == [(1, "Top", 0), (2, "é", 0)]
    assert {r[1]: r[3] for r in rows(data, "names")} == {"d": 0, "n": 0}
    assert rows(data, "fields")[0][1:3] == ("name", "value") and rows(data, "attachments")[0][2:4] == ("a.txt", b"attached")


def test_text_strings():
    assert text_string(b"\xfe\xff\x00A\x20\xac") == "A€" and text_string(b"\x80\xa0") == "•€"


def test_encodings_and_glyph_names():
    assert [glyph_text(n) for n in ("A", "eacute", "f_i", "uni00E9", "u1F600", "Euro.alt", "nope", "uniD800")] == ["A", "é", "fi", "é", "😀", "€", None, None]
    assert encoding("WinAnsiEncoding")[0x80] == "€" and encoding("StandardEncoding")[0xE1] == "Æ" and encoding("MacRomanEncoding")[0x80] == "Ä"
    assert with_differences("StandardEncoding", [65, "B", "zero", 200, "aring"])[66] == "0"
    widths, ascent, descent = base_metrics("Arial,Bold")
    assert widths["A"] == 722 and (ascent, descent) == (718, -207) and base_metrics("Courier")[0]["é"] == 600 and base_metrics("Unknown") is None


def test_more_glyph_names_and_base_widths():
    names = {"afii10017": "А", "afii10023": "Ё", "afii10097": "я", "Abreveacute": "Ắ", "Ahorn": None, "Ohorn": "Ơ", "alefhebrew": "א", "afii57664": "א", "registersans": "\uf8e8", "arrowright": "→", "club": "♣", "Zhecyrillic": "Ж", "ahiragana": "あ", "Udotbelow": "Ụ", "threesuperior": "³", "ffi": "ﬃ", "foursuperior": "⁴"}
    assert {n: glyph_text(n) for n in names} == names
    assert [base_metrics("Helvetica")[0][c] for c in "£©®Æ°±§¶™†×ďİį"] == [556, 737, 737, 1000, 400, 584, 556, 537, 1000, 556, 584, 643, 278, 222]
    assert [base_metrics("Times-BoldItalic")[0][c] for c in "¬−©¶Ł"] == [606, 606, 747, 500, 611] and base_metrics("Courier")[0]["Ă"] == 600
    assert base_metrics("Symbol")[0]["Σ"] == 592 and base_metrics("ZapfDingbats")[0]["!"] == 793 and base_metrics("Symbol")[1:] == (0, 0)


def test_width_runs_and_unicode_maps():
    assert expand_widths([1, [10, 20], 5, 7, 30]) == {1: 10, 2: 20, 5: 30, 6: 30, 7: 30}
    assert expand_vertical([1, [-1000, 500, 800], 3, 4, -900, 1, 2]) == {1: (-1000, (500, 800)), 3: (-900, (1, 2)), 4: (-900, (1, 2))}
    data = b"beginbfchar <01> <0041> <02> <00420043> endbfchar beginbfrange <03> <05> <0061> <06> <07> [<0031> <0032>] endbfrange"
    assert unicode_map(data) == {1: "A", 2: "BC", 3: "a", 4: "b", 5: "c", 6: "1", 7: "2"}


def test_maps_that_use_others(tmp_path, monkeypatch):
    import json

    from inkwell.functions import fonts

    monkeypatch.setenv("CMAP_PATH", str(tmp_path))
    (tmp_path / "Base-H.json").write_text(json.dumps({"CODE2CID": {"1": {"2": 7, "3": 8}}}))
    (tmp_path / "Over-V.json").write_text(json.dumps({"USECMAP": "Base-H", "IS_VERTICAL": True, "CODE2CID": {"1": {"3": 9}, "4": 1}}))
    assert fonts.code_map(fonts.cmap_resource("Over-V")) == {b"\1\2": 7, b"\1\3": 9, b"\4": 1}
    assert fonts.Font(widths={65: 500}, default_width=250).string_width(b"AB") == 0.75


def test_cid_font():
    cmap = stream(b"beginbfchar <0041> <0058> endbfchar")
    font = b"<< /Type /Font /Subtype /Type0 /BaseFont /F /Encoding /Identity-H /DescendantFonts [7 0 R] /ToUnicode 8 0 R >>"
    below = b"<< /Subtype /CIDFontType2 /BaseFont /F /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) >> /DW 500 /W [65 [250]] >>"
    got = items(one_page(b"BT /F2 10 Tf <004100420> Tj ET", b"/Font << /F2 6 0 R >>", [font, below, cmap])).rows
    assert [(r["text"], round(r["adv"], 3)) for r in got] == [("X", 2.5), ("(cid:66)", 5.0)]


def glyph(x0, y0, x1, y1, text="a", seq=0):
    return {"kind": "glyph", "x0": x0, "y0": y0, "x1": x1, "y1": y1, "text": text, "seq": seq, "figure": (), "font": "F", "size": y1 - y0, "ncs": "DeviceGray", "ncolor": 0, "undefined": False}


def test_lines_and_spaces():
    lines = build_lines([glyph(0, 0, 5, 10), glyph(5, 0, 10, 10), glyph(15, 0, 20, 10), glyph(100, 0, 105, 10, "z"), glyph(105, 0, 110, 10)], Params())
    assert [x.text for x in lines] == ["aa a", "za"]
    vertical = build_lines([glyph(0, 90, 10, 100), glyph(0, 80, 10, 90), glyph(0, 60, 10, 70)], Params(detect_vertical=True))
    assert [(x.vertical, x.text) for x in vertical] == [(True, "aa a")]


def test_boxes_and_lines_outside_the_page():
    def line(x0, y0, x1, y1):
        new = Line(False)
        new.add(glyph(x0, y0, x1, y1), 0.1)
        return new

    page = (0, 0, 50, 50)
    assert len(group_lines([line(5, 10, 20, 20), line(5, 22, 20, 32)], page, Params())) == 1
    assert len(group_lines([line(5, 100, 20, 110), line(5, 112, 20, 122)], page, Params())) == 2
    assert len(group_lines([line(5, 10, 20, 20), line(5, 26, 20, 36)], page, Params())) == 2


def test_reading_order_and_parameters():
    cells = [glyph(100, 150, 110, 160, "b"), glyph(0, 150, 10, 160, "a"), glyph(0, 0, 10, 10, "c")]
    for i, g in enumerate(cells):
        g["seq"] = i
    for flow in (0.5, None):
        out = layout(cells, (0, 0, 200, 200), Params(boxes_flow=flow))
        assert "".join(b.text[0] for b in out.boxes)[-1] == "c"
    for bad in (2, -1.5, "x", True):
        with pytest.raises(ValueError):
            Params(boxes_flow=bad)
    assert page_text([], (0, 0, 1, 1), Params()) == "\f"


def test_sinks():
    data = one_page(b"BT /F1 10 Tf 10 100 Td (a <b) Tj ET 0 0 5 5 re S")
    xml = rows(data, "xml")[0][2]
    assert "&lt;" in xml and '<rect linewidth="0" bbox="0.000,0.000,5.000,5.000" />' in xml and "<textgroup" not in xml
    assert "ocrx_word" in rows(data, "hocr")[0][2] and "left:" in rows(data, "html", layoutmode="exact")[0][2]
    assert sinks.xml_document([xml]).startswith('<?xml version="1.0" encoding="utf-8" ?>\n<pages>\n')
    assert sinks.html_document(["x"]).count("<a href=") == 1 and sinks.hocr_document([]).endswith("</html>\n")


def test_images():
    raw = stream(bytes(range(12)), b"/Type /XObject /Subtype /Image /Width 2 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceRGB")
    got = rows(one_page(b"/I Do", b"/XObject << /I 6 0 R >>", [raw]), "images")[0]
    assert got[15] == ".bmp" and got[16][:2] == b"BM" and got[16][54:60] == bytes([8, 7, 6, 11, 10, 9])
    assert sinks.bitmap(1, 9, 1, b"\xff\x80")[-4:] == b"\xff\x80\0\0"
    segment = b"\0\0\0\0" + bytes([48, 0, 1]) + (3).to_bytes(4, "big") + b"abc"
    whole = sinks.jbig2_file(segment)
    assert whole.startswith(sinks.JBIG2_HEAD) and [s[1] for s in sinks.jbig2_segments(whole[13:])] == [48, 49, 51]


def test_operators_of_ascii85_images():
    got = list(operators(b"BI /W 1 /H 1 /F /A85 ID 5sdp~> EI Q"))
    assert got[0][1].raw == b"5sdp~>" and got[1][0] == "Q"


def test_reading_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(typeset("hello\nworld"))
    (tmp_path / "b.pdf").write_bytes(b"not a file of this format")
    (tmp_path / "c.pdf").write_bytes(one_page(b"BT /F1 10 Tf (x) Tj ET", page=b"/Contents 99 0 R"))
    out = {r["doc_id"].rsplit("/", 1)[1]: r for r in read_pdf(spark, str(tmp_path), "text", boxes_flow="none").collect()}
    assert out["a.pdf"]["text"].split() == ["hello", "world"] and "b.pdf" not in out
    spark.dataSource.register(PdfSource)
    again = spark.read.format("pdf").option("table", "pages").option("page_numbers", "0").load(str(tmp_path))
    assert sorted(r["page_no"] for r in again.collect()) == [0, 0]
    objects = read_pdf(spark, str(tmp_path / "a.pdf"), "objects").selectExpr("parse_json(value) AS v")
    assert objects.selectExpr("count(variant_get(v, '$.d.Type.n', 'string')) AS n").first()["n"] == 4
    with pytest.raises(ValueError):
        Options.parse({"no_such_option": "1"})


def test_blocks_of_pages_give_the_same_rows(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(typeset("\n".join(map(str, range(400)))))
    (tmp_path / "b.pdf").write_bytes(b"junk")
    for table in ("text", "glyphs", "pages"):
        whole, parts = (sorted(map(str, read_pdf(spark, str(tmp_path), table, page_block=n, maxpages=6).collect())) for n in (0, 2))
        assert whole == parts and whole


def test_arriving_files(spark, tmp_path):
    from inkwell.streaming.arrivals import append_tables, stream_pdf

    inbox, out, state = (tmp_path / n for n in ("in", "out", "state"))
    inbox.mkdir()
    for n, text in (("a", "first"), ("b", "second")):
        (inbox / f"{n}.pdf").write_bytes(typeset(text))
        append_tables(stream_pdf(spark, str(inbox), "text"), str(out), str(state)).awaitTermination()
    assert sorted(r["text"].strip() for r in spark.read.parquet(str(out)).collect()) == ["first", "second"]
