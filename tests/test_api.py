import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell import api
from inkwell.functions import casts
from inkwell.functions import geometry as G
from inkwell.operators import cmap_tables
from inkwell.operators.dump import document_xml, object_xml, outline_xml
from inkwell.plans.books import one_page
from inkwell.plans.synth import stream, typeset
from inkwell.sources import pdf
from inkwell.sources.document import Document
from inkwell.sources.pdf import TABLES, Options, rows_of


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.pdf").write_bytes(typeset("\n".join(f"line {i}" for i in range(70))))
    return str(tmp_path)


def test_documents_of_all_types(spark, folder):
    text = api.extract_text(spark, folder).first()["text"]
    assert text.count("\f") == 2 and text.startswith("line 0\nline 1\n") and "line 69" in text
    for kind, end in (("xml", "</pages>\n"), ("html", "</body></html>\n"), ("hocr", "</html>\n"), ("tag", "</page>\n")):
        assert api.documents(spark, folder, kind).first()["text"].endswith(end)
    pages = {r["page_no"]: r["lines"] for r in api.extract_pages(spark, folder).collect()}
    assert len(pages[0]) == 60 and pages[1][0]["text"] == "line 60\n"
    with pytest.raises(ValueError):
        api.documents(spark, folder, "doc")


def test_writing_and_command_line(spark, folder, tmp_path, capsys):
    api.write(spark, folder, str(tmp_path / "out"), "xml")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    api.main([folder, "-p", "2", "-F", "disabled"])
    assert capsys.readouterr().out.startswith("line 60\n")


def test_images_in_a_folder(spark, tmp_path):
    """Names stay apart whatever they are; files of one name in two folders too; a second run gives the same files; what has no images gives none."""
    image = b"/Type /XObject /Subtype /Image /Width 1 /Height 1 /BitsPerComponent 8 /Filter /DCTDecode"
    named = {n: stream(n.encode(), image, compress=False) for n in ("I", "I.0", "..", "a#2F..#2Fb")}
    data = one_page(b"/I Do /I.0 Do /I Do /.. Do /a#2F..#2Fb Do", XObject=named).file()
    for sub in ("x", "y"):
        (tmp_path / "in" / sub).mkdir(parents=True)
        (tmp_path / "in" / sub / "a b.pdf").write_bytes(data)
    (tmp_path / "in" / "x" / "none.pdf").write_bytes(typeset("text"))
    target, paths = tmp_path / "out", [str(tmp_path / "in" / sub) for sub in ("x", "y")]
    for _ in range(2):
        rows = api.write_images(spark, paths, str(target)).collect()
        files = sorted(p for p in target.rglob("*") if p.is_file())
        assert sorted(r["file"] for r in rows) == sorted(map(str, files)) and len(files) == 10 and len(list(target.iterdir())) == 2
    one = sorted(target.iterdir())[0]
    assert {p.name: p.read_bytes() for p in one.iterdir()} == {"I.jpg": b"I", "I.0.jpg": b"I.0", "I.1.jpg": b"I", "...jpg": b"..", "a%2F..%2Fb.jpg": b"a#2F..#2Fb"}
    with pytest.raises(ValueError):
        api.write_images(spark, paths, "store://x/y")


def test_large_rows_leave_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(pdf, "BATCH_BYTES", 10)
    files = spark.createDataFrame([("a", bytearray(typeset("\n".join(f"line {i}" for i in range(200)))))], "path string, content binary")
    assert pdf.parse_files(files, "text").count() == 4


def test_dump():
    doc = Document(typeset("x"))
    xml = document_xml(doc, True)
    assert xml.count("<object id=") == 5 and "<trailer>" in xml and '<ref id="2" />' in xml and "<literal>Catalog</literal>" in xml
    assert object_xml([1, b"a<", None, True]) == '<list size="4">\n<number>1</number>\n<string size="2">a&#60;</string>\n<null />\n<number>True</number>\n</list>'
    assert "<pageno>3</pageno>" in outline_xml([(1, "t", None, 3)])


def test_collections(spark, tmp_path):
    (tmp_path / "c.txt").write_text("# comment\nCID\tUniJIS-UTF8\tUniJIS-UTF16\tH\n1\t41,42\t0041\t2121\n2\t43,44v\t*\t2122v\n3\t41\t*\t*\n")
    rows = cmap_tables.code_rows(spark, str(tmp_path / "c.txt"))
    assert {bytes(r["code"]): r["cid"] for r in cmap_tables.code_map(rows, "UniJIS-UTF8").collect()} == {b"A": 1, b"B": 1, b"C": 2}
    assert {r["cid"]: r["text"] for r in cmap_tables.unicode_rows(rows).collect()} == {1: "A", 2: "C", 3: "A"}
    assert {r["cid"]: r["text"] for r in cmap_tables.unicode_rows(rows, True).collect()} == {1: "A", 2: "D", 3: "A"}


def test_number_formats(spark):
    df = spark.createDataFrame([(n,) for n in (1, 4, 9, 26, 27, 702, 703, 1994, 3999, 0)], "n int")
    got = {r[0]: r[1:] for r in df.select("n", G.roman(F.col("n")), G.alpha(F.col("n"))).collect()}
    assert got[1] == ("i", "a") and got[4] == ("iv", "d") and got[27] == ("xxvii", "aa") and got[702] == ("dccii", "zz") and got[703][1] == "aaa"
    assert got[1994][0] == "mcmxciv" and got[3999][0] == "mmmcmxcix" and got[0] == (None, None)


def test_casts(spark):
    df = spark.createDataFrame([("1.5", ["1", "2", "x", "4"], b"\x01\x00", -1), ("x", ["1", "2", "3", "4"], b"", 5)], "a string, b array<string>, c binary, d int")
    got = [tuple(r) for r in df.select(casts.number(F.col("a")), casts.integer(F.col("a")), casts.numbers(F.col("b"), 4), casts.rectangles(F.col("b")), casts.pieces(F.col("b"), 3), casts.unsigned(F.col("c")), casts.signed_to_unsigned(F.col("d"), 32)).collect()]
    assert got[0] == (1.5, None, None, [None], [["1", "2", "x"]], 256, 2**32 - 1)
    assert got[1] == (None, None, [1, 2, 3, 4], [[1, 2, 3, 4]], [["1", "2", "3"]], 0, 5)


def test_strings(spark):
    row = spark.range(1).select(G.escape_markup(F.lit("<a & 'b'>")), G.strip_control(F.lit("a\x00b\tc")), G.shorten(F.lit("abcdefghijklmnop"), 11), G.rect_text(*map(F.lit, (1.0, 2.0, 3.0, 4.5)))).first()
    assert tuple(row) == ("&lt;a &amp; &#x27;b&#x27;&gt;", "ab\tc", "abc ... nop", "1.000,2.000,3.000,4.500")


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.integers(0, 5000), st.sampled_from(sorted(TABLES)))
def test_damaged_files_give_rows_or_an_error(noise, at, table):
    data = typeset("some text\nmore of it")
    at %= len(data)
    for broken in (b"%PDF-1.4 /Root " + noise, data[:at] + noise + data[at + len(noise) :]):
        list(rows_of("x", broken, table, Options()))
