import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.functions import geometry as G
from inkwell.functions.syntax import Op, values
from inkwell.operators import runs
from inkwell.operators.interpret import Interpreter, operators
from inkwell.plans import queries as plans
from inkwell.plans.synth import typeset
from inkwell.sources.document import Document
from inkwell.sources.pdf import Options, parse_files, rows_of

from .conftest import SF
from .test_pdf import SPACED, one_page

TURNS = one_page(b"BT /F1 10 Tf 3 Tc 5 Tw 50 Tz 10 20 Td [(a b) -100 (c)] TJ (d e) Tj 0 Tc (f g) Tj (h) Tj 1 0 0 rg (i) Tj 0 1 -1 0 5 5 Tm (turned) Tj 1 0 0 1 3 3 Tm (a\\)b\\\\ \\101\\r (n) x) Tj <4142> Tj ET 0 0 9 9 re S BT (j) Tj ET")
BACK = one_page(b"BT /F1 10 Tf -1 Tc (abc) Tj -50 Tz (def) Tj 50 Tz 0 Tc -9 Tw (g h) Tj [] TJ () Tj (i) Tj ET")
FILES = [("spaced", SPACED), ("turns", TURNS), ("noise", b"no file"), ("back", BACK), ("scanned", SPACED[: SPACED.rindex(b"startxref")]), ("long", typeset("line of words, (signs) \\ and more\n\n" * 200))]


def _plain(value):
    return tuple(value) if isinstance(value, list) else value


@pytest.mark.parametrize("options", [Options(), Options(rotation=90), Options(undefined="?"), Options(page_numbers=(0, 2)), Options(page_block=1)], ids=str)
def test_runs_give_the_rows_of_glyphs(spark, monkeypatch, options):
    """The same numbers to the last bit, in order, whatever the batches."""
    files = spark.createDataFrame(FILES, "path string, content binary").coalesce(1)
    expected = [tuple(map(_plain, r)) for name, data in FILES for r in rows_of(name, data, "glyphs", options if not options.page_block else Options())]
    got = [tuple(map(_plain, r)) for r in parse_files(files, "glyphs", options).collect()]
    if options.page_block:
        got, expected = (sorted(x, key=lambda r: (r[0], r[1] is None, r[1:3])) for x in (got, expected))
    assert got == expected and len(got) > 100
    some = parse_files(files, "glyphs", options, columns=("page_no", "x0"))
    assert some.columns == ["doc_id", "page_no", "x0", "error"]
    at = parse_files(files, "glyphs").columns
    assert sorted(map(str, map(tuple, some.collect()))) == sorted(str(tuple(r[at.index(c)] for c in some.columns)) for r in expected)


def test_a_string_is_one_run():
    """A string's glyphs are no rows of their own, and long ones leave in parts."""
    doc = Document(one_page(b"BT /F1 10 Tf (" + b"abc " * 5000 + b") Tj (d) Tj ET 0 0 m 1 1 l S"))
    page = Interpreter(doc, packed=True).page(next(doc.pages())[1])
    first, second, line = page.rows
    assert (first.count, second.seq, line["seq"]) == (20000, 20000, 20001)
    parts = list(runs.parts(first, 7000))
    assert [(p.seq, p.count) for p in parts] == [(0, 7000), (7000, 7000), (14000, 6000)]
    schema = pa.schema([("seq", pa.int64()), ("x0", pa.float64()), ("text", pa.string())])
    whole, cut = (runs.batch([("x", 0, r) for r in some], schema, lambda font, cid: font.text(cid), str) for some in ([first], parts))
    assert whole.equals(cut)


@pytest.mark.parametrize(
    "data",
    [
        b"1 0 0 1 36.5 -.5 Tm (a \\(b\\) \\\\) Tj (n (e) st) Tj (\\101\\\n\r) Tj +3 w",
        b"1 2 3 (x) /N 4 true null f 5 6 R 7 0 R g [1 (a) foo 2 0 R] TJ << /A 1 >> BDC ] > ) T* (open",
        b"% note\n1 % (more)\n2 l\x003\x00w 4.5.6 x 1-2 y f*/N gs(a)'(b)\"1 0 0 rg(c)Tj",
        b"BI /W 2 /H 1 ID ab\nEI 1 w BI foo 2 w 3 ID xx\nEI q 1 2 3",
        b"5 6 cm 7", b"", b"q", b"true false R", b"2 true 3 l",
    ],
)
def test_statements_are_the_tokens(data):
    """Statements read by one expression are those that the token machine reads."""
    got = [(None if op is None else str(op), extra) for op, extra in operators(data)]
    if b"BI" in data:
        assert [(op, getattr(x, "raw", x)) for op, x in got] == [("EI", b"ab"), (None, 1), ("w", None), ("foo", None), ("w", None), ("EI", b"xx"), ("q", None), (None, 1), (None, 2), (None, 3)]
        return
    assert got == [(str(v), None) if type(v) is Op else (None, v) for _, v, _ in values(data)]


def test_rounding_is_that_of_round(spark):
    cases = [0.0, 0.49999999999999994, 0.5, 0.5000000000000001, 1.5, 2.5, -0.5, -0.49999999999999994, -1.5, -2.5, -2.4, 1e15 + 0.5, 4503599627370497.5, -7.0, None]
    x = spark.createDataFrame([(c,) for c in cases], "x double")
    assert x.filter(~G.rounded(F.col("x")).eqNullSafe(F.round("x").cast("long"))).count() == 0


def test_glyph_positions_read_only_what_they_need(spark):
    plan = plans.pdf_glyph_positions(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "x0" in plan and "matrix" not in plan and "fontsize" not in plan
