"""Queries over the driver's tables, each with the SQL that gives the same rows.

Documents are typeset to PDF files, which the parser reads again; other queries take the relational operators (windows, range joins,
recursion, look-ups) on tables of the same shape.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import crypto, filters
from inkwell.functions import geometry as G
from inkwell.operators import layout as L
from inkwell.operators import tables as R
from inkwell.plans import codecs, synth
from inkwell.sources.pdf import Options, parse_files


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Parsing costs far more than moving the texts, so they are dealt out evenly first."""
    tasks = max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return synth.typeset_table(_table(spark, d, "documents").select("doc_id", "text", "source", "lang").repartition(tasks, "doc_id"))


def _page_glyphs(spark: SparkSession, d: str, keep: F.Column | None = None) -> DataFrame:
    """Glyphs of all documents, each page's together and in order. Texts are dealt out before they become glyphs, which are many times as large."""
    docs = _table(spark, d, "documents").select("doc_id", "text").repartition(spark.sparkContext.defaultParallelism * 2, "doc_id")
    return synth.glyph_table(synth.numbered_lines(docs), keep)


def _long(c: str) -> F.Column:
    return F.col(c).cast("long").alias(c)


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Lines as the typesetter cuts them, in SQL.
_LINES = f"""
WITH parts AS (
  SELECT doc_id, i AS p, w FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS w, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), cut AS (
  SELECT doc_id, p, q, substr(w, CAST(q * {synth.COLUMNS} + 1 AS BIGINT), {synth.COLUMNS}) AS line FROM parts, LATERAL (SELECT unnest(range(0, CAST(greatest(ceil(length(w) / {synth.COLUMNS}.0), 1) AS BIGINT))) AS q)
), lines AS (
  SELECT doc_id, (n // {synth.ROWS}) AS page_no, n % {synth.ROWS} AS row, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, q) - 1 AS n FROM cut)
)
"""

# -- files -----------------------------------------------------------------------------------------------------


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(replace(coalesce(text, ''), chr(10), '')) AS text_md5, length(replace(coalesce(text, ''), chr(10), '')) AS n_chars FROM documents")
def pdf_text_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Text of every file without layout analysis."""
    text = parse_files(_files(spark, d), "text", Options(layout=False))
    pages = text.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    whole = F.replace(F.array_join(F.transform("p", lambda x: x["text"]), ""), F.lit("\f"), F.lit(""))
    return pages.select("doc_id", F.md5(whole.cast("binary")).alias("text_md5"), F.length(whole).cast("long").alias("n_chars"))


@query(_LINES + "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(max(page_no) + 1 AS BIGINT) AS pages FROM lines GROUP BY doc_id")
def pdf_page_count(spark: SparkSession, d: str) -> DataFrame:
    return parse_files(_files(spark, d), "docs").select("doc_id", _long("pages"))


@query(
    _LINES
    + """SELECT CAST(doc_id AS VARCHAR) AS doc_id, page_no AS page_no, CASE page_no WHEN 0 THEN 'i' WHEN 1 THEN 'ii' ELSE 'p-' || CAST(page_no - 1 AS VARCHAR) END AS label, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height
FROM (SELECT DISTINCT doc_id, page_no FROM lines) WHERE page_no IN (0, 2, 5)"""
)
def pdf_pages_selected(spark: SparkSession, d: str) -> DataFrame:
    """Pages 0, 2 and 5 with labels and the inherited page box."""
    return parse_files(_files(spark, d), "pages", Options(page_numbers=(0, 2, 5))).select("doc_id", _long("page_no"), "label", "width", "height")


@query(_LINES + "SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(DISTINCT page_no) AS pages FROM lines WHERE page_no < 3 GROUP BY doc_id")
def pdf_pages_limit(spark: SparkSession, d: str) -> DataFrame:
    return parse_files(_files(spark, d), "pages", Options(maxpages=3)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))


@query(
    _LINES
    + f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, page_no, CAST(sum(length(line)) AS BIGINT) AS glyphs,
CAST(sum(length(line) * {1000 * synth.LEFT} + length(line) * (length(line) - 1) / 2 * {600 * synth.SIZE}) AS BIGINT) AS x_sum, CAST(sum(length(line) * ({1000 * synth.TOP} - row * {1000 * synth.STEP} - {194 * synth.SIZE})) AS BIGINT) AS y_sum
FROM lines WHERE line <> '' GROUP BY doc_id, page_no"""
)
def pdf_glyph_positions(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of all glyphs, in thousandths of a point, by page."""
    g = parse_files(_files(spark, d), "glyphs", columns=("page_no", "x0", "y0"))
    return g.filter("page_no IS NOT NULL").groupBy("doc_id", _long("page_no")).agg(F.count(F.lit(1)).alias("glyphs"), F.sum(G.rounded(F.col("x0") * 1000)).alias("x_sum"), F.sum(G.rounded(F.col("y0") * 1000)).alias("y_sum"))


@query(
    _LINES
    + """, filled AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY row) AS k FROM lines WHERE trim(line) <> '')
SELECT CAST(doc_id AS VARCHAR) AS doc_id, page_no, count(DISTINCT row - k) AS boxes, CAST(sum(length(line) + 1) AS BIGINT) AS chars FROM filled GROUP BY doc_id, page_no"""
)
def pdf_text_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Text boxes by page: runs of lines without an empty line between them."""
    b = parse_files(_files(spark, d), "text_boxes", Options(boxes_flow=None, word_margin=0.0))
    return b.filter("page_no IS NOT NULL").groupBy("doc_id", _long("page_no")).agg(F.count(F.lit(1)).alias("boxes"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(source, '') AS title, coalesce(lang, '') AS lang FROM documents")
def pdf_metadata(spark: SparkSession, d: str) -> DataFrame:
    info = F.from_json("info", "array<map<string,string>>")[0]
    return parse_files(_files(spark, d), "docs").select("doc_id", info["Title"].alias("title"), info["Lang"].alias("lang"))


@query(_LINES + "SELECT CAST(doc_id AS VARCHAR) AS doc_id, 3 + 2 * (max(page_no) + 1) + 1 AS objects, max(page_no) + 1 AS streams FROM lines GROUP BY doc_id")
def pdf_objects(spark: SparkSession, d: str) -> DataFrame:
    o = parse_files(_files(spark, d), "objects")
    return o.groupBy("doc_id").agg(F.count(F.lit(1)).alias("objects"), F.count("raw").alias("streams"))


# -- layout with windows and joins -----------------------------------------------------------------------------


@query(_LINES + "SELECT doc_id, page_no, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS glyphs FROM lines WHERE line <> '' GROUP BY doc_id, page_no")
def lines_from_glyphs(spark: SparkSession, d: str) -> DataFrame:
    lines = L.fold_lines(_page_glyphs(spark, d), ["doc_id", "page_no"])
    return lines.groupBy("doc_id", _long("page_no")).agg(F.count(F.lit(1)).alias("lines"), F.sum("glyphs").alias("glyphs"))


@query(_LINES + r"SELECT doc_id, page_no, row, md5(trim(regexp_replace(line, ' +', ' ', 'g'))) AS text_md5 FROM lines WHERE trim(line) <> ''")
def word_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose blanks were not drawn get them back from the gaps between glyphs. Lines are set three times as far apart as they are wide at most, so each row is a line."""
    lines = L.fold_lines(_page_glyphs(spark, d, F.col("text") != " "), ["doc_id", "page_no", "row"], L.Params(char_margin=1000.0))
    return lines.select("doc_id", _long("page_no"), _long("row"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    _LINES
    + """SELECT doc_id, page_no, count(*) AS pairs FROM (
SELECT a.doc_id, a.page_no FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND abs(a.row - b.row) = 1 WHERE a.line <> '' AND b.line <> '') GROUP BY doc_id, page_no"""
)
def line_neighbors(spark: SparkSession, d: str) -> DataFrame:
    lines = L.fold_lines(_page_glyphs(spark, d), ["doc_id", "page_no"])
    return L.line_neighbors(lines, ["doc_id", "page_no"]).groupBy("doc_id", _long("page_no")).agg(F.count(F.lit(1)).alias("pairs"))


@query(_LINES + "SELECT doc_id, page_no, row, count(*) AS words FROM (SELECT doc_id, page_no, row, unnest(string_split(line, ' ')) AS w FROM lines) WHERE w <> '' GROUP BY doc_id, page_no, row")
def hocr_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of each line as runs of glyphs between blanks: gaps and islands."""
    return L.fold_words(_page_glyphs(spark, d), ["doc_id", "page_no", "row"]).groupBy("doc_id", _long("page_no"), _long("row")).agg(F.count(F.lit(1)).alias("words"))


@query(
    _LINES
    + """SELECT doc_id, page_no, count(*) AS items, count(*) FILTER (WHERE part = 0) AS filled, count(*) FILTER (WHERE part = 1) AS blank FROM (
SELECT doc_id, page_no, 0 AS part FROM lines WHERE trim(line) <> '' UNION ALL SELECT doc_id, page_no, 1 FROM lines WHERE trim(line) = '') GROUP BY doc_id, page_no"""
)
def page_items(spark: SparkSession, d: str) -> DataFrame:
    """An ordered union of filled and empty lines, split by a predicate."""
    lines = synth.numbered_lines(_table(spark, d, "documents"))
    filled, blank = R.split_by(lines, F.trim("line") != "")
    both = R.ordered_union([filled, blank])
    return both.groupBy("doc_id", _long("page_no")).agg(F.count(F.lit(1)).alias("items"), F.count(F.when(F.col("part") == 0, 1)).alias("filled"), F.count(F.when(F.col("part") == 1, 1)).alias("blank"))


@query(_LINES + ", g AS (SELECT source, lang, sum(length(line)) AS n FROM lines JOIN documents USING (doc_id) GROUP BY source, lang) SELECT source, lang, CAST(sum(n) AS BIGINT) AS glyphs FROM g GROUP BY CUBE (source, lang)")
def glyph_cube(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    lines = synth.numbered_lines(docs).join(docs.select("doc_id", "source", "lang"), "doc_id")
    return lines.cube("source", "lang").agg(F.sum(F.length("line")).cast("long").alias("glyphs"))


# -- filters and ciphers ---------------------------------------------------------------------------------------

_MD5 = "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents"


def _through(name: str, encode, decode):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [decode(encode((t or "").encode())) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(out, pa.binary())], names=["doc_id", "data"])

    def f(spark: SparkSession, d: str) -> DataFrame:
        return _table(spark, d, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, data binary").select("doc_id", F.md5("data").alias("text_md5"))

    f.__name__ = name
    query(_MD5)(f)


_through("codec_flate", codecs.flate, filters.flate)
_through("codec_lzw", codecs.lzw, filters.lzw)
_through("codec_ascii85", codecs.ascii85, filters.ascii85)
_through("codec_runlength", codecs.run_length, filters.run_length)
_through("codec_png_predictor", lambda t: codecs.png(t, 16), lambda p: filters.png_predictor(p, 1, 16, 8).rstrip(b"\0"))
_through("codec_tiff_predictor", lambda t: codecs.tiff(t, 16), lambda p: filters.tiff_predictor(p, 1, 16, 8).rstrip(b"\0"))


@query(_MD5)
def codec_hex(spark: SparkSession, d: str) -> DataFrame:
    """ASCII hex with built-in functions; an odd last digit is filled up on the right."""
    text = F.concat(F.hex(F.coalesce("text", F.lit("")).cast("binary")), F.lit(">"))
    return _table(spark, d, "documents").select("doc_id", F.md5(R.decode_hex(text)).alias("text_md5"))


@query("SELECT c_custkey, md5(coalesce(c_name, '')) AS name_md5 FROM customer")
def codec_rc4(spark: SparkSession, d: str) -> DataFrame:
    return _cipher(spark, d, lambda k, t: crypto.rc4(k, crypto.rc4(k, t)))


@query("SELECT c_custkey, md5(coalesce(c_name, '')) AS name_md5 FROM customer")
def codec_aes(spark: SparkSession, d: str) -> DataFrame:
    def there_and_back(k: bytes, t: bytes) -> bytes:
        n = 16 - len(t) % 16
        return crypto.unpad(crypto.aes_cbc(k, bytes(16), crypto.aes_cbc(k, bytes(16), t + bytes([n]) * n, encrypting=True)))

    return _cipher(spark, d, there_and_back)


def _cipher(spark: SparkSession, d: str, f) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [f(k.to_bytes(16, "big"), (t or "").encode()) for k, t in zip(b["c_custkey"].to_pylist(), b["c_name"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["c_custkey"], pa.array(out, pa.binary())], names=["c_custkey", "data"])

    return _table(spark, d, "customer").select("c_custkey", "c_name").mapInArrow(run, "c_custkey long, data binary").select("c_custkey", F.md5("data").alias("name_md5"))


# -- geometry --------------------------------------------------------------------------------------------------


def _ints(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.col(c).cast("long").alias(a) for c, a in (("l_quantity", "q"), ("l_partkey", "p"), ("l_suppkey", "s"), ("l_orderkey", "o"), ("l_linenumber", "n"))))


_INTS = "WITH t AS (SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS BIGINT) AS q, l_partkey AS p, l_suppkey AS s, l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS n FROM lineitem) "


@query(_INTS + "SELECT l_orderkey, l_linenumber, q * 2 - n * 3 AS a, q * n + n * q AS b, s * 2 - q * 3 AS c, s * n + q * q AS d, p * 2 - o * 3 + 5 AS e, p * n + o * q + s AS f FROM t")
def matrix_compose(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    m = G.compose([c("q"), c("n"), c("s"), c("q"), c("p"), c("o")], [F.lit(2), c("n"), F.lit(-3), c("q"), F.lit(5), c("s")])
    return _ints(spark, d).select("l_orderkey", "l_linenumber", *(x.cast("long").alias(n) for x, n in zip(m, "abcdef", strict=True)))


@query(_INTS + "SELECT l_orderkey, l_linenumber, -q AS x0, least(p, p + s) AS y0, CAST(0 AS BIGINT) AS x1, greatest(p, p + s) AS y1 FROM t")
def rect_hull(spark: SparkSession, d: str) -> DataFrame:
    """A box turned by a quarter."""
    c, zero = F.col, F.lit(0)
    m = [zero, F.lit(1), F.lit(-1), zero, zero, c("p")]
    hull = G.apply_rect(m, zero, zero, c("s"), c("q"))
    return _ints(spark, d).select("l_orderkey", "l_linenumber", *(x.cast("long").alias(n) for x, n in zip(hull, ("x0", "y0", "x1", "y1"), strict=True)))


@query(
    _INTS
    + """SELECT l_orderkey, l_linenumber,
CASE WHEN s <= q + n AND q <= s + 4 THEN 0 ELSE least(abs(q - s - 4), abs(q + n - s)) END AS dist, CASE WHEN s <= q + n AND q <= s + 4 THEN least(abs(q - s - 4), abs(q + n - s)) ELSE 0 END AS over,
(greatest(q + n, s + 4) - least(q, s)) * 10 - n * 10 - 40 AS waste FROM t"""
)
def box_distance(spark: SparkSession, d: str) -> DataFrame:
    t = _ints(spark, d).withColumns({"a1": F.col("q") + F.col("n"), "b1": F.col("s") + 4, "lo": F.lit(0), "hi": F.lit(10)})
    a, b = G.Box("q", "lo", "a1", "hi"), G.Box("s", "lo", "b1", "hi")
    return t.select("l_orderkey", "l_linenumber", G.distance_h(a, b).cast("long").alias("dist"), G.overlap_h(a, b).cast("long").alias("over"), G.hull_waste(a, b).cast("long").alias("waste"))


@query(
    _INTS
    + """, f AS (SELECT *, CASE WHEN p % 6 <= 1 THEN 'line' WHEN p % 6 = 2 AND s % 3 = 0 THEN 'rect' WHEN p % 6 = 3 AND q % 2 = 0 THEN 'rect' ELSE 'curve' END AS kind FROM t)
SELECT kind, n AS line_number, count(*) AS paths FROM f GROUP BY ALL"""
)
def path_classify(spark: SparkSession, d: str) -> DataFrame:
    """Subpaths by their edges: open and closed lines, four-sided ones upright or slanting, four-sided ones that come home or don't, triangles, curves."""
    c = F.col
    at = lambda x, y: F.struct(F.lit(x).cast("long").alias("x") if isinstance(x, int) else x.cast("long").alias("x"), F.lit(y).cast("long").alias("y") if isinstance(y, int) else y.cast("long").alias("y"))
    kind, slant = c("p") % 6, c("s") % 3
    corners = (
        F.when(kind == 0, F.array(at(0, 0), at(c("q"), c("n"))))
        .when(kind == 1, F.array(at(0, 0), at(c("q"), c("n")), at(0, 0)))
        .when(kind == 2, F.array(at(0, 0), at(slant, c("n")), at(slant + c("q"), c("n")), at(c("q"), 0), at(0, 0)))
        .when(kind == 3, F.array(at(0, 0), at(c("q"), 0), at(c("q"), c("n")), at(0, c("n")), at(0, c("q") % 2)))
        .when(kind == 4, F.array(at(0, 0), at(c("q"), 0), at(c("q"), c("n")), at(0, 0)))
        .otherwise(F.array(at(0, 0), at(c("q"), 0), at(c("q"), c("n")), at(0, c("n")), at(0, 0)))
    )
    t = _ints(spark, d).withColumn("corners", corners)
    return R.classify_edges(t, "corners", kind == 5, kind.isin(1, 2, 4, 5)).groupBy("kind", c("n").alias("line_number")).agg(F.count(F.lit(1)).alias("paths"))


@query(
    _INTS
    + """, b AS (SELECT *, q + n - q - n AS z, greatest(q + n, s + 4) - least(q, s) - n - 4 AS w, greatest(10, 5 + n) - least(0, 5) - 10 - n AS h FROM t)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN w < 0 AND h < 0 THEN q + q + n - s - s - 4 ELSE 2 * greatest(w, 0) END AS BIGINT) AS dx2, CAST(CASE WHEN w < 0 AND h < 0 THEN 10 - 10 - n ELSE 2 * greatest(h, 0) END AS BIGINT) AS dy2 FROM b"""
)
def box_vector(spark: SparkSession, d: str) -> DataFrame:
    """What lies between two boxes, or between their middles, in halves."""
    t = _ints(spark, d).withColumns({"a1": F.col("q") + F.col("n"), "b1": F.col("s") + 4, "lo": F.lit(0), "hi": F.lit(10), "low": F.lit(5), "high": F.col("n") + 5})
    x, y = G.between(G.Box("q", "lo", "a1", "hi"), G.Box("s", "low", "b1", "high"))
    return t.select("l_orderkey", "l_linenumber", (x * 2).cast("long").alias("dx2"), (y * 2).cast("long").alias("dy2"))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CAST(trunc(l_quantity) AS BIGINT) AS score FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY trunc(l_quantity) DESC, l_linenumber) = 1")
def pick_best(spark: SparkSession, d: str) -> DataFrame:
    """The row with the highest score of each key, the first of equals."""
    t = _table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.col("l_quantity").cast("long").alias("score"))
    return R.pick(t, ["l_orderkey"], "score", "line")


@query(
    """WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN CAST(round(value * 100) AS BIGINT) END AS color FROM events)
SELECT user_id, event_id, coalesce(last_value(color IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), -1) AS color FROM e"""
)
def color_state(spark: SparkSession, d: str) -> DataFrame:
    """State at an operator: the last setting before it, events standing for operators and clicks for settings."""
    e = _table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "click", F.round(F.col("value") * 100).cast("long")).alias("color"))
    return R.last_setting(e, ["user_id"], "event_id", "color").fillna(-1, ["color"])


# -- documents' structure --------------------------------------------------------------------------------------


@query(
    """WITH RECURSIVE p AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page FROM orders),
letters AS (
  SELECT page AS k, page - 6 AS n, '' AS body FROM (SELECT DISTINCT page FROM p WHERE page >= 7)
  UNION ALL SELECT k, (n - 1) // 26, chr(CAST(65 + (n - 1) % 26 AS INTEGER)) || body FROM letters WHERE n > 0
)
SELECT o_orderkey, CASE WHEN page < o_custkey % 2 THEN NULL WHEN page < 3 THEN ['i', 'ii', 'iii'][page - o_custkey % 2 + 1] WHEN page < 7 THEN 'p-' || CAST(page - 2 AS VARCHAR) ELSE body END AS label
FROM p LEFT JOIN (SELECT k, body FROM letters WHERE n = 0) ON k = page"""
)
def page_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels by ranges: the last range of the document that starts at or before a page. A customer's orders stand for a document's pages; those of customers with an odd number have no label on the first."""
    orders = _table(spark, d, "orders")
    pages = orders.select("o_orderkey", F.col("o_custkey").alias("doc"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("page_no"))
    kinds = F.array(*(F.struct(start.cast("int").alias("start"), F.lit(style).alias("style"), F.lit(prefix).alias("prefix"), F.lit(1).alias("first")) for start, style, prefix in ((F.col("doc") % 2, "r", ""), (F.lit(3), "D", "p-"), (F.lit(7), "A", ""))))
    ranges = orders.select(F.col("o_custkey").alias("doc")).distinct().select("doc", F.inline(kinds))
    return R.label_pages(pages, ranges).select("o_orderkey", "label")


@query(
    """WITH RECURSIVE tree AS (
  SELECT CAST(c_custkey AS BIGINT) AS id, CAST(CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS BIGINT) AS parent, CASE WHEN c_custkey % 3 = 0 OR c_custkey = 1 THEN c_mktsegment END AS attr FROM customer
), walk AS (
  SELECT id, attr, CAST(0 AS BIGINT) AS depth FROM tree WHERE parent IS NULL
  UNION ALL SELECT t.id, coalesce(t.attr, w.attr), w.depth + 1 FROM tree t JOIN walk w ON t.parent = w.id
) SELECT id, depth, attr FROM walk"""
)
def page_tree_inherit(spark: SparkSession, d: str) -> DataFrame:
    """A page tree whose nodes take what they lack from above; customers stand for nodes, half the number for the parent."""
    c = _table(spark, d, "customer")
    key = F.col("c_custkey").cast("long")
    tree = c.select(key.alias("id"), F.when(key > 1, F.floor(key / 2)).alias("parent"), F.when((key % 3 == 0) | (key == 1), F.col("c_mktsegment")).alias("attr"))
    return R.inherit(tree, "id", "parent", "attr")


@query(
    """WITH RECURSIVE refs AS (
  SELECT CAST(p_partkey AS BIGINT) AS id, CAST(CASE WHEN p_partkey % 5 <> 0 AND p_partkey > 1 THEN p_partkey - 1 END AS BIGINT) AS target FROM part
), walk AS (
  SELECT id, id AS place, target FROM refs UNION ALL SELECT w.id, r.id, r.target FROM walk w JOIN refs r ON w.target = r.id
) SELECT id, place AS resolved FROM walk WHERE target IS NULL"""
)
def objref_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Chains of references to their ends; each part refers to the one before it, but every fifth is a value."""
    key = F.col("p_partkey").cast("long")
    refs = _table(spark, d, "part").select(key.alias("id"), F.when((key % 5 != 0) & (key > 1), key - 1).alias("target"))
    return R.resolve_chains(refs, "id", "target")


@query(
    """WITH x AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 3 ORDER BY l_linenumber, l_partkey) AS k FROM lineitem)
SELECT l_orderkey, CAST(l_partkey % 3 AS BIGINT) AS objid, CAST(l_linenumber AS BIGINT) AS section, l_partkey AS value FROM x WHERE k = 1"""
)
def xref_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """The first section that has an object gives it; an order's lines stand for sections."""
    x = _table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 3).cast("long").alias("objid"), F.col("l_linenumber").cast("long").alias("section"), F.col("l_partkey").alias("value"))
    return R.first_wins(x, ["l_orderkey", "objid"], "section")


@query("SELECT l_orderkey, p_partkey, p_name AS dest FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey")
def named_dest_lookup(spark: SparkSession, d: str) -> DataFrame:
    used = _table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).distinct()
    return used.join(_table(spark, d, "part").select("p_partkey", F.col("p_name").alias("dest")), "p_partkey").select("l_orderkey", "p_partkey", "dest")


@query(
    """WITH n AS (SELECT o_custkey, ascii(substr(o_orderpriority, 1, 1)) AS cp, count(*) AS c FROM orders GROUP BY ALL)
SELECT o_custkey, CAST(cp AS BIGINT) AS cp FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY c DESC, cp) AS k FROM n) WHERE k = 1"""
)
def most_popular_code(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent value of a group, ties by the smallest."""
    o = _table(spark, d, "orders").select("o_custkey", F.ascii("o_orderpriority").cast("long").alias("cp"))
    return R.most_popular(o, ["o_custkey"], "cp")


@query(
    r"""WITH w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS ws FROM documents)), f AS (SELECT doc_id, w, min(i) AS i FROM w GROUP BY ALL)
SELECT doc_id, md5(string_agg(w, ' ' ORDER BY i)) AS words_md5, count(*) AS n_words FROM f GROUP BY doc_id"""
)
def uniq_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words of each document in the order of their first places."""
    words = F.array_distinct(F.split(F.coalesce("text", F.lit("")), " ", -1))
    return _table(spark, d, "documents").select("doc_id", F.md5(F.array_join(words, " ").cast("binary")).alias("words_md5"), F.size(words).cast("long").alias("n_words"))


@query("SELECT c_custkey, CAST(c_custkey % 4 = 0 AS BOOLEAN) AS printable, (c_custkey // 8) % 2 = 1 AS modifiable, (c_custkey // 16) % 2 = 1 AS extractable FROM customer".replace("CAST(c_custkey % 4 = 0 AS BOOLEAN)", "(c_custkey // 4) % 2 = 1"))
def permission_bits(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "customer").select("c_custkey", *R.permissions(F.col("c_custkey")))


@query(
    """SELECT s_suppkey, format('{:.3f},{:.3f},{:.3f},{:.3f}', CAST(s_suppkey AS DOUBLE), s_suppkey / 2.0::DOUBLE, CAST(s_suppkey + 1 AS DOUBLE), CAST(s_nationkey AS DOUBLE)) AS rect, replace(replace(s_name, '&', '&amp;'), '<', '&lt;') AS name FROM supplier"""
)
def markup_strings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey").cast("double")
    return _table(spark, d, "supplier").select("s_suppkey", G.rect_text(k, k / 2, k + 1, F.col("s_nationkey").cast("double")).alias("rect"), G.escape_markup(F.col("s_name")).alias("name"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Text of all documents: typeset, parsed, analysed and put in reading order."""
    return parse_files(_files(spark, d), "text")
