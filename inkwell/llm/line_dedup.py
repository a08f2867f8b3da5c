"""Line deduplication over content-defined chunks of lines.

Each line has a hash; a rolling hash over the hashes of WINDOW lines makes a line a boundary unless it is 0 modulo SPREAD, so
boundaries move with the lines around them and an inserted line shifts only the chunks that it touches. A chunk begins after a boundary (or with
the text) and reaches to the first boundary that leaves it LEAST_LINES lines, so chunks may overlap by a line and a short passage holds one too.
Chunks whose 64-bit hash occurs more than once in the table are candidates; their texts are compared with that of the
hash's first occurrence (smallest id, then place), byte by byte, and those that differ from it are grouped among themselves by their texts. Of equal chunks
the first occurrence stays, and a line goes if it stands in a chunk that occurred before. So the first of equal lines always stays.

DataFrame and SQL functions only. A first scan counts chunk hashes (sums within tasks before the shuffle); a second one writes out the texts of
chunks whose hash is in a bitmap of the repeated ones. Whole documents are shuffled only if a line of theirs may go. The comparing join is a plain equi-join,
which Spark splits where a passage is hot.

Defined cases: null text counts as one empty line; null ids sort after all others; rows that repeat an id are separate documents, in
order of their file place; a passage that repeats within a document is cut there too; a document may end up empty; a text of fewer than LEAST_LINES lines has no
chunk; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAYBE, bitmap_bits, drop_dir, load, maybe_in, maybe_rows, saved, work_dir
from .exact_dedup import PLACE as _PLACE
from .exact_dedup import located

#: Lines that a boundary depends on; one line in so many is none. A prime: with a power of two no line that repeats the one before it would be a boundary.
WINDOW, SPREAD = 2, 11
#: Lines of a chunk, at least.
LEAST_LINES = 2


def lines(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def boundaries(doc_lines: Column) -> Column:
    """Places of the lines that are boundaries; the last line is one."""
    hashes = F.transform(doc_lines, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 7), 16, 10).cast("long"))

    def bounds(x: Column, i: Column, all_: Column) -> Column:
        rolled = x
        for k in range(1, WINDOW):
            rolled = rolled + F.lit(31**k) * F.coalesce(F.get(all_, i - k), F.lit(0))
        return (rolled % SPREAD != 0) | (i == F.size(all_) - 1)

    return _let(hashes, lambda h: F.filter(F.transform(h, lambda x, i: F.when(bounds(x, i, h), i)), lambda e: e.isNotNull()))


def chunks(doc_lines: Column, of: Callable[[Column], Column]) -> Column:
    """array<struct<start, n, of>> of an array of lines; ``of`` makes a value of a chunk's text."""

    def cut(ls: Column, ends: Column) -> Column:
        def one(e: Column, j: Column) -> Column:
            before, following = F.coalesce(F.get(ends, j - 1), F.lit(-1)), [e, *(F.get(ends, j + k) for k in range(1, LEAST_LINES))]
            last = F.coalesce(*(F.when(x - before >= LEAST_LINES, x) for x in following))
            return F.struct((before + 1).alias("start"), (last - before).alias("n"))

        text = lambda c: F.array_join(F.slice(ls, c["start"] + 1, c["n"]), "\n")
        found = F.filter(F.transform(ends, one), lambda c: c["n"].isNotNull())
        return F.transform(found, lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"), of(text(c)).alias("of")))

    return _let(doc_lines, lambda ls: _let(boundaries(ls), lambda ends: cut(ls, ends)))


def line_dedup(docs: DataFrame, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, text) to doc_id, n_lines, n_removed and the cleaned text. ``docs`` is a table read from files; any other is written first. ``digest`` is a chunk's hash; tests weaken it to force collisions."""
    spark = docs.sparkSession
    base = work_dir(spark, "line-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    try:
        docs = located(docs)
    except AnalysisException:
        docs = located(saved(docs, f"{base}/docs"))

    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *_PLACE, "start")
    hashed = docs.select("doc_id", *_PLACE, F.explode(chunks(lines(), digest)).alias("c")).select("doc_id", *_PLACE, "c.start", F.col("c.of").alias("hash"))
    repeated = saved(hashed.groupBy("hash").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("hash", "first"), f"{base}/repeated")
    bits = bitmap_bits(repeated.count())

    texts = docs.select("doc_id", *_PLACE, F.explode(chunks(lines(), lambda t: t)).alias("c")).select("doc_id", *_PLACE, "c.start", "c.n", digest(F.col("c.of")).alias("hash"), F.col("c.of").alias("chunk"))
    occurrences = saved(maybe_rows(texts, ["hash"], repeated, bits), f"{base}/occurrences")
    spot = [*_PLACE, "start"]
    firsts = repeated.select("hash", *(F.col(f"first.{c}").alias(c) for c in spot))
    kept = saved(maybe_rows(occurrences, spot, firsts, bits).join(firsts, ["hash", *spot]).select("hash", F.col("chunk").alias("kept"), *(F.col(c).alias(f"kept_{c}") for c in spot)), f"{base}/kept")
    later = F.struct(*spot) != F.struct(*(F.col(f"kept_{c}") for c in spot))
    same = F.col("chunk") == F.col("kept")
    compared = saved(occurrences.join(kept, "hash").filter(later).select("doc_id", *spot, "n", "hash", same.alias("same"), F.when(~same, F.col("chunk")).alias("chunk")), f"{base}/compared")
    gone = compared.filter("same").select(*_PLACE, "start", "n")
    other = compared.filter("NOT same")
    if other.limit(1).count():  # texts of one hash differ
        groups = other.groupBy("hash", "chunk").agg(F.min(place).alias("first"))
        again = other.join(groups, ["hash", "chunk"]).filter(F.struct(*spot) != F.struct(*(F.col(f"first.{c}") for c in spot)))
        gone = gone.union(again.select(*_PLACE, "start", "n"))
    removed = saved(gone.groupBy(*_PLACE).agg(F.collect_list(F.struct("start", "n")).alias("removed")), f"{base}/removed")
    drop_dir(spark, *(f"{base}/{x}" for x in ("repeated", "occurrences", "kept", "compared")))

    tested = maybe_in(docs, _PLACE, removed)
    same = tested.filter(~F.col(MAYBE)).select("doc_id", F.size(lines()).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.coalesce("text", F.lit("")).alias("text"))
    cut = tested.filter(MAYBE).join(removed, _PLACE, "left").withColumn("lines", lines())
    out = F.coalesce(F.array_distinct(F.flatten(F.transform("removed", lambda r: F.sequence(r["start"], r["start"] + r["n"] - 1)))), F.array().cast("array<int>"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("out"))
    stay = _let(F.col("lines"), lambda ls: F.array_join(F.transform(left, lambda i: F.get(ls, i)), "\n"))
    return same.unionByName(cut.withColumn("out", out).select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("out").cast("long").alias("n_removed"), stay.alias("text")))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("clean_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("clean_sha256"))


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h, max(i) OVER (PARTITION BY doc_id) AS n FROM l),
r AS (SELECT doc_id, i, i = n OR (h + 31 * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 11 <> 0 AS bounds FROM h),
b AS (SELECT doc_id, i FROM r WHERE bounds UNION ALL SELECT DISTINCT doc_id, 0 FROM r),
e AS (SELECT doc_id, i AS before, lead(i, 1) OVER w AS e1, lead(i, 2) OVER w AS e2 FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, before + 1 AS first, CASE WHEN e1 - before >= 2 THEN e1 ELSE e2 END AS last FROM e),
g AS (SELECT c.doc_id, first, last, string_agg(line, chr(10) ORDER BY i) AS t FROM c JOIN l ON c.doc_id = l.doc_id AND i BETWEEN first AND last GROUP BY ALL),
m AS (SELECT doc_id, first, last FROM g QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, first) > 1),
gone AS (SELECT DISTINCT m.doc_id, i FROM m JOIN l ON m.doc_id = l.doc_id AND i BETWEEN first AND last),
f AS (SELECT doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL), '') AS t FROM l LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, length(t) AS clean_chars, sha256(t) AS clean_sha256 FROM f
"""
