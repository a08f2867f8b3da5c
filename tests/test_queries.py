import pytest
from pyspark.sql import functions as F

from inkwell.operators import layout as L
from inkwell.operators import tables as R
from inkwell.plans import features  # noqa: F401
from inkwell.plans import queries as plans

from .conftest import SF, same_rows


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    same_rows(plans.QUERIES[name](spark, SF), duck.execute(plans.SQL[name]).df())


def test_every_query_has_sql():
    assert plans.QUERIES.keys() == plans.SQL.keys()


def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns == ["doc_id", "page_no", "text", "error"]
    assert out.filter("error IS NOT NULL").count() == 0 and out.count() >= 200


def test_page_labels_go_on_beyond_z(spark, tmp_path):
    """One customer with more pages than letters; the numbering is bijective base 26."""
    spark.range(800).selectExpr("id AS o_orderkey", "if(id < 760, 1L, id) AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))

    def letters(n):
        out = ""
        while n:
            n, k = divmod(n - 1, 26)
            out = chr(65 + k) + out
        return out

    def label(page, odd):
        return None if page < odd else ["i", "ii", "iii"][page - odd] if page < 3 else f"p-{page - 2}" if page < 7 else letters(page - 6)

    got = {r["o_orderkey"]: r["label"] for r in plans.page_labels(spark, str(tmp_path)).collect()}
    assert got == {i: label(i, 1) if i < 760 else label(0, i % 2) for i in range(800)}
    assert (got[32], got[33], got[34], got[709]) == ("Z", "AA", "AB", "AAA")


def test_long_chains_are_resolved(spark):
    """A chain of 700 references, a cycle, what leads into it, a reference to itself and one to nothing."""
    refs = [(i, i - 1 if i else None) for i in range(701)] + [(1000, 1001), (1001, 1002), (1002, 1000), (1003, 1000), (1004, 1004), (1005, 9999), (1006, 1005), (1007, None)]
    got = R.resolve_chains(spark.createDataFrame(refs, "id long, target long"), "id", "target")
    assert sorted(map(tuple, got.collect())) == [(i, 0) for i in range(701)] + [(1007, 1007)]
    assert R.resolve_chains(spark.createDataFrame([], "id long, target long"), "id", "target").count() == 0


def test_deep_trees_inherit(spark):
    """A path of 600 levels with an attribute at every seventh, a cycle, and a node below a missing one."""
    nodes = [(i, i - 1 if i else None, f"a{i}" if i % 7 == 0 and i else None) for i in range(601)] + [(1000, 1001, "x"), (1001, 1000, None), (1002, 9999, "y"), (1003, 1002, None), (1004, 300, None)]
    got = R.inherit(spark.createDataFrame(nodes, "id long, parent long, attr string"), "id", "parent", "attr")
    above = {i: f"a{i - i % 7}" if i >= 7 else None for i in range(601)}
    assert sorted(map(tuple, got.collect())) == [(i, i, above[i]) for i in range(601)] + [(1004, 301, above[300])]


def test_folds_match_the_windows(spark):
    """Pages of one and of many glyphs, in batches that cut them; blanks, gaps, overlaps, null keys."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    glyphs = spark.range(0, 400, 1, 3).selectExpr("IF(id div 23 = 4, NULL, id div 23) AS page", "id AS seq", "IF(id % 5 = 0, ' ', char(97 + id % 26)) AS text", "(id * 37 % 11) * 4.0D AS x0", "(id div 9) * -8.0D + id % 2 AS y0").withColumns({"x1": F.col("x0") + 5, "y1": F.col("y0") + 9 - F.col("seq") % 3})
    by_page = [r for part in glyphs.rdd.glom().collect() for r in part]
    glyphs = spark.createDataFrame(by_page, glyphs.schema).coalesce(1)
    lines = L.text_lines(L.glyph_lines(glyphs, ["page"]), ["page"])
    columns = ["page", "line", "x0", "y0", "x1", "y1", "text", "glyphs", "seq"]
    assert sorted(map(str, L.fold_lines(glyphs, ["page"]).select(columns).collect())) == sorted(map(str, lines.select(columns).collect()))
    words = ["page", "text", "x0", "y0", "x1", "y1"]
    assert sorted(map(str, L.fold_words(glyphs, ["page"]).select(words).collect())) == sorted(map(str, R.word_runs(glyphs, ["page"]).select(words).collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert L.fold_lines(glyphs.limit(0), ["page"]).count() == 0
