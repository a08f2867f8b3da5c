"""Relational operators on the tables of a document: look-ups, chains, trees, unions and ranked choices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import geometry as G
from inkwell.sources.shared import shared_dir


def split_by(df: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and all others (null included)."""
    passed = F.coalesce(test, F.lit(False))
    return df.filter(passed), df.filter(~passed)


def ordered_union(parts: list[DataFrame]) -> DataFrame:
    """Union of all, with the number of the part that a row is from."""
    return reduce(DataFrame.unionByName, (p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)))


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key's rows the one with the smallest order: an aggregate with partial sums, no window."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(order, *rest), F.struct(order, *rest)).alias("_"))
    return best.select(*keys, f"_.{order}", *(f"_.{c}" for c in rest))


def most_popular(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), value)).alias(value))


def pick(df: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """Of each key's rows the one with the highest score, the first by ``order`` among equals: an aggregate with partial results."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(order))).alias("_"))
    return best.select(*keys, *(f"_.{c}" for c in rest))


def last_setting(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The last non-null value at or before each row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def _to_the_end(step: DataFrame, merged: dict[str, Column]) -> DataFrame:
    """Follow ``at`` of (id, at, ...) rows until it is null. Path doubling: each round joins the rows that still have an ``at`` with the rows it names and
    takes ``merged`` from both (theirs are called ``far_``...), and is written to the shared folder, so a path of n links takes about log2(n) rounds. Rows that lead nowhere or into a cycle have no end and are left out.
    """
    spark = step.sparkSession
    base = shared_dir(spark, "chains")

    def written(df: DataFrame, k: int) -> DataFrame:
        df.write.parquet(f"{base}/{k}")
        return spark.read.schema(df.schema).parquet(f"{base}/{k}")

    step = written(step, 0)
    rows, k = step.count(), 0
    while 2**k < rows and step.filter("at IS NOT NULL").limit(1).count():  # a path without a cycle has fewer links than there are rows
        far = step.select(F.col("id").alias("at"), F.col("at").alias("far_at"), *(F.col(c).alias(f"far_{c}") for c in merged))
        hop = step.filter("at IS NOT NULL").join(far, "at").select("id", F.col("far_at").alias("at"), *(c.alias(n) for n, c in merged.items()))
        k += 1
        step = written(step.filter("at IS NULL").unionByName(hop), k)
    return step.filter("at IS NULL").drop("at")


def inherit(tree: DataFrame, key: str, parent: str, attr: str) -> DataFrame:
    """(id, depth, attr) of all nodes below the roots, however deep; a null attribute comes from above. A row holds the nearest attribute and the links so far of a path upwards."""
    depth = F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long")
    step = tree.select(F.col(key).alias("id"), F.col(parent).alias("at"), depth.alias("depth"), F.col(attr).alias("attr"))
    return _to_the_end(step, {"depth": F.col("depth") + F.col("far_depth"), "attr": F.coalesce("attr", "far_attr")})


def resolve_chains(refs: DataFrame, key: str, target: str) -> DataFrame:
    """(key, resolved): the end of each chain of references, however long; a cycle has no end and gives no row. Path doubling: as many joins as the longest chain has bits."""
    step = refs.select(F.col(key).alias("id"), F.col(target).alias("at"), F.coalesce(target, key).alias("resolved"))
    return _to_the_end(step, {"resolved": F.col("far_resolved")})


def label_pages(pages: DataFrame, ranges: DataFrame, doc: str = "doc") -> DataFrame:
    """Add ``label``: of the ranges of a document that start at or before a page the last one counts; pages before all ranges, and of documents without any, have none. A document's ranges are few and travel as one list."""
    listed = ranges.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("start", "style", "prefix", "first")), asc=False).alias("ranges"))
    own = pages.join(listed, doc, "left").withColumn("r", F.get(F.filter("ranges", lambda r: r["start"] <= F.col("page_no")), F.lit(0)))
    label = G.page_label(F.col("r.style"), F.col("r.prefix"), F.col("r.first") + F.col("page_no") - F.col("r.start"))
    return own.withColumn("label", F.when(F.col("r").isNotNull(), label)).drop("ranges", "r")


def word_runs(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """Words: runs of glyphs that are not blank, within a line and of one baseline."""
    w = Window.partitionBy(*keys).orderBy("seq")
    blank = F.trim("text") == ""
    new = blank | F.coalesce(F.lag(blank).over(w), F.lit(True)) | (F.lag("y0").over(w) != F.col("y0"))
    runs = glyphs.withColumn("_b", blank).withColumn("_n", new.cast("int")).withColumn("word", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    return runs.filter("NOT _b").groupBy(*keys, "word").agg(text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def classify_edges(df: DataFrame, corners: str, bent: Column, closed: Column) -> DataFrame:
    """Add ``kind`` of subpaths given by their corners, an array of (x, y): a line has one edge; a rectangle has four that come back to the first corner, along the axes by turns; all others are curves."""
    c = F.col(corners)
    edges = F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda p, q: F.struct((q["x"] - p["x"]).alias("x"), (q["y"] - p["y"]).alias("y")))
    lies, stands = (lambda k, axis=axis: F.get(edges, F.lit(k))[axis] == 0 for axis in ("y", "x"))
    by_turns = (lies(0) & stands(1) & lies(2) & stands(3)) | (stands(0) & lies(1) & stands(2) & lies(3))
    home = F.get(c, F.lit(0)) == F.get(c, F.lit(4))
    kind = F.when(~bent & (F.size(c) - closed.cast("int") == 2), "line").when(~bent & (F.size(c) == 5) & home & by_turns, "rect").otherwise("curve")
    return df.withColumn("kind", kind)


def decode_hex(text: Column) -> Column:
    """ASCII hex data as binary: white space ignored, up to the end mark, an odd last digit filled up on the right."""
    digits = F.regexp_replace(F.substring_index(text, ">", 1), "[^0-9A-Fa-f]", "")
    return F.unhex(F.concat(digits, F.when(F.length(digits) % 2 == 1, "0").otherwise("")))


def permissions(flags: Column) -> list[Column]:
    return [(flags.bitwiseAND(bit) != 0).alias(name) for bit, name in ((4, "printable"), (8, "modifiable"), (16, "extractable"))]


def flatten_names(nodes: DataFrame) -> DataFrame:
    """(name, value) pairs of name-tree nodes with an array column ``names`` of alternating names and values."""
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("names") / 2) - 1), lambda i: F.struct(F.get("names", i * 2).alias("name"), F.get("names", i * 2 + 1).alias("value")))
    return nodes.filter(F.size("names") >= 2).select(F.explode(pairs).alias("p")).select("p.*")
