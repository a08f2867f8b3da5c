"""Character collections: tab-separated code tables to code and Unicode maps, with DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Code columns whose codes can be read as characters, and their charset.
CHARSETS = {"UniJIS-UTF8": "UTF-8", "UniGB-UTF8": "UTF-8", "UniCNS-UTF8": "UTF-8", "UniKS-UTF8": "UTF-8", "UniJIS-UTF16": "UTF-16BE", "UniGB-UTF16": "UTF-16BE", "UniCNS-UTF16": "UTF-16BE", "UniKS-UTF16": "UTF-16BE", "UniJIS-UTF32": "UTF-32", "UniGB-UTF32": "UTF-32", "UniCNS-UTF32": "UTF-32", "UniKS-UTF32": "UTF-32"}


def code_rows(spark: SparkSession, path: str) -> DataFrame:
    """(cid, map, code, vertical) of a table whose header begins with CID; ``*`` is no code, codes are comma-separated hex, a final v marks vertical ones."""
    table = spark.read.csv(path, sep="\t", header=True, comment="#")
    maps = [c for c in table.columns if c != "CID"]
    wide = table.select(F.col("CID").cast("int").alias("cid"), F.explode(F.array(*(F.struct(F.lit(c).alias("map"), F.col(f"`{c}`").alias("codes")) for c in maps))).alias("x"))
    listed = wide.filter("x.codes IS NOT NULL AND x.codes <> '*'").select("cid", "x.map", F.explode(F.split("x.codes", ",")).alias("code"))
    return listed.select("cid", "map", F.unhex(F.regexp_replace("code", "v$", "")).alias("code"), F.col("code").endswith("v").alias("vertical"))


def code_map(rows: DataFrame, name: str, vertical: bool = False) -> DataFrame:
    """(code, cid) of one map. A vertical map has the horizontal codes too, where it has none of its own; the smallest cid of a code stays."""
    mine = rows.filter(F.col("map") == name)
    mine = mine if vertical else mine.filter("NOT vertical")
    return mine.groupBy("code").agg(F.min_by("cid", F.struct(~F.col("vertical"), "cid")).alias("cid"))


def unicode_rows(rows: DataFrame, vertical: bool = False) -> DataFrame:
    """(cid, text): the character that most maps give, ties by the smallest code point; vertical forms first where they are asked for and exist."""
    charset = F.element_at(F.create_map(*(F.lit(x) for kv in CHARSETS.items() for x in kv)), F.col("map"))

    def char(name: str) -> Column:
        return F.decode("code", name)

    text = F.when(charset == "UTF-8", char("UTF-8")).when(charset == "UTF-16BE", char("UTF-16BE")).when(charset == "UTF-32", char("UTF-32"))
    known = rows.filter(F.col("map").isin(*CHARSETS)).withColumn("text", text).filter(F.length("text") == 1)
    known = known if vertical else known.filter("NOT vertical")
    counts = known.groupBy("cid", "vertical", "text").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("cid").agg(F.min_by("text", F.struct(~F.col("vertical"), -F.col("n"), F.hex(F.encode("text", "UTF-32")))).alias("text"))
