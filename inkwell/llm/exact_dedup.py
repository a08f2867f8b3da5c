"""Exact deduplication by a stateful stream over keyed state on disk.

Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` has become one space. A stream reads narrow
rows (digest, id, content locator) and keeps per digest, in RocksDB state without expiry, how many rows it has
seen, the smallest id, and the locator of that row's text. The state lives below the checkpoint folder, so that a later
batch of documents goes on from it and the part of a lost executor is loaded again. A batch's rows are written aside and renamed into the
stream's folder when they are complete, the stream's own log takes each file once, and the batch is marked as added after the stream has committed; whatever step was
interrupted, adding the batch again (or asking for the result) goes on from there.

A digest seen more than once is a hit, and a hit is only a candidate: the whole texts of its rows are compared
with the text behind the locator, byte by byte. Rows that differ are grouped among themselves by their full
text. The comparing joins are plain equi-joins, which Spark splits where a digest is hot, and groups are only counted
with partial aggregates.

DataFrame and SQL functions only. Defined cases: null text counts as empty; a null id sorts after all others, so
such a row stays only if its group has no other; rows that repeat an id are separate rows, of which one stays
(the smallest locator); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import conf_set, drop_dir, load, maybe_rows, saved, without, work_dir

#: RocksDB keeps the state on disk; memory of all its instances in an executor together is bounded.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no preallocated files
}
PLACE = ["_inkwell_file", "_inkwell_row"]
LOCATOR = ["_inkwell_batch", *PLACE]
ROWS = "doc_id long, digest string, sha string, _inkwell_batch int, _inkwell_file long, _inkwell_row long"


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class StreamingDedup:
    """Keyed state over all batches added so far. ``digest`` is a column function of the normalised text; tests weaken it to force collisions."""

    def __init__(self, spark: SparkSession, base: str, digest=sha256):
        self.spark, self.base, self.digest = spark, base, digest

    def _located(self, docs: DataFrame, batch: int) -> DataFrame:
        return located(docs).withColumn(LOCATOR[0], F.lit(batch))

    def add(self, docs: DataFrame, batch: int = 0) -> None:
        """Take a batch of (doc_id, text) rows into the state. A batch number that was added before adds nothing; one that was interrupted is completed."""
        if batch in self._numbers("added"):
            return
        if batch not in self._numbers("rows"):
            self._write(docs, batch)
        self._finish()

    def _write(self, docs: DataFrame, batch: int) -> None:
        rows = self._located(docs, batch).withColumn("t", normalized(F.col("text"))).select(F.col("doc_id").cast("long").alias("doc_id"), self.digest(F.col("t")).alias("digest"), sha256(F.col("t")).alias("sha"), *LOCATOR)
        rows.write.mode("overwrite").parquet(f"{self.base}/aside/batch-{batch}")
        source, target = (self._path(f"{x}/batch-{batch}") for x in ("aside", "rows"))
        files = self._files(target)
        files.mkdirs(target.getParent())
        if not files.rename(source, target):
            raise OSError(f"{source} can't be renamed to {target}")

    def _finish(self) -> None:
        """Stream what is complete and not yet in the state, then mark it as added."""
        if not (open_ := self._numbers("rows") - self._numbers("added")):
            return
        self._stream()
        for batch in open_:
            mark = self._path(f"added/batch-{batch}")
            self._files(mark).mkdirs(mark)

    def _stream(self) -> None:
        with conf_set(self.spark, STATE_CONF):
            stream = self.spark.readStream.schema(ROWS).parquet(f"{self.base}/rows/batch-*")
            stay = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *LOCATOR)
            state = stream.groupBy("digest").agg(F.min(stay).alias("stay"), F.count(F.lit(1)).alias("n"))
            state.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{self.base}/state").trigger(availableNow=True).start().awaitTermination()

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")

    def _files(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> set[int]:
        """Batches whose rows are complete (``rows``) or in the state (``added``)."""
        path = self._path(f"{kind}/batch-*")
        return {int(s.getPath().getName().split("-")[1]) for s in self._files(path).globStatus(path) or ()}

    def rows(self) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(f"{self.base}/rows/batch-*")

    def state(self) -> DataFrame:
        """digest, stay (keep_id and the kept row's locator), n."""
        return self.spark.read.format("statestore").load(f"{self.base}/state").select("key.digest", F.col("value.min").alias("stay"), F.col("value.count").alias("n"))

    def result(self, batches: dict[int, DataFrame]) -> DataFrame:
        """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and its locator. ``batches``: what was added, by number."""
        self._finish()
        seen = saved(self.rows().join(self.state(), "digest").withColumn("is_kept", F.struct(*LOCATOR) == F.struct(*(F.col(f"stay.{c}") for c in LOCATOR))), f"{self.base}/seen")
        columns = ["doc_id", F.col("stay.doc_id").alias("keep_id"), "group_size", F.col("is_kept").alias("kept"), F.col("sha").alias("text_sha256"), *LOCATOR]
        alone = seen.filter("n = 1").withColumn("group_size", F.lit(1).cast("long")).select(*columns)

        # the whole texts of all rows of hits, found again through their locators
        marked, texts = seen.filter("n > 1"), None
        for batch, docs in batches.items():
            t = self._located(docs, batch).select("text", *LOCATOR)
            texts = t if texts is None else texts.unionByName(t)
        maybe = maybe_rows(texts, LOCATOR, marked).select(normalized(F.col("text")).alias("t"), *LOCATOR)
        hits = saved(maybe.join(marked, LOCATOR), f"{self.base}/hits")
        behind = hits.filter("is_kept").select("digest", F.col("t").alias("kept_text"))
        same = F.col("t") == F.col("kept_text")
        compared = saved(hits.join(behind, "digest").select(*(c for c in hits.columns if c != "t"), same.alias("same"), F.when(~same, F.col("t")).alias("t")), f"{self.base}/compared")
        equal = compared.filter("same")
        sizes = equal.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        out = alone.unionByName(equal.join(sizes, "digest").select(*columns))
        drop_dir(self.spark, f"{self.base}/hits")
        other = compared.filter("NOT same").drop("stay", "is_kept")
        if other.limit(1).count():  # texts of one digest differ: group them by the texts themselves
            stay = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *LOCATOR)
            groups = other.groupBy("digest", "t").agg(F.min(stay).alias("stay"), F.count(F.lit(1)).alias("group_size"))
            regrouped = other.join(groups, ["digest", "t"]).withColumn("is_kept", F.struct(*LOCATOR) == F.struct(*(F.col(f"stay.{c}") for c in LOCATOR)))
            out = out.unionByName(regrouped.select(*columns))
        return out


def located(docs: DataFrame) -> DataFrame:
    """docs, read from files, with the place of each row: a hash of the file's path, and the row's index in it."""
    return docs.select(*docs.columns, F.xxhash64("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """All rows of (doc_id, text) as one batch of a new state. ``docs`` is a table read from files; any other is written first."""
    spark = docs.sparkSession
    base = work_dir(spark, "exact-dedup")
    docs = docs.select("doc_id", "text")
    try:
        located(docs)
    except AnalysisException:
        docs = saved(docs, f"{base}/docs")
    dedup = StreamingDedup(spark, base)
    dedup.add(docs)
    return dedup.result({0: docs})


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents")).drop(*LOCATOR)


OP9_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that stay, columns unchanged. ``docs`` is read from files."""
    dropped = exact_dedup(docs).filter("NOT kept").select(*PLACE)
    return without(located(docs), PLACE, dropped).select(*docs.columns)
