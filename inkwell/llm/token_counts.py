"""Token counts as a delta-maintained rollup.

A folder holds three kinds of tables, each written batch by batch: the documents' latest counts, additive totals by
source, language and tokenizer version (signed: inserts add, deletes subtract, revisions do both), and a mark for each batch that
is complete. A batch first finds the earlier counts of its documents and turns into signed rows
(+1 document, +tokens for what is new, -1 document, -tokens for what it replaces); these are summed within
tasks before they are shuffled. Its folders are named after its number and written before its mark, so a batch that was
interrupted is written again in whole, and one that is committed is never counted twice. Batches are committed in the order of their numbers: a number
below the last committed one that wasn't committed itself is refused. Totals are the sums of the committed batches. A commit looks up only its own documents in the earlier
batches (a bitmap, then a join), and after every COMPACT batches the documents' latest counts are written as one table, so that looking up doesn't grow with the history.

Defined cases: null text has no tokens; a null source or language is a group of its own; each inserted row with a null id is a document of its own, which can't be named
again, so revisions and deletes of null ids change nothing; a batch that names a document twice counts the last
change (``seq``; then the largest operation and text); deletes of unknown documents change nothing; an insert of a known one is a revision; groups whose documents are
all gone are left out; an empty batch is committed and changes nothing; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import codec, default_ranks
from .common import drop_dir, load, maybe_rows, saved, sole_memo, work_dir
from .packing import byte_ids, default_tokenizer

COUNTED = "doc_id long, op string, seq long, source string, lang string, n_chars long, tokenizer string, tokens long"
STATE = "doc_id long, tokenizer string, source string, lang string, n_chars long, tokens long, alive boolean, batch int"
TOTALS = "source string, lang string, tokenizer string, docs long, tokens long, chars long, batch int"
KEY = ["source", "lang", "tokenizer"]
#: Batches whose counts are looked up one by one before they are written as one table.
COMPACT = 16


@lru_cache(1)
def counters():
    """{tokenizer version: count of a text's tokens}."""
    single, multi = byte_ids(default_tokenizer()), codec(*default_ranks())
    return {"byte_bpe_50k@1": lambda t: len(single.encode(t)) // 4, "byte_bpe_multi_50k@1": lambda t: len(multi.encode(t))}


def _forget() -> None:
    for f in (counters, byte_ids, codec):
        f.cache_clear()


def count_tokens(changes: DataFrame) -> DataFrame:
    """(doc_id, op, seq, source, lang, text) to a row per change and tokenizer version, with its count instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memo("token_counts", _forget)
        by = counters()
        for b in batches:
            texts = [t or "" for t in b["text"].to_pylist()]
            chars = pa.array(map(len, texts), pa.int64())
            for name, count in by.items():
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["op"], b["seq"], b["source"], b["lang"], chars, pa.array([name] * len(b)), pa.array(map(count, texts), pa.int64())], names=["doc_id", "op", "seq", "source", "lang", "n_chars", "tokenizer", "tokens"])

    cast = {"doc_id": "long", "op": "string", "seq": "long", "source": "string", "lang": "string", "text": "string"}
    return changes.select(*(F.col(c).cast(t).alias(c) for c, t in cast.items())).mapInArrow(run, COUNTED)


class TokenRollup:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def _path(self, kind: str, batch: int) -> str:
        return f"{self.base}/{kind}/batch={batch}"

    def _numbers(self, kind: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{kind}/batch=*")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(s.getPath().getName().split("=")[1]) for s in found or ())

    def committed(self) -> list[int]:
        return self._numbers("done")

    def _read(self, kind: str, schema: str, batches: list[int]) -> DataFrame:
        paths = [self._path(kind, b) for b in batches]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _mark(self, kind: str, batch: int) -> None:
        self.spark.range(0, 1, 1, 1).select(F.lit(batch).alias("batch")).write.mode("overwrite").parquet(self._path(kind, batch))

    def _history(self) -> DataFrame:
        """Counts of all documents: the last compacted table and the batches since."""
        done = self._numbers("compacted")
        since = [b for b in self.committed() if not done or b > done[-1]]
        recent = self._read("state", STATE, since)
        return self._read("latest", STATE, done[-1:]).unionByName(recent) if done else recent

    def _latest(self, of: DataFrame | None = None) -> DataFrame:
        """The last known counts of each document and tokenizer version, or of those in ``of``."""
        key, history = ["doc_id", "tokenizer"], self._history()
        if of is not None:
            history = maybe_rows(history, key, of).join(of.select(*key), key, "left_semi")
        row = F.max_by(F.struct("source", "lang", "n_chars", "tokens", "alive", "batch"), "batch").alias("old")
        return history.groupBy(*key).agg(row).select(*key, "old.*").filter("alive")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply changes (doc_id, op insert/revise/delete, seq, source, lang, text) as a batch; False if it was committed before."""
        done = self.committed()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]} was committed")
        counted = saved(count_tokens(changes), self._path("counted", batch))  # read more than once, counted once
        known, nameless = counted.filter("doc_id IS NOT NULL"), counted.filter("doc_id IS NULL AND op = 'insert'")
        last = F.max_by(F.struct("op", "source", "lang", "n_chars", "tokens"), F.struct("seq", "op", "tokens")).alias("new")
        new = known.groupBy("doc_id", "tokenizer").agg(last).select("doc_id", "tokenizer", "new.*").unionByName(nameless.drop("seq"))
        alive = F.col("op") != "delete"
        new.select("doc_id", "tokenizer", "source", "lang", "n_chars", "tokens", alive.alias("alive"), F.lit(batch).alias("batch")).write.mode("overwrite").parquet(self._path("state", batch))
        new = self.spark.read.schema(STATE).parquet(self._path("state", batch))
        drop_dir(self.spark, self._path("counted", batch))
        plus = new.filter("alive").select(*KEY, F.lit(1).alias("docs"), "tokens", F.col("n_chars").alias("chars"))
        minus = self._latest(new.filter("doc_id IS NOT NULL")).select(*KEY, F.lit(-1).alias("docs"), (-F.col("tokens")).alias("tokens"), (-F.col("n_chars")).alias("chars"))
        signed = plus.unionByName(minus).groupBy(*KEY).agg(*(F.sum(c).cast("long").alias(c) for c in ("docs", "tokens", "chars")))
        signed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(self._path("totals", batch))
        self._mark("done", batch)
        compacted = self._numbers("compacted")
        if sum(not compacted or b > compacted[-1] for b in self.committed()) >= COMPACT:
            self.compact()
        return True

    def compact(self) -> None:
        """Write the latest counts as one table, mark it, and remove what it replaces. The mark comes last, so an interruption leaves the batches in use."""
        upto = self.committed()[-1]
        self._latest().filter("doc_id IS NOT NULL").write.mode("overwrite").parquet(self._path("latest", upto))
        old = self._numbers("compacted")
        self._mark("compacted", upto)
        drop_dir(self.spark, *(self._path("state", b) for b in self.committed()), *(self._path("latest", b) for b in old))

    def totals(self) -> DataFrame:
        sums = self._read("totals", TOTALS, self.committed()).groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in ("docs", "tokens", "chars")))
        return sums.filter("docs <> 0").select(*KEY, F.col("docs").alias("n_docs"), F.col("tokens").alias("n_tokens"), F.col("chars").alias("n_chars"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted; those whose text isn't trimmed are revised to the trimmed text; those labelled toxic are deleted; the revision is sent once more."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    toxic = load(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    one = F.lit(1).cast("long").alias("seq")
    trimmed = F.regexp_replace("text", r"^\s+|\s+$", "")
    revised = docs.filter(trimmed != F.col("text")).select("doc_id", F.lit("revise").alias("op"), one, "source", "lang", trimmed.alias("text"))
    rollup = TokenRollup(spark, work_dir(spark, "token-counts"))
    rollup.commit(1, docs.select("doc_id", F.lit("insert").alias("op"), one, "source", "lang", "text"))
    rollup.commit(2, revised)
    rollup.commit(3, docs.join(toxic, "doc_id", "left_semi").select("doc_id", F.lit("delete").alias("op"), one, "source", "lang", F.lit("").alias("text")))
    rollup.commit(2, revised)
    return rollup.totals()
