"""Shared pieces: where tables go, Arrow text access, hashing, word splitting, tokenizer memos."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U = np.uint64
#: ASCII letters lowered, every other byte kept.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bytes of text that one numpy step works on; bounds a Python worker's memory.
SLICE_BYTES = 4 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """Arrow batches small enough for Python workers with little memory, however long texts are. A smaller setting of the session stays."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = spark.conf.get(name, None)
        digits = "".join(c for c in now or "" if c.isdigit())
        if not (now and now == digits and 0 < int(digits) <= most):
            spark.conf.set(name, str(most))
    return spark


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a temporary folder serves a local master (as in tests); a cluster must name a shared one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="inkwell-")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def conf_set(spark: SparkSession, values: dict[str, str]):
    """Session settings for a while; what was set before comes back."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Once a table is written, the shuffle files that it was made of are of no more use.
_CLEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def saved(df: DataFrame, path: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors and gives back the disk of its shuffles."""
    with conf_set(df.sparkSession, _CLEAN):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_dir(spark: SparkSession, *paths: str) -> None:
    """Remove work tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def with_fields(df: DataFrame, more: str) -> T.StructType:
    """The schema of df and ``more`` columns in DDL."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])


def text_bytes(col: pa.Array) -> list[bytes]:
    """UTF-8 of every row; null is empty."""
    return col.fill_null("").cast(pa.binary()).to_pylist()


def slices(sizes: np.ndarray, limit: int = SLICE_BYTES, rows: int = 2000) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` rows and about ``limit`` bytes; a longer row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit or i - start >= rows:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"").cast(pa.large_binary())
    raw = col.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_owner: list = [None, None]


def sole_memo(owner: str, release) -> None:
    """Called where a task begins: Python workers are used again by later operators, so what another one remembers in this process is given back first."""
    if _owner[0] not in (None, owner):
        import contextlib
        import ctypes
        import gc

        _owner[1]()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
    _owner[:] = [owner, release]


class Memo(dict):
    """A bounded memo: ``make(key)`` on a miss; at ``limit`` entries nothing more is kept, which costs time and never changes a result."""

    def __init__(self, make, limit: int = 300_000):
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.limit:
            self[key] = value
        return value


#: Bits of a membership bitmap, as a power of two: 4 MB, up to 32 MB for many keys. A fuller one only lets more rows through.
BITMAP_BITS, MOST_BITMAP_BITS = 25, 28


def bitmap_bits(keys: int) -> int:
    """Eight bits a key within the bounds."""
    return min(MOST_BITMAP_BITS, max(BITMAP_BITS, (8 * keys).bit_length()))


def _place(keys: list[str], bits: int):
    return F.pmod(F.xxhash64(*keys), F.lit(1 << bits)) + 1


#: Columns that are added to a caller's table for a while; no table's own columns begin like this.
MAYBE = "_inkwell_maybe"


def maybe_in(df: DataFrame, keys: list[str], wanted: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    """df with MAYBE: false only where no row of ``wanted`` has these keys. Broadcasts a bitmap of a fixed size."""
    bitmap = wanted.select(_place(keys, bits).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("_inkwell_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("_inkwell_bits"))
    hashed = df.withColumn("_inkwell_h", _place(keys, bits)).withColumn("_inkwell_bucket", F.bitmap_bucket_number("_inkwell_h")).withColumn("_inkwell_bit", F.bitmap_bit_position("_inkwell_h"))
    hit = F.expr("coalesce((cast(conv(hex(substring(_inkwell_bits, cast(_inkwell_bit div 8 as int) + 1, 1)), 16, 10) as int) >> cast(_inkwell_bit % 8 as int)) & 1, 0) = 1")
    return hashed.join(F.broadcast(bitmap), "_inkwell_bucket", "left").withColumn(MAYBE, hit).drop("_inkwell_h", "_inkwell_bucket", "_inkwell_bit", "_inkwell_bits")


def maybe_rows(df: DataFrame, keys: list[str], wanted: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    return maybe_in(df, keys, wanted, bits).filter(MAYBE).drop(MAYBE)


def without(df: DataFrame, keys: list[str], dropped: DataFrame) -> DataFrame:
    """Rows of df whose keys are not in ``dropped``; only rows that the bitmap can't clear are shuffled."""
    tested = maybe_in(df, keys, dropped)
    sure = tested.filter(~F.col(MAYBE)).drop(MAYBE)
    return sure.unionByName(tested.filter(MAYBE).drop(MAYBE).join(dropped.select(*keys), keys, "left_anti"))
