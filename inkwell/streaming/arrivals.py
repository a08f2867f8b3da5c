"""Files as they arrive: the same tables from a streaming read of a folder."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from inkwell.sources.pdf import Options, parse_files

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_pdf(spark: SparkSession, path: str, table: str = "text", files_per_trigger: int = 100, **options: Any) -> DataFrame:
    """A streaming table of the files in a folder; ``files_per_trigger`` bounds a batch."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return parse_files(files, table, Options.parse(options))


def append_tables(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived to Parquet, each file once however often the query is restarted."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
