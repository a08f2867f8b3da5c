"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder's name below spark.checkpoint.dir. Where that is unset, a temporary folder serves a local master (as in tests); a cluster must name a shared one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='inkwell-')}"
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
