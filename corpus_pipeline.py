"""A corpus pipeline: language ID, exact dedup, n-gram Jaccard join, best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import exact_dedup, jaccard_join, langid, packing
from inkwell.llm.common import load, saved, work_dir

STAGES = [("language_id", langid.stage), ("exact_dedup", exact_dedup.stage), ("ngram_jaccard", jaccard_join.stage), ("best_fit_packing", packing.stage)]

#: Not expressible in SQL (a trained model, a tokenizer and bin packing); tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base = load(spark, sf_dir, "documents"), work_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"{base}/{k}-{name}")
    return docs
