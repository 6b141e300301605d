"""The corpus pipeline: language, toxicity, near-duplicates, repeated passages, packing.

Each stage works on all that its predecessor kept, is written as Parquet on the shared store
and read again as the documents of the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quizlake.llm import stages
from quizlake.llm.common import stored, table

STAGES = [
    ("language", stages.by_language),
    ("toxicity", stages.by_toxicity),
    ("near_texts", stages.one_of_near_texts),
    ("long_repeats", stages.without_long_repeats),
    ("packing", stages.packed),
]

#: No stage but the last has a form in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
