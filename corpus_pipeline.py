"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayer.llm import stages
from assayer.session import scratch_path

STAGES = [
    ("quality", stages.good_quality),
    ("toxicity", stages.not_toxic),
    ("near_duplicates", stages.one_of_each_group),
    ("repeats", stages.without_repeats),
    ("packing", stages.packed),
]

#: SQL cannot express the classifiers; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
