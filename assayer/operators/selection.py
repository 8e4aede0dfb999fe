"""Which assets a run covers: exclusion patterns, views, labels, table cap, run outcome counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.fixed import EXCLUDED_DATASET_PATTERNS


def is_excluded(dataset: Column, patterns: list[str] = EXCLUDED_DATASET_PATTERNS) -> Column:
    return reduce(lambda a, b: a | b, [dataset.contains(p) for p in patterns], F.lit(False))


def label_flag(labels: Column, key: str) -> Column:
    """True or false if the label is present (value in any case), null if it is not."""
    value = F.try_element_at(labels, F.lit(key))
    return F.when(value.isNotNull(), F.lower(value) == "true")


def skip_by_label(child_flag: Column, parent_flag: Column) -> Column:
    """The table's own label decides when present; else the dataset's."""
    return F.coalesce(child_flag, parent_flag, F.lit(False))


def with_label_decision(tables: DataFrame, datasets: DataFrame, key: str, on: list[str]) -> DataFrame:
    """Tables with ``skip``. Unreadable table labels are null, and fall back to the dataset's decision."""
    parents = datasets.select(*on, label_flag(F.col("labels"), key).alias("_parent"))
    joined = tables.join(parents, on, "left")
    return joined.withColumn("skip", skip_by_label(label_flag(F.col("labels"), key), F.col("_parent"))).drop("_parent")


def select_assets(
    assets: DataFrame,
    include_views: bool = True,
    patterns: list[str] = EXCLUDED_DATASET_PATTERNS,
    max_tables: int | None = None,
) -> DataFrame:
    """Assets left after exclusion, the view choice and the table cap (in name order)."""
    kept = assets.filter(~is_excluded(F.col("dataset_id"), patterns))
    if not include_views:
        kept = kept.filter(~F.col("table_type").isin("VIEW", "MATERIALIZED_VIEW"))
    if max_tables is not None:
        kept = kept.orderBy("project_id", "dataset_id", "table_id").limit(max_tables)
    return kept


def run_statistics(outcomes: DataFrame) -> DataFrame:
    """Counters of a run from one row per asset with ``project_id, dataset_id, outcome, description_generated``."""
    return outcomes.agg(
        F.count_distinct("project_id").alias("projects_scanned"),
        F.count_distinct("project_id", "dataset_id").alias("datasets_scanned"),
        F.count_if(F.expr("outcome != 'filtered'")).alias("tables_scanned"),
        F.count_if(F.expr("outcome = 'formatted'")).alias("tables_formatted"),
        F.count_if(F.expr("outcome = 'filtered'")).alias("tables_filtered_by_label"),
        F.count_if(F.expr("outcome = 'error'")).alias("errors"),
        F.count_if("description_generated").alias("descriptions_generated"),
    )
