"""Quality: completeness, freshness, status, issues, document checks and catalog health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.display import parse_timestamp
from assayer.functions.fixed import FAIR_FROM, GOOD_FROM, MAX_CONTENT_CHARS


def completeness(profile: DataFrame, by: list[str] = ["table_id"]) -> DataFrame:
    """Share of cells that hold a value, 0 to 1, per table; null for an empty table."""
    cells = F.sum("total_rows")
    return profile.groupBy(*by).agg(
        F.max("total_rows").alias("total_rows"),
        F.count(F.lit(1)).alias("total_columns"),
        F.sum("null_count").alias("null_cells"),
        (1.0 - F.try_divide(F.sum("null_count"), cells)).alias("completeness_score"),
    )


def freshness(last_change: Column, reference: Column, horizon_days: float = 30.0) -> Column:
    """1 for a change at the reference time, falling to 0 at the horizon."""
    age_days = (F.unix_micros(reference.cast("timestamp")) - F.unix_micros(last_change.cast("timestamp"))) / 86_400_000_000.0
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - age_days / horizon_days))


def status(score: Column) -> Column:
    percent = score * 100
    return F.when(percent >= GOOD_FROM, "GOOD").when(percent >= FAIR_FROM, "FAIR").when(percent.isNotNull(), "POOR")


def issues(profile: DataFrame, null_limit: float = 50.0) -> DataFrame:
    """Column issues: empty, mostly null, or one value only."""
    found = F.array_compact(F.array(
        F.when((F.col("total_rows") > 0) & (F.col("null_count") == F.col("total_rows")), F.lit("all values are null")),
        F.when((F.col("null_count") < F.col("total_rows")) & (F.col("null_percentage") >= null_limit), F.lit("mostly null")),
        F.when((F.col("distinct_count") == 1) & (F.col("total_rows") > 1), F.lit("one value only")),
    ))
    return profile.select("table_id", "column_name", F.explode(found).alias("issue"))


def quality_summary(profile: DataFrame) -> DataFrame:
    """Per table: completeness, a quality score (share of columns without an issue times completeness) and status."""
    flawed = issues(profile).groupBy("table_id").agg(F.count_distinct("column_name").alias("columns_with_issues"))
    scored = completeness(profile).join(flawed, "table_id", "left").withColumn(
        "columns_with_issues", F.coalesce("columns_with_issues", F.lit(0).cast("bigint"))
    )
    share = 1.0 - F.try_divide("columns_with_issues", "total_columns")
    return scored.select(
        "table_id", "total_rows", "total_columns", "completeness_score", "columns_with_issues",
        (F.col("completeness_score") * share).alias("quality_score"),
        status(F.col("completeness_score")).alias("status"),
    )


def check_documents(documents: DataFrame, text: str = "text", timestamps: list[str] = []) -> DataFrame:
    """Every document with the reason it would be refused, or null if it is sound."""
    reason = (
        F.when(F.coalesce(F.length(F.trim(F.col(text), F.lit(" \t\r\n"))), F.lit(0)) == 0, "empty text")
        .when(F.length(text) > MAX_CONTENT_CHARS, "text too long")
    )
    for name in timestamps:
        bad = F.col(name).isNotNull() & parse_timestamp(F.col(name)).isNull()
        reason = reason.when(bad, f"{name} is no timestamp")
    return documents.withColumn("reject_reason", reason)


def health_checks(catalog: DataFrame, required: list[str], table_types: list[str]) -> DataFrame:
    """One row per rule with the number of violations, from one pass over the catalog."""
    rules = {f"{c} is set": F.count_if(F.col(c).isNull()) for c in required}
    rules["table_type is known"] = F.count_if(~F.coalesce(F.col("table_type").isin(table_types), F.lit(False)))
    rules["counts are not negative"] = F.count_if(
        (F.coalesce("row_count", F.lit(0)) < 0) | (F.coalesce("column_count", F.lit(0)) < 0) | (F.coalesce("size_bytes", F.lit(0)) < 0)
    )
    first, last = F.min("run_timestamp"), F.max("run_timestamp")
    rules["one run timestamp"] = F.when(first < last, 1).otherwise(0).cast("bigint")
    counted = catalog.agg(F.count(F.lit(1)).alias("records"), *[agg.alias(f"r{i}") for i, agg in enumerate(rules.values())])
    rows = F.inline(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.col(f"r{i}").alias("violations")) for i, rule in enumerate(rules)
    ]))
    return counted.select("records", rows).withColumn("passed", F.col("violations") == 0)
