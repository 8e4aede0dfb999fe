"""Column profiles: every column is read once and aggregated, one long row per column.

The aggregates follow from the schema, so they are generated as SQL expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from assayer import schemas
from assayer.functions import sqltext as q
from assayer.operators.ranking import top_ranked
from assayer.sources.tables import Field, profilable, union_all


@dataclass(frozen=True)
class ProfileOptions:
    """What to measure. Approximate distinct counts and quartiles are mergeable sketches of bounded size.

    ``columns_per_pass`` keeps the generated aggregation code small enough to be compiled; each pass reads
    only its own columns, so more passes read no more bytes. Very wide tables use at most ``max_passes``.
    """

    nulls: bool = True
    cardinality: bool = True
    distribution: bool = True
    quartiles: bool = True
    relative_error: float = 0.05
    quantile_accuracy: int = 10_000
    columns_per_pass: int = 4
    max_passes: int = 50


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.StringType, T.BinaryType, T.VarcharType, T.CharType)):
        return "string"
    return "other"


def unsigned_zero(c: str, data_type: T.DataType) -> str:
    """Minus zero read as zero, so bounds and texts do not depend on which of the two is met first."""
    return f"({c} + CAST(0 AS {data_type.simpleString()}))" if isinstance(data_type, (T.DoubleType, T.FloatType)) else c


def _measures(f: Field, opts: ProfileOptions) -> dict[str, str]:
    """The aggregates this column's type allows; anything else stays null."""
    c, kind = q.name(f.path), kind_of(f.data_type)
    out: dict[str, str] = {}
    if opts.nulls:
        out["null_count"] = f"count_if({c} IS NULL)"
    if opts.cardinality and not isinstance(f.data_type, (T.MapType, T.VariantType, T.CalendarIntervalType)):
        out["distinct_count"] = f"approx_count_distinct({c}, {opts.relative_error})"
    if not opts.distribution:
        return out
    if kind == "numeric":
        out |= {"min": f"min({unsigned_zero(c, f.data_type)})", "max": f"max({unsigned_zero(c, f.data_type)})", "avg": f"avg({c})", "stddev": f"stddev_samp({c})"}
        if opts.quartiles:
            out["quartiles"] = f"percentile_approx(CAST({c} AS DOUBLE), array(0.25, 0.5, 0.75), {opts.quantile_accuracy})"
    size = f"length({c})" if kind == "string" else f"size({c})" if isinstance(f.data_type, T.ArrayType) else None
    if size:
        sized = f"CASE WHEN {c} IS NOT NULL THEN {size} END"
        out |= {"min_length": f"min({sized})", "max_length": f"max({sized})", "avg_length": f"avg({sized})"}
    return out


_RESULT_TYPES = {
    "null_count": "BIGINT", "distinct_count": "BIGINT",
    "min": "DOUBLE", "max": "DOUBLE", "avg": "DOUBLE", "stddev": "DOUBLE", "quartiles": "ARRAY<DOUBLE>",
    "min_length": "BIGINT", "max_length": "BIGINT", "avg_length": "DOUBLE",
}


def _number_text(c: str, data_type: T.DataType) -> str:
    """A bound in its own type's digits; doubles without exponent."""
    if not isinstance(data_type, (T.DoubleType, T.FloatType)):
        return f"CAST({c} AS STRING)"
    plain = f"regexp_replace(CAST(CAST(CAST({c} AS STRING) AS DECIMAL(38,20)) AS STRING), '(\\\\.\\\\d+?)0+$', '$1')"
    return f"CASE WHEN {c} = 0 OR abs({c}) BETWEEN 1e-4 AND 1e16 THEN {plain} ELSE CAST({c} AS STRING) END"


def profile_table(
    df: DataFrame, table_id: str, columns: list[str] | None = None, options: ProfileOptions = ProfileOptions()
) -> DataFrame:
    """The long profile of one table (schema ``PROFILE``).

    One partial and one final aggregate per column group; what crosses the network is one row per task.
    """
    wanted = [f for f in profilable(df.schema) if columns is None or f.dotted in columns]
    if not wanted:
        return df.sparkSession.createDataFrame([], schemas.PROFILE)
    size = max(options.columns_per_pass, -(-len(wanted) // options.max_passes))
    groups = [wanted[i:i + size] for i in range(0, len(wanted), size)]
    return union_all(_profile_group(df, table_id, g, options) for g in groups)


def _profile_group(df: DataFrame, table_id: str, group: list[Field], opts: ProfileOptions) -> DataFrame:
    aggregates, structs = ["count(1) AS total_rows"], []
    for i, f in enumerate(group):
        measures = _measures(f, opts)
        aggregates += [f"{agg} AS {name}_{i}" for name, agg in measures.items()]
        bounds = {
            f"{b}_value": _number_text(f"{b}_{i}", f.data_type) if b in measures else "CAST(NULL AS STRING)" for b in ("min", "max")
        }
        structs.append(q.struct(
            column_name=q.text(f.dotted), ordinal=str(f.ordinal), data_type=q.text(f.data_type.simpleString()),
            profile_type=q.text(kind_of(f.data_type)),
            **{n: f"CAST({f'{n}_{i}' if n in measures else 'NULL'} AS {kind})" for n, kind in _RESULT_TYPES.items()},
            **bounds,
        ))
    long = df.selectExpr(*aggregates).selectExpr("total_rows", q.rows(structs))
    # A sketch may overshoot; there are never more distinct values than filled cells.
    filled = F.expr("least(distinct_count, total_rows - coalesce(null_count, 0L))")
    return long.withColumn("distinct_count", F.when(F.col("distinct_count").isNotNull(), filled)).selectExpr(
        f"{q.text(table_id)} AS table_id", "column_name", "ordinal", "data_type", "profile_type", "total_rows", "null_count",
        "round(try_divide(null_count * 100.0D, total_rows), 2) AS null_percentage",
        "distinct_count", "round(try_divide(distinct_count * 100.0D, total_rows), 2) AS distinct_percentage",
        "min", "max", "avg", "stddev", "quartiles[0] AS q1", "quartiles[1] AS median", "quartiles[2] AS q3",
        "min_length", "max_length", "avg_length", "min_value", "max_value",
    )


def profile_tables(
    tables: dict[str, DataFrame], options: ProfileOptions = ProfileOptions(), stored: DataFrame | None = None
) -> DataFrame:
    """Profiles of many tables as one frame and one job; tables are profiled side by side.

    A table with a stored profile is not scanned again: its stored rows are taken over.
    """
    reused: set[str] = set()
    if stored is not None:
        names = stored.filter(F.col("table_id").isin(list(tables))).select("table_id").distinct()
        reused = {row.table_id for row in names.collect()}  # at most the table names asked for
    parts = [profile_table(df, t, options=options) for t, df in tables.items() if t not in reused]
    if reused:
        parts.append(stored.filter(F.col("table_id").isin(sorted(reused))))
    return union_all(parts)


def store_profile(profile: DataFrame, path: str, scan_id: str, state: str = "ACTIVE") -> None:
    """Keep a profile under its scan id; a profile stored earlier under the same id is replaced, others stay."""
    rows = profile.withColumns({"scan_id": F.lit(scan_id), "state": F.lit(state)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").parquet(path)


def stored_profile(spark: SparkSession, path: str, scan_id: str) -> DataFrame:
    """A profile saved earlier under its scan id, if it is active; only that scan's folder is read."""
    return spark.read.parquet(path).filter((F.col("scan_id") == scan_id) & (F.col("state") == "ACTIVE")).drop("scan_id", "state")


def ratios(profile: DataFrame) -> DataFrame:
    """Counts with the ratios derived from them (never the other way round, so no rounding loss)."""
    return profile.select(
        "table_id", "column_name", "total_rows", "null_count", "distinct_count",
        F.try_divide("null_count", "total_rows").alias("null_ratio"),
        F.try_divide("distinct_count", "total_rows").alias("distinct_ratio"),
    )


def counts_from_ratios(ratios_frame: DataFrame) -> DataFrame:
    """Counts of a profile that only stores ratios, truncated to whole rows."""
    rows = F.col("total_rows")
    return ratios_frame.select(
        "*",
        (rows * F.col("null_ratio")).cast("bigint").alias("null_count"),
        (F.col("null_ratio") * 100.0).alias("null_percentage"),
        (rows * F.col("distinct_ratio")).cast("bigint").alias("distinct_count"),
    )


def most_null(profile: DataFrame, k: int = 10, only_with_nulls: bool = True) -> DataFrame:
    """The ``k`` columns with the highest null share of every table."""
    source = profile.filter("null_count > 0") if only_with_nulls else profile
    columns = source.select("table_id", "column_name", "ordinal", "null_count", "null_percentage")
    # columns of one table have the same number of rows, so their counts have the order of their unrounded shares
    return top_ranked(columns, Window.partitionBy("table_id").orderBy(F.desc("null_count"), "ordinal"), k)


def first_of_kind(profile: DataFrame, kind: str, k: int = 10) -> DataFrame:
    """The first ``k`` columns of one profile type of every table, in column order."""
    return top_ranked(profile.filter(F.col("profile_type") == kind), Window.partitionBy("table_id").orderBy("ordinal"), k)
