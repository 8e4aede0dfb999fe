"""Sensitive data: by column name, by cell value and by outside findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayer.functions import sqltext as q
from assayer.functions.fixed import INFO_TYPE_MARKERS, INFO_TYPES, PHI_KEYWORDS, PII_KEYWORDS
from assayer.functions.display import is_report_sensitive
from assayer.functions.naming import contains_any
from assayer.sources.tables import Field, profilable


def flag_columns(columns: DataFrame, nested: bool = True) -> DataFrame:
    """The columns frame with ``is_pii``, ``is_phi`` and ``is_sensitive`` by keyword in the column's own name."""
    source = columns if nested else columns.filter("depth = 0")
    return source.select(
        "*",
        contains_any(F.col("name"), PII_KEYWORDS).alias("is_pii"),
        contains_any(F.col("name"), PHI_KEYWORDS).alias("is_phi"),
        is_report_sensitive(F.col("name")).alias("is_sensitive"),
    )


def flag_tables(columns: DataFrame, nested: bool = True) -> DataFrame:
    """``has_pii`` and ``has_phi`` per table: true if any of its columns is flagged."""
    return flag_columns(columns, nested).groupBy("table_id").agg(
        F.bool_or("is_pii").alias("has_pii"), F.bool_or("is_phi").alias("has_phi")
    )


def holds(cell: str, info_type: str, regex: str) -> str:
    """The condition that a cell holds a match; the marker character is looked for first, as it is far cheaper."""
    test = f"{cell} RLIKE {q.pattern(regex)}"
    marker = INFO_TYPE_MARKERS.get(info_type)
    return f"contains({cell}, {q.text(marker)}) AND {test}" if marker else test


def value_findings(
    df: DataFrame, table_id: str, columns: list[str] | None = None, info_types: dict[str, str] | None = None
) -> DataFrame:
    """Cells per column and info type that hold a match. Whole texts are tested, in one pass over the table."""
    types = info_types or INFO_TYPES
    chosen: list[Field] = [
        f for f in profilable(df.schema)
        if isinstance(f.data_type, T.StringType) and (columns is None or f.dotted in columns)
    ]
    if not chosen:
        return df.sparkSession.createDataFrame([], "table_id string, column_name string, info_type string, match_count bigint")
    cells = [(f, name, regex) for f in chosen for name, regex in types.items()]
    counted = df.selectExpr(*[
        f"count_if({holds(q.name(f.path), name, regex)}) AS m{i}" for i, (f, name, regex) in enumerate(cells)
    ])
    rows = q.rows([
        q.struct(column_name=q.text(f.dotted), info_type=q.text(name), match_count=f"m{i}") for i, (f, name, _) in enumerate(cells)
    ])
    return counted.selectExpr(f"{q.text(table_id)} AS table_id", rows)


def has_info_type(column: str, info_types: dict[str, str] | None = None) -> Column:
    """True if the column's text holds any of the info types."""
    tests = [holds(q.name(column), name, regex) for name, regex in (info_types or INFO_TYPES).items()]
    return F.expr(" OR ".join(f"({t})" for t in tests))


def pii_with_findings(has_pii: Column, findings: Column) -> Column:
    """The name-based flag, or any outside finding that mentions PII."""
    return F.coalesce(has_pii, F.lit(False)) | F.coalesce(F.exists(findings, lambda x: x.contains("PII")), F.lit(False))
