"""Value frequencies: common values, sample values, exact distinct counts and string patterns.

All of them start from one shuffle of (column, value) pairs that are counted before they leave the
task. A value that fills a third of the table is one counter per task, and the per-column ranking
keeps only its top ``k`` per task before the second shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from assayer.functions import sqltext as q
from assayer.operators.profile import unsigned_zero
from assayer.operators.ranking import top_ranked
from assayer.sources.tables import Field, profilable


def whole_value(f: Field) -> str:
    """The column's whole value as text, different for different values: bytes in hex, nested values as JSON."""
    c = q.name(f.path)
    if isinstance(f.data_type, T.BinaryType):
        return f"hex({c})"
    if isinstance(f.data_type, (T.ArrayType, T.MapType)):
        return f"to_json({c})"
    return f"CAST({unsigned_zero(c, f.data_type)} AS STRING)"


def display_value_of(f: Field, c: str) -> str:
    if isinstance(f.data_type, T.BinaryType):
        return f"concat('<bytes: ', length({c}), ' bytes>')"
    if isinstance(f.data_type, (T.ArrayType, T.MapType)):
        return f"substring(to_json({c}), 1, 100)"
    return f"CAST({unsigned_zero(c, f.data_type)} AS STRING)"


def _shown(chosen: list[Field]) -> Column:
    """A whole value as it is shown: bytes by their length, nested values by at most 100 characters. Only after counting."""
    name, value = F.col("column_name"), F.col("value")
    binary = [f.dotted for f in chosen if isinstance(f.data_type, T.BinaryType)]
    nested = [f.dotted for f in chosen if isinstance(f.data_type, (T.ArrayType, T.MapType))]
    length = (F.length(value) / 2).cast("bigint").cast("string")
    return (
        F.when(name.isin(binary), F.concat(F.lit("<bytes: "), length, F.lit(" bytes>")))
        .when(name.isin(nested), F.substring(value, 1, 100))
        .otherwise(value)
    )


def pattern(value: str) -> str:
    """The shape of a text: letters become ``A``, digits become ``9``."""
    letters = f"regexp_replace({value}, {q.pattern(chr(92) + 'p{L}')}, 'A')"
    return f"regexp_replace({letters}, {q.pattern(chr(92) + 'p{N}')}, '9')"


def _selected(df: DataFrame, columns: list[str] | None) -> list[Field]:
    return [f for f in profilable(df.schema) if columns is None or f.dotted in columns]


def _counted_pairs(df: DataFrame, chosen: list[Field], value: str, expr) -> DataFrame:
    if not chosen:
        return df.sparkSession.createDataFrame([], f"column_name string, {value} string, n bigint")
    pairs = q.rows([q.struct(column_name=q.text(f.dotted), **{value: expr(f)}) for f in chosen])
    return df.selectExpr(pairs).groupBy("column_name", value).agg(F.count(F.lit(1)).alias("n"))


def _top(counted: DataFrame, k: int, *order) -> DataFrame:
    return top_ranked(counted, Window.partitionBy("column_name").orderBy(*order), k)


def value_frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, value, n)`` with every distinct whole value of the chosen columns, nulls included."""
    return _counted_pairs(df, _selected(df, columns), "value", whole_value)


#: How a value is told from others without its text; all other types by their whole text.
_PLAIN = {"whole": ("BIGINT", (T.IntegralType, T.BooleanType)), "number": ("DOUBLE", (T.DoubleType, T.FloatType)), "moment": ("TIMESTAMP_NTZ", (T.DateType, T.TimestampNTZType))}


def _plain_value(f: Field) -> dict[str, str]:
    """One of the columns ``whole``, ``number``, ``moment`` and ``text`` holds the value, the others are null."""
    c = q.name(f.path)
    kind = next((k for k, (_, types) in _PLAIN.items() if isinstance(f.data_type, types)), "text")
    own = whole_value(f) if kind == "text" else f"CAST({unsigned_zero(c, f.data_type)} AS {_PLAIN[kind][0]})"
    kinds = {k: name for k, (name, _) in _PLAIN.items()} | {"text": "STRING"}
    return {k: own if k == kind else f"CAST(NULL AS {name})" for k, name in kinds.items()}


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Exact distinct counts from counted pairs as above, without expanding whole rows once per column; numbers and times are not made into texts."""
    chosen = _selected(df, columns)
    if not chosen:
        return df.sparkSession.createDataFrame([], "column_name string, total_rows bigint, distinct_count bigint")
    kinds = [*_PLAIN, "text"]
    pairs = q.rows([q.struct(column_name=q.text(f.dotted), **_plain_value(f)) for f in chosen])
    counted = df.selectExpr(pairs).groupBy("column_name", *kinds).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("column_name").agg(
        F.sum("n").alias("total_rows"), F.expr(f"count_if({' OR '.join(f'{k} IS NOT NULL' for k in kinds)})").alias("distinct_count")
    )


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 10) -> DataFrame:
    """The ``k`` most common values of every column, with their share of all rows."""
    counted = value_frequencies(df, columns).filter("value IS NOT NULL")
    ranked = _top(counted, k, F.desc("n"), "value")
    rows = df.agg(F.count(F.lit(1))).scalar()  # from file footers; the values are scanned once
    return ranked.withColumn("total_rows", rows).select(
        "column_name", "rank", _shown(_selected(df, columns)).alias("value"), F.col("n").alias("value_count"), F.try_divide(F.col("n") * F.lit(100.0), F.col("total_rows")).alias("percentage")
    )


def top_values_sketch(df: DataFrame, columns: list[str] | None = None, k: int = 10, tracked: int = 10_000) -> DataFrame:
    """Common values from a frequent-items sketch of ``tracked`` entries per column: one pass, nothing shuffled per value.

    Counts are exact while a column has fewer distinct values than ``tracked``.
    """
    chosen = _selected(df, columns)
    sketches = [f"approx_top_k({whole_value(f)}, {k}, {tracked}) AS t{i}" for i, f in enumerate(chosen)]
    rows = q.rows([q.struct(column_name=q.text(f.dotted), top=f"t{i}") for i, f in enumerate(chosen)])
    each = df.selectExpr("count(1) AS total_rows", *sketches).selectExpr("total_rows", rows)
    found = each.selectExpr("column_name", "total_rows", "posexplode(top) AS (pos, entry)").filter("entry.item IS NOT NULL").selectExpr(
        "column_name", "CAST(pos + 1 AS BIGINT) AS rank", "entry.item AS value", "entry.count AS value_count",
        "try_divide(entry.count * 100.0D, total_rows) AS percentage",
    )
    return found.withColumn("value", _shown(chosen))


def sample_values(df: DataFrame, columns: list[str] | None = None, k: int = 3, max_columns: int | None = None) -> DataFrame:
    """The ``k`` smallest distinct values of every column (or of the first ``max_columns``), as text.

    Each round finds every column's next larger value with one plain ``min`` per column, so even a column of
    unique texts is never shuffled: what leaves a task is one row per round.
    """
    chosen = [f for f in _selected(df, columns) if not isinstance(f.data_type, (T.MapType, T.VariantType))][:max_columns]
    if not chosen:
        return df.sparkSession.createDataFrame([], "column_name string, rank bigint, value string")
    found: DataFrame | None = None
    for step in range(1, k + 1):
        if found is None:
            rows, kept = df, []
        else:
            rows = df.withColumn("_found", found.select(F.struct("*")).scalar())
            kept = [f"any_value(_found.v{i}_{s}) AS v{i}_{s}" for i in range(len(chosen)) for s in range(1, step)]
        nexts = [
            f"min(CASE WHEN {q.name(f.path)} > _found.v{i}_{step - 1} THEN {q.name(f.path)} END) AS v{i}_{step}"
            if found is not None else f"min({q.name(f.path)}) AS v{i}_{step}"
            for i, f in enumerate(chosen)
        ]
        found = rows.selectExpr(*kept, *nexts)
    out = q.rows([
        q.struct(column_name=q.text(f.dotted), rank=f"{s}L", value=display_value_of(f, f"v{i}_{s}"))
        for i, f in enumerate(chosen) for s in range(1, k + 1)
    ])
    return found.selectExpr(out).filter("value IS NOT NULL")


def string_patterns(df: DataFrame, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    """The ``k`` most common value shapes of every string column."""
    chosen = [f for f in _selected(df, columns) if isinstance(f.data_type, T.StringType)]
    counted = _counted_pairs(df, chosen, "pattern", lambda f: pattern(q.name(f.path))).filter("pattern IS NOT NULL")
    return _top(counted, k, F.desc("n"), "pattern").select("column_name", "rank", "pattern", F.col("n").alias("value_count"))
