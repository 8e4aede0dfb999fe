"""Profiles that are kept by data file and merged: a table that grew is profiled by reading its new files only.

For every data file (told by its path, size and time) and column the store holds what can be merged: filled cells, bounds,
mean and squared deviations, lengths, and three sketches (distinct values, ranks, frequent values). The profile of a table is the
merge over the files that it has now; a file that was replaced or removed drops out, and one that was stored twice counts once.
Row counts, null counts, bounds, means and lengths are exact; distinct counts, quartiles and common values are estimates whose
error does not grow with the number of files. A column that some files lack is null in their rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from assayer import schemas
from assayer.functions import sqltext as q
from assayer.operators.profile import _number_text, kind_of, unsigned_zero
from assayer.sources.tables import Field, profilable, union_all

#: What the sketches are made of; states of another kind cannot be merged with these, and their files are read again.
FORMAT = 2
FILE = ["file_path", "file_size", "file_time"]


@dataclass(frozen=True)
class SketchOptions:
    """Sizes of the sketches, and how many columns one scan aggregates.

    Values longer than ``longest`` characters are not followed as common values, so a sketch's size has a bound.
    """

    distinct_bits: int = 14
    rank_k: int = 800
    tracked: int = 1000
    longest: int = 1000
    columns_per_pass: int = 8


@dataclass(frozen=True)
class Refreshed:
    """What a refresh found: files read now, files known from before, stored files that the table no longer has."""

    scanned: int
    known: int
    gone: int


def data_files(spark: SparkSession, path: str) -> DataFrame:
    """The table's data files: key columns and the path to read. No file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    meta = F.col("_metadata")
    return files.select(
        meta["file_path"].alias("file_path"), meta["file_size"].alias("file_size"), meta["file_modification_time"].alias("file_time"), F.col("path").alias("_read")
    )


_KINDS = {
    "filled": "BIGINT", "hll": "BINARY", "min": "DOUBLE", "max": "DOUBLE", "min_long": "BIGINT", "max_long": "BIGINT", "mean": "DOUBLE", "m2": "DOUBLE",
    "kll": "BINARY", "min_length": "BIGINT", "max_length": "BIGINT", "sum_length": "BIGINT",
}
_TOP = "STRUCT<sketch: BINARY, maxItemsTracked: INT, itemDataType: STRING, itemDataTypeDDL: STRING>"


STATES = f"""
    table_id STRING, file_path STRING, file_size BIGINT, file_time TIMESTAMP, file_rows BIGINT, format INT,
    column_name STRING, ordinal INT, data_type STRING, profile_type STRING,
    {', '.join(f"{n} {kind}" for n, kind in _KINDS.items())}, min_value STRING, max_value STRING, top {_TOP}
"""


def _hashed(c: str, data_type: T.DataType) -> str:
    """What the distinct values' sketch gets: whole numbers as they are, else 64-bit hashes, as making texts of all values took half a scan's time."""
    if isinstance(data_type, T.IntegralType):
        return f"CAST({c} AS BIGINT)"
    plain = unsigned_zero(c, data_type)
    # a hash passes over nulls within arrays and depends on a decimal's precision
    raw = (T.DoubleType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    value = plain if isinstance(data_type, raw) else f"CAST({plain} AS STRING)"
    return f"CASE WHEN {c} IS NOT NULL THEN xxhash64({value}) END"


def _states(f: Field, opts: SketchOptions) -> dict[str, str]:
    """The mergeable aggregates that a column's type allows."""
    c, kind = q.name(f.path), kind_of(f.data_type)
    out = {"filled": f"count({c})"}
    if isinstance(f.data_type, (T.MapType, T.VariantType, T.CalendarIntervalType)):
        return out
    plain = unsigned_zero(c, f.data_type)
    out["hll"] = f"hll_sketch_agg({_hashed(c, f.data_type)}, {opts.distinct_bits})"
    if kind == "numeric":
        number = f"CAST({plain} AS DOUBLE)"
        out |= {"min": f"min({plain})", "max": f"max({plain})", "mean": f"avg({number})", "m2": f"var_pop({number}) * count({c})"}
        out["kll"] = f"kll_sketch_agg_double({number}, {opts.rank_k})"
        if isinstance(f.data_type, T.IntegralType):
            out |= {"min_long": f"min({c})", "max_long": f"max({c})"}
    size = f"length({c})" if kind == "string" else f"size({c})" if isinstance(f.data_type, T.ArrayType) else None
    if size:
        sized = f"CASE WHEN {c} IS NOT NULL THEN {size} END"
        out |= {"min_length": f"min({sized})", "max_length": f"max({sized})", "sum_length": f"sum({sized})"}
    if isinstance(f.data_type, (T.StringType, T.IntegralType, T.BooleanType, T.DateType)):
        value = f"CAST({c} AS STRING)"
        followed = f"length({value}) <= {opts.longest}" if isinstance(f.data_type, T.StringType) else f"{c} IS NOT NULL"
        out["top"] = f"approx_top_k_accumulate({value}, {opts.tracked}) FILTER (WHERE {followed})"
    return out


def sketched(df: DataFrame, table_id: str, opts: SketchOptions = SketchOptions()) -> DataFrame:
    """One row per data file and column of ``df`` (a scan of files), with the states to merge."""
    wanted = profilable(df.schema)
    groups = [wanted[i : i + opts.columns_per_pass] for i in range(0, len(wanted), opts.columns_per_pass)]
    return union_all(_sketched_group(df, table_id, g, opts) for g in groups)


def _sketched_group(df: DataFrame, table_id: str, group: list[Field], opts: SketchOptions) -> DataFrame:
    aggregates, structs = [F.expr("count(1)").alias("file_rows")], []
    for i, f in enumerate(group):
        states = _states(f, opts)
        aggregates += [F.expr(agg).alias(f"{name}_{i}") for name, agg in states.items()]
        structs.append(q.struct(
            column_name=q.text(f.dotted), ordinal=str(f.ordinal), data_type=q.text(f.data_type.simpleString()), profile_type=q.text(kind_of(f.data_type)),
            **{n: f"CAST({f'{n}_{i}' if n in states else 'NULL'} AS {kind})" for n, kind in _KINDS.items()},
            **{f"{b}_value": _number_text(f"{b}_{i}", f.data_type) if b in states else "CAST(NULL AS STRING)" for b in ("min", "max")},
            top=f"CAST({f'top_{i}' if 'top' in states else 'NULL'} AS {_TOP})",
        ))
    meta = F.col("_metadata")
    keys = [meta["file_path"].alias("file_path"), meta["file_size"].alias("file_size"), meta["file_modification_time"].alias("file_time")]
    found = df.groupBy(*keys).agg(*aggregates)
    return found.selectExpr(f"{q.text(table_id)} AS table_id", *FILE, "file_rows", f"{FORMAT} AS format", q.rows(structs))


def stored(spark: SparkSession, store: str, table_id: str) -> DataFrame | None:
    """The stored states of a table; only its folder is read. None before the first refresh."""
    try:
        found = spark.read.schema(STATES).parquet(store)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return found.filter((F.col("table_id") == table_id) & (F.col("format") == FORMAT)).dropDuplicates([*FILE, "column_name"])


def refresh(spark: SparkSession, path: str, store: str, table_id: str, opts: SketchOptions = SketchOptions()) -> Refreshed:
    """Profile the data files below ``path`` that the store does not have yet, and append their states.

    The append becomes visible as a whole; after a failure the next refresh reads the same files again. A refresh that ran
    twice at the same time stores equal rows, which count once.
    """
    files = data_files(spark, path)
    old = stored(spark, store, table_id)
    if old is None:
        new, known, gone = files, 0, 0
    else:
        seen = old.select(*FILE).distinct()
        new = files.join(seen, FILE, "left_anti")
        known, gone = files.join(seen, FILE, "left_semi").count(), seen.join(files, FILE, "left_anti").count()
    # the paths of new files, which a scan lists on the driver anyway
    paths = [r["_read"] for r in new.select("_read").collect()]
    if paths:
        # new files may have columns that older ones lack; folders named after values are columns too
        reader = spark.read.option("mergeSchema", "true")
        reader = reader if paths[0].endswith(path) else reader.option("basePath", path)
        states = sketched(reader.parquet(*paths), table_id, opts)
        states.write.mode("append").partitionBy("table_id").parquet(store)
        # files without rows have no states; a row without a column keeps them from being read again
        empty = new.join(stored(spark, store, table_id).select(*FILE).distinct(), FILE, "left_anti")
        empty = empty.select(F.lit(table_id).alias("table_id"), *FILE, F.lit(0).cast("bigint").alias("file_rows"), F.lit(FORMAT).alias("format"))
        if empty.count():
            empty.write.mode("append").partitionBy("table_id").parquet(store)
    return Refreshed(len(paths), known, gone)


# A sketch without values has no quartiles.
_RANKS = "kll_merge_agg_double(kll)"
_QUARTILES = f"CASE WHEN count(kll) > 0 AND kll_sketch_get_n_double({_RANKS}) > 0 THEN kll_sketch_get_quantile_double({_RANKS}, array(0.25D, 0.5D, 0.75D)) END"


def merged(spark: SparkSession, path: str, store: str, table_id: str) -> DataFrame:
    """The profile (schema ``PROFILE``) of the files that the table has now, from their stored states alone."""
    old = stored(spark, store, table_id)
    if old is None:
        return spark.createDataFrame([], schemas.PROFILE)
    rows = old.join(data_files(spark, path).select(*FILE), FILE, "left_semi").filter("column_name IS NOT NULL")
    total = rows.select(*FILE, "file_rows").distinct().agg(F.sum("file_rows").alias("total_rows"))
    means = rows.groupBy("column_name").agg((F.sum(F.col("mean") * F.col("filled")) / F.sum(F.when(F.col("mean").isNotNull(), F.col("filled")))).alias("_mean"))
    joined = rows.join(means, "column_name")
    spread = F.col("m2") + F.col("filled") * F.pow(F.col("mean") - F.col("_mean"), 2)
    latest = F.struct("file_time", "file_path")
    found = joined.groupBy("column_name").agg(
        *(F.max_by(c, latest).alias(c) for c in ("ordinal", "data_type", "profile_type")),
        F.sum("filled").alias("filled"),
        F.expr("hll_sketch_estimate(hll_union_agg(hll))").alias("_distinct"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.first("_mean").alias("avg"), F.sum(spread).alias("_m2"),
        F.expr(_QUARTILES).alias("_quartiles"),
        F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length"), F.sum("sum_length").alias("_lengths"),
        F.min_by("min_value", F.struct("min", "min_long")).alias("min_value"), F.max_by("max_value", F.struct("max", "max_long")).alias("max_value"),
    )
    # one row of totals, read beside every column's row
    found = found.withColumn("total_rows", F.coalesce(total.scalar(), F.lit(0)).cast("bigint"))
    found = found.withColumns({
        "null_count": F.col("total_rows") - F.col("filled"),
        "distinct_count": F.least("_distinct", "filled"),
        "stddev": F.sqrt(F.try_divide("_m2", F.when(F.col("filled") > 1, F.col("filled") - 1))),
    })
    share = lambda c: F.round(F.try_divide(F.col(c) * 100.0, F.col("total_rows")), 2)
    return found.select(
        F.lit(table_id).alias("table_id"), "column_name", "ordinal", "data_type", "profile_type", "total_rows", "null_count", share("null_count").alias("null_percentage"),
        "distinct_count", share("distinct_count").alias("distinct_percentage"), "min", "max", "avg", "stddev",
        F.col("_quartiles")[0].alias("q1"), F.col("_quartiles")[1].alias("median"), F.col("_quartiles")[2].alias("q3"),
        "min_length", "max_length", F.try_divide("_lengths", "filled").alias("avg_length"), "min_value", "max_value",
    )


def common_values(spark: SparkSession, path: str, store: str, table_id: str, k: int = 5) -> DataFrame:
    """The ``k`` most common values of each column by the merged sketches: ``column_name``, ``rank``, ``value``, ``value_count`` (an estimate)."""
    old = stored(spark, store, table_id)
    if old is None:
        return spark.createDataFrame([], "column_name string, rank int, value string, value_count bigint")
    rows = old.join(data_files(spark, path).select(*FILE), FILE, "left_semi").filter("top IS NOT NULL")
    found = rows.groupBy("column_name").agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(top), {k})").alias("top"))
    found = found.select("column_name", F.inline("top")).toDF("column_name", "value", "value_count")
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("value_count"), "value"))
    return found.select("column_name", place.alias("rank"), "value", F.col("value_count").cast("bigint").alias("value_count"))
