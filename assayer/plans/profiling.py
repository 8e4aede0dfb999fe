"""Profiling queries: column statistics, values, patterns, sensitivity and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.functions.fixed import INFO_TYPES, PHI_KEYWORDS, PII_KEYWORDS, REPORT_SENSITIVE_KEYWORDS
from assayer.operators import classify, frequencies, quality, quartiles, stored_profiles, usage
from assayer.operators.profile import (
    ProfileOptions, counts_from_ratios, first_of_kind, most_null, profile_table, profile_tables, ratios, store_profile, stored_profile,
)
from assayer.plans import data
from assayer.session import scratch_path
from assayer.sources import documents as docs_io
from assayer.sources.tables import columns_frame, file_facts, sample_rows, sampled, sampled_by_key, table_metadata, union_all

NO_DISTINCT = ProfileOptions(cardinality=False, quartiles=False)

# Column names per table, for the generated SQL below.
ALL_COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "pages": ["page_id", "url", "html"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "labels": ["doc_id", "quality", "toxic"],
    "benchmark": ["item_id", "text"],
    "conversations": ["conv_id", "turn", "role", "text"],
    "embeddings": ["vec_id", "embedding", "label"],
}
# Kinds: doubles, columns that are neither numbers nor text, and whole numbers; what is left is text.
DOUBLES = {"c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "value"}
OTHERS = {"l_shipdate", "o_orderdate", "ts", "embedding"}
INTEGERS = {c for columns in ALL_COLUMNS.values() for c in columns if c.endswith(("key", "_id", "number", "size", "chars"))} | {"quality", "toxic", "turn", "label"}
NUMERIC = {t: [c for c in columns if c in DOUBLES | INTEGERS] for t, columns in ALL_COLUMNS.items()}
STRINGS = {t: [c for c in columns if c not in DOUBLES | INTEGERS | OTHERS] for t, columns in ALL_COLUMNS.items()}
PROFILED = list(ALL_COLUMNS)


def _union_sql(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def _profiled(spark: SparkSession, sf: str, names: list[str] = PROFILED, options: ProfileOptions = NO_DISTINCT) -> DataFrame:
    return profile_tables({n: data.table(spark, sf, n) for n in names}, options)


# --- one pass statistics ------------------------------------------------------------------------


def estate_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The whole estate: every column of every table, approximate distinct counts and quartiles included."""
    return profile_tables(data.tables(spark, sf))


def profile_nulls(spark: SparkSession, sf: str) -> DataFrame:
    rows = profile_tables({t.rsplit(".", 1)[1]: df for t, df in data.tables(spark, sf).items()}, ProfileOptions(cardinality=False, distribution=False))
    return rows.select("table_id", "column_name", "total_rows", "null_count", "null_percentage")


PROFILE_NULLS_SQL = _union_sql([
    f"SELECT '{t}' AS table_id, '{c}' AS column_name, count(*) AS total_rows, count(*) - count({c}) AS null_count,"
    f" round(100.0 * (count(*) - count({c})) / count(*), 2) AS null_percentage FROM {t}"
    for t, columns in ALL_COLUMNS.items() for c in columns
])


def profile_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return _profiled(spark, sf).filter("profile_type = 'numeric'").select(
        "table_id", "column_name", "min", "max", F.round("avg", 4).alias("avg"), F.round("stddev", 4).alias("stddev")
    )


PROFILE_NUMERIC_SQL = _union_sql([
    f"SELECT '{t}' AS table_id, '{c}' AS column_name, CAST(min({c}) AS DOUBLE) + 0.0 AS min, CAST(max({c}) AS DOUBLE) + 0.0 AS max,"
    f" round(avg({c}), 4) AS avg, round(stddev_samp({c}), 4) AS stddev FROM {t}"
    for t in PROFILED for c in NUMERIC[t]
])


def profile_string(spark: SparkSession, sf: str) -> DataFrame:
    return _profiled(spark, sf).filter("profile_type = 'string'").select(
        "table_id", "column_name", "min_length", "max_length", F.round("avg_length", 4).alias("avg_length")
    )


PROFILE_STRING_SQL = _union_sql([
    f"SELECT '{t}' AS table_id, '{c}' AS column_name, min(length({c})) AS min_length, max(length({c})) AS max_length,"
    f" round(avg(length({c})), 4) AS avg_length FROM {t}"
    for t in PROFILED for c in STRINGS[t]
])


def profile_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact quartiles of every numeric column of the estate."""
    return quartiles.quartiles({n: data.table(spark, sf, n) for n in PROFILED})


PROFILE_QUARTILES_SQL = _union_sql([
    f"SELECT '{t}' AS table_id, '{c}' AS column_name, CAST(quantile_disc({c}, 0.25) AS DOUBLE) AS q1, CAST(quantile_disc({c}, 0.5) AS DOUBLE) AS median,"
    f" CAST(quantile_disc({c}, 0.75) AS DOUBLE) AS q3 FROM {t}"
    for t in PROFILED for c in NUMERIC[t]
])


def profile_approx_distinct(spark: SparkSession, sf: str) -> DataFrame:
    rows = _profiled(spark, sf, options=ProfileOptions(distribution=False))
    return rows.select("table_id", "column_name", "total_rows", "distinct_count", "distinct_percentage")


DISTINCT_COLUMNS = ALL_COLUMNS


def profile_exact_distinct(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        frequencies.distinct_counts(data.table(spark, sf, t), columns).select(F.lit(t).alias("table_id"), "*")
        for t, columns in DISTINCT_COLUMNS.items()
    ]
    return union_all(parts)


PROFILE_EXACT_DISTINCT_SQL = _union_sql([
    f"SELECT '{t}' AS table_id, '{c}' AS column_name, count(*) AS total_rows, count(DISTINCT {c}) AS distinct_count FROM {t}"
    for t, columns in DISTINCT_COLUMNS.items() for c in columns
])


def profile_other(spark: SparkSession, sf: str) -> DataFrame:
    """Null share of columns that are neither numbers nor text, and element counts of arrays."""
    names = ["lineitem", "orders", "events", "embeddings"]
    rows = _profiled(spark, sf, names).filter("profile_type = 'other'")
    return rows.select("table_id", "column_name", "null_percentage", "min_length", "max_length")


PROFILE_OTHER_SQL = _union_sql([
    f"SELECT '{t}' AS table_id, '{c}' AS column_name, round(100.0 * (count(*) - count({c})) / count(*), 2) AS null_percentage,"
    f" CAST({low} AS BIGINT) AS min_length, CAST({high} AS BIGINT) AS max_length FROM {t}"
    for t, c, low, high in [
        ("lineitem", "l_shipdate", "NULL", "NULL"), ("orders", "o_orderdate", "NULL", "NULL"), ("events", "ts", "NULL", "NULL"),
        ("embeddings", "embedding", "min(len(embedding))", "max(len(embedding))"),
    ]
])


# Documents with their labels: the unlabelled ones give every label column real nulls.
LABELLED_SQL = "SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
LABELLED_COLUMNS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    docs = data.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(data.table(spark, sf, "labels"), "doc_id", "left")


def profile_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Null ratios next to the counts they come from, on columns with real nulls."""
    rows = ratios(profile_table(labelled(spark, sf), "labelled", options=ProfileOptions(distribution=False)))
    return rows.select("column_name", "total_rows", "null_count", F.round("null_ratio", 6).alias("null_ratio"))


def profile_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts taken back from a profile that only stores ratios, truncated to whole rows."""
    stored = ratios(profile_table(labelled(spark, sf), "labelled", options=ProfileOptions(distribution=False))).drop("null_count", "distinct_count")
    return counts_from_ratios(stored).select("column_name", "total_rows", "null_count", F.round("null_percentage", 6).alias("null_percentage"))


PROFILE_RATIOS_SQL = f"WITH t AS ({LABELLED_SQL}) " + _union_sql([
    f"SELECT '{c}' AS column_name, count(*) AS total_rows, count(*) - count({c}) AS null_count,"
    f" round((count(*) - count({c})) / count(*), 6) AS null_ratio FROM t" for c in LABELLED_COLUMNS
])


def most_null_columns(spark: SparkSession, sf: str) -> DataFrame:
    profile = profile_table(labelled(spark, sf), "labelled", options=ProfileOptions(cardinality=False, distribution=False))
    return most_null(profile, k=10).select("column_name", "null_count", "null_percentage", "rank")


MOST_NULL_SQL = f"""
    WITH t AS ({LABELLED_SQL}), p AS ({_union_sql([
        f"SELECT '{c}' AS column_name, {i} AS ordinal, count(*) - count({c}) AS null_count,"
        f" round(100.0 * (count(*) - count({c})) / count(*), 2) AS null_percentage FROM t" for i, c in enumerate(LABELLED_COLUMNS)
    ])}), r AS (SELECT *, row_number() OVER (ORDER BY null_percentage DESC, ordinal) AS rank FROM p WHERE null_percentage > 0)
    SELECT column_name, null_count, null_percentage, rank FROM r WHERE rank <= 10
"""


def first_numeric_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten numeric columns of every table, as content texts list them."""
    named = {t.rsplit(".", 1)[1]: df for t, df in data.tables(spark, sf).items()}
    rows = first_of_kind(profile_tables(named, NO_DISTINCT), "numeric")
    return rows.select("table_id", "column_name", "rank", "min", "max")


NUMBERS = NUMERIC
FIRST_NUMERIC_SQL = _union_sql([
    f"SELECT '{t}' AS table_id, '{c}' AS column_name, CAST({i} AS BIGINT) AS rank, CAST(min({c}) AS DOUBLE) + 0.0 AS min, CAST(max({c}) AS DOUBLE) + 0.0 AS max FROM {t}"
    for t, columns in NUMBERS.items() for i, c in enumerate(columns, 1)
])


PROFILE_COUNTS_SQL = f"WITH t AS ({LABELLED_SQL}) " + _union_sql([
    f"SELECT '{c}' AS column_name, count(*) AS total_rows, CAST(floor(count(*) * ((count(*) - count({c})) / count(*))) AS BIGINT) AS null_count,"
    f" round((count(*) - count({c})) / count(*) * 100.0, 6) AS null_percentage FROM t" for c in LABELLED_COLUMNS
])


# --- sampled and filtered scans -----------------------------------------------------------------


def profile_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """A profile over the rows a filter keeps, for chosen columns; the filter reaches the scan."""
    rows = sampled(
        data.table(spark, sf, "lineitem"), row_filter="l_returnflag = 'R' AND l_quantity >= 25",
        target_columns=["l_quantity", "l_extendedprice", "l_linestatus"],
    )
    return profile_table(rows, "lineitem", options=NO_DISTINCT).select(
        "column_name", "total_rows", "null_count", "min", "max", F.round("avg", 4).alias("avg"), "max_length"
    )


_FILTERED = "FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 25"
PROFILE_FILTERED_SQL = f"""
    SELECT 'l_quantity' AS column_name, count(*) AS total_rows, count(*) - count(l_quantity) AS null_count,
           min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 4) AS avg, CAST(NULL AS BIGINT) AS max_length {_FILTERED}
    UNION ALL SELECT 'l_extendedprice', count(*), count(*) - count(l_extendedprice), min(l_extendedprice), max(l_extendedprice),
           round(avg(l_extendedprice), 4), NULL {_FILTERED}
    UNION ALL SELECT 'l_linestatus', count(*), count(*) - count(l_linestatus), NULL, NULL, NULL, max(length(l_linestatus)) {_FILTERED}
"""


def profile_sampled(spark: SparkSession, sf: str) -> DataFrame:
    """A ten percent sample, drawn below the aggregate."""
    return profile_table(sampled(data.table(spark, sf, "lineitem"), percent=10.0), "lineitem")


def profile_key_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A ten percent sample by key hash: the same rows wherever and however often it runs."""
    rows = sampled_by_key(data.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], 10.0)
    return profile_table(rows, "lineitem", ["l_quantity", "l_extendedprice", "l_tax"], NO_DISTINCT).select(
        "column_name", "total_rows", "min", "max", F.round("avg", 4).alias("avg")
    )


_KEY_SAMPLE = (
    "FROM lineitem WHERE CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)), 1, 8) AS BIGINT)"
    f" < {int(0.1 * 2**32)}"
)
PROFILE_KEY_SAMPLE_SQL = _union_sql([
    f"SELECT '{c}' AS column_name, count(*) AS total_rows, min({c}) + 0.0 AS min, max({c}) + 0.0 AS max, round(avg({c}), 4) AS avg {_KEY_SAMPLE}"
    for c in ("l_quantity", "l_extendedprice", "l_tax")
])


def profile_reused(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables, one of them with a stored profile: only the other is scanned for the result."""
    path = scratch_path(spark, "profiles")
    store_profile(profile_table(data.table(spark, sf, "orders"), "orders", options=NO_DISTINCT), path, "profile-sales-orders")
    named = {t: data.table(spark, sf, t) for t in ("orders", "customer")}
    rows = profile_tables(named, NO_DISTINCT, stored=stored_profile(spark, path, "profile-sales-orders"))
    return rows.filter("profile_type = 'numeric'").select("table_id", "column_name", "total_rows", "min", "max")


PROFILE_REUSED_SQL = _union_sql([
    f"SELECT '{t}' AS table_id, '{c}' AS column_name, count(*) AS total_rows, CAST(min({c}) AS DOUBLE) + 0.0 AS min, CAST(max({c}) AS DOUBLE) + 0.0 AS max FROM {t}"
    for t in ("orders", "customer") for c in NUMERIC[t]
])


INCREMENTAL = {"lineitem": "l_orderkey", "orders": "o_orderkey", "documents": "doc_id"}


def profile_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Tables that grow by new files between two refreshes: the second reads these alone, and the merge equals a full profile.

    Bounds, counts, means and lengths are compared as they are; the sketched distinct counts with exact ones, within 5 %.
    """
    store, parts = scratch_path(spark, "sketches"), []
    for name, key in INCREMENTAL.items():
        df, path = data.table(spark, sf, name), scratch_path(spark, f"grown-{name}")
        later = F.pmod(F.xxhash64(key), F.lit(5)) == 0
        df.filter(~later).write.parquet(path)
        first = stored_profiles.refresh(spark, path, store, name)
        df.filter(later).write.mode("append").parquet(path)
        second = stored_profiles.refresh(spark, path, store, name)
        files = stored_profiles.data_files(spark, path).count()
        only_new = second.known == first.scanned and second.scanned == files - first.scanned and not second.gone
        exact = frequencies.distinct_counts(df, ALL_COLUMNS[name]).select(F.col("column_name").alias("_c"), F.col("distinct_count").alias("_exact"))
        merged = stored_profiles.merged(spark, path, store, name)
        found = merged.join(exact, F.col("column_name") == F.col("_c"))
        parts.append(found.withColumns({"only_new_files_read": F.lit(only_new), "distinct_close": F.abs(F.col("distinct_count") - F.col("_exact")) <= F.col("_exact") * 0.05}))
    rounded = [F.round(c, 4).alias(c) for c in ("avg", "stddev", "avg_length")]
    return union_all(parts).select(
        "table_id", "column_name", "only_new_files_read", "total_rows", "null_count", "distinct_close", "min", "max", *rounded, "min_length", "max_length"
    )


def _incremental_sql(t: str, c: str) -> str:
    numeric, text = c in NUMERIC[t], c in STRINGS[t]
    number = f"CAST(min({c}) AS DOUBLE) + 0.0, CAST(max({c}) AS DOUBLE) + 0.0, round(avg({c}), 4), round(stddev_samp({c}), 4)"
    size = f"round(avg(length({c})), 4), min(length({c})), max(length({c}))"
    return (
        f"SELECT '{t}' AS table_id, '{c}' AS column_name, true AS only_new_files_read, count(*) AS total_rows, count(*) - count({c}) AS null_count, true AS distinct_close,"
        f" {number if numeric else 'NULL, NULL, NULL, NULL'}, {size if text else 'NULL, NULL, NULL'} FROM {t}"
    )


PROFILE_INCREMENTAL_SQL = (
    "SELECT table_id, column_name, only_new_files_read, total_rows, null_count, distinct_close, min, max, avg, stddev, avg_length, min_length, max_length FROM ("
    + _union_sql([_incremental_sql(t, c) for t in INCREMENTAL for c in ALL_COLUMNS[t]])
    + ") x(table_id, column_name, only_new_files_read, total_rows, null_count, distinct_close, min, max, avg, stddev, avg_length, min_length, max_length)"
)


def inspect_sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sample_rows(data.table(spark, sf, "orders"), ["o_orderkey"], 100).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


SAMPLE_ROWS_SQL = """
    SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders
    ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100
"""


# --- inventory ----------------------------------------------------------------------------------


def table_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return union_all(table_metadata(a.read(spark), a) for a in data.assets(sf))


TABLE_INVENTORY_SQL = _union_sql([
    f"SELECT '{data.PROJECT}' AS project_id, '{d}' AS dataset_id, '{t}' AS table_id, 'TABLE' AS table_type,"
    f" count(*) AS row_count, CAST({len(ALL_COLUMNS[t])} AS BIGINT) AS column_count FROM {t}"
    for d, names in data.DATASETS.items() for t in names
])


def table_files(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes and file times of every table from the file listing alone."""
    return union_all(file_facts(spark, a) for a in data.assets(sf))


# --- values -------------------------------------------------------------------------------------

# All columns whose text is the same in any engine: doubles and times are left to the profile queries.
VALUE_COLUMNS = {t: [c for c in columns if c not in DOUBLES | OTHERS] for t, columns in ALL_COLUMNS.items()}


def _pairs_sql(wanted: dict[str, list[str]], expr: str = "CAST({c} AS VARCHAR)") -> str:
    return _union_sql([
        f"SELECT '{t}' AS table_id, '{c}' AS column_name, {expr.format(c=c)} AS value FROM {t}" for t, columns in wanted.items() for c in columns
    ])


def _per_table(spark: SparkSession, sf: str, wanted: dict[str, list[str]], operator) -> DataFrame:
    return union_all(
        operator(data.table(spark, sf, t), columns).select(F.lit(t).alias("table_id"), "*") for t, columns in wanted.items()
    )


def top_values(spark: SparkSession, sf: str) -> DataFrame:
    return _per_table(spark, sf, VALUE_COLUMNS, frequencies.top_values).withColumn("percentage", F.round("percentage", 4))


TOP_VALUES_SQL = f"""
    WITH v AS ({_pairs_sql(VALUE_COLUMNS)}),
         t AS (SELECT table_id, column_name, count(*) AS total_rows FROM v GROUP BY ALL),
         c AS (SELECT table_id, column_name, value, count(*) AS value_count FROM v WHERE value IS NOT NULL GROUP BY ALL),
         r AS (SELECT *, row_number() OVER (PARTITION BY table_id, column_name ORDER BY value_count DESC, value) AS rank FROM c)
    SELECT table_id, column_name, rank, value, value_count, round(100.0 * value_count / total_rows, 4) AS percentage
    FROM r JOIN t USING (table_id, column_name) WHERE rank <= 10
"""

# Every column but the embeddings: an array's smallest values have no common text.
SAMPLE_COLUMNS = {t: [c for c in columns if c not in ("embedding", "ts")] for t, columns in ALL_COLUMNS.items()}


def sample_values(spark: SparkSession, sf: str) -> DataFrame:
    return _per_table(spark, sf, SAMPLE_COLUMNS, frequencies.sample_values)


SAMPLE_VALUES_SQL = _union_sql([
    f"SELECT '{t}' AS table_id, '{c}' AS column_name, row_number() OVER (ORDER BY v) AS rank, CAST(v AS VARCHAR) AS value"
    f" FROM (SELECT DISTINCT {c} AS v FROM {t} WHERE {c} IS NOT NULL ORDER BY v LIMIT 3)"
    for t, columns in SAMPLE_COLUMNS.items() for c in columns
])


def top_values_sketch(spark: SparkSession, sf: str) -> DataFrame:
    return _per_table(spark, sf, VALUE_COLUMNS, frequencies.top_values_sketch)


PATTERN_COLUMNS = {t: columns for t, columns in STRINGS.items() if columns}


def string_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return _per_table(spark, sf, PATTERN_COLUMNS, frequencies.string_patterns)


_PATTERN_EXPR = "regexp_replace(regexp_replace({c}, '\\p{{L}}', 'A', 'g'), '\\p{{N}}', '9', 'g')"
STRING_PATTERNS_SQL = f"""
    WITH v AS ({_pairs_sql(PATTERN_COLUMNS, _PATTERN_EXPR)}),
         c AS (SELECT table_id, column_name, value AS pattern, count(*) AS value_count FROM v WHERE value IS NOT NULL GROUP BY ALL),
         r AS (SELECT *, row_number() OVER (PARTITION BY table_id, column_name ORDER BY value_count DESC, pattern) AS rank FROM c)
    SELECT table_id, column_name, rank, pattern, value_count FROM r WHERE rank <= 5
"""


# --- sensitivity --------------------------------------------------------------------------------


def _named_schemas(spark: SparkSession, sf: str) -> dict:
    return {t.rsplit(".", 1)[1]: df.schema for t, df in data.tables(spark, sf).items()}


def sensitive_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Every column with its name flags next to what its cells hold: filled cells, and cells with an info type."""
    named = {t.rsplit(".", 1)[1]: df for t, df in data.tables(spark, sf).items()}
    flags = classify.flag_columns(columns_frame(spark, {t: df.schema for t, df in named.items()}))
    filled = profile_tables(named, ProfileOptions(cardinality=False, distribution=False))
    cells = union_all(classify.value_findings(df, t) for t, df in named.items())
    matched = cells.groupBy("table_id", "column_name").agg(F.sum("match_count").alias("cell_matches"))
    return flags.join(filled, ["table_id", "column_name"]).join(matched, ["table_id", "column_name"], "left").select(
        "table_id", "column_name", "is_pii", "is_phi", "is_sensitive",
        (F.col("total_rows") - F.col("null_count")).alias("filled_cells"),
        F.coalesce("cell_matches", F.lit(0)).alias("cell_matches"),
    )


def _any_keyword(name: str, words: list[str]) -> str:
    return str(any(w in name.lower() for w in words)).upper()


_TEXT_COLUMNS = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"],
    "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"],
    "events": ["event_type", "props"], "pages": ["url", "html"], "documents": ["text", "lang", "source"], "labels": [],
    "benchmark": ["text"], "conversations": ["role", "text"], "embeddings": [],
}


def _matches_sql(c: str) -> str:
    return " + ".join(f"count(*) FILTER (WHERE regexp_matches({c}, '{regex}'))" for regex in INFO_TYPES.values())


SENSITIVE_COLUMNS_SQL = _union_sql([
    f"SELECT '{t}' AS table_id, '{c}' AS column_name, {_any_keyword(c, PII_KEYWORDS)} AS is_pii, {_any_keyword(c, PHI_KEYWORDS)} AS is_phi,"
    f" {_any_keyword(c, REPORT_SENSITIVE_KEYWORDS)} AS is_sensitive, count({c}) AS filled_cells,"
    f" CAST({_matches_sql(c) if c in _TEXT_COLUMNS[t] else '0'} AS BIGINT) AS cell_matches FROM {t}"
    for t, columns in ALL_COLUMNS.items() for c in columns
])


def sensitive_tables(spark: SparkSession, sf: str) -> DataFrame:
    """PII and PHI per table by column name, with the number of rows that are exposed."""
    flags = classify.flag_tables(columns_frame(spark, _named_schemas(spark, sf)))
    counts = table_inventory(spark, sf).select("table_id", "row_count")
    return flags.join(counts, "table_id")


SENSITIVE_TABLES_SQL = _union_sql([
    f"SELECT '{t}' AS table_id, {str(any(_any_keyword(c, PII_KEYWORDS) == 'TRUE' for c in columns)).upper()} AS has_pii,"
    f" {str(any(_any_keyword(c, PHI_KEYWORDS) == 'TRUE' for c in columns)).upper()} AS has_phi, count(*) AS row_count FROM {t}"
    for t, columns in ALL_COLUMNS.items()
])


def sensitive_values(spark: SparkSession, sf: str) -> DataFrame:
    """Cells per info type in the text columns."""
    return union_all(classify.value_findings(data.table(spark, sf, t), t, c) for t, c in [
        ("documents", ["text"]), ("conversations", ["text"]), ("pages", ["html", "url"]), ("benchmark", ["text"]),
    ])


SENSITIVE_VALUES_SQL = _union_sql([
    f"SELECT '{t}' AS table_id, '{c}' AS column_name, '{name}' AS info_type, count(*) FILTER (WHERE regexp_matches({c}, '{regex}')) AS match_count FROM {t}"
    for t, c in [("documents", "text"), ("conversations", "text"), ("pages", "html"), ("pages", "url"), ("benchmark", "text")]
    for name, regex in INFO_TYPES.items()
])


def findings_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Documents flagged by name or by an outside finding; findings come from the cell scan and the labels."""
    docs = data.document_assets(spark, sf).select(
        "dataset_id", "has_phi",
        F.array_compact(F.array(
            F.when(F.col("has_pii"), F.lit("PII: EMAIL_ADDRESS")), F.when(F.col("environment") == "dev", F.lit("LOW_QUALITY"))
        )).alias("findings"),
    )
    flagged = docs.withColumn("has_pii", classify.pii_with_findings(F.lit(None).cast("boolean"), F.col("findings")))
    return flagged.groupBy("dataset_id").agg(F.count_if("has_pii").alias("pii_assets"), F.count_if(F.size("findings") > 0).alias("with_findings"))


FINDINGS_PII_SQL = f"""
    SELECT dataset_id, count(*) FILTER (WHERE has_pii) AS pii_assets, count(*) FILTER (WHERE has_pii OR environment = 'dev') AS with_findings
    FROM ({data.DOCUMENT_ASSETS_SQL}) GROUP BY dataset_id
"""


# --- quality ------------------------------------------------------------------------------------


def completeness(spark: SparkSession, sf: str) -> DataFrame:
    """Completeness and status per source, on documents whose label columns are often null."""
    rows = labelled(spark, sf)
    cells = ["lang", "n_chars", "quality", "toxic"]
    counted = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cells])
    long = counted.select("source", F.col("n").alias("total_rows"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in cells
    ])))
    scored = quality.completeness(long, by=["source"])
    return scored.select(
        "source", "total_rows", "total_columns", "null_cells", F.round("completeness_score", 4).alias("completeness_score"),
        quality.status(F.col("completeness_score")).alias("status"),
    )


COMPLETENESS_SQL = f"""
    WITH t AS (SELECT source, count(*) AS n,
                      4 * count(*) - count(lang) - count(n_chars) - count(quality) - count(toxic) AS null_cells
               FROM ({LABELLED_SQL}) GROUP BY source)
    SELECT source, n AS total_rows, CAST(4 AS BIGINT) AS total_columns, null_cells, round(1.0 - null_cells / (4.0 * n), 4) AS completeness_score,
           CASE WHEN 1.0 - null_cells / (4.0 * n) >= 0.95 THEN 'GOOD' WHEN 1.0 - null_cells / (4.0 * n) >= 0.80 THEN 'FAIR' ELSE 'POOR' END AS status
    FROM t
"""


def quality_status(spark: SparkSession, sf: str) -> DataFrame:
    """Score, status and flawed columns of every table in the estate."""
    rows = quality.quality_summary(estate_profile(spark, sf))
    return rows.select(
        "table_id", "total_rows", "total_columns", F.round("completeness_score", 4).alias("completeness_score"),
        "columns_with_issues", F.round("quality_score", 4).alias("quality_score"), "status",
    )


def quality_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Column issues of the labelled documents: label columns that are mostly null."""
    return quality.issues(profile_table(labelled(spark, sf), "labelled")).select("column_name", "issue")


QUALITY_ISSUES_SQL = f"WITH t AS ({LABELLED_SQL}) " + _union_sql([
    f"SELECT * FROM (SELECT '{c}' AS column_name, CASE WHEN count({c}) = 0 THEN 'all values are null'"
    f" WHEN 100.0 * (count(*) - count({c})) / count(*) >= 50 THEN 'mostly null' END AS issue FROM t) WHERE issue IS NOT NULL"
    f" UNION ALL SELECT * FROM (SELECT '{c}', CASE WHEN count(DISTINCT {c}) = 1 AND count(*) > 1 THEN 'one value only' END AS issue FROM t) WHERE issue IS NOT NULL"
    for c in LABELLED_COLUMNS
])


def freshness(spark: SparkSession, sf: str) -> DataFrame:
    """Freshness of each event type at the time of the newest event, over a thirty-day horizon."""
    log = data.table(spark, sf, "events")
    newest = log.agg(F.max("ts")).scalar()
    last = log.groupBy("event_type").agg(F.max("ts").alias("last_change"))
    score = quality.freshness(F.col("last_change"), newest)
    return last.select("event_type", F.round(score, 6).alias("freshness_score"), quality.status(score).alias("status"))


FRESHNESS_SQL = """
    WITH n AS (SELECT max(ts) AS newest FROM events),
         s AS (SELECT event_type, greatest(0.0, least(1.0, 1.0 - (epoch_us((SELECT newest FROM n)) - epoch_us(max(ts))) / 86400000000.0 / 30.0)) AS score
               FROM events GROUP BY event_type)
    SELECT event_type, round(score, 6) AS freshness_score, CASE WHEN score >= 0.95 THEN 'GOOD' WHEN score >= 0.8 THEN 'FAIR' ELSE 'POOR' END AS status FROM s
"""


# --- usage --------------------------------------------------------------------------------------


def usage_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = usage.usage(data.table(spark, sf, "events"), "event_type", "ts", "user_id", "value", days=30)
    return rows.select("event_type", "query_count", "active_users", F.round("avg_query_time", 4).alias("avg_query_time"))


USAGE_SQL = """
    SELECT event_type, count(*) AS query_count, count(DISTINCT user_id) AS active_users, round(avg(value), 4) AS avg_query_time
    FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY GROUP BY event_type
"""


def recent_activity(spark: SparkSession, sf: str) -> DataFrame:
    return usage.recent_queries(data.table(spark, sf, "events"), "event_type", "ts", "event_id").select("event_type", "rank", "event_id", "user_id")


RECENT_SQL = """
    SELECT event_type, rank, event_id, user_id FROM
      (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rank FROM events) WHERE rank <= 10
"""


def busiest_users(spark: SparkSession, sf: str) -> DataFrame:
    return usage.active_users(data.table(spark, sf, "events"), "event_type", "user_id")


BUSIEST_SQL = """
    SELECT event_type, user_id, query_count, rank FROM
      (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY query_count DESC, user_id) AS rank FROM
        (SELECT event_type, user_id, count(*) AS query_count FROM events GROUP BY ALL)) WHERE rank <= 10
"""


def update_frequency(spark: SparkSession, sf: str) -> DataFrame:
    rows = usage.update_frequency(data.table(spark, sf, "events"), "user_id", "ts")
    return rows.select("user_id", "changes", F.round("update_frequency_hours", 4).alias("update_frequency_hours"))


UPDATE_FREQUENCY_SQL = """
    WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
    SELECT user_id, count(*) AS changes, round(avg(gap) / 3600000000.0, 4) AS update_frequency_hours FROM g GROUP BY user_id
"""


def volatility(spark: SparkSession, sf: str) -> DataFrame:
    """Volatility and cache lifetime: per user a table, per event type a partitioned table, per hour a view."""
    log = data.table(spark, sf, "events")
    by_user = usage.update_frequency(log, "user_id", "ts").select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("asset"), F.lit("TABLE").alias("asset_type"),
        F.lit(False).alias("partitioned"), "update_frequency_hours",
    )
    by_type = usage.update_frequency(log, "event_type", "ts").select(
        F.col("event_type").alias("asset"), F.when(F.col("event_type") == "view", "VIEW").otherwise("TABLE"),
        F.col("event_type") == "purchase", "update_frequency_hours",
    )
    both = by_user.union(by_type)
    kind = usage.volatility(F.col("asset_type"), F.col("partitioned"), F.col("update_frequency_hours"))
    return both.select("asset", kind.alias("volatility"), usage.cache_ttl(kind).alias("cache_ttl"))


VOLATILITY_SQL = """
    WITH a AS (
      SELECT 'user_' || user_id AS asset, 'TABLE' AS asset_type, false AS partitioned, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0 / (count(*) - 1) AS hours
      FROM events GROUP BY user_id
      UNION ALL SELECT event_type, CASE WHEN event_type = 'view' THEN 'VIEW' ELSE 'TABLE' END, event_type = 'purchase',
             (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0 / (count(*) - 1) FROM events GROUP BY event_type),
    v AS (SELECT asset, CASE WHEN asset_type = 'VIEW' THEN 'low' WHEN partitioned THEN 'medium' WHEN hours < 1 THEN 'high' WHEN hours < 24 THEN 'medium' ELSE 'low' END AS volatility FROM a)
    SELECT asset, volatility, CASE volatility WHEN 'low' THEN '7d' WHEN 'medium' THEN '24h' ELSE '1h' END AS cache_ttl FROM v
"""


def stale_assets(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as assets: last order is the last touch, stale when a year older than the newest order."""
    orders = data.table(spark, sf, "orders")
    newest = orders.agg(F.max("o_orderdate")).scalar()
    last = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_accessed"))
    return usage.stale(last, "last_accessed", newest, 365).select("o_custkey")


STALE_SQL = """
    SELECT o_custkey FROM orders GROUP BY o_custkey HAVING max(o_orderdate) < (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY
"""


# --- documents ----------------------------------------------------------------------------------


def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as documents: title and readable text out of the HTML."""
    pages = data.table(spark, sf, "pages")
    return pages.select(
        "page_id", docs_io.html_title(F.col("html")).alias("title"),
        F.md5(docs_io.html_text(F.col("html"))).alias("text_md5"), F.length(docs_io.html_text(F.col("html"))).cast("bigint").alias("text_length"),
    )


def _unescape_sql(expr: str) -> str:
    for entity, char in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "''''"), ("&amp;", "'&'")):
        expr = f"replace({expr}, '{entity}', {char})"
    return expr


_BARE = (
    "regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<title[^>]*>.*?</title>', ' ', 'g')"
)
_TAGLESS = f"regexp_replace({_BARE}, '<[^>]*>', ' ', 'g')"
_PAGE_TEXT = f"trim(regexp_replace({_unescape_sql(_TAGLESS)}, '\\s+', ' ', 'g'))"
_PAGE_TITLE = _unescape_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
PAGE_TEXTS_SQL = f"""
    SELECT page_id, nullif({_PAGE_TITLE}, '') AS title, md5({_PAGE_TEXT}) AS text_md5, length({_PAGE_TEXT}) AS text_length FROM pages
"""


def document_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the reason they would be refused; texts are joined up per source to reach the size limit."""
    docs = data.table(spark, sf, "documents")
    prepared = docs.select(
        "doc_id", F.when(F.col("lang") == "de", F.lit(" \n")).when(F.col("n_chars") > 10_000, F.repeat("text", F.lit(12))).otherwise(F.col("text")).alias("text"),
        F.when(F.col("lang") == "es", F.lit("not a time")).when(F.col("lang") == "fr", F.lit("2024-01-01T00:00:00Z")).alias("created"),
    )
    checked = quality.check_documents(prepared, "text", ["created"])
    return checked.groupBy(F.coalesce("reject_reason", F.lit("sound")).alias("reject_reason")).agg(F.count(F.lit(1)).alias("n_documents"))


DOCUMENT_CHECKS_SQL = """
    SELECT CASE WHEN lang = 'de' THEN 'empty text' WHEN n_chars > 10000 AND length(text) * 12 > 100000 THEN 'text too long'
                WHEN lang = 'es' THEN 'created is no timestamp' ELSE 'sound' END AS reject_reason, count(*) AS n_documents
    FROM documents GROUP BY 1
"""

QUERIES = {
    "estate_profile": (estate_profile, None),
    "profile_nulls": (profile_nulls, PROFILE_NULLS_SQL),
    "profile_numeric": (profile_numeric, PROFILE_NUMERIC_SQL),
    "profile_string": (profile_string, PROFILE_STRING_SQL),
    "profile_other": (profile_other, PROFILE_OTHER_SQL),
    "profile_quartiles": (profile_quartiles, PROFILE_QUARTILES_SQL),
    "profile_approx_distinct": (profile_approx_distinct, None),
    "profile_exact_distinct": (profile_exact_distinct, PROFILE_EXACT_DISTINCT_SQL),
    "profile_counts": (profile_counts, PROFILE_COUNTS_SQL),
    "profile_ratios": (profile_ratios, PROFILE_RATIOS_SQL),
    "profile_filtered": (profile_filtered, PROFILE_FILTERED_SQL),
    "profile_sampled": (profile_sampled, None),
    "profile_key_sample": (profile_key_sample, PROFILE_KEY_SAMPLE_SQL),
    "profile_reused": (profile_reused, PROFILE_REUSED_SQL),
    "profile_incremental": (profile_incremental, PROFILE_INCREMENTAL_SQL),
    "most_null_columns": (most_null_columns, MOST_NULL_SQL),
    "first_numeric_columns": (first_numeric_columns, FIRST_NUMERIC_SQL),
    "sample_rows": (inspect_sample_rows, SAMPLE_ROWS_SQL),
    "table_inventory": (table_inventory, TABLE_INVENTORY_SQL),
    "table_files": (table_files, None),
    "top_values": (top_values, TOP_VALUES_SQL),
    "top_values_sketch": (top_values_sketch, None),
    "sample_values": (sample_values, SAMPLE_VALUES_SQL),
    "string_patterns": (string_patterns, STRING_PATTERNS_SQL),
    "sensitive_columns": (sensitive_columns, SENSITIVE_COLUMNS_SQL),
    "sensitive_tables": (sensitive_tables, SENSITIVE_TABLES_SQL),
    "sensitive_values": (sensitive_values, SENSITIVE_VALUES_SQL),
    "findings_pii": (findings_pii, FINDINGS_PII_SQL),
    "completeness": (completeness, COMPLETENESS_SQL),
    "quality_status": (quality_status, None),
    "quality_issues": (quality_issues, QUALITY_ISSUES_SQL),
    "freshness": (freshness, FRESHNESS_SQL),
    "usage_30d": (usage_window, USAGE_SQL),
    "recent_activity": (recent_activity, RECENT_SQL),
    "busiest_users": (busiest_users, BUSIEST_SQL),
    "update_frequency": (update_frequency, UPDATE_FREQUENCY_SQL),
    "volatility": (volatility, VOLATILITY_SQL),
    "stale_assets": (stale_assets, STALE_SQL),
    "page_texts": (page_texts, PAGE_TEXTS_SQL),
    "document_checks": (document_checks, DOCUMENT_CHECKS_SQL),
}
