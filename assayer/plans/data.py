"""The tables a folder holds, as assets and as the frames the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.functions.cost import query_cost, storage_cost, total_cost
from assayer.functions.fixed import INFO_TYPES
from assayer.operators.classify import has_info_type
from assayer.sources.tables import Asset

PROJECT = "lake"
DATASETS = {
    "sales": ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"],
    "web": ["events", "pages"],
    "text": ["documents", "labels", "benchmark", "conversations"],
    "vectors": ["embeddings"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assets(sf_dir: str) -> list[Asset]:
    return [
        Asset(PROJECT, dataset, name, path=f"{sf_dir}/{name}.parquet")
        for dataset, names in DATASETS.items() for name in names
    ]


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Every table under its three-part name."""
    return {a.id: a.read(spark) for a in assets(sf_dir)}


# --- documents as a large catalog: one asset per document ---------------------------------------

EMAIL = INFO_TYPES["EMAIL_ADDRESS"]

DOCUMENT_ASSETS_SQL = f"""
    SELECT d.lang || '.' || d.source || '.doc_' || d.doc_id AS id,
           d.lang AS project_id, d.source AS dataset_id, 'doc_' || d.doc_id AS table_id,
           CASE WHEN l.doc_id IS NULL THEN 'VIEW' ELSE 'TABLE' END AS table_type,
           d.n_chars AS row_count, d.n_chars * 1000000 AS size_bytes,
           1 + length(d.text) - length(replace(d.text, chr(10), '')) AS column_count,
           regexp_matches(d.text, '{EMAIL}') AS has_pii,
           coalesce(l.toxic = 1, false) AS has_phi,
           CASE l.quality WHEN 1 THEN 'prod' WHEN 0 THEN 'dev' ELSE 'unknown' END AS environment,
           'team_' || d.lang AS team,
           d.n_chars / (d.n_chars + 100.0) AS completeness_score,
           make_timestamp((1700000000 + d.n_chars * 600) * 1000000) AS last_modified,
           round(d.n_chars * 1000000 / 1073741824.0 * 0.020, 2) AS storage_cost_usd,
           round(d.n_chars * 1000000 / 1099511627776.0 * 6.25 * 4, 2) AS query_cost_usd,
           round(d.n_chars * 1000000 / 1073741824.0 * 0.020 + d.n_chars * 1000000 / 1099511627776.0 * 6.25 * 4, 2) AS monthly_cost_usd,
           d.text AS text
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


def document_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one asset: language is the project, source the dataset, a megabyte per character its size."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    size = F.col("n_chars") * 1_000_000
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    joined = docs.join(labels.withColumn("_labelled", F.lit(True)), "doc_id", "left")
    return joined.select(
        F.concat_ws(".", "lang", "source", name).alias("id"),
        F.col("lang").alias("project_id"),
        F.col("source").alias("dataset_id"),
        name.alias("table_id"),
        F.when(F.col("_labelled"), "TABLE").otherwise("VIEW").alias("table_type"),
        F.col("n_chars").alias("row_count"),
        size.alias("size_bytes"),
        (1 + F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("bigint").alias("column_count"),
        has_info_type("text", {"EMAIL_ADDRESS": EMAIL}).alias("has_pii"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("has_phi"),
        F.when(F.col("quality") == 1, "prod").when(F.col("quality") == 0, "dev").otherwise("unknown").alias("environment"),
        F.concat(F.lit("team_"), "lang").alias("team"),
        (F.col("n_chars") / (F.col("n_chars") + 100.0)).alias("completeness_score"),
        F.timestamp_seconds(1_700_000_000 + F.col("n_chars") * 600).alias("last_modified"),
        storage_cost(size).alias("storage_cost_usd"),
        query_cost(size).alias("query_cost_usd"),
        total_cost(size).alias("monthly_cost_usd"),
        "text",
    )


# --- query texts out of the event log, and records as a graph ------------------------------------

VIEWS_SQL = """
    SELECT 'lake.views.v_' || event_id AS view_ref, 'lake' AS project_id, 'views' AS dataset_id, 'v_' || event_id AS view_id,
           'SELECT u.user_id, e.value, ''FROM x.y'' AS note FROM `lake.raw.' || event_type || '` e JOIN users.u' || user_id
           || ' u ON e.user_id = u.user_id -- FROM old.' || event_type AS view_query
    FROM events
"""

VIEW_TABLES_SQL = """
    SELECT DISTINCT 'lake.raw.' || event_type AS table_ref, 'raw' AS dataset_id, event_type AS table_id FROM events
    UNION ALL SELECT DISTINCT 'lake.users.u' || user_id, 'users', 'u' || user_id FROM events
"""


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One view definition per event: it reads the raw table of the event type and the table of the user."""
    number, user, kind = F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("event_type")
    query = F.concat(
        F.lit("SELECT u.user_id, e.value, 'FROM x.y' AS note FROM `lake.raw."), kind, F.lit("` e JOIN users.u"), user,
        F.lit(" u ON e.user_id = u.user_id -- FROM old."), kind,
    )
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("lake.views.v_"), number).alias("view_ref"), F.lit("lake").alias("project_id"),
        F.lit("views").alias("dataset_id"), F.concat(F.lit("v_"), number).alias("view_id"), query.alias("view_query"),
    )


def view_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables those views read."""
    log = table(spark, sf_dir, "events")
    raw = log.select(F.lit("raw").alias("dataset_id"), F.col("event_type").alias("table_id")).distinct()
    users = log.select(F.lit("users").alias("dataset_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("table_id")).distinct()
    return raw.union(users).select(F.concat_ws(".", F.lit("lake"), "dataset_id", "table_id").alias("table_ref"), "dataset_id", "table_id")


RECORD_EDGES_SQL = """
    SELECT 'region:' || n_regionkey AS source, 'nation:' || n_nationkey AS target, 'reference' AS edge_type FROM nation
    UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'reference' FROM customer
    UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'reference' FROM supplier
    UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'reference' FROM orders
    UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'data_flow' FROM lineitem
    UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'data_flow' FROM lineitem
"""


def record_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as a graph: regions feed nations, nations customers and suppliers, those orders and parts."""
    def node(kind: str, key: str):
        return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))

    def edges(name: str, source: tuple, target: tuple, kind: str, distinct: bool = False) -> DataFrame:
        rows = table(spark, sf_dir, name).select(source[1], target[1])
        rows = rows.distinct() if distinct else rows
        return rows.select(node(*source).alias("source"), node(*target).alias("target"), F.lit(kind).alias("edge_type"))

    return (
        edges("nation", ("region", "n_regionkey"), ("nation", "n_nationkey"), "reference")
        .union(edges("customer", ("nation", "c_nationkey"), ("customer", "c_custkey"), "reference"))
        .union(edges("supplier", ("nation", "s_nationkey"), ("supplier", "s_suppkey"), "reference"))
        .union(edges("orders", ("customer", "o_custkey"), ("order", "o_orderkey"), "reference"))
        .union(edges("lineitem", ("order", "l_orderkey"), ("part", "l_partkey"), "data_flow", distinct=True))
        .union(edges("lineitem", ("supplier", "l_suppkey"), ("part", "l_partkey"), "data_flow", distinct=True))
    )
