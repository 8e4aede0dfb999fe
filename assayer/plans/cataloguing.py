"""Catalog queries: selection, storage, versions, diffs, rollups, lineage and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayer import schemas
from assayer.functions import cost, display, naming
from assayer.operators import bucketed, catalog, classify, collection, frequencies, lineage, quality, report, selection
from assayer.operators.profile import ProfileOptions, profile_tables
from assayer.operators.usage import cache_ttl, volatility
from assayer.plans import data, profiling
from assayer.session import cut_lineage, scratch_path
from assayer.sources import documents as docs_io
from assayer.sources.tables import Asset, columns_frame, file_facts, table_metadata, union_all

DOCS = data.DOCUMENT_ASSETS_SQL
RUN = "2024-02-01 00:00:00"


# --- selection ----------------------------------------------------------------------------------


def dataset_exclude(spark: SparkSession, sf: str) -> DataFrame:
    """Document assets outside excluded datasets, without views."""
    docs = data.document_assets(spark, sf)
    kept = selection.select_assets(docs, include_views=False, patterns=["src1", "_staging"])
    return kept.groupBy("project_id", "dataset_id").agg(F.count(F.lit(1)).alias("n_assets"))


DATASET_EXCLUDE_SQL = f"""
    SELECT project_id, dataset_id, count(*) AS n_assets FROM ({DOCS})
    WHERE NOT contains(dataset_id, 'src1') AND NOT contains(dataset_id, '_staging') AND table_type <> 'VIEW' GROUP BY ALL
"""


def table_cap(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred assets in name order: the cap a run may set."""
    return selection.select_assets(data.document_assets(spark, sf), patterns=[], max_tables=100).select("id", "table_type")


TABLE_CAP_SQL = f"SELECT id, table_type FROM ({DOCS}) ORDER BY project_id, dataset_id, table_id LIMIT 100"


def label_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Skip decision per document: its own label where present, else the label of its source."""
    docs = data.table(spark, sf, "documents").select("doc_id", F.col("source").alias("dataset_id"))
    labels = data.table(spark, sf, "labels")
    own = F.when(
        F.col("toxic").isNotNull(),
        F.create_map(F.lit("skip-scan"), F.when(F.col("toxic") == 1, "TRUE").when(F.col("quality") == 1, "false").otherwise("maybe")),
    )
    tables = docs.join(labels, "doc_id", "left").withColumn("labels", own)
    sources = docs.select("dataset_id").distinct().withColumn(
        "labels", F.when(F.col("dataset_id").endswith("1"), F.create_map(F.lit("skip-scan"), F.lit("True")))
        .when(F.col("dataset_id").endswith("2"), F.create_map(F.lit("other"), F.lit("true")))
    )
    decided = selection.with_label_decision(tables, sources, "skip-scan", ["dataset_id"])
    return decided.select("doc_id", "skip")


LABEL_FILTER_SQL = """
    SELECT d.doc_id, coalesce(CASE WHEN l.doc_id IS NOT NULL THEN l.toxic = 1 END, CASE WHEN d.source LIKE '%1' THEN true END, false) AS skip
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


def run_statistics(spark: SparkSession, sf: str) -> DataFrame:
    docs = data.document_assets(spark, sf)
    outcome = F.when(F.col("has_phi"), "filtered").when(F.length("text") == 0, "error").otherwise("formatted")
    return selection.run_statistics(docs.select(
        "project_id", "dataset_id", outcome.alias("outcome"), (F.col("environment") == "unknown").alias("description_generated")
    ))


RUN_STATISTICS_SQL = f"""
    SELECT count(DISTINCT project_id) AS projects_scanned, count(DISTINCT (project_id, dataset_id)) AS datasets_scanned,
           count(*) FILTER (WHERE NOT has_phi) AS tables_scanned, count(*) FILTER (WHERE NOT has_phi AND length(text) > 0) AS tables_formatted,
           count(*) FILTER (WHERE has_phi) AS tables_filtered_by_label, count(*) FILTER (WHERE NOT has_phi AND length(text) = 0) AS errors,
           count(*) FILTER (WHERE environment = 'unknown') AS descriptions_generated
    FROM ({DOCS})
"""


def asset_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names, types and scan ids of every document asset."""
    docs = data.document_assets(spark, sf)
    project, dataset, table = F.col("project_id"), F.col("dataset_id"), F.col("table_id")
    fqn = naming.table_fqn("spark", project, dataset, table)
    return docs.select(
        "id", fqn.alias("fqn"), naming.strip_scheme(fqn).alias("plain"),
        naming.file_fqn("s3", project, F.concat(F.lit("//"), dataset, F.lit("/"), table, F.lit(".md"))).alias("report_fqn"),
        naming.scan_id(dataset, table).alias("scan_id"), naming.document_key(F.col("id")).alias("document_key"),
        naming.asset_type(F.when(F.col("has_phi"), "EXTERNAL").otherwise(F.col("table_type"))).alias("asset_type"),
        naming.table_type_or_default(F.when(F.col("has_pii"), "").otherwise(F.lit(None)), F.nullif("table_type", F.lit("TABLE"))).alias("table_type"),
    )


ASSET_NAMES_SQL = f"""
    SELECT id, 'spark:' || id AS fqn, id AS plain, 's3://' || project_id || '/' || dataset_id || '/' || table_id || '.md' AS report_fqn,
           lower(replace('profile-' || dataset_id || '-' || table_id, '_', '-')) AS scan_id, replace(id, '.', '_') AS document_key,
           CASE WHEN has_phi THEN 'TABLE' ELSE table_type END AS asset_type, table_type
    FROM ({DOCS})
"""


# --- versions -----------------------------------------------------------------------------------


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as catalog rows; the month of the order is the run that found them."""
    return data.table(spark, sf, "orders").withColumn("run_timestamp", F.date_trunc("month", "o_orderdate").cast("timestamp"))


def latest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.latest(_runs(spark, sf)).select("o_orderkey", "o_custkey", "o_totalprice")


LATEST_SNAPSHOT_SQL = """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE date_trunc('month', o_orderdate) = (SELECT max(date_trunc('month', o_orderdate)) FROM orders)
"""


def asof_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.latest(_runs(spark, sf), as_of=F.lit("1996-07-15").cast("timestamp")).select("o_orderkey", "o_custkey", "o_totalprice")


ASOF_SNAPSHOT_SQL = """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE date_trunc('month', o_orderdate) = (SELECT max(date_trunc('month', o_orderdate)) FROM orders WHERE date_trunc('month', o_orderdate) <= TIMESTAMP '1996-07-15')
"""


def latest_per_asset(spark: SparkSession, sf: str) -> DataFrame:
    """The newest order of every customer."""
    orders = data.table(spark, sf, "orders")
    return catalog.latest_per_key(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


LATEST_PER_ASSET_SQL = """
    SELECT o_custkey, o_orderkey, o_totalprice FROM
      (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1
"""


def _order_documents(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Stored documents (one per order up to 1997) and incoming ones (one per line item of orders from 1996 on)."""
    orders = data.table(spark, sf, "orders").withColumn("id", F.concat(F.lit("order."), F.col("o_orderkey").cast("string")))
    stored = orders.filter("o_orderdate < timestamp'1998-01-01'").select("id", F.col("o_totalprice").alias("amount"), F.lit(0).alias("version"))
    lines = data.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    recent = orders.filter("o_orderdate >= timestamp'1996-01-01'").select("id", F.col("o_orderkey").alias("l_orderkey"))
    incoming = lines.join(recent, "l_orderkey").select("id", F.col("l_extendedprice").alias("amount"), F.col("l_linenumber").alias("version"))
    return stored, incoming


_ORDER_DOCS_SQL = """
    stored AS (SELECT 'order.' || o_orderkey AS id, o_totalprice AS amount, 0 AS version FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
    incoming AS (SELECT 'order.' || o_orderkey AS id, l_extendedprice AS amount, l_linenumber AS version
                 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1996-01-01'),
    fresh AS (SELECT id, amount, version FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, amount DESC) AS r FROM incoming) WHERE r = 1)
"""


def _newest() -> list[Column]:
    return [F.desc("version"), F.desc("amount")]


def upsert_documents(spark: SparkSession, sf: str) -> DataFrame:
    stored, incoming = _order_documents(spark, sf)
    return catalog.upsert(stored, incoming, "id", _newest())


UPSERT_SQL = f"WITH {_ORDER_DOCS_SQL} SELECT * FROM stored WHERE id NOT IN (SELECT id FROM fresh) UNION ALL SELECT * FROM fresh"


def upsert_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """The same documents kept in buckets: loaded, upserted, compacted where much changed, and those of urgent orders deleted."""
    stored, incoming = _order_documents(spark, sf)
    path = scratch_path(spark, "documents")
    bucketed.load(stored, "id", path, _newest())
    bucketed.upsert(incoming, path, _newest())
    bucketed.compact(spark, path)
    urgent = data.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    bucketed.delete(urgent.select(F.concat(F.lit("order."), F.col("o_orderkey").cast("string")).alias("id")), path)
    return bucketed.read(spark, path)


UPSERT_BUCKETS_SQL = f"""
    WITH {_ORDER_DOCS_SQL}, kept AS (SELECT * FROM stored WHERE id NOT IN (SELECT id FROM fresh) UNION ALL SELECT * FROM fresh)
    SELECT * FROM kept WHERE id NOT IN (SELECT 'order.' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
"""


def upsert_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.upsert_outcome(*_order_documents(spark, sf), "id").groupBy("outcome").agg(F.count(F.lit(1)).alias("n_documents"))


UPSERT_OUTCOME_SQL = f"""
    WITH {_ORDER_DOCS_SQL} SELECT CASE WHEN id IN (SELECT id FROM stored) THEN 'updated' ELSE 'created' END AS outcome, count(*) AS n_documents
    FROM fresh GROUP BY 1
"""


def reconcile_full(spark: SparkSession, sf: str) -> DataFrame:
    stored, incoming = _order_documents(spark, sf)
    return catalog.reconcile(stored, incoming, "id", _newest(), "FULL")


RECONCILE_FULL_SQL = f"WITH {_ORDER_DOCS_SQL} SELECT * FROM fresh"


def delete_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without those labelled toxic or of low quality."""
    ids = data.table(spark, sf, "labels").filter("toxic = 1 OR quality = 0")
    return catalog.delete(data.table(spark, sf, "documents"), ids, "doc_id").select("doc_id", "lang", "n_chars")


DELETE_SQL = """
    SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0)
"""


def id_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Part names used as ids, dotted for small parts and underscored for large ones."""
    dotted = F.replace("p_name", F.lit(" "), F.lit("."))
    ids = data.table(spark, sf, "part").select(F.when(F.col("p_size") > 25, dotted).otherwise(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("id"))
    return catalog.id_collisions(ids)


ID_COLLISIONS_SQL = """
    WITH i AS (SELECT DISTINCT CASE WHEN p_size > 25 THEN replace(p_name, ' ', '.') ELSE replace(p_name, ' ', '_') END AS id FROM part)
    SELECT replace(id, '.', '_') AS document_key, count(*) AS n_ids, min(id) AS first_id, max(id) AS last_id FROM i GROUP BY 1 HAVING count(*) > 1
"""


def diff_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Customers between two runs: their order count and spend up to 1997 against up to 1998."""
    orders = data.table(spark, sf, "orders")

    def run(until: str) -> DataFrame:
        return orders.filter(F.col("o_orderdate") < F.lit(until).cast("timestamp")).groupBy("o_custkey").agg(
            F.count(F.lit(1)).alias("row_count"), F.max("o_orderstatus").alias("table_type"), F.max("o_totalprice").alias("size_bytes")
        )

    return catalog.diff(run("1993-01-01"), run("1996-01-01"), ["o_custkey"], ["row_count", "table_type", "size_bytes"])


def _run_sql(until: str) -> str:
    return (f"SELECT o_custkey, count(*) AS row_count, max(o_orderstatus) AS table_type, max(o_totalprice) AS size_bytes"
            f" FROM orders WHERE o_orderdate < TIMESTAMP '{until}' GROUP BY o_custkey")


DIFF_RUNS_SQL = f"""
    WITH a AS ({_run_sql('1993-01-01')}), b AS ({_run_sql('1996-01-01')}),
    j AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.o_custkey AS ak, b.o_custkey AS bk,
            concat_ws(',', CASE WHEN a.row_count IS DISTINCT FROM b.row_count THEN 'row_count' END,
                           CASE WHEN a.table_type IS DISTINCT FROM b.table_type THEN 'table_type' END,
                           CASE WHEN a.size_bytes IS DISTINCT FROM b.size_bytes THEN 'size_bytes' END) AS changed
          FROM a FULL JOIN b ON a.o_custkey = b.o_custkey)
    SELECT o_custkey, CASE WHEN ak IS NULL THEN 'added' WHEN bk IS NULL THEN 'removed' ELSE 'changed' END AS change,
           CASE WHEN ak IS NOT NULL AND bk IS NOT NULL THEN changed END AS changed_columns
    FROM j WHERE ak IS NULL OR bk IS NULL OR changed <> ''
"""


def ingest_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome counts of reading documents as JSON lines, some cut off, some without an id, some blank, some known."""
    docs = data.table(spark, sf, "documents").join(data.table(spark, sf, "labels"), "doc_id", "left")
    line = F.to_json(F.struct(
        F.when(F.col("lang") != "es", F.concat_ws(".", "source", "lang")).alias("id"),
        F.struct(F.col("source").alias("dataset_id"), F.col("n_chars").alias("row_count")).alias("structData"),
        F.struct(F.lit("text/plain").alias("mime_type"), "text").alias("content"),
    ))
    cut = F.when(F.col("toxic") == 1, F.substr(line, F.lit(1), F.length(line) - 2)).when(F.col("quality") == 0, F.lit("  ")).otherwise(line)
    parsed = docs_io.parse_lines(docs.select(cut.alias("value")))
    known = data.table(spark, sf, "documents").filter("lang = 'de'").select(F.concat_ws(".", "source", "lang").alias("id"))
    return docs_io.ingest_summary(parsed, known)


INGEST_OUTCOME_SQL = """
    WITH l AS (SELECT CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 0 THEN 'blank' WHEN lang = 'es' THEN 'no id' ELSE 'ok' END AS state,
                      source || '.' || lang AS id, lang
               FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id),
         v AS (SELECT id, any_value(lang) AS lang, count(*) AS n FROM l WHERE state = 'ok' GROUP BY id),
         c AS (SELECT count(*) FILTER (WHERE id NOT IN (SELECT source || '.' || lang FROM documents WHERE lang = 'de')) AS created, CAST(sum(n) AS BIGINT) AS valid FROM v)
    SELECT (SELECT count(*) FROM l WHERE state <> 'blank') AS total, created, valid - created AS updated,
           (SELECT count(*) FROM l WHERE state = 'failed') AS failed, (SELECT count(*) FROM l WHERE state = 'no id') AS skipped FROM c
"""


# --- rollups ------------------------------------------------------------------------------------


def dataset_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.dataset_rollup(data.document_assets(spark, sf))
    return rows.withColumn("total_cost", F.round("total_cost", 2))


DATASET_ROLLUP_SQL = f"""
    SELECT project_id, dataset_id, count(*) AS table_count, CAST(sum(row_count) AS BIGINT) AS total_rows, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes,
           round(sum(monthly_cost_usd), 2) AS total_cost, bool_or(has_pii) AS has_pii, bool_or(has_phi) AS has_phi
    FROM ({DOCS}) GROUP BY ALL
"""


def dataset_tables(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.dataset_tables(data.document_assets(spark, sf))


DATASET_TABLES_SQL = f"SELECT DISTINCT project_id, dataset_id, table_id FROM ({DOCS})"


def cost_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.cost_rollup(data.document_assets(spark, sf))
    return rows.withColumns({c: F.round(c, 2) for c in ("storage_cost_usd", "query_cost_usd", "monthly_cost_usd")})


COST_ROLLUP_SQL = f"""
    SELECT project_id, dataset_id, grouping_id(project_id, dataset_id) AS level, count(*) AS table_count,
           round(sum(storage_cost_usd), 2) AS storage_cost_usd, round(sum(query_cost_usd), 2) AS query_cost_usd, round(sum(monthly_cost_usd), 2) AS monthly_cost_usd
    FROM ({DOCS}) GROUP BY ROLLUP (project_id, dataset_id)
"""


def asset_costs(spark: SparkSession, sf: str) -> DataFrame:
    docs = data.document_assets(spark, sf)
    per_gb = cost.cost_per_gb(F.col("monthly_cost_usd"), F.col("size_bytes"))
    return docs.select("id", "storage_cost_usd", "query_cost_usd", "monthly_cost_usd", F.round(per_gb, 4).alias("cost_per_gb"))


ASSET_COSTS_SQL = f"""
    SELECT id, storage_cost_usd, query_cost_usd, monthly_cost_usd, round(monthly_cost_usd / (size_bytes / 1073741824.0), 4) AS cost_per_gb FROM ({DOCS})
"""


def catalog_health(spark: SparkSession, sf: str) -> DataFrame:
    """Health rules over the document catalog, with some broken rows: unknown teams, odd types, two runs."""
    docs = data.document_assets(spark, sf).select(
        "project_id", "dataset_id", "table_id", F.when(F.col("environment") != "dev", F.col("team")).alias("team"),
        F.when(F.col("has_phi"), "FOLDER").otherwise(F.col("table_type")).alias("table_type"),
        "row_count", "column_count", (F.col("size_bytes") - 100_000_000).alias("size_bytes"),
        F.date_trunc("year", "last_modified").alias("run_timestamp"),
    )
    return quality.health_checks(docs, ["project_id", "dataset_id", "table_id", "team"], ["TABLE", "VIEW", "MATERIALIZED_VIEW"])


CATALOG_HEALTH_SQL = f"""
    WITH d AS ({DOCS}), n AS (SELECT count(*) AS records FROM d)
    SELECT records, rule, violations, violations = 0 AS passed FROM n CROSS JOIN (
      SELECT 'project_id is set' AS rule, count(*) FILTER (WHERE project_id IS NULL) AS violations FROM d
      UNION ALL SELECT 'dataset_id is set', count(*) FILTER (WHERE dataset_id IS NULL) FROM d
      UNION ALL SELECT 'table_id is set', count(*) FILTER (WHERE table_id IS NULL) FROM d
      UNION ALL SELECT 'team is set', count(*) FILTER (WHERE environment = 'dev') FROM d
      UNION ALL SELECT 'table_type is known', count(*) FILTER (WHERE has_phi) FROM d
      UNION ALL SELECT 'counts are not negative', count(*) FILTER (WHERE size_bytes < 100000000) FROM d
      UNION ALL SELECT 'one run timestamp', CAST(count(DISTINCT date_trunc('year', last_modified)) > 1 AS BIGINT) FROM d)
"""


# --- lineage ------------------------------------------------------------------------------------


def extract_refs(spark: SparkSession, sf: str) -> DataFrame:
    """Table references in every view text: quoted and unquoted, not those in comments or strings."""
    return lineage.extract_refs(data.views(spark, sf))


EXTRACT_REFS_SQL = f"""
    WITH c AS (SELECT view_ref, regexp_replace(view_query, '--[^\\n]*|/\\*(?s:.*?)\\*/|''[^'']*''', ' ', 'g') AS code FROM ({data.VIEWS_SQL})),
    r AS (SELECT view_ref, unnest(regexp_extract_all(code, '`([^`.]+\\.[^`.]+\\.[^`.]+)`', 1)) AS table_ref FROM c
          UNION SELECT view_ref, 'lake.' || unnest(regexp_extract_all(code, '(?i)\\b(?:FROM|JOIN)\\s+([A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+)', 1)) FROM c)
    SELECT view_ref, table_ref FROM r
"""


def view_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.view_dependencies(data.views(spark, sf), data.view_tables(spark, sf))


VIEW_DEPENDENCIES_SQL = """
    SELECT 'lake.raw.' || event_type AS source, 'lake.views.v_' || event_id AS target, 'view' AS edge_type FROM events
    UNION ALL SELECT 'lake.users.u' || user_id, 'lake.views.v_' || event_id, 'view' FROM events
"""


def lineage_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The whole neighbourhood of every asset in parts: raw tables with thousands of views among them."""
    edges = lineage.view_dependencies(data.views(spark, sf), data.view_tables(spark, sf))
    parts = catalog.lineage_neighbours(edges, 100)
    return catalog.neighbourhood_digests(parts).select("table_ref", "direction", F.col("n").alias("n_names"), "total", F.col("digest").alias("names_md5"))


LINEAGE_NEIGHBOURS_SQL = f"""
    WITH e AS ({VIEW_DEPENDENCIES_SQL}),
    n AS (SELECT target AS table_ref, 'upstream' AS direction, source AS name FROM e UNION ALL SELECT source, 'downstream', target FROM e)
    SELECT table_ref, direction, count(*) AS n_names, count(*) AS total, md5(string_agg(name, ',' ORDER BY name)) AS names_md5 FROM n GROUP BY ALL
"""


def view_dependencies_substring(spark: SparkSession, sf: str) -> DataFrame:
    """Views per table when any occurrence of ``dataset.table`` in the text counts, also inside longer names."""
    found = lineage.view_dependencies_by_substring(data.views(spark, sf), data.view_tables(spark, sf))
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n_views"))


VIEW_SUBSTRING_SQL = f"""
    WITH t AS ({data.VIEW_TABLES_SQL}), v AS ({data.VIEWS_SQL})
    SELECT t.table_ref AS source, count(*) AS n_views FROM t JOIN v ON contains(lower(v.view_query), lower(t.dataset_id || '.' || t.table_id)) GROUP BY 1
"""


def clean_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges from two sources, with and without scheme, file and report targets and self links among them."""
    docs = data.table(spark, sf, "pages").select("page_id", "url", F.explode(docs_io.html_links(F.col("html"))).alias("link"))
    host = F.regexp_extract("url", r"://([^/]+)", 1)
    api = docs.select(F.concat(F.lit("web:"), host).alias("source"), F.concat(F.lit("web:"), F.col("link")).alias("target"), F.lit("link").alias("edge_type"))
    views = docs.select(
        host.alias("source"),
        F.when(F.length("link") > 9, F.concat(F.lit("gs://bucket"), F.col("link"))).when(F.length("link") > 7, F.concat(F.col("link"), F.lit(".md")))
        .when(F.length("link") < 4, host).otherwise(F.col("link")).alias("target"),
        F.lit("link").alias("edge_type"),
    )
    return lineage.clean_edges(api.union(views))


CLEAN_EDGES_SQL = """
    WITH d AS (SELECT regexp_extract(url, '://([^/]+)', 1) AS host, unnest(regexp_extract_all(html, '(?i)href=["'']([^"'']*)["'']', 1)) AS link FROM pages),
    e AS (SELECT host AS source, link AS target FROM d
          UNION ALL SELECT host, CASE WHEN length(link) > 9 THEN 'gs://bucket' || link WHEN length(link) > 7 THEN link || '.md' WHEN length(link) < 4 THEN host ELSE link END FROM d)
    SELECT DISTINCT CASE WHEN regexp_matches(source, '^[A-Za-z][A-Za-z0-9+]*:[^/]') THEN regexp_replace(source, '^[A-Za-z][A-Za-z0-9+]*:', '') ELSE source END AS source, target, 'link' AS edge_type
    FROM e WHERE source <> target AND target NOT LIKE 'gs://%' AND target NOT LIKE '%.md'
"""


def reference_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Link targets of pages with the number of hosts that point to them."""
    pages = data.table(spark, sf, "pages").select("url", F.explode(docs_io.html_links(F.col("html"))).alias("target"))
    return pages.select(F.regexp_extract("url", r"://([^/]+)", 1).alias("host"), "target").distinct().groupBy("target").agg(F.count(F.lit(1)).alias("n_hosts"))


REFERENCE_EDGES_SQL = """
    SELECT target, count(DISTINCT host) AS n_hosts FROM
      (SELECT regexp_extract(url, '://([^/]+)', 1) AS host, unnest(regexp_extract_all(html, '(?i)href=["'']([^"'']*)["'']', 1)) AS target FROM pages) GROUP BY target
"""


def _stored_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The edge table, written once as a catalog would keep it: every round of a walk reads it again."""
    return cut_lineage(data.record_edges(spark, sf))


def lineage_downstream(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.reach(_stored_edges(spark, sf), ["region:0"], "downstream", 4).withColumn("depth", F.col("depth").cast("bigint"))


def lineage_upstream(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.reach(_stored_edges(spark, sf), ["part:7"], "upstream", 4).withColumn("depth", F.col("depth").cast("bigint"))


def _reach_sql(root: str, near: str, far: str, depth: int) -> str:
    return f"""
        WITH RECURSIVE e AS ({data.RECORD_EDGES_SQL}), r(node, depth) AS (
          SELECT '{root}', 0 UNION SELECT e.{far}, r.depth + 1 FROM r JOIN e ON e.{near} = r.node WHERE r.depth < {depth})
        SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r WHERE node <> '{root}' GROUP BY node
    """


LINEAGE_DOWNSTREAM_SQL = _reach_sql("region:0", "source", "target", 4)
LINEAGE_UPSTREAM_SQL = _reach_sql("part:7", "target", "source", 4)


def lineage_from_roots(spark: SparkSession, sf: str) -> DataFrame:
    """What every nation feeds, each nation to a depth of its own, in one walk."""
    roots = data.table(spark, sf, "nation").select(
        F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("root"), (1 + F.col("n_nationkey") % 4).alias("max_depth")
    )
    return lineage.reach_from(_stored_edges(spark, sf), roots).withColumn("depth", F.col("depth").cast("bigint"))


LINEAGE_FROM_ROOTS_SQL = f"""
    WITH RECURSIVE e AS ({data.RECORD_EDGES_SQL}), r(root, node, depth, max_depth) AS (
      SELECT 'nation:' || n_nationkey, 'nation:' || n_nationkey, 0, 1 + n_nationkey % 4 FROM nation
      UNION SELECT r.root, e.target, r.depth + 1, r.max_depth FROM r JOIN e ON e.source = r.node WHERE r.depth < r.max_depth)
    SELECT root, node, CAST(min(depth) AS BIGINT) AS depth FROM r WHERE node <> root GROUP BY root, node
"""


def lineage_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of the graph around one customer, both ways, three steps far."""
    nodes, _ = lineage.lineage_graph(_stored_edges(spark, sf), "customer:7", "both", 3)
    return lineage.lineage_totals(nodes).withColumn("max_depth_reached", F.col("max_depth_reached").cast("bigint"))


LINEAGE_TOTALS_SQL = f"""
    WITH u AS ({_reach_sql('customer:7', 'target', 'source', 3)}), d AS ({_reach_sql('customer:7', 'source', 'target', 3)})
    SELECT (SELECT count(*) FROM u) AS total_upstream, (SELECT count(*) FROM d) AS total_downstream,
           greatest((SELECT max(depth) FROM u), (SELECT max(depth) FROM d)) AS max_depth_reached
"""


def lineage_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The edges inside the graph around one supplier."""
    return lineage.lineage_graph(_stored_edges(spark, sf), "supplier:3", "both", 2)[1]


LINEAGE_GRAPH_EDGES_SQL = f"""
    WITH n AS (SELECT node FROM ({_reach_sql('supplier:3', 'target', 'source', 2)}) UNION SELECT node FROM ({_reach_sql('supplier:3', 'source', 'target', 2)}) UNION SELECT 'supplier:3'),
    e AS ({data.RECORD_EDGES_SQL})
    SELECT source, target, edge_type FROM e WHERE source IN (SELECT node FROM n) AND target IN (SELECT node FROM n)
"""


def lineage_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage over customers, orders and parts as the known tables."""
    def named(kind: str, name: str, key: str) -> DataFrame:
        return data.table(spark, sf, name).select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("table_ref"))

    known = named("customer", "customer", "c_custkey").union(named("order", "orders", "o_orderkey")).union(named("part", "part", "p_partkey"))
    return lineage.coverage(known, data.record_edges(spark, sf))


LINEAGE_COVERAGE_SQL = f"""
    WITH e AS ({data.RECORD_EDGES_SQL}),
    t AS (SELECT 'customer:' || c_custkey AS table_ref FROM customer UNION ALL SELECT 'order:' || o_orderkey FROM orders UNION ALL SELECT 'part:' || p_partkey FROM part),
    j AS (SELECT table_ref, u.n AS n_up, d.n AS n_down FROM t LEFT JOIN (SELECT target, count(*) AS n FROM e GROUP BY 1) u ON u.target = table_ref
          LEFT JOIN (SELECT source, count(*) AS n FROM e GROUP BY 1) d ON d.source = table_ref)
    SELECT count(*) AS total_tables, count(n_up) AS tables_with_upstream, count(n_down) AS tables_with_downstream,
           count(*) FILTER (WHERE n_up IS NOT NULL OR n_down IS NOT NULL) AS tables_with_lineage,
           CAST(sum(n_up) AS BIGINT) AS upstream_links, CAST(sum(n_down) AS BIGINT) AS downstream_links,
           round(100.0 * count(*) FILTER (WHERE n_up IS NOT NULL OR n_down IS NOT NULL) / count(*), 2) AS coverage_rate
    FROM j
"""


def lineage_links(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.links_of(data.record_edges(spark, sf), "nation:3")


LINEAGE_LINKS_SQL = f"""
    WITH e AS ({data.RECORD_EDGES_SQL})
    SELECT DISTINCT source AS neighbour, 'upstream' AS direction FROM e WHERE target = 'nation:3'
    UNION ALL SELECT DISTINCT target, 'downstream' FROM e WHERE source = 'nation:3'
"""


def job_events(spark: SparkSession, sf: str) -> DataFrame:
    """The lineage events of a run that read every view's sources."""
    edges = lineage.view_dependencies(data.views(spark, sf), data.view_tables(spark, sf)).withColumn("target", F.lit("lake.catalog.assets"))
    start, end = F.lit(RUN).cast("timestamp"), F.lit("2024-02-01 00:05:00").cast("timestamp")
    return lineage.job_events(edges, "discovery", "collect", start, end, True)


JOB_EVENTS_SQL = f"""
    SELECT 'discovery' AS process, 'discovery/collect/20240201T000000' AS run_id, 'COMPLETED' AS state, TIMESTAMP '{RUN}' AS start_time,
           TIMESTAMP '2024-02-01 00:05:00' AS end_time, table_ref AS source, 'lake.catalog.assets' AS target FROM ({data.VIEW_TABLES_SQL})
"""


# --- catalog rows and reports -------------------------------------------------------------------


# Whole-number columns of the estate, with the key they may be.
_KEYS = [(t, c, c[2:] if c[1] == "_" else c) for t, columns in profiling.ALL_COLUMNS.items() for c in columns if c in profiling.INTEGERS]


def key_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Which table feeds which, from the keys they share."""
    tables = {a.table_id: a.read(spark) for a in data.assets(sf)}
    tables = {t: df.select([c for c, kind in df.dtypes if kind in ("int", "bigint")]) for t, df in tables.items() if t in {k[0] for k in _KEYS}}
    options = ProfileOptions(nulls=False, distribution=False, relative_error=0.01)
    return lineage.key_edges(cut_lineage(profile_tables(tables, options)))  # the profile is read twice


KEY_EDGES_SQL = f"""
    WITH k AS ({profiling._union_sql([f"SELECT '{t}' AS table_id, '{k}' AS key, count(*) AS total_rows, count(DISTINCT {c}) / count(*) AS share FROM {t}" for t, c, k in _KEYS])}),
         h AS (SELECT key, table_id AS source FROM k WHERE share >= 0.9 QUALIFY row_number() OVER (PARTITION BY key ORDER BY total_rows DESC, table_id) = 1)
    SELECT DISTINCT source, table_id AS target, 'reference' AS edge_type FROM k JOIN h USING (key) WHERE table_id <> source
"""


def catalog_with_reports(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Catalog rows of the estate, and the same rows with what reports show besides.

    Profile, samples and facts are written once: several parts of a row read them, and no table is scanned twice for it.
    """
    assets = {a.id: a for a in data.assets(sf)}
    tables = {i: a.read(spark) for i, a in assets.items()}
    profile = cut_lineage(profile_tables(tables))
    edges = cut_lineage(lineage.key_edges(profile))
    samples = cut_lineage(union_all(frequencies.sample_values(df).select(F.lit(i).alias("table_id"), "*") for i, df in tables.items()))
    columns = columns_frame(spark, {i: df.schema for i, df in tables.items()})
    facts = union_all(table_metadata(tables[i], a) for i, a in assets.items())
    files = union_all(file_facts(spark, a) for a in assets.values()).withColumnRenamed("asset_id", "table_ref")
    flags = classify.flag_tables(columns).withColumnRenamed("table_id", "table_ref")
    scores = quality.completeness(profile).select(F.col("table_id").alias("table_ref"), "completeness_score")
    kind = volatility(F.col("table_type"), F.lit(False), F.lit(None).cast("double"))
    flat = cut_lineage(
        facts.withColumn("table_ref", naming.asset_id(F.col("project_id"), F.col("dataset_id"), F.col("table_id")))
        .join(files, "table_ref").join(flags, "table_ref").join(scores, "table_ref")
        .withColumns({
            "description": display.table_description("Spark", F.col("table_id"), F.col("table_type"), F.col("row_count"), F.col("column_count")),
            "environment": F.lit("prod"), "volatility": kind, "cache_ttl": cache_ttl(kind),
        })
    )
    rows = catalog.catalog_rows(flat, columns, profile, samples, edges, F.lit(RUN).cast("timestamp"))
    extras = flat.select(
        "table_ref", "completeness_score", "volatility", "cache_ttl",
        cost.storage_cost(F.col("size_bytes")).alias("storage_cost_usd"), cost.query_cost(F.col("size_bytes")).alias("query_cost_usd"),
        cost.total_cost(F.col("size_bytes")).alias("monthly_cost_usd"),
    ).join(catalog.lineage_totals(edges), "table_ref", "left")
    return rows, catalog.report_input(rows, extras, profile)


def catalog_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One nested catalog row per table of the estate."""
    return catalog_with_reports(spark, sf)[0]


def asset_content(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog_with_reports(spark, sf)[1]
    return rows.select("table_id", report.content_text(rows).alias("content"))


def asset_report(spark: SparkSession, sf: str) -> DataFrame:
    return report.reports(catalog_with_reports(spark, sf)[1])


def collection_run(spark: SparkSession, sf: str) -> DataFrame:
    """A run over the estate and a table that is not there: one outcome each, with what was stored of it."""
    assets = [*data.assets(sf), Asset(data.PROJECT, "web", "gone", path=f"{sf}/gone.parquet")]
    done = collection.collect(spark, assets, scratch_path(spark, "collection"), RUN)
    stored = done.read(spark, "facts").select("table_ref", "row_count")
    profiled = done.read(spark, "profile").groupBy(F.col("table_id").alias("table_ref")).agg(F.count(F.lit(1)).alias("n_columns"))
    found = done.read(spark, "outcomes").join(stored, "table_ref", "left").join(profiled, "table_ref", "left")
    return found.select("dataset_id", "table_id", "outcome", "row_count", "n_columns")


COLLECTION_RUN_SQL = profiling._union_sql([
    f"SELECT '{d}' AS dataset_id, '{t}' AS table_id, 'formatted' AS outcome, count(*) AS row_count, CAST({len(profiling.ALL_COLUMNS[t])} AS BIGINT) AS n_columns FROM {t}"
    for d, names in data.DATASETS.items() for t in names
]) + " UNION ALL SELECT 'web', 'gone', 'error', NULL, NULL"


EARLIER_RUN = "2024-01-31 00:00:00"


def committed_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Three attempts in one folder: a run, a run that fails after its tables are read, and that run again.

    One row for each completed run and table, with the rows that the frames hold of it, and the attempts at the run.
    """
    root = scratch_path(spark, "runs")
    assets = [a for a in data.assets(sf) if a.dataset_id == "sales"][:4]
    collection.collect(spark, assets[:2], root, EARLIER_RUN)
    try:  # lineage that cannot be read ends the run when its tables are stored already
        collection.collect(spark, assets, root, RUN, edges=spark.createDataFrame([("a", "b")], "parent string, child string"))
    except AnalysisException:
        pass
    collection.collect(spark, assets, root, RUN)
    found = collection.committed(spark, root, "catalog").select("run_id", "dataset_id", "table_id", "row_count")
    for name in ("catalog", "facts", "reports"):
        found = found.join(collection.committed(spark, root, name).groupBy("run_id", "table_id").agg(F.count(F.lit(1)).alias(f"n_{name}")), ["run_id", "table_id"])
    attempts = collection.runs(spark, root).groupBy("run_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("state") == "FAILED").alias("failed"))
    return found.join(attempts, "run_id").select("run_id", "dataset_id", "table_id", "row_count", "n_catalog", "n_facts", "n_reports", "attempts", "failed")


COMMITTED_RUNS_SQL = profiling._union_sql([
    f"SELECT '{run.translate({45: None, 32: None, 58: None})}' AS run_id, 'sales' AS dataset_id, '{t}' AS table_id, count(*) AS row_count, CAST(1 AS BIGINT) AS n_catalog,"
    f" CAST(1 AS BIGINT) AS n_facts, CAST(1 AS BIGINT) AS n_reports, CAST({1 + failed} AS BIGINT) AS attempts, CAST({failed} AS BIGINT) AS failed FROM {t}"
    for run, names, failed in ((EARLIER_RUN, data.DATASETS["sales"][:2], 0), (RUN, data.DATASETS["sales"][:4], 1)) for t in names
])


def _document_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Document assets in the catalog schema, without profiles."""
    docs = data.document_assets(spark, sf).withColumn(
        "description", display.table_description("Spark", F.col("table_id"), F.col("table_type"), F.col("row_count"), F.col("column_count"))
    )
    carried = {
        "project_id", "dataset_id", "table_id", "description", "table_type", "last_modified", "row_count", "column_count",
        "size_bytes", "has_pii", "has_phi", "environment",
    }
    empty = {"labels", "schema", "analytical_insights", "lineage", "column_profiles", "key_metrics"}
    fields = spark.createDataFrame([], schemas.CATALOG).schema.fields
    return docs.select(
        *[
            (F.col(f.name) if f.name in carried else F.array() if f.name in empty else F.lit(RUN) if f.name == "run_timestamp" else F.lit(None))
            .cast(f.dataType).alias(f.name) for f in fields
        ],
        "team", "storage_cost_usd", "query_cost_usd", "monthly_cost_usd",
    )


_DESCRIPTION_SQL = """'Spark ' || lower(table_type) || ' ''' || table_id || '''' || CASE WHEN column_count > 0 THEN ' with ' || column_count || CASE WHEN column_count = 1 THEN ' column' ELSE ' columns' END ELSE '' END
      || ' containing ' || format('{:,}', row_count) || CASE WHEN row_count = 1 THEN ' row' ELSE ' rows' END || '.'"""


def document_content(spark: SparkSession, sf: str) -> DataFrame:
    """The content text of every document asset."""
    rows = _document_catalog(spark, sf)
    return rows.select("table_id", "project_id", "dataset_id", report.content_text(rows).alias("content"))


DOCUMENT_CONTENT_SQL = f"""
    SELECT table_id, project_id, dataset_id, concat_ws(chr(10),
      '# ' || dataset_id || '.' || table_id, '', '**Type**: ' || table_type, '**Dataset**: ' || dataset_id, '**Project**: ' || project_id,
      '', '## Statistics', '- **Rows**: ' || format('{{:,}}', row_count), '- **Size**: ' || format('{{:.2f}}', size_bytes / 1073741824.0) || ' GB',
      '- **Columns**: ' || column_count, '- **Last Modified**: ' || strftime(last_modified, '%Y-%m-%dT%H:%M:%SZ'),
      '', '## Description', {_DESCRIPTION_SQL},
      '', '## Lineage', '', '**Upstream Sources:**', '- *No upstream sources found*', '', '**Downstream Consumers:**', '- *No downstream dependencies found*',
      '', '## Governance', CASE WHEN has_pii THEN '- **Classification**: Contains PII data' END, CASE WHEN has_phi THEN '- **Classification**: Contains PHI data' END,
      '- **Team**: ' || team, '', '## Cost',
      CASE WHEN storage_cost_usd > 0 THEN '- **Storage**: $' || format('{{:.2f}}', storage_cost_usd) || '/month' END,
      CASE WHEN query_cost_usd > 0 THEN '- **Queries**: $' || format('{{:.2f}}', query_cost_usd) || '/month' END,
      CASE WHEN monthly_cost_usd > 0 THEN '- **Total**: $' || format('{{:.2f}}', monthly_cost_usd) || '/month' END) AS content
    FROM ({DOCS})
"""


def document_report(spark: SparkSession, sf: str) -> DataFrame:
    """The Markdown report of every document asset."""
    rows = _document_catalog(spark, sf)
    return report.reports(rows).select("path", "markdown")


_SIZE_SQL = """CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN format('{:.2f}', size_bytes / 1024.0) || ' KB'
      WHEN size_bytes < 1073741824 THEN format('{:.2f}', size_bytes / 1048576.0) || ' MB' ELSE format('{:.2f}', size_bytes / 1073741824.0) || ' GB' END"""
_MINUTE_SQL = "strftime(last_modified, '%Y-%m-%d %H:%M UTC')"

DOCUMENT_REPORT_SQL = f"""
    SELECT 'run=20240201T000000/project_id=' || project_id || '/dataset_id=' || dataset_id || '/table_id=' || table_id AS path, concat_ws(chr(10) || chr(10),
      '# ' || dataset_id || '.' || table_id,
      concat_ws(' | ', '[' || table_type || ']', CASE WHEN has_pii THEN '[PII]' END, CASE WHEN has_phi THEN '[PHI]' END, '[' || upper(environment) || ']'),
      '## Executive Summary',
      concat_ws(' - ', '**' || format('{{:,}}', row_count) || '** rows', '**' || {_SIZE_SQL} || '**', '**' || column_count || '** columns',
                CASE WHEN monthly_cost_usd > 0 THEN '**$' || format('{{:.2f}}', monthly_cost_usd) || '/month**' END),
      '**Team**: ' || team || chr(10) || '**Last Modified**: ' || {_MINUTE_SQL},
      '## Key Metrics',
      concat_ws(chr(10), '| Metric | Value |', '|--------|-------|', '| Row Count | ' || format('{{:,}}', row_count) || ' |', '| Size | ' || {_SIZE_SQL} || ' |',
                '| Columns | ' || column_count || ' |', '| Last Modified | ' || {_MINUTE_SQL} || ' |'),
      '## Description', {_DESCRIPTION_SQL},
      '## Schema', '*Schema contains ' || column_count || ' columns*', 'Run full discovery to see detailed schema information.',
      '## Security & Governance',
      concat_ws(chr(10), '- **Data Classification**: ' || CASE WHEN has_pii OR has_phi THEN concat_ws(', ', CASE WHEN has_pii THEN '**PII** (Personally Identifiable Information)' END,
                CASE WHEN has_phi THEN '**PHI** (Protected Health Information)' END) ELSE 'No sensitive data detected' END,
                '- **Team**: ' || team, '- **Environment**: ' || upper(environment)),
      CASE WHEN monthly_cost_usd > 0 THEN concat_ws(chr(10) || chr(10), '## Cost Analysis', '**Total Monthly Cost**: $' || format('{{:.2f}}', monthly_cost_usd),
        CASE WHEN storage_cost_usd > 0 OR query_cost_usd > 0 THEN concat_ws(chr(10), '| Component | Cost |', '|-----------|------|',
          CASE WHEN storage_cost_usd > 0 THEN '| Storage | $' || format('{{:.2f}}', storage_cost_usd) || ' |' END,
          CASE WHEN query_cost_usd > 0 THEN '| Queries | $' || format('{{:.2f}}', query_cost_usd) || ' |' END,
          '| **Total** | **$' || format('{{:.2f}}', monthly_cost_usd) || '** |') END,
        '*Cost per GB*: $' || format('{{:.2f}}', monthly_cost_usd / (size_bytes / 1073741824.0))) END,
      '## Data Lineage', '### Upstream Sources', '*No upstream sources found*', '### Downstream Dependencies', '*No downstream dependencies found*',
      '---', '*Report generated at 2024-02-01T00:00:00Z*', '**Full Path**: `' || id || '`',
      '*This report is generated from cached metadata. For real-time information, query the live system.*') AS markdown
    FROM ({DOCS})
"""


def report_export_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Reports made per dataset, with assets without a project failing."""
    rows = _document_catalog(spark, sf)
    made = report.reports(rows)
    return report.export_summary(made.withColumn("markdown", F.when(F.col("markdown").contains("[UNKNOWN]"), None).otherwise(F.col("markdown"))))


REPORT_EXPORT_SQL = f"""
    WITH r AS ({DOCUMENT_REPORT_SQL}), s AS (SELECT split_part(split_part(path, '/', 2), '=', 2) AS project_id, split_part(split_part(path, '/', 3), '=', 2) AS dataset_id, CASE WHEN contains(markdown, '[UNKNOWN]') THEN NULL ELSE markdown END AS m FROM r)
    SELECT project_id, dataset_id, count(m) AS exported, count(*) FILTER (WHERE m IS NULL) AS failed, CAST(coalesce(sum(length(m)), 0) AS BIGINT) AS total_chars FROM s GROUP BY ALL
"""


def run_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog rows with the report of their own run: dev assets were only reported in an earlier run."""
    rows = _document_catalog(spark, sf)
    earlier = F.when(F.col("environment") == "dev", F.col("run_timestamp") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("run_timestamp"))
    reports = report.reports(rows.withColumn("run_timestamp", earlier))
    joined = report.with_reports_of_run(rows, reports)
    return joined.select("run", "table_id", "project_id", "dataset_id", F.length("markdown").cast("bigint").alias("report_chars"))


RUN_REPORTS_SQL = f"""
    WITH r AS ({DOCUMENT_REPORT_SQL})
    SELECT '20240201T000000' AS run, table_id, project_id, dataset_id, CASE WHEN environment <> 'dev' THEN length(markdown) END AS report_chars
    FROM ({DOCS}) d JOIN r ON r.path = 'run=20240201T000000/project_id=' || d.project_id || '/dataset_id=' || d.dataset_id || '/table_id=' || d.table_id
"""


def display_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes, dates, ISO times and stand-in column descriptions as reports show them."""
    docs = data.document_assets(spark, sf)
    seconds = (F.lit(1_700_000_000) + F.col("row_count") * 600).cast("string")
    raw = (
        F.when(F.col("environment") == "prod", seconds).when(F.col("environment") == "dev", F.date_format("last_modified", "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(F.lit("unknown"))
    )
    mode = F.when(F.col("has_phi"), "REPEATED").when(F.col("has_pii"), "REQUIRED").otherwise("NULLABLE")
    return docs.select(
        "id", display.size_text(F.pow(F.col("row_count").cast("double"), F.lit(2.0)).cast("bigint")).alias("size"), display.minute_text(F.col("last_modified")).alias("minute"),
        display.iso_text(raw).alias("iso"), display.column_description(F.col("table_id"), F.lit("STRING"), mode).alias("description"),
    )


DISPLAY_TEXTS_SQL = f"""
    SELECT id, {_SIZE_SQL.replace('size_bytes', '(row_count * row_count)')} AS size, {_MINUTE_SQL} AS minute,
           CASE WHEN environment = 'unknown' THEN 'unknown' ELSE strftime(last_modified, '%Y-%m-%dT%H:%M:%SZ') END AS iso,
           'Doc ' || substr(table_id, 5) || CASE WHEN has_phi THEN ' - Array of string values' WHEN has_pii THEN ' - Required string field' ELSE ' - String field' END AS description
    FROM ({DOCS})
"""


def catalog_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The columns inside the catalog rows: bounds and null shares as stored, with their sample values."""
    rows = catalog_rows(spark, sf)
    profiles = rows.select("table_id", F.inline("column_profiles")).select("table_id", "column_name", "profile_type", "min_value", "max_value", "null_percentage")
    fields = rows.select("table_id", F.inline("schema")).select(
        "table_id", F.col("name").alias("column_name"), "description", F.array_join("sample_values", "|").alias("samples")
    )
    return profiles.join(fields, ["table_id", "column_name"]).filter("profile_type != 'other'")


def _catalog_column_sql(t: str, c: str) -> str:
    number = c in profiling.NUMBERS[t]
    low, high = (f"CAST(min({c}) + 0 AS VARCHAR)", f"CAST(max({c}) + 0 AS VARCHAR)") if number else ("''", "''")
    kind = "Int" if c in _INTS else "Double" if c in _DOUBLES else "Bigint" if number else "String"
    title = " ".join(w.capitalize() for w in c.split("_"))
    return (
        f"SELECT '{t}' AS table_id, '{c}' AS column_name, '{'numeric' if number else 'string'}' AS profile_type, {low} AS min_value, {high} AS max_value,"
        f" round(100.0 * (count(*) - count({c})) / count(*), 2) AS null_percentage, '{title} - {kind} field' AS description,"
        f" (SELECT string_agg(CAST(v AS VARCHAR), '|' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM {t} WHERE {c} IS NOT NULL ORDER BY v LIMIT 3)) AS samples FROM {t}"
    )


_INTS = {"r_regionkey", "n_nationkey", "n_regionkey", "c_nationkey", "s_nationkey", "p_size", "l_linenumber", "quality", "toxic", "label"}
_DOUBLES = {"c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "value"}
CATALOG_COLUMNS_SQL = " UNION ALL ".join(
    _catalog_column_sql(t, c) for t, columns in profiling.ALL_COLUMNS.items() for c in columns if c not in ("l_shipdate", "o_orderdate", "ts", "embedding")
)


def column_details(spark: SparkSession, sf: str) -> DataFrame:
    """Columns next to their null figures and samples, for documents with their mostly null labels."""
    labelled = profiling.labelled(spark, sf)
    samples = frequencies.sample_values(labelled).select(F.lit("labelled").alias("table_id"), "*")
    rows = catalog.column_details(
        columns_frame(spark, {"labelled": labelled.schema}), profile_tables({"labelled": labelled}, profiling.NO_DISTINCT), samples
    )
    return rows.select("column_name", "null_count", "null_percentage", "min", "max", "max_length", F.array_join("sample_values", "|").alias("samples"))


COLUMN_DETAILS_SQL = f"WITH t AS ({profiling.LABELLED_SQL}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, round(100.0 * (count(*) - count({c})) / count(*), 2) AS null_percentage,"
    + (f" CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, max(length({c})) AS max_length," if c in ("lang", "source")
       else f" CAST(min({c}) AS DOUBLE) + 0.0 AS min, CAST(max({c}) AS DOUBLE) + 0.0 AS max, CAST(NULL AS BIGINT) AS max_length,")
    + f" (SELECT string_agg(CAST(v AS VARCHAR), '|' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM t WHERE {c} IS NOT NULL ORDER BY v LIMIT 3)) AS samples FROM t"
    for c in profiling.LABELLED_COLUMNS
)


def content_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptions read back out of content texts, and the opening lines of texts that have none."""
    rows = _document_catalog(spark, sf)
    content = report.content_text(rows)
    with_section = rows.select("table_id", display.description_in(content).alias("description"))
    plain = data.table(spark, sf, "documents").select(
        F.concat(F.lit("plain_"), F.col("doc_id").cast("string")).alias("table_id"), display.description_in(F.col("text")).alias("description")
    )
    return with_section.union(plain)


CONTENT_DESCRIPTIONS_SQL = f"""
    SELECT table_id, {_DESCRIPTION_SQL} AS description FROM ({DOCS})
    UNION ALL SELECT 'plain_' || doc_id, coalesce(nullif(array_to_string(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0 AND NOT starts_with(x, '#'))[1:6], chr(10)), ''), '*No description available*')
    FROM documents
"""


def export_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """Document assets as JSON lines, null fields left out."""
    return docs_io.to_jsonl(report.documents(_document_catalog(spark, sf)))


def stored_catalog_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs appended to a stored catalog, the second over production assets only; its latest run read back."""
    path = scratch_path(spark, "catalog")
    flat = ("team", "storage_cost_usd", "query_cost_usd", "monthly_cost_usd")
    rows = _document_catalog(spark, sf).drop(*flat)
    catalog.append(rows, path)
    catalog.append(rows.filter("environment = 'prod'").withColumn("run_timestamp", F.col("run_timestamp") + F.expr("INTERVAL 1 DAY")), path)
    return catalog.latest(catalog.read(spark, path)).select("project_id", "dataset_id", "table_id", "row_count", "size_bytes", "has_pii", "environment")


STORED_CATALOG_SQL = f"SELECT project_id, dataset_id, table_id, row_count, size_bytes, has_pii, environment FROM ({DOCS}) WHERE environment = 'prod'"


def stored_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Document assets written as JSON lines and read back with the fixed schema."""
    path = scratch_path(spark, "documents")
    docs_io.write_jsonl(report.documents(_document_catalog(spark, sf)), path)
    return docs_io.read_jsonl(spark, path).select(
        "id", "state", F.col("structData.dataset_id").alias("dataset_id"), F.col("structData.asset_type").alias("asset_type"),
        F.col("structData.row_count").alias("row_count"), F.col("structData.has_pii").alias("has_pii"),
        F.col("structData.last_modified_timestamp").alias("last_modified"), F.col("structData.team").alias("team"), F.md5("content.text").alias("text_md5"),
    )


STORED_DOCUMENTS_SQL = f"""
    SELECT d.id, 'ok' AS state, d.dataset_id, d.table_type AS asset_type, d.row_count, d.has_pii, strftime(d.last_modified, '%Y-%m-%dT%H:%M:%SZ') AS last_modified,
           d.team, md5(c.content) AS text_md5 FROM ({DOCS}) d JOIN ({DOCUMENT_CONTENT_SQL}) c USING (project_id, dataset_id, table_id)
"""


def schema_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Fields added, removed or changed between a run over orders and one over line items joined with them."""
    orders, lines = data.table(spark, sf, "orders"), data.table(spark, sf, "lineitem")
    wide = lines.join(orders, lines.l_orderkey == orders.o_orderkey).drop("o_orderpriority").withColumn("o_custkey", F.col("o_custkey").cast("string"))

    def run(df: DataFrame) -> DataFrame:
        fields = catalog.schema_arrays(columns_frame(spark, {"sales": df.schema}), frequencies.sample_values(df, [df.columns[0]]).select(F.lit("sales").alias("table_id"), "*"))
        return fields.select(F.lit("lake").alias("project_id"), F.lit("sales").alias("dataset_id"), "table_id", "schema")

    return catalog.schema_diff(run(orders), run(wide)).select("name", "change", "changed_columns")


SCHEMA_CHANGES_SQL = """
    SELECT * FROM (VALUES ('o_orderpriority', 'removed', NULL), ('o_custkey', 'changed', 'type')) t(name, change, changed_columns)
    UNION ALL SELECT column_name, 'added', NULL FROM information_schema.columns WHERE table_name = 'lineitem'
"""

QUERIES = {
    "dataset_exclude": (dataset_exclude, DATASET_EXCLUDE_SQL),
    "table_cap": (table_cap, TABLE_CAP_SQL),
    "label_filter": (label_filter, LABEL_FILTER_SQL),
    "run_statistics": (run_statistics, RUN_STATISTICS_SQL),
    "asset_names": (asset_names, ASSET_NAMES_SQL),
    "latest_snapshot": (latest_snapshot, LATEST_SNAPSHOT_SQL),
    "asof_snapshot": (asof_snapshot, ASOF_SNAPSHOT_SQL),
    "latest_per_asset": (latest_per_asset, LATEST_PER_ASSET_SQL),
    "upsert_documents": (upsert_documents, UPSERT_SQL),
    "upsert_buckets": (upsert_buckets, UPSERT_BUCKETS_SQL),
    "upsert_outcome": (upsert_outcome, UPSERT_OUTCOME_SQL),
    "reconcile_full": (reconcile_full, RECONCILE_FULL_SQL),
    "delete_documents": (delete_documents, DELETE_SQL),
    "id_collisions": (id_collisions, ID_COLLISIONS_SQL),
    "diff_runs": (diff_runs, DIFF_RUNS_SQL),
    "ingest_outcome": (ingest_outcome, INGEST_OUTCOME_SQL),
    "dataset_rollup": (dataset_rollup, DATASET_ROLLUP_SQL),
    "dataset_tables": (dataset_tables, DATASET_TABLES_SQL),
    "cost_rollup": (cost_rollup, COST_ROLLUP_SQL),
    "asset_costs": (asset_costs, ASSET_COSTS_SQL),
    "catalog_health": (catalog_health, CATALOG_HEALTH_SQL),
    "extract_refs": (extract_refs, EXTRACT_REFS_SQL),
    "view_dependencies": (view_dependencies, VIEW_DEPENDENCIES_SQL),
    "view_dependencies_substring": (view_dependencies_substring, VIEW_SUBSTRING_SQL),
    "lineage_neighbours": (lineage_neighbours, LINEAGE_NEIGHBOURS_SQL),
    "key_edges": (key_edges, KEY_EDGES_SQL),
    "collection_run": (collection_run, COLLECTION_RUN_SQL),
    "committed_runs": (committed_runs, COMMITTED_RUNS_SQL),
    "clean_edges": (clean_edges, CLEAN_EDGES_SQL),
    "reference_edges": (reference_edges, REFERENCE_EDGES_SQL),
    "lineage_downstream": (lineage_downstream, LINEAGE_DOWNSTREAM_SQL),
    "lineage_upstream": (lineage_upstream, LINEAGE_UPSTREAM_SQL),
    "lineage_from_roots": (lineage_from_roots, LINEAGE_FROM_ROOTS_SQL),
    "lineage_totals": (lineage_totals, LINEAGE_TOTALS_SQL),
    "lineage_graph_edges": (lineage_graph_edges, LINEAGE_GRAPH_EDGES_SQL),
    "lineage_coverage": (lineage_coverage, LINEAGE_COVERAGE_SQL),
    "lineage_links": (lineage_links, LINEAGE_LINKS_SQL),
    "job_events": (job_events, JOB_EVENTS_SQL),
    "catalog_rows": (catalog_rows, None),
    "asset_content": (asset_content, None),
    "asset_report": (asset_report, None),
    "document_content": (document_content, DOCUMENT_CONTENT_SQL),
    "document_report": (document_report, DOCUMENT_REPORT_SQL),
    "report_export_summary": (report_export_summary, REPORT_EXPORT_SQL),
    "run_reports": (run_reports, RUN_REPORTS_SQL),
    "display_texts": (display_texts, DISPLAY_TEXTS_SQL),
    "catalog_columns": (catalog_columns, CATALOG_COLUMNS_SQL),
    "column_details": (column_details, COLUMN_DETAILS_SQL),
    "content_descriptions": (content_descriptions, CONTENT_DESCRIPTIONS_SQL),
    "export_jsonl": (export_jsonl, None),
    "stored_catalog_latest": (stored_catalog_latest, STORED_CATALOG_SQL),
    "stored_documents": (stored_documents, STORED_DOCUMENTS_SQL),
    "schema_changes": (schema_changes, SCHEMA_CHANGES_SQL),
}
