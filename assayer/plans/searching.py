"""Search queries: filters, ranking, paging, facets, similarity and free-text requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.functions import display
from assayer.operators import catalog, report, requests, retrieval, search, similarity
from assayer.operators.search import B, K1, SearchRequest
from assayer.plans import data
from assayer.session import scratch_path
from assayer.operators.quality import completeness
from assayer.operators.usage import usage

DOCS = data.DOCUMENT_ASSETS_SQL
WORDS = ["the", "que", "email", "contact"]
QUERY = "The que, email CONTACT"


def _word(w: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{w}'))"


def _bm25_sql(source: str, words: list[str]) -> str:
    """BM25 over a sub-select with all its columns; ``score`` is not rounded."""
    tf = ", ".join(f"{_word(w)} AS tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(words)))
    part = " + ".join(
        f"ln(1.0 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * {K1 + 1.0} / (tf{i} + {K1} * ({1.0 - B} + {B} * len / avg_len))" for i in range(len(words))
    )
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(words)))
    return f"""
      SELECT *, {part} AS score FROM
        (SELECT *, {tf}, len(t) AS len FROM (SELECT *, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM ({source}))),
        (SELECT count(*) AS n, avg(len(t)) AS avg_len, {df} FROM (SELECT t, {tf} FROM
          (SELECT list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM ({source}))))
      WHERE {hit}
    """


# --- ranking ------------------------------------------------------------------------------------


def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with a query word and its score."""
    hits = search.bm25(data.table(spark, sf, "documents"), QUERY, "doc_id", "text")
    return hits.select("doc_id", F.round("score", 6).alias("score"))


BM25_SQL = f"SELECT doc_id, round(score, 6) AS score FROM ({_bm25_sql('SELECT * FROM documents', WORDS)})"


def bm25_index_search(spark: SparkSession, sf: str) -> DataFrame:
    """The same search over a written index, of which it opens the query's folders only."""
    path = scratch_path(spark, "index")
    search.write_index(data.table(spark, sf, "documents"), "doc_id", "text", path)
    hits = search.search_stored(spark, path, QUERY, "doc_id")
    return hits.select("doc_id", F.round("score", 6).alias("score"))


def bm25_page(spark: SparkSession, sf: str) -> DataFrame:
    """The first page from an index in two segments: every fifth document was stored with another text first and then replaced."""
    docs, path = data.table(spark, sf, "documents").select("doc_id", "text"), scratch_path(spark, "segments")
    fifth = F.col("doc_id") % 5 == 0
    retrieval.upsert(docs.withColumn("text", F.when(fifth, F.concat(F.lit("the old big que "), F.reverse("text"))).otherwise(F.col("text"))), "doc_id", "text", path)
    retrieval.upsert(docs.filter(fifth), "doc_id", "text", path)
    return retrieval.page(spark, path, QUERY, "doc_id", 20).hits.withColumn("score", F.round("score", 6))


BM25_PAGE_SQL = f"""
    SELECT CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM
      (SELECT doc_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ({_bm25_sql('SELECT * FROM documents', WORDS)})) WHERE rank <= 20
"""


def term_index(spark: SparkSession, sf: str) -> DataFrame:
    """Document and total frequency of every term: the size of each posting list."""
    return search.build_index(data.table(spark, sf, "documents"), "doc_id", "text").groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf")
    )


TERM_INDEX_SQL = """
    SELECT term, count(DISTINCT doc_id) AS df, count(*) AS total_tf FROM
      (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM documents) WHERE term <> '' GROUP BY term
"""


def boosted_search(spark: SparkSession, sf: str) -> DataFrame:
    """The page of a request whose words also trigger the cost and size boosts."""
    request = SearchRequest(query="the big que cost", page_size=20)
    page = search.search_page(data.document_assets(spark, sf), request, "id", "text")
    return page.select("rank", "id", F.round("score", 6).alias("score"), "has_more")


_BOOST_SQL = """
    (CASE WHEN last_modified >= TIMESTAMP '2024-01-01' THEN 1.5 ELSE 1.0 END) * (CASE WHEN environment = 'prod' THEN 1.3 ELSE 1.0 END)
    * (CASE WHEN completeness_score >= 0.95 THEN 1.2 ELSE 1.0 END) * (CASE WHEN monthly_cost_usd > 100 THEN 2.0 ELSE 1.0 END)
    * (CASE WHEN row_count > 1000000 THEN 1.5 ELSE 1.0 END)
"""
BOOSTED_SQL = f"""
    WITH s AS (SELECT id, score * {_BOOST_SQL} AS score FROM ({_bm25_sql(DOCS, ['big', 'cost', 'que', 'the'])})),
         r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank, count(*) OVER () > 20 AS has_more FROM s)
    SELECT rank, id, round(score, 6) AS score, has_more FROM r WHERE rank <= 20
"""


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Text and structured filters together, ranked within the filtered documents."""
    request = SearchRequest(
        query="the que", environment="prod", has_phi=False, min_row_count=200, max_cost=500.0, numeric=[("size_bytes", ">", 3e8)],
    )
    hits = search.search(data.document_assets(spark, sf), request, "id", "text", boosted=False)
    return hits.select("id", F.round("score", 6).alias("score"))


_HYBRID = f"SELECT * FROM ({DOCS}) WHERE environment = 'prod' AND NOT has_phi AND row_count >= 200 AND monthly_cost_usd <= 500 AND size_bytes > 300000000"
HYBRID_SQL = f"SELECT id, round(score, 6) AS score FROM ({_bm25_sql(_HYBRID, ['que', 'the'])})"


def filtered_assets(spark: SparkSession, sf: str) -> DataFrame:
    """Structured filters alone, a zero bound and tags among them."""
    docs = data.document_assets(spark, sf).withColumn("tags", F.array_compact(F.array(
        "environment", F.when(F.col("has_pii"), F.lit("pii")), F.when(F.col("row_count") > 5000, F.lit("large"))
    )))
    request = SearchRequest(project_id="en", team="team_en", min_cost=0.0, max_row_count=8000, tags=["pii", "large", "dev"])
    return docs.filter(search.predicate(request)).select("id", "row_count", F.array_join("tags", ",").alias("tags"))


FILTERED_SQL = f"""
    SELECT id, row_count, concat_ws(',', environment, CASE WHEN has_pii THEN 'pii' END, CASE WHEN row_count > 5000 THEN 'large' END) AS tags
    FROM ({DOCS}) WHERE project_id = 'en' AND team = 'team_en' AND monthly_cost_usd >= 0 AND row_count <= 8000
      AND (environment = 'dev' OR has_pii OR row_count > 5000)
"""


def highlighted_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Which fields of each asset hold a word of the query."""
    docs = data.document_assets(spark, sf)
    fields = search.highlighted("src3 prod quell", ["dataset_id", "environment", "text"])
    return docs.select("id", F.array_join(fields, ",").alias("fields"))


HIGHLIGHTED_SQL = f"""
    SELECT id, concat_ws(',', CASE WHEN contains(lower(dataset_id), 'src3') THEN 'dataset_id' END, CASE WHEN contains(lower(environment), 'prod') THEN 'environment' END,
      CASE WHEN contains(lower(text), 'src3') OR contains(lower(text), 'prod') OR contains(lower(text), 'quell') THEN 'text' END) AS fields FROM ({DOCS})
"""


# --- pages and groups ---------------------------------------------------------------------------


def paged_search(spark: SparkSession, sf: str) -> DataFrame:
    """The page after a given last row, in descending size."""
    request = SearchRequest(query="", sort_by="row_count", page_size=25, after=(5000, ""), environment="prod")
    page = search.search_page(data.document_assets(spark, sf), request, "id", "text")
    return page.select("rank", "id", "row_count", "has_more")


PAGED_SQL = f"""
    WITH r AS (SELECT id, row_count, row_number() OVER (ORDER BY row_count DESC, id) AS rank, count(*) OVER () > 25 AS has_more
               FROM ({DOCS}) WHERE environment = 'prod' AND (row_count < 5000 OR (row_count = 5000 AND id > '')))
    SELECT rank, id, row_count, has_more FROM r WHERE rank <= 25
"""


def paged_ascending(spark: SparkSession, sf: str) -> DataFrame:
    """A page from the cheap end, by another field and in ascending order."""
    request = SearchRequest(query="", sort_by="monthly_cost_usd", descending=False, page_size=30, has_pii=False)
    page = search.search_page(data.document_assets(spark, sf), request, "id", "text")
    return page.select("rank", "id", "monthly_cost_usd", "has_more")


PAGED_ASCENDING_SQL = f"""
    WITH r AS (SELECT id, monthly_cost_usd, row_number() OVER (ORDER BY monthly_cost_usd, id) AS rank, count(*) OVER () > 30 AS has_more FROM ({DOCS}) WHERE NOT has_pii)
    SELECT rank, id, monthly_cost_usd, has_more FROM r WHERE rank <= 30
"""


def paged_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """A page that begins among the last rows with a sort value and goes on with those that have none."""
    docs = data.document_assets(spark, sf).withColumn("reviewed", F.when(F.col("environment") != "unknown", F.col("row_count")))
    request = SearchRequest(query="", sort_by="reviewed", page_size=60, after=(60, ""))
    return search.search_page(docs, request, "id", "text").select("rank", "id", "reviewed", "has_more")


PAGED_NULLS_SQL = f"""
    WITH d AS (SELECT id, CASE WHEN environment <> 'unknown' THEN row_count END AS reviewed FROM ({DOCS})),
         r AS (SELECT id, reviewed, row_number() OVER (ORDER BY reviewed DESC NULLS LAST, id) AS rank, count(*) OVER () > 60 AS has_more
               FROM d WHERE reviewed IS NULL OR reviewed < 60 OR (reviewed = 60 AND id > ''))
    SELECT rank, id, reviewed, has_more FROM r WHERE rank <= 60
"""


def search_response(spark: SparkSession, sf: str) -> DataFrame:
    """A whole answer: the page's keys, the total, the token of the next page and the facets of all hits."""
    request = SearchRequest(query="", sort_by="row_count", page_size=20, environment="prod")
    found = search.response(data.document_assets(spark, sf), request, "id", "text", ["project_id"])
    return found.select(
        "total", F.array_join("keys", ",").alias("keys"), F.col("next_page.sort_value").alias("next_value"), F.col("next_page.key").alias("next_key"),
        F.array_join(F.transform("facets", lambda f: F.concat_ws("=", f["value"], f["n"].cast("string"))), ",").alias("projects"),
    )


SEARCH_RESPONSE_SQL = f"""
    WITH d AS (SELECT id, row_count, project_id FROM ({DOCS}) WHERE environment = 'prod'),
         r AS (SELECT *, row_number() OVER (ORDER BY row_count DESC, id) AS rank FROM d),
         f AS (SELECT project_id, count(*) AS n FROM d GROUP BY 1)
    SELECT (SELECT count(*) FROM d) AS total, string_agg(id, ',' ORDER BY rank) AS keys, CAST(arg_max(row_count, rank) AS VARCHAR) AS next_value,
           arg_max(id, rank) AS next_key, (SELECT string_agg(project_id || '=' || n, ',' ORDER BY n DESC, project_id) FROM f) AS projects
    FROM r WHERE rank <= 20
"""


def facets(spark: SparkSession, sf: str) -> DataFrame:
    docs = data.document_assets(spark, sf).filter(search.predicate(SearchRequest(has_phi=False)))
    return search.facets(docs, ["project_id", "dataset_id", "environment", "table_type", "has_pii"])


FACETS_SQL = f"""
    WITH d AS (SELECT * FROM ({DOCS}) WHERE NOT has_phi),
    v AS (SELECT 'project_id' AS field, project_id AS value FROM d UNION ALL SELECT 'dataset_id', dataset_id FROM d UNION ALL SELECT 'environment', environment FROM d
          UNION ALL SELECT 'table_type', table_type FROM d UNION ALL SELECT 'has_pii', CAST(has_pii AS VARCHAR) FROM d),
    c AS (SELECT field, value, count(*) AS n FROM v GROUP BY ALL)
    SELECT field, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM c) WHERE rank <= 10
"""


def order_facets(spark: SparkSession, sf: str) -> DataFrame:
    return search.facets(data.table(spark, sf, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"])


ORDER_FACETS_SQL = """
    WITH v AS (SELECT 'o_custkey' AS field, CAST(o_custkey AS VARCHAR) AS value FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders
               UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
    c AS (SELECT field, value, count(*) AS n FROM v GROUP BY ALL)
    SELECT field, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM c) WHERE rank <= 10
"""


def group_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The customers with the highest spend, the part types by average price and the sources by documents."""
    def top(name: str, key: str, function: str, value: str | None) -> DataFrame:
        rows = search.group_top(data.table(spark, sf, name), key, function, value)
        return rows.select(F.lit(key).alias("field"), F.col(key).cast("string").alias("value"), F.round(F.col("result").cast("double"), 2).alias("result"), "total_groups")

    return top("orders", "o_custkey", "sum", "o_totalprice").union(top("part", "p_brand", "avg", "p_retailprice")).union(top("documents", "source", "count", None))


def _top_sql(name: str, key: str, measure: str) -> str:
    return f"""(SELECT '{key}' AS field, CAST({key} AS VARCHAR) AS value, round(CAST({measure} AS DOUBLE), 2) AS result, (SELECT count(DISTINCT {key}) FROM {name}) AS total_groups
                FROM {name} GROUP BY {key} ORDER BY {measure} DESC, {key} LIMIT 10)"""


GROUP_TOPK_SQL = " UNION ALL ".join([
    _top_sql("orders", "o_custkey", "sum(o_totalprice)"), _top_sql("part", "p_brand", "avg(p_retailprice)"), _top_sql("documents", "source", "count(*)"),
])


# --- similarity ---------------------------------------------------------------------------------


def similar_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items like item 0, itself included, at the given cosine or above."""
    items = data.table(spark, sf, "embeddings")
    reference = items.filter("vec_id = 0").select("embedding").scalar()
    return search.similar(items, reference, "embedding", "vec_id", threshold=0.2, k=50).select("vec_id", F.round("similarity", 6).alias("similarity"))


SIMILAR_SQL = """
    SELECT vec_id, round(s, 6) AS similarity FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings)
    WHERE s >= 0.2 ORDER BY s DESC, vec_id LIMIT 50
"""


def similar_for_references(spark: SparkSession, sf: str) -> DataFrame:
    """The ten items most like each reference, for every item whose number is divisible by 100, against all items."""
    items = data.table(spark, sf, "embeddings")
    references = items.filter("vec_id % 100 = 0")
    found = similarity.similar_for(items, references, "embedding", "vec_id", "vec_id", threshold=0.2, k=10)
    return found.withColumn("similarity", F.round("similarity", 6))


SIMILAR_FOR_SQL = """
    SELECT ref_vec_id, CAST(rank AS INTEGER) AS rank, vec_id, round(s, 6) AS similarity FROM (
      SELECT *, row_number() OVER (PARTITION BY ref_vec_id ORDER BY s DESC, vec_id) AS rank FROM (
        SELECT r.vec_id AS ref_vec_id, e.vec_id, list_cosine_similarity(CAST(r.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS s
        FROM embeddings r, embeddings e WHERE r.vec_id % 100 = 0) WHERE s >= 0.2) WHERE rank <= 10
"""


# --- hits ---------------------------------------------------------------------------------------


def hit_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Title, snippet and report path of every document as a hit; long texts are cut for display only."""
    hits = search.hit_fields(data.document_assets(spark, sf), "text", "s3://reports")
    return hits.select("id", "title", "snippet", "report_path")


HIT_FIELDS_SQL = f"""
    SELECT id, dataset_id || '.' || table_id AS title, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' WHEN length(text) > 0 THEN text ELSE 'No content available' END AS snippet,
           's3://reports/project_id=' || project_id || '/dataset_id=' || dataset_id || '/table_id=' || table_id AS report_path FROM ({DOCS})
"""


def hits_json(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of a search as JSON objects."""
    hits = search.search(data.document_assets(spark, sf), SearchRequest(query="the"), "id", "text")
    return search.hits_as_json(search.hit_fields(hits, "text"), ["project_id", "dataset_id", "table_id", "row_count", "size_bytes", "has_pii", "environment", "team"])


def hits_with_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Hits whose text is missing take it from their report: here pages stand in for reports."""
    docs = data.document_assets(spark, sf).withColumn("content", F.when(F.col("has_phi") | (F.col("environment") == "dev"), F.lit("")).otherwise(F.col("text")))
    reports = docs.filter("environment != 'unknown'").select("project_id", "dataset_id", "table_id", F.concat(F.lit("# "), "id").alias("markdown"))
    # the same names in another project: its reports must not reach these hits
    reports = reports.union(reports.withColumn("project_id", F.lit("other")).withColumn("markdown", F.lit("# other")))
    filled = search.with_report_text(docs, reports, "content")
    return filled.select("id", F.md5(F.coalesce("content", F.lit("none"))).alias("content_md5"))


HITS_WITH_REPORTS_SQL = f"""
    SELECT id, md5(CASE WHEN (has_phi OR environment = 'dev') OR length(text) = 0 THEN CASE WHEN environment <> 'unknown' THEN '# ' || id ELSE 'none' END ELSE text END) AS content_md5 FROM ({DOCS})
"""


def asset_details(spark: SparkSession, sf: str) -> DataFrame:
    """One known asset by name, and the nearest hit for a name that does not exist."""
    docs = data.document_assets(spark, sf).withColumn("text", F.concat_ws(" ", "dataset_id", "table_id", "text"))
    known = docs.agg(F.min(F.struct("id", "project_id", "dataset_id", "table_id"))).first()[0]
    lost = search.asset_details(docs, "en", "src3", "no_such_table", "id", "text")
    if known is None:  # an empty catalog has no asset to ask for
        return lost.select("id", "match")
    found = search.asset_details(docs, known.project_id, known.dataset_id, known.table_id, "id", "text")
    return found.union(lost).select("id", "match")


_NAMED = f"SELECT * REPLACE (dataset_id || ' ' || table_id || ' ' || text AS text) FROM ({DOCS})"
ASSET_DETAILS_SQL = f"""
    SELECT min(id) AS id, 'exact' AS match FROM ({DOCS})
    UNION ALL (SELECT id, 'search' FROM ({_bm25_sql(f"SELECT * FROM ({_NAMED}) WHERE project_id = 'en' AND dataset_id = 'src3'", ['no', 'src3', 'such', 'table'])}) ORDER BY score DESC, id LIMIT 1)
"""


def query_ready_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Filtered assets with their report text, owner and tags, for tools that write queries."""
    docs = data.document_assets(spark, sf).filter(search.predicate(SearchRequest(environment="prod", has_pii=False)))
    reports = docs.select("project_id", "dataset_id", "table_id", F.concat_ws("\n", F.concat(F.lit("# "), "id"), display.snippet(F.col("text"))).alias("markdown"))
    flat = docs.select("project_id", "dataset_id", "table_id", "table_type", "row_count", "column_count", "size_bytes", "has_pii", "has_phi", "environment")
    return report.query_ready(flat, reports).drop("tags")


QUERY_READY_SQL = f"""
    SELECT project_id, dataset_id, table_id, table_type, row_count, column_count, size_bytes, has_pii, has_phi, environment,
           '# ' || id || chr(10) || CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' WHEN length(text) > 0 THEN text ELSE 'No content available' END AS full_markdown,
           CAST(NULL AS VARCHAR) AS owner_email
    FROM ({DOCS}) WHERE environment = 'prod' AND NOT has_pii
"""


def inspect_asset(spark: SparkSession, sf: str) -> DataFrame:
    """One nation as an asset, in one row: its customers, completeness of its suppliers, neighbours and usage."""
    def named(key: str):
        return F.concat(F.lit("nation:"), F.col(key).cast("string")).alias("table_ref")

    customers, suppliers = data.table(spark, sf, "customer"), data.table(spark, sf, "supplier")
    assets = customers.groupBy(named("c_nationkey")).agg(F.count(F.lit(1)).alias("row_count"), F.round(F.sum("c_acctbal"), 2).alias("total"))
    cells = suppliers.groupBy(named("s_nationkey")).agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("s_acctbal") < 0).alias("null_count"))
    statistics = completeness(cells, by=["table_ref"]).select("table_ref", F.round("completeness_score", 4).alias("completeness_score"))
    log = data.table(spark, sf, "events").withColumn("table_ref", named("user_id"))
    row = catalog.inspect(
        assets, "nation:3", statistics=statistics, edges=data.record_edges(spark, sf), usage=usage(log, "table_ref", "ts", "event_type", "value")
    )
    return row.select(
        "table_ref", "row_count", "total", "completeness_score", "query_count", "active_users",
        "upstream_total", "downstream_total", F.array_join("upstream", ",").alias("upstream"),
    )


INSPECT_SQL = f"""
    WITH e AS ({data.RECORD_EDGES_SQL}), u AS (SELECT * FROM events WHERE user_id = 3 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY)
    SELECT 'nation:3' AS table_ref, count(*) AS row_count, round(sum(c_acctbal), 2) AS total,
           (SELECT round(1.0 - count(*) FILTER (WHERE s_acctbal < 0) / CAST(count(*) AS DOUBLE), 4) FROM supplier WHERE s_nationkey = 3) AS completeness_score,
           (SELECT count(*) FROM u) AS query_count, (SELECT count(DISTINCT event_type) FROM u) AS active_users,
           (SELECT nullif(count(*), 0) FROM e WHERE target = 'nation:3') AS upstream_total, (SELECT nullif(count(*), 0) FROM e WHERE source = 'nation:3') AS downstream_total,
           (SELECT string_agg(source, ',' ORDER BY source) FROM e WHERE target = 'nation:3') AS upstream
    FROM customer WHERE c_nationkey = 3
"""


# --- free-text requests -------------------------------------------------------------------------

# Request texts are made from every turn: its words around the filters a user might type.
_ROLE_FILTER = {
    "user": "find project: {0} tables in dataset=src{1} with PII data, size > {2}GB",
    "assistant": "Expensive tables cost >= ${2} env:prod rows<{2}000 owner=team_{0}",
    "system": "dataset with PHI {1} philadelphia project status, bytes <= {2}0000KB records > {2}",
}


_LANGUAGES = ["en", "de", "fr", "es"]


def request_texts(spark: SparkSession, sf: str) -> DataFrame:
    parts = []
    for template in _ROLE_FILTER.values():
        pieces = template.replace("{0}", "\x00lang\x00").replace("{1}", "\x00turn\x00").replace("{2}", "\x00conv\x00").split("\x00")
        lang = F.element_at(F.array(*map(F.lit, _LANGUAGES)), (F.col("conv_id") % 4 + 1).cast("int"))
        fields = {"conv": F.col("conv_id").cast("string"), "turn": F.col("turn").cast("string"), "lang": lang}
        parts.append(F.concat(*[fields.get(p, F.lit(p)) for p in pieces if p]))
    text = F.when(F.col("role") == "user", parts[0]).when(F.col("role") == "assistant", parts[1]).otherwise(parts[2])
    return data.table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws(" ", text, F.col("text")).alias("request"))


def _request_sql() -> str:
    def template(t: str) -> str:
        return "'" + t.replace("{0}", f"' || ({_LANGUAGES})[1 + conv_id % 4] || '").replace("{1}", "' || turn || '").replace("{2}", "' || conv_id || '") + "'"

    user, assistant, system = (template(t) for t in _ROLE_FILTER.values())
    return (f"SELECT conv_id, turn, CASE role WHEN 'user' THEN {user} WHEN 'assistant' THEN {assistant} ELSE {system} END || ' ' || text AS request FROM conversations")


_FIELDS = ["project_id", "dataset_id", "has_pii", "has_phi", "environment", "team"]
_NUMBERS = ["size_bytes", "monthly_cost_usd", "row_count"]


def _parsed(spark: SparkSession, sf: str, strict: bool) -> DataFrame:
    rows = requests.parse(request_texts(spark, sf), "request", strict)
    return rows.select("conv_id", "turn", *_FIELDS, *[f"{n}_{x}" for n in _NUMBERS for x in ("op", "value")], "semantic_query")


def parse_requests(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf, strict=True)


def parse_requests_loose(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf, strict=False)


def _parse_sql(patterns: dict[str, str], bound: str) -> str:
    """The same steps as nested selects: take a value, drop its text, go on with the rest."""
    sql = f"SELECT *, request AS rest FROM ({_request_sql()})"
    for name, regex in patterns.items():
        r = regex.replace("'", "''")
        if name.startswith("has_"):
            sql = (f"SELECT * REPLACE (CASE WHEN regexp_matches(request, '{r}') THEN regexp_replace(rest, '{r}', '', 'g') ELSE rest END AS rest),"
                   f" CASE WHEN regexp_matches(request, '{r}') THEN true END AS {name} FROM ({sql})")
        else:
            value = f"regexp_extract(request, '{r}', 1)"
            value = f"lower({value})" if name == "environment" else value
            sql = (f"SELECT * REPLACE (CASE WHEN regexp_extract(request, '{r}') <> '' THEN replace(rest, regexp_extract(request, '{r}'), '') ELSE rest END AS rest),"
                   f" nullif({value}, '') AS {name} FROM ({sql})")
    number = "\\s*([><]=?|=)\\s*\\$?([0-9.]+)\\s*(GB|MB|KB)?"
    from assayer.functions.fixed import NUMERIC_FILTER_KEYWORDS

    for name, words in NUMERIC_FILTER_KEYWORDS.items():
        first = ", ".join(f"nullif(regexp_extract(rest, '(?i){bound}{w}{number}'), '')" for w in words)
        sql = f"SELECT *, coalesce({first}) AS m FROM ({sql})"
        unit = f"CASE upper(regexp_extract(m, '(?i){number}', 3)) WHEN 'KB' THEN 1024.0 WHEN 'MB' THEN 1048576.0 WHEN 'GB' THEN 1073741824.0 ELSE 1.0 END"
        sql = (f"SELECT * EXCLUDE (m) REPLACE (CASE WHEN m IS NOT NULL THEN replace(rest, m, '') ELSE rest END AS rest),"
               f" nullif(regexp_extract(m, '{number}', 1), '') AS {name}_op, TRY_CAST(regexp_extract(m, '{number}', 2) AS DOUBLE) * {unit} AS {name}_value FROM ({sql})")
    columns = ", ".join([*_FIELDS, *[f"{n}_{x}" for n in _NUMBERS for x in ("op", "value")]])
    return f"SELECT conv_id, turn, {columns}, trim(regexp_replace(rest, '\\s+', ' ', 'g')) AS semantic_query FROM ({sql})"


PARSE_STRICT_SQL = _parse_sql(requests.STRICT, "\\b")
PARSE_LOOSE_SQL = _parse_sql(requests.LOOSE, "")

_MATCH_FIELDS = ["project_id", "dataset_id", "has_pii", "has_phi", "environment", "team"]


def request_match_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many assets each parsed request selects, by all its names and bounds."""
    parsed = requests.parse(request_texts(spark, sf), "request")
    counted = search.match_counts(parsed, data.document_assets(spark, sf), _MATCH_FIELDS, _NUMBERS)
    return counted.select("conv_id", "turn", "matches", "matched_rows")


_BOUND = "({q}_value IS NULL OR {q}_op IS NULL OR CASE {q}_op WHEN '>' THEN d.{n} > {q}_value WHEN '>=' THEN d.{n} >= {q}_value WHEN '<' THEN d.{n} < {q}_value WHEN '<=' THEN d.{n} <= {q}_value ELSE d.{n} = {q}_value END)"
REQUEST_MATCHES_SQL = f"""
    WITH q AS ({PARSE_STRICT_SQL}), d AS ({DOCS}),
    u AS (SELECT DISTINCT {', '.join(_MATCH_FIELDS)}, {', '.join(f'{n}_{x}' for n in _NUMBERS for x in ('op', 'value'))} FROM q),
    c AS (SELECT u.*, count(d.id) AS matches, CAST(coalesce(sum(d.row_count), 0) AS BIGINT) AS matched_rows FROM u LEFT JOIN d ON
      {' AND '.join(f'(u.{n} IS NULL OR u.{n} = d.{n})' for n in _MATCH_FIELDS)} AND {' AND '.join(_BOUND.format(q='u.' + n, n=n) for n in _NUMBERS)} GROUP BY ALL)
    SELECT conv_id, turn, matches, matched_rows FROM q JOIN c ON
      {' AND '.join(f'q.{n} IS NOT DISTINCT FROM c.{n}' for n in [*_MATCH_FIELDS, *[f'{n}_{x}' for n in _NUMBERS for x in ('op', 'value')]])}
"""

QUERIES = {
    "bm25_search": (bm25_search, BM25_SQL),
    "bm25_index_search": (bm25_index_search, BM25_SQL),
    "bm25_page": (bm25_page, BM25_PAGE_SQL),
    "term_index": (term_index, TERM_INDEX_SQL),
    "boosted_search": (boosted_search, BOOSTED_SQL),
    "hybrid_search": (hybrid_search, HYBRID_SQL),
    "filtered_assets": (filtered_assets, FILTERED_SQL),
    "highlighted_fields": (highlighted_fields, HIGHLIGHTED_SQL),
    "paged_search": (paged_search, PAGED_SQL),
    "paged_ascending": (paged_ascending, PAGED_ASCENDING_SQL),
    "paged_nulls": (paged_nulls, PAGED_NULLS_SQL),
    "search_response": (search_response, SEARCH_RESPONSE_SQL),
    "facets": (facets, FACETS_SQL),
    "order_facets": (order_facets, ORDER_FACETS_SQL),
    "group_topk": (group_topk, GROUP_TOPK_SQL),
    "similar_items": (similar_items, SIMILAR_SQL),
    "similar_for_references": (similar_for_references, SIMILAR_FOR_SQL),
    "hit_fields": (hit_fields, HIT_FIELDS_SQL),
    "hits_json": (hits_json, None),
    "hits_with_reports": (hits_with_reports, HITS_WITH_REPORTS_SQL),
    "asset_details": (asset_details, ASSET_DETAILS_SQL),
    "query_ready_hits": (query_ready_hits, QUERY_READY_SQL),
    "inspect_asset": (inspect_asset, INSPECT_SQL),
    "parse_requests": (parse_requests, PARSE_STRICT_SQL),
    "parse_requests_loose": (parse_requests_loose, PARSE_LOOSE_SQL),
    "request_match_counts": (request_match_counts, REQUEST_MATCHES_SQL),
}
