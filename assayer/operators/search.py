"""Search over a catalog or any document table: filters, ranking, boosts, paging, facets, similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
import re
import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from assayer.functions.display import snippet
from assayer.functions.fixed import BOOSTS, DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE
from assayer.functions.naming import report_path, run_id
from assayer.operators.ranking import top_ranked
from assayer.session import cut_lineage

K1, B = 1.2, 0.75

_COMPARE: dict[str, Callable[[Column, float], Column]] = {
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "=": lambda c, v: c == v,
}


@dataclass(frozen=True)
class SearchRequest:
    """What to look for. ``numeric`` holds (field, operator, value); None means no constraint, zero is a value."""

    query: str = ""
    project_id: str | None = None
    dataset_id: str | None = None
    table_id: str | None = None
    team: str | None = None
    environment: str | None = None
    has_pii: bool | None = None
    has_phi: bool | None = None
    min_row_count: float | None = None
    max_row_count: float | None = None
    min_cost: float | None = None
    max_cost: float | None = None
    tags: list[str] = field(default_factory=list)
    numeric: list[tuple[str, str, float]] = field(default_factory=list)
    sort_by: str | None = None
    descending: bool = True
    page_size: int = DEFAULT_PAGE_SIZE
    after: tuple | None = None


def predicate(request: SearchRequest) -> Column:
    """The structured filters as one condition, which the scan can push down."""
    parts: list[Column] = []
    for name in ("project_id", "dataset_id", "table_id", "team", "environment", "has_pii", "has_phi"):
        value = getattr(request, name)
        if value is not None:
            parts.append(F.col(name) == F.lit(value))
    bounds = [
        ("row_count", ">=", request.min_row_count), ("row_count", "<=", request.max_row_count),
        ("monthly_cost_usd", ">=", request.min_cost), ("monthly_cost_usd", "<=", request.max_cost),
    ]
    for name, op, value in [*bounds, *request.numeric]:
        if value is not None:
            parts.append(_COMPARE[op](F.col(name), value))
    if request.tags:
        parts.append(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in request.tags])))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


# --- ranking ----------------------------------------------------------------------------------


_WORD = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in any language."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def query_terms(query: str) -> list[str]:
    """The distinct words of a request's query, cut the same way as document text."""
    return sorted(set(re.findall(r"[^\W_]+", query.lower())))


def _idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def _weight(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * length / average))


def _occurrences(words: str, word: str) -> Column:
    return F.size(F.filter(words, lambda w: w == word))


def bm25(documents: DataFrame, query: str, key: str, text: str) -> DataFrame:
    """Documents with a word of the query and their BM25 score; an empty query keeps all with score 1.

    Nothing is exploded or shuffled per word: each document counts the query's few words in place. Document
    frequencies and the average length come from one aggregate that meets the rows as a scalar.
    """
    terms = query_terms(query)
    if not terms:
        return documents.withColumn("score", F.lit(1.0))
    whole_word = r"(?<![\p{L}\p{N}])(?:" + "|".join(terms) + r")(?![\p{L}\p{N}])"
    lowered = F.lower(F.col(text))

    def counted(df: DataFrame) -> DataFrame:
        found = df.withColumns({
            "_hits": F.regexp_extract_all(lowered, F.lit(whole_word), F.lit(0)),
            "_len": F.regexp_count(text, F.lit(_WORD)).cast("double"),
        })
        return found.withColumns({f"_tf{i}": _occurrences("_hits", w).cast("double") for i, w in enumerate(terms)})

    stats = counted(documents.select(text)).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.avg("_len").alias("avg_len"),
        *[F.count_if(F.col(f"_tf{i}") > 0).cast("double").alias(f"df{i}") for i in range(len(terms))],
    )
    scored = counted(documents.filter(lowered.rlike(whole_word))).withColumn("_s", stats.select(F.struct("*")).scalar())
    parts = [
        _idf(F.col("_s.n"), F.col(f"_s.df{i}")) * _weight(F.col(f"_tf{i}"), F.col("_len"), F.col("_s.avg_len"))
        for i in range(len(terms))
    ]
    return scored.select(*documents.columns, reduce(lambda a, b: a + b, parts).alias("score"))


def _postings(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Postings ``(term, key, tf, length)`` of each row: its words are counted where the row is, so repeats are never shuffled."""
    kind = documents.schema[key].dataType.simpleString()
    words = documents.select(F.col(key).alias("key"), tokens(F.col(text)).alias("words")).filter(F.size("words") > 0)
    # no word has a space
    words = words.select("key", F.array_join("words", " ").alias("words"), F.size("words").alias("length"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                lists = pc.split_pattern(some.column("words"), " ")
                each = pa.table({"row": pc.list_parent_indices(lists), "term": pc.list_flatten(lists)})
                found = each.group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
                row = found.column("row")
                out = [found.column("term"), some.column("key").take(row.combine_chunks()), found.column("count_all"), some.column("length").take(row.combine_chunks())]
                yield from pa.table(out, ["term", "key", "tf", "length"]).to_batches()

    return words.mapInArrow(run, f"term string, key {kind}, tf bigint, length int")


def build_index(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Postings ``(term, key, tf, length)``: write them partitioned or bucketed by term, and queries read few terms."""
    found = _postings(documents, key, text).withColumnRenamed("key", key)
    return found.groupBy("term", key).agg(F.sum("tf").alias("tf"), F.first("length").alias("length"))


def index_statistics(documents: DataFrame, text: str) -> DataFrame:
    """Document count and average length, the two corpus figures ranking needs."""
    return documents.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.regexp_count(text, F.lit(_WORD))).alias("avg_len"))


def _term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term), F.lit(buckets)).cast("int")


def write_index(documents: DataFrame, key: str, text: str, path: str, buckets: int = 64) -> None:
    """Postings in folders by a hash of the term, and the corpus figures: a query opens the folders of its words only."""
    postings = _postings(documents, key, text).withColumn("bucket", _term_bucket(F.col("term"), buckets))
    # a hot word's postings are spread over several tasks and files; all rows of a term and key meet in one of them, so one shuffle does
    dealt = postings.withColumn("_spread", F.pmod(F.xxhash64("key"), F.lit(8))).repartition("bucket", "_spread").withColumnRenamed("key", key)
    if not documents.groupBy(key).count().filter("count > 1").isEmpty():  # rows with one key are one document
        dealt = dealt.groupBy("bucket", "_spread", "term", key).agg(F.sum("tf").alias("tf"), F.first("length").alias("length"))
    dealt.select("term", key, "tf", "length", "bucket").write.partitionBy("bucket").parquet(f"{path}/postings")
    index_statistics(documents, text).withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/statistics")


def search_stored(spark: SparkSession, path: str, query: str, key: str, buckets: int = 64) -> DataFrame:
    """The scores of :func:`bm25` from a written index (with the number of buckets it was written with)."""
    words = sorted({zlib.crc32(t.encode()) % buckets for t in query_terms(query)})
    postings = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(words))
    return search_index(postings.drop("bucket"), spark.read.parquet(f"{path}/statistics"), query, key)


def search_index(postings: DataFrame, statistics: DataFrame, query: str, key: str) -> DataFrame:
    """The same scores as :func:`bm25`, from stored postings: only the query's terms are read."""
    hits = postings.filter(F.col("term").isin(query_terms(query)))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))  # at most one row per query word
    scored = hits.join(F.broadcast(df), "term").withColumn("_s", statistics.select(F.struct("n", "avg_len")).scalar())
    part = _idf(F.col("_s.n"), F.col("df")) * _weight(F.col("tf").cast("double"), F.col("length").cast("double"), F.col("_s.avg_len"))
    return scored.groupBy(key).agg(F.sum(part).alias("score"))


def boost(query: str, rules: list[tuple[str, float, list[str]]] = BOOSTS) -> Column:
    """The product of the boosts whose condition holds; rules with trigger words need one in the query."""
    lowered = query.lower()
    active = [(c, f) for c, f, words in rules if not words or any(w in lowered for w in words)]
    return reduce(lambda a, b: a * b, [F.when(F.expr(c), f).otherwise(1.0) for c, f in active], F.lit(1.0))


def highlighted(query: str, fields: list[str]) -> Column:
    """Names of the fields that contain a word of the query."""
    terms = query_terms(query)
    hits = [F.when(reduce(lambda a, b: a | b, [F.lower(f).contains(t) for t in terms], F.lit(False)), F.lit(f)) for f in fields]
    return F.array_compact(F.array(*hits))


def search(documents: DataFrame, request: SearchRequest, key: str, text: str, boosted: bool = True) -> DataFrame:
    """Filtered and ranked documents of a request, unsorted; :func:`page` cuts a page out of them."""
    ranked = bm25(documents.filter(predicate(request)), request.query, key, text)
    return ranked.withColumn("score", F.col("score") * boost(request.query)) if boosted else ranked


# --- pages, facets, groups --------------------------------------------------------------------


def page(
    rows: DataFrame, sort_by: str, key: str, descending: bool = True, size: int = DEFAULT_PAGE_SIZE, after: tuple | None = None
) -> DataFrame:
    """One page in a total order, with ``rank`` and ``has_more``.

    ``after`` is the (sort value, key) of the last row seen, so a deep page costs the same as the first; the value may be
    null, since rows without a sort value come last in either direction. The plan is a distributed top-k of one row more
    than the page.
    """
    if not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"a page has 1 to {MAX_PAGE_SIZE} rows")
    value = F.col(sort_by)
    if after is not None:
        last_key = F.col(key) > F.lit(after[1])
        if after[0] is None:
            rows = rows.filter(value.isNull() & last_key)
        else:
            last = F.lit(after[0])
            beyond = value < last if descending else value > last
            rows = rows.filter(beyond | value.isNull() | ((value == last) & last_key))
    order = [F.desc_nulls_last(sort_by) if descending else F.asc_nulls_last(sort_by), F.asc(key)]
    top = rows.orderBy(*order).limit(size + 1)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    more = ranked.withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) > size)
    return more.filter(F.col("rank") <= size)


def search_page(documents: DataFrame, request: SearchRequest, key: str, text: str) -> DataFrame:
    """The page a request asks for, by its own sort field or by score."""
    hits = search(documents, request, key, text)
    return page(hits, request.sort_by or "score", key, request.descending, request.page_size, request.after)


def response(documents: DataFrame, request: SearchRequest, key: str, text: str, facet_names: list[str] = [], boosted: bool = True) -> DataFrame:
    """A whole answer as one row: the page's hits in order, the total, the next page's token and the facets.

    The token is the (sort value, key) to pass as ``after``; it is null on the last page.
    """
    hits = search(documents, request, key, text, boosted)
    sort_by = request.sort_by or "score"
    shown = page(hits, sort_by, key, request.descending, request.page_size, request.after)
    entry = F.struct("rank", F.col(sort_by).cast("string").alias("sort_value"), F.col(key).alias("key"), "has_more")
    rows = shown.agg(F.sort_array(F.collect_list(entry)).alias("hits"))  # at most one page
    last = F.element_at(F.col("hits"), -1)
    out = rows.select(
        F.transform("hits", lambda h: h["key"]).alias("keys"),
        F.when((F.size("hits") > 0) & last["has_more"], F.struct(last["sort_value"].alias("sort_value"), last["key"].alias("key"))).alias("next_page"),
    ).withColumn("total", hits.agg(F.count(F.lit(1))).scalar())
    if facet_names:
        counted = facets(hits, facet_names).agg(F.sort_array(F.collect_list(F.struct("field", "rank", "value", "n"))))
        out = out.withColumn("facets", counted.scalar())
    return out


def facets(rows: DataFrame, names: list[str], k: int = 10) -> DataFrame:
    """The ``k`` most common values of every field over the given (filtered) rows."""
    pairs = F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in names]))
    counted = rows.select(pairs).filter(F.col("value").isNotNull()).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    return top_ranked(counted, Window.partitionBy("field").orderBy(F.desc("n"), "value"), k)


def group_top(rows: DataFrame, group_by: str, function: str = "count", value: str | None = None, k: int = 10) -> DataFrame:
    """The ``k`` largest groups by count, sum or average, with the number of groups there are."""
    if not 1 <= k <= 100:
        raise ValueError("k must lie between 1 and 100")
    measures = {"count": F.count(F.lit(1))}
    if value is not None:
        measures |= {"sum": F.sum(value), "avg": F.avg(value)}
    if function not in measures:
        raise ValueError("function must be count, or sum or avg with a value column")
    groups = rows.groupBy(group_by).agg(measures[function].alias("result"))
    top = groups.orderBy(F.desc("result"), group_by).limit(k)
    return top.withColumn("total_groups", groups.agg(F.count(F.lit(1))).scalar())


# --- hits -------------------------------------------------------------------------------------


def hit_fields(hits: DataFrame, text: str, reports_root: str | None = None) -> DataFrame:
    """Hits with title, snippet and the path of their report."""
    named = F.col("dataset_id").isNotNull() & F.col("table_id").isNotNull()
    title = F.when(named, F.concat_ws(".", "dataset_id", "table_id")).otherwise(F.col("id"))
    run = run_id(F.col("run_timestamp")) if "run_timestamp" in hits.columns else None
    below = report_path(run, F.col("project_id"), F.col("dataset_id"), F.col("table_id"))
    path = F.concat_ws("/", F.lit(reports_root), below) if reports_root else F.lit(None).cast("string")
    return hits.withColumns({"title": title, "snippet": snippet(F.col(text)), "report_path": F.when(named, path)})


def hits_as_json(hits: DataFrame, metadata: list[str]) -> DataFrame:
    """One JSON object per hit, null fields left out."""
    body = F.struct("id", "title", "score", F.struct(*metadata).alias("metadata"), "snippet")
    return hits.select("id", F.to_json(body).alias("hit"))


def with_report_text(hits: DataFrame, reports: DataFrame, text: str, keys: tuple[str, ...] = ("project_id", "dataset_id", "table_id")) -> DataFrame:
    """Hits without text take it from the report of the same asset; pass the run as a further key if reports of several runs are given."""
    keys = list(keys)
    found = reports.select(*keys, F.col("markdown").alias("_markdown"))
    filled = F.coalesce(F.when(F.length(text) > 0, F.col(text)), F.col("_markdown"))
    return hits.join(found, keys, "left").withColumn(text, filled).drop("_markdown")


def asset_details(documents: DataFrame, project: str, dataset: str, table: str, key: str, text: str) -> DataFrame:
    """The asset with this three-part name; if there is none, the best hit of a search for its name in its dataset."""
    exact = documents.filter(
        (F.col("project_id") == project) & (F.col("dataset_id") == dataset) & (F.col("table_id") == table)
    ).withColumns({"score": F.lit(0.0), "match": F.lit("exact")})
    request = SearchRequest(query=f"{dataset}.{table}", project_id=project, dataset_id=dataset)
    nearest = search(documents, request, key, text, boosted=False).withColumn("match", F.lit("search"))
    both = exact.unionByName(nearest)
    return both.orderBy(F.asc("match"), F.desc("score"), key).limit(1)


def similar(
    items: DataFrame, reference: Column, vector: str, key: str, threshold: float = 0.7, k: int = DEFAULT_PAGE_SIZE
) -> DataFrame:
    """Items whose vector has at least this cosine with the reference vector, best first.

    ``reference`` is one array (for instance a scalar subquery), so the items are scanned once and never
    paired with each other.
    """
    def total(pairs: Column) -> Column:
        return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)

    own, other = F.col(vector).cast("array<double>"), F.col("_ref").cast("array<double>")
    dot = total(F.zip_with(own, other, lambda a, b: a * b))
    norms = F.sqrt(total(F.transform(own, lambda a: a * a))) * F.sqrt(total(F.transform(other, lambda b: b * b)))
    scored = items.withColumn("_ref", reference).withColumn("similarity", F.try_divide(dot, norms)).drop("_ref")
    return scored.filter(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), key).limit(k)


# --- many requests at once --------------------------------------------------------------------

def _all_places(asked: DataFrame, known: DataFrame, numbers: list[str]) -> tuple[DataFrame, list[int]]:
    """``_number``, ``_value`` and ``_place`` of every number of both tables (a column for each of ``numbers``), and how many different ones are asked for.

    A number's place is odd on a number that is asked for, even between two. All numbers are sorted together in ranges; only
    one row for each range and column comes back to the driver, whose counts become the places at which the ranges begin.
    """
    def values(df: DataFrame, listed: int) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(i).alias("_number"), F.col(n).cast("double").alias("_value")) for i, n in enumerate(numbers)])
        return df.select(F.inline(pairs)).filter(F.col("_value").isNotNull()).withColumn("_listed", F.lit(listed))

    both = values(asked, 1).union(values(known, 0)).groupBy("_number", "_value").agg(F.max("_listed").cast("bigint").alias("_listed"))
    ranges = cut_lineage(both.repartitionByRange("_number", "_value").withColumn("_part", F.spark_partition_id()))
    found = ranges.groupBy("_number", "_part").agg(F.min("_value").alias("_first"), F.sum("_listed").alias("_n")).orderBy("_number", "_first").collect()
    begins, totals = [], [0] * len(numbers)
    for row in found:
        begins.append((row["_number"], row["_part"], totals[row["_number"]]))
        totals[row["_number"]] += row["_n"]
    begins = asked.sparkSession.createDataFrame(begins, "_number int, _part int, _begin bigint")
    upto = F.sum("_listed").over(Window.partitionBy("_number", "_part").orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = ranges.withColumn("_upto", upto).join(begins, ["_number", "_part"])
    return cut_lineage(counted.select("_number", "_value", ((F.col("_begin") + F.col("_upto")) * 2 - F.col("_listed")).alias("_place"))), totals


def _places(asked: DataFrame, known: DataFrame) -> tuple[DataFrame, int]:
    """``_value`` and ``_place`` of the numbers of one column."""
    found, (total,) = _all_places(asked.toDF("_n"), known.toDF("_n"), ["_n"])
    return found.drop("_number"), total


def _halved(first: Column, last: Column, levels: int) -> Column:
    """The few (level, node) whose places make up first..last; place p lies in node p >> level of each level."""
    start = F.struct(
        first.cast("bigint").alias("a"), (last + 1).cast("bigint").alias("b"),
        F.array().cast("array<struct<level:int,node:bigint>>").alias("nodes"),
    )

    def node(level: Column, x: Column, wanted: Column) -> Column:
        one = F.array(F.struct(level.cast("int").alias("level"), x.cast("bigint").alias("node")))
        return F.when(wanted, one).otherwise(F.array().cast("array<struct<level:int,node:bigint>>"))

    def step(state: Column, level: Column) -> Column:
        a, b = state["a"], state["b"]
        left, right = (a < b) & (a % 2 == 1), (a < b) & (b % 2 == 1)
        nodes = F.concat(state["nodes"], node(level, a, left), node(level, b - 1, right))
        return F.struct(
            F.shiftright(a + left.cast("bigint"), 1).alias("a"), F.shiftright(b - right.cast("bigint"), 1).alias("b"), nodes.alias("nodes")
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step, lambda state: state["nodes"])


def match_counts(requests: DataFrame, catalog: DataFrame, names: list[str], numbers: list[str] = []) -> DataFrame:
    """How many assets (and rows) each request's filters select, for a whole table of requests.

    A null filter means any value. ``names`` are compared for equality; of ``numbers`` a request has ``<name>_op`` and
    ``<name>_value``. The catalog is counted once by its names and by where its numbers lie among the numbers that requests
    name. Which filters occur together is known from the requests, so a count is kept for each such choice, and requests meet
    counts by equality: of their names, of the halved ranges that make up their first bound, and, inside these, of those that make
    up the second. So a bound meets a few counts for each halving, however many bounds and assets share a name; only a
    third bound is looked at count by count.
    """
    conditions = [*names, *[f"{n}_{x}" for n in numbers for x in ("op", "value")]]
    requests = cut_lineage(requests)  # parsed once: the plan below reads the conditions in several places
    counted = _counted_conditions(requests.select(*conditions).distinct(), catalog, names, numbers)
    counted = counted.withColumnsRenamed({c: f"_{c}" for c in conditions})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in conditions])
    zero = F.lit(0).cast("bigint")
    return requests.join(counted, same, "left").select(
        *requests.columns, F.coalesce("matches", zero).alias("matches"), F.coalesce("matched_rows", zero).alias("matched_rows")
    )


def _counted_conditions(distinct: DataFrame, catalog: DataFrame, names: list[str], numbers: list[str]) -> DataFrame:
    """``matches`` and ``matched_rows`` of each different choice of conditions that selects anything."""
    conditions = distinct.columns
    met = _met(distinct, catalog, names, numbers)
    return met.groupBy(*conditions).agg(F.sum("_n").alias("matches"), F.sum("_r").alias("matched_rows"))


def _met(distinct: DataFrame, catalog: DataFrame, names: list[str], numbers: list[str]) -> DataFrame:
    """The counts that each choice of conditions is made of, one row each."""
    conditions = distinct.columns
    filters = [F.col(n).isNotNull() for n in names] + [F.col(f"{n}_op").isNotNull() & F.col(f"{n}_value").isNotNull() for n in numbers]
    mask = reduce(lambda a, b: a + b, [F.when(f, F.lit(1 << i)).otherwise(0) for i, f in enumerate(filters)], F.lit(0))
    asked = distinct.withColumn("_mask", mask)
    masks = [r[0] for r in asked.select("_mask").distinct().collect()]  # at most 2 ** filters, whatever the number of requests
    values = [f"_v_{n}" for n in numbers]
    known = catalog.select(*names, F.col("row_count").alias("_rows"), *[F.col(n).cast("double").alias(f"_v_{n}") for n in numbers])
    known = known.groupBy(*names, *values).agg(F.count(F.lit(1)).alias("_n"), F.sum("_rows").alias("_r"))
    known, totals = cut_lineage(known) if numbers else known, []
    if numbers:
        places, totals = _all_places(distinct.select(*[F.col(f"{n}_value").alias(n) for n in numbers]), known.toDF(*names, *numbers, "_n", "_r"), numbers)

    def with_place(df: DataFrame, i: int, value: str, place: str) -> DataFrame:
        own = places.filter(F.col("_number") == i).select(F.col("_value").alias("_known"), F.col("_place").alias(place))
        return df.join(own, F.col(value).cast("double") == F.col("_known"), "left").drop("_known")

    def bounded(m: int) -> list[int]:
        return [i for i in range(len(numbers)) if m >> (len(names) + i) & 1]

    def has(i: int) -> Column:
        return F.col("_mask").bitwiseAND(F.lit(1 << i)) > 0

    alone = F.array(F.struct(F.lit(-1).alias("level"), F.lit(0).cast("bigint").alias("node")))

    def nodes(nth: int, of_number) -> Column:
        """Where a row meets others by its n-th bound: -1 without one."""
        choice = alone
        for m in masks:
            if len(bounded(m)) > nth:
                choice = F.when(F.col("_mask") == m, of_number(bounded(m)[nth])).otherwise(choice)
        return choice

    def spread(df: DataFrame, of_number) -> DataFrame:
        for nth in (0, 1):
            df = df.select("*", F.inline(nodes(nth, of_number))).withColumnsRenamed({"level": f"_level{nth}", "node": f"_node{nth}"})
        return df

    own = [f"_f{i}" for i in range(len(names))]

    def keyed(df: DataFrame) -> DataFrame:
        """Names that a choice does not ask for are null; a name that it asks for is never null."""
        return df.withColumns({f"_f{i}": F.when(has(i), F.col(n)) for i, n in enumerate(names)})

    levels = [(2 * total + 1).bit_length() for total in totals]
    third = lambda i: reduce(lambda a, b: a | b, [F.col("_mask") == m for m in masks if i in bounded(m)[2:]], F.lit(False))
    cells = known
    for i, n in enumerate(numbers):
        cells = with_place(cells, i, f"_v_{n}", f"_p{i}")
    place = [f"_p{i}" for i in range(len(numbers))]
    cells = cells.groupBy(*names, *place).agg(F.sum("_n").alias("_n"), F.sum("_r").alias("_r"))
    cells = keyed(cells.withColumn("_mask", F.explode(F.array(*[F.lit(m) for m in masks]) if masks else F.array().cast("array<int>"))))
    cells = cells.filter(reduce(lambda a, b: a & b, [~has(i) | F.col(f"_f{i}").isNotNull() for i in range(len(names))] + [~has(len(names) + i) | F.col(f"_p{i}").isNotNull() for i in range(len(numbers))], F.lit(True)))
    cells = cells.withColumns({f"_p{i}": F.when(has(len(names) + i), F.col(f"_p{i}")) for i in range(len(numbers))})
    cells = cells.groupBy("_mask", *own, *place).agg(F.sum("_n").alias("_n"), F.sum("_r").alias("_r"))
    up = lambda i: F.transform(F.array(*[F.lit(k) for k in range(levels[i] + 1)]), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", F.col(f"_p{i}"), k).alias("node")))
    cells = spread(cells, up).withColumns({f"_p{i}": F.when(third(i), F.col(f"_p{i}")) for i in range(len(numbers))})
    at = ["_level0", "_node0", "_level1", "_node1"]
    cells = cells.groupBy("_mask", *own, *at, *place).agg(F.sum("_n").alias("_n"), F.sum("_r").alias("_r"))

    wanted = keyed(asked)
    for i, n in enumerate(numbers):
        wanted = with_place(wanted, i, f"{n}_value", f"_on{i}")
        on, op = F.col(f"_on{i}"), F.col(f"{n}_op")
        wanted = wanted.withColumns({
            f"_a{i}": F.when(op == ">", on + 1).when(op.isin(">=", "="), on).otherwise(F.lit(0)),
            f"_b{i}": F.when(op == "<", on - 1).when(op.isin("<=", "="), on).otherwise(F.lit(2 * totals[i])),
        })
    wanted = spread(wanted, lambda i: _halved(F.col(f"_a{i}"), F.col(f"_b{i}"), levels[i]))
    wanted = wanted.withColumnsRenamed({c: f"_w{c}" for c in ["_mask", *own, *at]})
    equal = [F.col(f"_w{c}") == F.col(c) for c in ["_mask", *at]] + [F.col(f"_w{c}").eqNullSafe(F.col(c)) for c in own]
    inside = [~third(i) | F.col(f"_p{i}").between(F.col(f"_a{i}"), F.col(f"_b{i}")) for i in range(len(numbers))]
    met = wanted.join(cells, reduce(lambda a, b: a & b, equal)).filter(reduce(lambda a, b: a & b, inside, F.lit(True)))
    return met.select(*conditions, "_n", "_r")
