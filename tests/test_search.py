import math

from helpers import rows
import pytest
from pyspark.sql import functions as F

from assayer.operators import requests, search
from assayer.operators.search import SearchRequest

TEXTS = {
    "a": "Orders and orders of customers", "b": "customer orders, big ones", "c": "nothing to see", "d": "Größe der Kunden", "e": "", "f": None,
}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(TEXTS.items()), "id string, text string")


def brute_bm25(query):
    import re

    docs = {k: re.findall(r"[^\W_]+", v.lower()) if v is not None else None for k, v in TEXTS.items()}
    known = [d for d in docs.values() if d is not None]
    average, n = sum(map(len, known)) / len(known), len(docs)
    out = {}
    for key, words in docs.items():
        score = 0.0
        for t in set(re.findall(r"[^\W_]+", query.lower())):
            df = sum(t in (d or []) for d in docs.values())
            tf = (words or []).count(t)
            if tf:
                score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / average))
        if score:
            out[key] = round(score, 9)
    return out


@pytest.mark.parametrize("query", ["orders", "big ORDERS customers", "größe kunden", "missing"])
def test_bm25(texts, query):
    assert {r.id: round(r.score, 9) for r in search.bm25(texts, query, "id", "text").collect()} == brute_bm25(query)


def test_index_gives_the_same_scores(spark, texts, tmp_path):
    stats, index = search.index_statistics(texts, "text"), search.build_index(texts, "id", "text")
    direct = {r.id: round(r.score, 9) for r in search.bm25(texts, "big orders of", "id", "text").collect()}
    assert {r.id: round(r.score, 9) for r in search.search_index(index, stats, "big orders of", "id").collect()} == direct
    path = str(tmp_path / "index")
    search.write_index(texts, "id", "text", path, 16)
    stored = search.search_stored(spark, path, "big orders of", "id", 16)
    assert {r.id: round(r.score, 9) for r in stored.collect()} == direct
    plan = stored._jdf.queryExecution().optimizedPlan().toString() + stored._jdf.queryExecution().sparkPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan.split("term")[0]


def test_empty_query_keeps_all(texts):
    assert search.bm25(texts, "", "id", "text").filter("score = 1.0").count() == 6


@pytest.fixture(scope="module")
def assets(spark):
    data = [(f"t{i:02d}", "p" if i % 2 else "q", f"d{i % 3}", i * 10, float(i), i % 4 == 0, ["x"] if i % 5 == 0 else ["y", "z"]) for i in range(30)]
    return spark.createDataFrame(data, "id string, project_id string, dataset_id string, row_count bigint, monthly_cost_usd double, has_pii boolean, tags array<string>")


def test_filters_and_zero_bounds(assets):
    keep = lambda **k: assets.filter(search.predicate(SearchRequest(**k))).count()
    assert keep() == 30 and keep(project_id="p") == 15 and keep(has_pii=False) == 22
    assert keep(max_cost=0.0) == 1 and keep(min_cost=0.0) == 30 and keep(min_row_count=100, max_row_count=200) == 11
    assert keep(tags=["x"]) == 6 and keep(tags=["x", "z"]) == 30
    assert keep(numeric=[("row_count", ">", 280), ("row_count", "<=", 290)]) == 1 and keep(numeric=[("monthly_cost_usd", "=", 3.0)]) == 1


def test_pages_partition_the_result(assets):
    ties = assets.withColumn("row_count", F.floor(F.col("row_count") / 70))
    seen, after = [], None
    while True:
        page = search.page(ties, "row_count", "id", True, 7, after).orderBy("rank").collect()
        seen += [r.id for r in page]
        if not page[-1].has_more:
            break
        after = (page[-1].row_count, page[-1].id)
    assert seen == [r.id for r in ties.orderBy(F.desc("row_count"), "id").collect()]
    assert search.page(assets, "row_count", "id", size=100).count() == 30
    with pytest.raises(ValueError):
        search.page(assets, "row_count", "id", size=101)


@pytest.mark.parametrize("descending", [True, False])
def test_pages_lose_no_row_without_sort_value(spark, descending):
    df = spark.createDataFrame([("a", 5), ("b", None), ("c", 3), ("d", None), ("e", 1)], "id string, v int")
    seen, after = [], None
    while True:
        page = search.page(df, "v", "id", descending, 2, after).orderBy("rank").collect()
        seen += [r.id for r in page]
        if not page[-1].has_more:
            break
        after = (page[-1].v, page[-1].id)
    assert seen == (["a", "c", "e"] if descending else ["e", "c", "a"]) + ["b", "d"]


def test_response_has_total_token_and_facets(assets):
    request = SearchRequest(sort_by="row_count", page_size=20)
    first = search.response(assets, request, "id", "text", ["project_id"], boosted=False).first()
    assert first.total == 30 and len(first["keys"]) == 20 and first.next_page.key == first["keys"][-1]
    assert sum(f.n for f in first.facets) == 30
    last = search.response(assets, SearchRequest(sort_by="row_count", page_size=20, after=(int(first.next_page.sort_value), first.next_page.key)), "id", "text", boosted=False).first()
    assert last.next_page is None and len(last["keys"]) == 10 and not set(last["keys"]) & set(first["keys"])


def test_boosts(spark):
    rows_in = [("2024-01-01 00:00:00", "prod", 0.95, 200.0, 2_000_000), ("2023-12-31 23:59:59", "dev", 0.9, 50.0, 10), (None, None, None, None, None)]
    df = spark.createDataFrame(rows_in, "m string, environment string, completeness_score double, monthly_cost_usd double, row_count bigint").withColumn("last_modified", F.col("m").cast("timestamp"))
    got = [round(r[0], 6) for r in df.select(search.boost("plain query")).collect()]
    assert got == [2.34, 1.0, 1.0]
    got = [round(r[0], 6) for r in df.select(search.boost("Expensive and LARGE")).collect()]
    assert got == [7.02, 1.0, 1.0]


def test_facets_groups_and_hot_values(spark, assets):
    hot = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', string(id)) AS v")
    top = search.facets(hot, ["v"], k=1).first()
    assert (top.value, top.n, top["rank"]) == ("hot", 1000, 1)
    got = rows(search.group_top(assets, "dataset_id", "avg", "row_count", k=2), "dataset_id", "result", "total_groups")
    assert got == [("d1", 145.0, 3), ("d2", 155.0, 3)]
    with pytest.raises(ValueError):
        search.group_top(assets, "dataset_id", "sum")


def test_similar(spark):
    items = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0])], "k int, v array<float>")
    ref = items.filter("k = 0").select("v").scalar()
    got = [(r.k, round(r.similarity, 4)) for r in search.similar(items, ref, "v", "k", 0.5).collect()]
    assert got == [(0, 1.0), (1, 0.7071)]


def test_match_counts_against_brute_force(spark, assets):
    with_null = assets.withColumn("dataset_id", F.when(F.col("dataset_id") != "d2", F.col("dataset_id")))
    asked = spark.createDataFrame(
        [(1, "p", None, None), (2, None, "d1", True), (3, None, None, None), (4, "zz", None, None), (5, "q", "d0", False), (6, "p", None, None), (7, None, None, None)],
        "rid int, project_id string, dataset_id string, has_pii boolean",
    )
    names = ["project_id", "dataset_id", "has_pii"]
    got = {r.rid: (r.matches, r.matched_rows) for r in search.match_counts(asked, with_null, names).collect()}
    known = [r.asDict() for r in with_null.collect()]
    for r in asked.collect():
        hit = [a for a in known if all(r[n] is None or a[n] == r[n] for n in names)]
        assert got[r.rid] == (len(hit), sum(a["row_count"] for a in hit))
    assert len(got) == 7


def test_match_counts_with_bounds_against_brute_force(spark, assets):
    import itertools
    import random

    random.seed(6)
    ops = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b}
    asked = []
    for rid in range(120):
        bound = lambda values: (random.choice(list(ops)), random.choice(values)) if random.random() < 0.6 else (None, None)
        asked.append((rid, random.choice([None, "p", "q"]), random.choice([None, None, True]), *bound([0.0, 100.0, 150.0, 155.5, 290.0, 1e9]), *bound([-1.0, 3.0, 7.5, 30.0])))
    frame = spark.createDataFrame(asked, "rid int, project_id string, has_pii boolean, row_count_op string, row_count_value double, monthly_cost_usd_op string, monthly_cost_usd_value double")
    with_null = assets.withColumn("monthly_cost_usd", F.when(F.col("row_count") % 50 != 0, F.col("monthly_cost_usd")))
    got = {r.rid: (r.matches, r.matched_rows) for r in search.match_counts(frame, with_null, ["project_id", "has_pii"], ["row_count", "monthly_cost_usd"]).collect()}
    known = [r.asDict() for r in with_null.collect()]
    for rid, project, pii, o1, v1, o2, v2 in asked:
        hit = [
            a for a in known if project in (None, a["project_id"]) and pii in (None, a["has_pii"]) and (o1 is None or ops[o1](a["row_count"], v1))
            and (o2 is None or a["monthly_cost_usd"] is not None and ops[o2](a["monthly_cost_usd"], v2))
        ]
        assert got[rid] == (len(hit), sum(a["row_count"] for a in hit)), rid
    assert len(got) == len(asked) and len(set(itertools.chain(got.values()))) > 10


def test_places_of_many_numbers_come_from_ranges(spark):
    known = spark.range(0, 3000).selectExpr("id / 2.0D AS v")
    asked = spark.range(0, 1000).selectExpr("double(id) AS v").union(spark.createDataFrame([(None,)], "v double"))
    places, total = search._places(asked, known)
    got = {r[0]: r[1] for r in places.collect()}
    assert total == 1000 and len(got) == 3000
    assert all(p == 2 * min(-int(-v // 1), 1000) + (v < 1000 and v % 1 == 0) for v, p in got.items())
    assert places.filter("_value is null").count() == 0


def test_match_counts_sends_no_list_of_numbers(spark, assets):
    asked = spark.range(5000).selectExpr("id", "'>' AS row_count_op", "double(id) AS row_count_value")
    found = search.match_counts(asked, assets, [], ["row_count"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "scalar-subquery" not in plan
    counts = [r["row_count"] for r in assets.collect()]
    assert all(r.matches == sum(c > r.row_count_value for c in counts) for r in found.collect())


def test_bounds_of_one_name_meet_few_counts(spark):
    catalog = spark.range(20_000).selectExpr("'prod' AS environment", "id % 5000 AS row_count", "double(id % 777) AS monthly_cost_usd")
    asked = spark.range(10_000).selectExpr(
        "'prod' AS environment", "IF(id % 2 = 0, '>', '<=') AS row_count_op", "double(id % 5000) AS row_count_value", "IF(id % 4 < 2, '<', '>=') AS monthly_cost_usd_op",
        "IF(id % 3 = 0, double(id % 700), NULL) AS monthly_cost_usd_value",
    )
    numbers = ["row_count", "monthly_cost_usd"]
    distinct = asked.select("environment", *[f"{n}_{x}" for n in numbers for x in ("op", "value")])
    # a bound is made of at most 13 ranges, two bounds of 13 * 11; every request with every asset would be 200 million rows
    assert search._met(distinct, catalog, ["environment"], numbers).count() < 10_000 * 13 * 11 / 2
    got = search.match_counts(asked.withColumn("id", F.monotonically_increasing_id()), catalog, ["environment"], numbers)
    known = [(r[1], r[2]) for r in catalog.collect()]
    for r in got.orderBy(F.xxhash64("id")).limit(25).collect():
        want = [
            c for c, m in known if (c > r.row_count_value if r.row_count_op == ">" else c <= r.row_count_value)
            and (r.monthly_cost_usd_value is None or (m < r.monthly_cost_usd_value if r.monthly_cost_usd_op == "<" else m >= r.monthly_cost_usd_value))
        ]
        assert (r.matches, r.matched_rows) == (len(want), sum(want))


def parsed(spark, text, strict):
    df = requests.parse(spark.createDataFrame([(text,)], "q string"), "q", strict)
    return {k: v for k, v in df.first().asDict().items() if v is not None and k != "q"}


@pytest.mark.parametrize("text, strict, want", [
    ("find tables in project: my-project", False, {"project_id": "my-project", "semantic_query": "find tables in"}),
    ("find tables in dataset: analytics", True, {"dataset_id": "analytics", "semantic_query": "find tables in"}),
    ("find tables with PII data", False, {"has_pii": True, "semantic_query": "find tables with data"}),
    ("find tables with PII data", True, {"has_pii": True, "semantic_query": "find tables with"}),
    ("find tables in project:test-project dataset:analytics with PII", True,
     {"project_id": "test-project", "dataset_id": "analytics", "has_pii": True, "semantic_query": "find tables in with"}),
    ("Show me expensive tables (cost > $100)", True,
     {"monthly_cost_usd_op": ">", "monthly_cost_usd_value": 100.0, "semantic_query": "Show me expensive tables ()"}),
    ("dataset:analytics environment:PROD", True, {"dataset_id": "analytics", "environment": "prod", "semantic_query": ""}),
    ("customer tables with PHI", True, {"has_phi": True, "semantic_query": "customer tables with"}),
    ("dataset with PII", False, {"dataset_id": "with", "has_pii": True, "semantic_query": ""}),
    ("dataset with PII", True, {"has_pii": True, "semantic_query": "dataset with"}),
    ("project status tables", True, {"semantic_query": "project status tables"}),
    ("philadelphia graphics tables", False, {"has_phi": True, "semantic_query": "ladela gracs tables"}),
    ("philadelphia graphics tables", True, {"semantic_query": "philadelphia graphics tables"}),
    ("size >= 2GB rows<10 owner=ann", True,
     {"size_bytes_op": ">=", "size_bytes_value": 2 * 1024.0**3, "row_count_op": "<", "row_count_value": 10.0, "team": "ann", "semantic_query": ""}),
    ("tables with email@example.com", True, {"semantic_query": "tables with email@example.com"}),
    ("", True, {"semantic_query": ""}),
])
def test_request_texts(spark, text, strict, want):
    assert parsed(spark, text, strict) == want


def test_details_and_report_text(spark):
    docs = spark.createDataFrame(
        [("p.d.one", "p", "d", "one", "d one first"), ("p.d.two", "p", "d", "two", "")], "id string, project_id string, dataset_id string, table_id string, text string"
    ).withColumns({n: F.lit(None).cast(t) for n, t in (("last_modified", "timestamp"), ("environment", "string"))})
    assert tuple(search.asset_details(docs, "p", "d", "two", "id", "text").select("id", "match").first()) == ("p.d.two", "exact")
    assert tuple(search.asset_details(docs, "p", "d", "gone", "id", "text").select("id", "match").first()) == ("p.d.one", "search")
    reports = spark.createDataFrame(
        [("p", "d", "two", "# report"), ("q", "d", "two", "# of another project")], "project_id string, dataset_id string, table_id string, markdown string"
    )
    assert rows(search.with_report_text(docs, reports, "text"), "id", "text") == [("p.d.one", "d one first"), ("p.d.two", "# report")]
    hits = search.hit_fields(docs.withColumn("score", F.lit(1.0)), "text", "root")
    assert rows(hits, "title", "snippet", "report_path") == [
        ("d.one", "d one first", "root/project_id=p/dataset_id=d/table_id=one"), ("d.two", "No content available", "root/project_id=p/dataset_id=d/table_id=two"),
    ]
    assert search.hits_as_json(hits, ["project_id", "environment"]).filter("id = 'p.d.one'").first().hit == (
        '{"id":"p.d.one","title":"d.one","score":1.0,"metadata":{"project_id":"p"},"snippet":"d one first"}'
    )
    assert docs.select(F.array_join(search.highlighted("one P", ["table_id", "text", "id"]), ",")).first()[0] == "table_id,text,id"


def test_repeats_of_a_word_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "to be, or not TO be"), (1, "to"), (None, "be"), (3, None), (4, "")], "id long, text string")
    assert "HashAggregate" not in search._postings(docs, "id", "text")._jdf.queryExecution().executedPlan().toString()
    found = {(r.id, r.term): (r.tf, r.length) for r in search.build_index(docs.filter("id IS NULL OR text <> 'to'"), "id", "text").collect()}
    assert found == {(1, "to"): (2, 6), (1, "be"): (2, 6), (1, "or"): (1, 6), (1, "not"): (1, 6), (None, "be"): (1, 1)}
    assert {r.tf for r in search.build_index(docs, "id", "text").filter("term = 'to'").collect()} == {3}
