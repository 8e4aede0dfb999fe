import hashlib

from helpers import rows
import pytest
from pyspark.sql import functions as F

from assayer.functions import naming
from assayer.operators import catalog, lineage


def edges(spark, *pairs):
    return spark.createDataFrame([(s, t, "data_flow") for s, t in pairs], lineage.EDGES)


def test_walk_with_cycle_and_diamond(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "e"), ("b", "e"), ("x", "y"))
    assert rows(lineage.reach(e, ["a"], "downstream", 10)) == [("b", 1), ("c", 2), ("d", 1), ("e", 2)]
    assert rows(lineage.reach(e, ["e"], "upstream", 10)) == [("a", 2), ("b", 1), ("c", 3), ("d", 1)]
    assert rows(lineage.reach(e, ["a"], "downstream", 1)) == [("b", 1), ("d", 1)]
    assert lineage.reach(e, ["nowhere"]).count() == 0
    with pytest.raises(ValueError):
        lineage.reach(e, ["a"], max_depth=11)


def test_walk_is_a_fixpoint(spark):
    e = spark.range(200).selectExpr("string(id) AS source", "string((id * 7 + 3) % 50) AS target", "'x' AS edge_type")
    found = lineage.reach(e, ["11"], "downstream", 10).select("node")
    more = e.join(found, e.source == found.node).select("target").distinct()
    deepest = lineage.reach(e, ["11"], "downstream", 10).agg(F.max("depth")).first()[0]
    if deepest < 10:
        assert more.join(found.union(spark.createDataFrame([("11",)], "node string")), F.col("target") == F.col("node"), "left_anti").count() == 0


def test_hub_node(spark):
    e = spark.range(3000).selectExpr("'hub' AS source", "concat('t', id) AS target", "'x' AS edge_type").union(edges(spark, ("root", "hub")))
    found = lineage.reach(e, ["root"], "downstream", 3)
    assert found.count() == 3001 and found.filter("depth = 2").count() == 3000


def test_walks_of_many_roots(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "e"), ("b", "e"), ("x", "y"), ("a", "b"), (None, "z"), ("y", None))
    roots = spark.createDataFrame([("a", 10), ("a", 1), ("c", 1), ("x", None), ("nowhere", 3), (None, 2)], "root string, max_depth int")
    expected = [("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("a", "e", 2), ("c", "a", 1), ("x", "y", 1)]
    assert rows(lineage.reach_from(e, roots)) == expected
    # a hub of one edge each: every list is dealt into parts
    assert rows(lineage.reach_from(e, roots, hub=1)) == expected
    assert rows(lineage.reach_from(e, roots.select("root").filter("root = 'c'"), "upstream", 2)) == [("c", "a", 2), ("c", "b", 1)]
    assert lineage.reach_from(e, roots.limit(0)).count() == 0 and lineage.reach_from(e.limit(0), roots).count() == 0
    for wrong in (0, 11):
        with pytest.raises(ValueError):
            lineage.reach_from(e, spark.createDataFrame([("a", wrong)], "root string, max_depth int"))


def test_walks_of_many_roots_equal_single_walks(spark):
    e = spark.range(300).selectExpr("string(id % 60) AS source", "string((id * 7 + id DIV 60) % 60) AS target", "'x' AS edge_type")
    together = lineage.reach_from(e, spark.createDataFrame([("3",), ("17",)], "root string"), max_depth=3, hub=2)
    for root in ("3", "17"):
        assert rows(together.filter(F.col("root") == root).drop("root")) == rows(lineage.reach(e, [root]))


def test_a_walk_writes_no_copy_of_the_edges(spark, monkeypatch):
    written, cut = [], lineage.cut_lineage

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(lineage, "cut_lineage", counted)
    e = spark.range(5000).selectExpr("string(id % 700) AS source", "string(700 + id) AS target", "'x' AS edge_type")
    found = lineage.reach_from(e, spark.createDataFrame([("3",), ("17",)], "root string"))
    assert found.groupBy("root").count().count() == 2 and max(written) < 100


def test_graph_and_totals(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("z", "q"))
    nodes, inner = lineage.lineage_graph(e, "b")
    assert rows(nodes) == [("a", 1, "upstream"), ("b", 0, "root"), ("c", 1, "downstream")]
    assert rows(inner, "source", "target") == [("a", "b"), ("b", "c")]
    assert tuple(lineage.lineage_totals(nodes).first()) == (1, 1, 1)


QUERIES = [
    ("p.v.one", "SELECT * FROM `p.d.orders` o JOIN d.items i ON o.k = i.k -- FROM d.gone"),
    ("p.v.two", "select * from p-1.d.orders_archive where s = 'from d.fake'"),
    ("p.v.three", "SELECT 1 FROM `p`.`d`.`orders` JOIN `p.v.three` USING (k) /* JOIN\n d.never */"),
    ("p.v.four", "SELECT 1"),
]


@pytest.fixture(scope="module")
def views(spark):
    data = [(ref, "p", ref.split(".")[1], ref.split(".")[2], q) for ref, q in QUERIES]
    return spark.createDataFrame(data, "view_ref string, project_id string, dataset_id string, view_id string, view_query string")


def test_references_in_query_text(views):
    assert rows(lineage.extract_refs(views)) == [
        ("p.v.one", "p.d.items"), ("p.v.one", "p.d.orders"), ("p.v.three", "p.d.orders"), ("p.v.two", "p-1.d.orders_archive"),
    ]


def test_whole_names_and_substrings(spark, views):
    tables = spark.createDataFrame([("p.d.orders", "d", "orders"), ("p.d.items", "d", "items"), ("p.d.gone", "d", "gone")], "table_ref string, dataset_id string, table_id string")
    assert rows(lineage.view_dependencies(views, tables), "source", "target") == [
        ("p.d.items", "p.v.one"), ("p.d.orders", "p.v.one"), ("p.d.orders", "p.v.three"),
    ]
    found = rows(lineage.view_dependencies_by_substring(views, tables), "source", "target")
    brute = sorted(
        (t.table_ref, ref) for t in tables.collect() for ref, q in QUERIES if f"{t.dataset_id}.{t.table_id}" in q.lower()
    )
    assert found == brute
    assert ("p.d.orders", "p.v.two") in found and ("p.d.gone", "p.v.one") in found
    assert lineage.view_dependencies(views, tables, excluded=["v"]).count() == 0


def test_edges_are_cleaned(spark):
    raw = edges(
        spark, ("db:p.d.a", "db:p.d.b"), ("p.d.a", "p.d.b"), ("p.d.a", "db:p.d.a"), ("p.d.a", "gs://x/y"), ("p.d.a", "p/report.md"), ("gs://in/f", "p.d.a"),
    )
    assert rows(lineage.clean_edges(raw), "source", "target") == [("gs://in/f", "p.d.a"), ("p.d.a", "p.d.b")]


def test_coverage_and_links(spark):
    e = edges(spark, ("a", "b"), ("a", "c"), ("c", "d"))
    known = spark.createDataFrame([("a",), ("b",), ("e",)], "table_ref string")
    assert tuple(lineage.coverage(known, e).first()) == (3, 1, 1, 2, 1, 2, 66.67)
    assert rows(lineage.links_of(e, "c")) == [("a", "upstream"), ("d", "downstream")]


def test_job_events(spark):
    start, end = F.lit("2024-10-20 10:00:00").cast("timestamp"), F.lit("2024-10-20 10:05:00").cast("timestamp")
    events = lineage.job_events(edges(spark, ("a", "t"), ("a", "t"), ("b", "t")), "proc", "task", start, end, False)
    assert rows(events, "run_id", "state", "source", "target") == [
        ("proc/task/20241020T100000", "FAILED", "a", "t"), ("proc/task/20241020T100000", "FAILED", "b", "t"),
    ]


def test_names(spark):
    one = spark.range(1)
    p, d, t = F.lit("p"), F.lit("d"), F.lit("t")
    got = one.select(
        naming.table_fqn("db", p, d, t), naming.file_fqn("gs", F.lit("b"), F.lit("/x/y.md")), naming.strip_scheme(F.lit("db:p.d.t")),
        naming.strip_scheme(F.lit("gs://b/x")), naming.document_key(F.lit("a.b_c")),
    ).first()
    assert tuple(got) == ("db:p.d.t", "gs://b/x/y.md", "p.d.t", "gs://b/x", "a_b_c")
    kinds = spark.createDataFrame([("VIEW", None), ("EXTERNAL", "VIEW"), (None, "VIEW"), ("", None)], "t string, a string")
    assert rows(kinds.select(naming.asset_type(F.col("t")), naming.table_type_or_default(F.col("t"), F.col("a")))) == [
        ("TABLE", "EXTERNAL"), ("TABLE", "TABLE"), ("TABLE", "VIEW"), ("VIEW", "VIEW"),
    ]


def test_edges_of_several_types_keep_the_first_by_name(spark):
    raw = spark.createDataFrame([("p.d.a", "p.d.b", t) for t in ("view", "load", "copy")], lineage.EDGES)
    assert rows(lineage.clean_edges(raw.union(raw))) == [("p.d.a", "p.d.b", "copy")]


def test_the_whole_neighbourhood_of_a_hub(spark):
    edges = spark.range(1500).selectExpr("'p.d.hub' AS source", "concat('p.v.v', id) AS target", "'view' AS edge_type")
    parts = catalog.lineage_neighbours(edges, 100).filter("table_ref = 'p.d.hub'").collect()
    assert {r.total for r in parts} == {1500} and {r.parts for r in parts} == {15} and max(len(r.names) for r in parts) < 160
    assert sorted(n for r in parts for n in r.names) == sorted(f"p.v.v{i}" for i in range(1500))
    assert catalog.lineage_documents(edges, 1500).count() == 0 and catalog.lineage_documents(edges, 700).count() == 3


def test_the_digest_of_a_whole_neighbourhood(spark):
    hub = spark.range(25000).selectExpr("'p.d.hub' AS source", "concat('p.v.v', id) AS target", "'view' AS edge_type")
    found = catalog.neighbourhood_digests(catalog.lineage_neighbours(hub.union(edges(spark, ("a", "é"), ("a", "b"), ("a", "b"))), 100))
    names = sorted(f"p.v.v{i}" for i in range(25000))
    md5 = lambda *x: hashlib.md5(",".join(x).encode()).hexdigest()
    got = {(r.table_ref, r.direction): (r.n, r.total, r.digest) for r in found.collect()}
    assert len(got) == 25004 and got["p.d.hub", "downstream"] == (25000, 25000, md5(*names))
    assert got["a", "downstream"] == (3, 3, md5("b", "b", "é")) and got["b", "upstream"] == (2, 2, md5("a", "a")) and got["p.v.v7", "upstream"] == (1, 1, md5("p.d.hub"))


def test_texts_are_not_gathered_by_dataset(spark, views):
    tables = spark.createDataFrame([("p.d.orders", "d", "orders"), ("p.d.items", "d", "items")], "table_ref string, dataset_id string, table_id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lineage.view_dependencies_by_substring(views, tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not any("Exchange hashpartitioning(_ds" in line and "_tb" not in line and "_right" in line for line in plan.splitlines()) and "BroadcastHashJoin" in plan
