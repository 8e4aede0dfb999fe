import datetime as dt

from helpers import rows
import pytest
from pyspark.sql import functions as F

from assayer import schemas
from assayer.operators import catalog, lineage, quality, report, selection, usage
from assayer.sources import documents as docs
from assayer.sources import tables as src
from assayer.sources.views import catalog_views

T0 = dt.datetime(2024, 1, 1)


def test_label_truth_table(spark):
    cases = [
        ("a", None, "true", True), ("b", "false", "true", False), ("c", "true", None, True), ("d", None, None, False),
        ("e", "maybe", "TRUE", False), ("f", None, "True", True), ("g", "TRUE", "false", True),
    ]
    tables = spark.createDataFrame([(i, {"skip": c} if c else {"Skip": "true"}) for i, c, _, _ in cases], "dataset_id string, labels map<string,string>")
    sets = spark.createDataFrame([(i, {"skip": p} if p else None) for i, _, p, _ in cases], "dataset_id string, labels map<string,string>")
    decided = selection.with_label_decision(tables, sets, "skip", ["dataset_id"])
    assert rows(decided, "dataset_id", "skip") == [(i, want) for i, _, _, want in cases]


def test_unreadable_table_labels_fall_back_to_the_dataset(spark):
    tables = spark.createDataFrame([("x", None)], "dataset_id string, labels map<string,string>")
    sets = spark.createDataFrame([("x", {"skip": "true"})], "dataset_id string, labels map<string,string>")
    assert selection.with_label_decision(tables, sets, "skip", ["dataset_id"]).first().skip is True


def test_selection(spark):
    assets = src.inventory(spark, [
        src.Asset("p", "sales", "b"), src.Asset("p", "sales_staging", "c"), src.Asset("p", "temp_x", "d"), src.Asset("p", "sales", "v", table_type="VIEW"), src.Asset("p", "sales", "a"),
    ])
    assert rows(selection.select_assets(assets), "table_id") == [("a",), ("b",), ("v",)]
    assert rows(selection.select_assets(assets, include_views=False, max_tables=1), "table_id") == [("a",)]


def orders(spark, *data):
    return spark.createDataFrame(list(data), "id string, v int, version int")


def newest():
    return [F.desc("version"), F.desc("v")]


def test_upsert_is_idempotent_and_keeps_the_newest_copy(spark):
    old = orders(spark, ("a", 1, 0), ("b", 2, 0))
    new = orders(spark, ("b", 3, 1), ("b", 4, 2), ("c", 5, 1))
    once = catalog.upsert(old, new, "id", newest())
    assert rows(once) == [("a", 1, 0), ("b", 4, 2), ("c", 5, 1)]
    assert rows(catalog.upsert(once, new, "id", newest())) == rows(once)
    assert rows(catalog.upsert_outcome(old, new, "id")) == [("b", "updated"), ("c", "created")]
    assert rows(catalog.reconcile(old, new, "id", newest(), "FULL")) == [("b", 4, 2), ("c", 5, 1)]
    assert rows(catalog.reconcile(old, new, "id", newest(), "INCREMENTAL")) == rows(once)
    with pytest.raises(ValueError):
        catalog.reconcile(old, new, "id", newest(), "OTHER")
    assert rows(catalog.delete(old, new, "id")) == [("a", 1, 0)]


def test_hot_id_is_one_row(spark):
    hot = spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', string(id)) AS id", "int(id) AS v", "int(id) AS version")
    kept = catalog.latest_per_key(hot, ["id"], newest())
    assert kept.filter("id = 'hot'").first().version == 4998 and kept.count() == 5000 - 1667 + 1


def test_collisions(spark):
    ids = spark.createDataFrame([("a.b_c",), ("a_b.c",), ("a.b_c",), ("x.y",)], "id string")
    assert rows(catalog.id_collisions(ids)) == [("a_b_c", 2, "a.b_c", "a_b.c")]


def test_diff(spark):
    before = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("c", 3, "y")], "k string, n int, s string")
    after = spark.createDataFrame([("a", 1, None), ("b", 5, None), ("d", 4, "z")], "k string, n int, s string")
    assert rows(catalog.diff(before, after, ["k"], ["n", "s"])) == [("b", "changed", "n,s"), ("c", "removed", None), ("d", "added", None)]


def catalog_row(spark, run, **over):
    row = {f.name: None for f in spark.createDataFrame([], schemas.CATALOG).schema.fields}
    row |= {"table_id": "t", "project_id": "p", "dataset_id": "d", "table_type": "TABLE", "run_timestamp": run, "insert_timestamp": run,
            "schema": [], "labels": [], "analytical_insights": [], "lineage": [], "column_profiles": [], "key_metrics": []} | over
    return tuple(row.values())


def test_versions_on_disk(spark, tmp_path):
    path = str(tmp_path / "catalog")
    for day, n in ((0, 1), (0.1, 2), (5, 3)):
        run = T0 + dt.timedelta(days=day)
        catalog.append(spark.createDataFrame([catalog_row(spark, run, row_count=n), catalog_row(spark, run, table_id="u", row_count=n)], schemas.CATALOG), path)
    stored = catalog.read(spark, path)
    newest = catalog.latest(stored)
    assert rows(newest, "table_id", "row_count") == [("t", 3), ("u", 3)] and "run_timestamp" not in newest.columns
    assert rows(catalog.latest(stored, as_of=F.lit(T0 + dt.timedelta(days=1))), "row_count") == [(2,), (2,)]
    assert rows(catalog.latest_per_key(stored, ["table_id"], [F.desc("run_timestamp")]), "table_id", "row_count") == [("t", 3), ("u", 3)]
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_date" in plan.replace("\n", " ")


def test_lineage_arrays_keep_totals_beyond_the_limit(spark):
    e = spark.range(50).selectExpr("concat('s', lpad(id, 2, '0')) AS source", "'hub' AS target", "'x' AS edge_type")
    got = catalog.lineage_arrays(e, limit=3).filter("table_ref = 'hub'").first()
    assert got.upstream == ["s00", "s01", "s02"] and got.upstream_total == 50 and got.downstream is None and got.downstream_total is None


def test_health_checks(spark):
    good = spark.createDataFrame([catalog_row(spark, T0, row_count=1), catalog_row(spark, T0)], schemas.CATALOG)
    assert quality.health_checks(good, ["table_id", "run_timestamp"], ["TABLE"]).filter("not passed").count() == 0
    bad = good.union(spark.createDataFrame([catalog_row(spark, T0 + dt.timedelta(days=1), table_id=None, table_type="X", row_count=-1)], schemas.CATALOG))
    checked = {r.rule: r.violations for r in quality.health_checks(bad, ["table_id"], ["TABLE"]).collect()}
    assert checked == {"table_id is set": 1, "table_type is known": 1, "counts are not negative": 1, "one run timestamp": 1}


def test_document_checks(spark):
    data = [("a", " \n", None), ("b", "x" * 100_001, None), ("c", "ok", "yesterday"), ("d", "x" * 100_000, "2024-01-01T00:00:00Z"), ("e", None, None)]
    checked = quality.check_documents(spark.createDataFrame(data, "id string, text string, at string"), "text", ["at"])
    assert rows(checked, "id", "reject_reason") == [("a", "empty text"), ("b", "text too long"), ("c", "at is no timestamp"), ("d", None), ("e", "empty text")]


LINES = [
    '{"id": "a.b_c", "structData": {"row_count": 5, "unknown": 1}, "content": {"text": "x"}}', '{"id": "broken', "", "   ",
    '{"structData": {}}', '{"id": ""}', '[{"id": "list"}]', '"text"', '{"id": "a.b_c"}', '{"id": "old"}', '{"id": "new"}',
]


def test_jsonl_ingest(spark, tmp_path):
    path = str(tmp_path / "in.jsonl")
    with open(path, "w") as f:
        f.write("\n".join(LINES))
    parsed = docs.read_jsonl(spark, path)
    states = parsed.groupBy("state").count()
    assert rows(states) == [("blank", 2), ("failed", 3), ("ok", 4), ("skipped", 2)]
    known = spark.createDataFrame([("old",), ("old",)], "id string")
    assert docs.ingest_summary(parsed, known).first().asDict() == {"total": 9, "created": 2, "updated": 2, "failed": 3, "skipped": 2}
    assert docs.ingest_summary(parsed, known, upsert=False).first().asDict() == {"total": 9, "created": 2, "updated": 0, "failed": 3, "skipped": 4}
    assert parsed.filter("id = 'a.b_c' AND structData IS NOT NULL").first().structData.row_count == 5


def test_jsonl_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    made = docs.parse_lines(spark.createDataFrame([(LINES[0],)], "value string")).select("id", "structData", "content")
    docs.write_jsonl(made, path)
    assert spark.read.text(path).first()[0] == '{"id":"a.b_c","structData":{"row_count":5},"content":{"text":"x"}}'
    assert rows(docs.read_jsonl(spark, path), "id", "state") == [("a.b_c", "ok")]


def test_files_as_documents(spark, tmp_path):
    (tmp_path / "one.html").write_text("<html><title>A &amp; B</title><script>x()</script><body><!-- no -->Hi&nbsp;<b>there</b> &lt;you&gt;</body></html>")
    got = docs.read_files(spark, str(tmp_path / "*.html"), html=True).first()
    assert (got.id, got.title, got.text) == ("one.html", "A & B", "Hi there <you>")
    (tmp_path / "two.txt").write_text("line\nline")
    assert docs.read_files(spark, str(tmp_path / "*.txt")).first().text == "line\nline"


def test_views_and_tables_of_the_session_catalog(spark, tmp_path):
    spark.sql(f"CREATE TABLE IF NOT EXISTS default.base_rows USING parquet LOCATION '{tmp_path}/base' AS SELECT 1 AS id, 'a' AS name")
    spark.sql("CREATE OR REPLACE VIEW default.base_view AS SELECT id FROM default.base_rows")
    try:
        views = catalog_views(spark, "p").filter("view_id = 'base_view'")
        assert "base_rows" in views.first().view_query
        known = spark.createDataFrame([("p.default.base_rows",)], "table_ref string")
        assert rows(lineage.view_dependencies(views, known), "source", "target") == [("p.default.base_rows", "p.default.base_view")]
        listed = {a.table_id: a.table_type for a in src.list_catalog(spark, "p")}
        assert listed["base_view"] == "VIEW" and listed["base_rows"] in ("TABLE", "EXTERNAL")
        facts = src.file_facts(spark, src.Asset("p", "default", "base_rows", path=f"{tmp_path}/base")).first()
        assert facts.size_bytes > 0 and facts.file_count >= 1
    finally:
        spark.sql("DROP VIEW default.base_view")
        spark.sql("DROP TABLE default.base_rows")


def test_volatility(spark):
    cases = [("VIEW", True, 0.1, "low", "7d"), ("TABLE", True, 0.1, "medium", "24h"), ("TABLE", False, 0.5, "high", "1h"),
             ("TABLE", None, 12.0, "medium", "24h"), ("TABLE", False, 48.0, "low", "7d"), ("TABLE", False, None, "low", "7d")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, p boolean, h double, want string, ttl string")
    kind = usage.volatility(F.col("t"), F.col("p"), F.col("h"))
    assert df.filter((kind != F.col("want")) | (usage.cache_ttl(kind) != F.col("ttl"))).count() == 0


def test_rollup_and_inspect(spark):
    rows_in = [("p", "d1", "a", 10, 100, 1.5, True, False), ("p", "d1", "b", None, None, None, False, None), ("p", "d2", "c", 5, 50, 0.5, False, False)]
    df = spark.createDataFrame(rows_in, "project_id string, dataset_id string, table_id string, row_count bigint, size_bytes bigint, monthly_cost_usd double, has_pii boolean, has_phi boolean")
    assert rows(catalog.dataset_rollup(df)) == [("p", "d1", 2, 10, 100, 1.5, True, False), ("p", "d2", 1, 5, 50, 0.5, False, False)]
    priced = df.withColumns({"storage_cost_usd": F.col("monthly_cost_usd"), "query_cost_usd": F.lit(0.0)})
    assert rows(catalog.cost_rollup(priced), "project_id", "dataset_id", "level", "monthly_cost_usd") == [
        ("p", "d1", 0, 1.5), ("p", "d2", 0, 0.5), ("p", None, 1, 2.0), (None, None, 3, 2.0),
    ]
    assert rows(catalog.dataset_tables(df)) == [("p", "d1", "a"), ("p", "d1", "b"), ("p", "d2", "c")]
    asset = df.withColumn("table_ref", F.concat_ws(".", "project_id", "dataset_id", "table_id"))
    e = spark.createDataFrame([("s", "p.d1.a", "x"), ("q", "r", "x")], lineage.EDGES)
    got = catalog.inspect(asset, "p.d1.a", edges=e).first()
    assert got.upstream == ["s"] and got.downstream is None and "query_count" not in got


def test_run_statistics(spark):
    data = [("p", "a", "formatted", True), ("p", "a", "error", False), ("p", "b", "filtered", False), ("q", "b", "formatted", False)]
    got = selection.run_statistics(spark.createDataFrame(data, "project_id string, dataset_id string, outcome string, description_generated boolean")).first()
    assert tuple(got) == (2, 3, 3, 2, 1, 1, 1)


def test_reports_are_written_per_table(spark, tmp_path):
    made = spark.createDataFrame([catalog_row(spark, T0, row_count=7), catalog_row(spark, T0, table_id="u")], schemas.CATALOG)
    path = str(tmp_path / "reports")
    report.write_reports(report.reports(made), path)
    back = spark.read.text(path, wholetext=True)
    assert rows(back.filter("table_id = 't'"), "run", "project_id", "dataset_id") == [("20240101T000000", "p", "d")]
    assert "# d.t" in back.filter("table_id = 't'").first().value
