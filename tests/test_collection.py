import os

import pytest
from pyspark.sql import functions as F

from assayer.operators import collection, lineage, selection
from assayer.operators.search import hit_fields
from assayer.plans import data
from assayer.sources.tables import Asset

FOLDER = "/root/testdata/sf0.001"
NAMES = ["region", "nation", "labels", "benchmark"]


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("run"))
    broken = f"{root}-broken"
    os.makedirs(broken)
    with open(f"{broken}/part-0.parquet", "wb") as f:
        f.write(b"this is no parquet file")
    assets = [a for a in data.assets(FOLDER) if a.table_id in NAMES]
    assets += [Asset("lake", "sales", "gone", path=f"{root}-nowhere"), Asset("lake", "sales", "broken", path=broken), Asset("lake", "sales", "hidden", path=FOLDER, labels={"scan": "no"})]
    assets = [Asset(**(vars(a) | {"labels": a.labels or {"scan": "yes"}})) for a in assets]
    edges = spark.createDataFrame([("lake.sales.region", "lake.sales.nation", "reference")], lineage.EDGES)
    options = collection.CollectionOptions(batch=3, required_labels={"scan": "yes"})
    return collection.collect(spark, assets, root, "2024-02-01 00:00:00", edges, options), root


def test_unreadable_tables_stop_no_other(spark, run):
    done, _ = run
    found = {r.table_id: r for r in done.read(spark, "outcomes").collect()}
    assert {t for t, r in found.items() if r.outcome == "formatted"} == set(NAMES)
    assert {t for t, r in found.items() if r.outcome == "error"} == {"gone", "broken"} and found["gone"].error
    assert found["hidden"].outcome == "filtered"
    counted = selection.run_statistics(done.read(spark, "outcomes")).first()
    assert (counted.tables_formatted, counted.errors, counted.tables_filtered_by_label, counted.tables_scanned) == (4, 2, 1, 6)


def test_frames_hold_each_table_once(spark, run):
    done, _ = run
    for name in ("facts", "catalog", "reports", "documents"):
        key = "id" if name == "documents" else "table_id"
        rows = [r[0] for r in done.read(spark, name).select(key).collect()]
        assert len(rows) == len(set(rows)) == 4
    facts = {r.table_id: r.row_count for r in done.read(spark, "facts").collect()}
    assert facts == {n: data.table(spark, FOLDER, n).count() for n in NAMES}
    assert done.read(spark, "profile").groupBy("table_id", "column_name").count().filter("count > 1").count() == 0
    assert {(r.state, r.source.split(".")[-1]) for r in done.read(spark, "events").collect()} == {("COMPLETED", n) for n in NAMES} | {("FAILED", "gone"), ("FAILED", "broken")}


def test_a_hits_path_is_where_the_report_lies(spark, run):
    done, root = run
    rows = done.read(spark, "catalog").withColumns({"id": F.col("table_id"), "text": F.lit("x"), "score": F.lit(1.0)})
    hit = hit_fields(rows, "text", f"{root}/report_files").filter("table_id = 'nation'").first()
    text = "\n".join(r.value for r in spark.read.text(hit.report_path).collect())
    assert text.startswith("# sales.nation") and "region" in text


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """A run, a failed attempt at a second one, and both repeated."""
    root = str(tmp_path_factory.mktemp("runs"))
    two = [a for a in data.assets(FOLDER) if a.table_id in ("region", "nation")]
    collection.collect(spark, two, root, "2024-02-01 00:00:00")
    with pytest.raises(Exception):
        collection.collect(spark, two, root, "2024-02-02 00:00:00", edges=spark.createDataFrame([("a",)], "nothing string"))
    after_failure = {name: collection.committed(spark, root, name).count() for name in ("facts", "catalog", "reports", "documents", "outcomes")}
    collection.collect(spark, two[:1], root, "2024-02-01 00:00:00")
    collection.collect(spark, two, root, "2024-02-02 00:00:00")
    return root, after_failure


def test_a_failed_attempt_is_never_read(store):
    assert store[1] == dict.fromkeys(store[1], 2)


def test_a_repeated_run_replaces_itself(spark, store):
    root, _ = store
    for name in ("facts", "catalog", "reports", "outcomes", "assets"):
        rows = sorted((r.run_id, r.table_id) for r in collection.committed(spark, root, name).collect())
        assert rows == [("20240201000000", "region"), ("20240202000000", "nation"), ("20240202000000", "region")], name
    assert collection.committed(spark, root, "documents").count() == 3
    newest = collection.committed(spark, root, "catalog", newest_only=True).collect()
    assert {(r.run_id, r.table_id) for r in newest} == {("20240202000000", "region"), ("20240202000000", "nation")}
    paths = [p for p, _, names in os.walk(f"{root}/report_files") for n in names if n.endswith(".txt")]
    assert len(paths) == len(set(paths)) == 4


def test_the_run_table(spark, store):
    found = sorted((r.run_id, r.state, r.tables, r.formatted) for r in collection.runs(spark, store[0]).collect())
    first, second = "20240201000000", "20240202000000"
    assert found == [(first, "COMPLETED", 1, 1), (first, "COMPLETED", 2, 2), (second, "COMPLETED", 2, 2), (second, "FAILED", 2, 2)]
    for r in collection.runs(spark, store[0]).collect():
        assert r.started < r.ended and r.process == "discovery/collect" and bool(r.error) == (r.state == "FAILED")
    events = collection.committed(spark, store[0], "events").collect()
    assert len(events) == 3 and all(e.start_time < e.end_time for e in events)


def test_an_attempt_that_died_is_not_read(spark, tmp_path):
    root = str(tmp_path)
    assert collection.committed(spark, root, "facts") is None and collection.runs(spark, root).count() == 0
    done = collection.Collected(root, "r1", "a1")
    spark.range(3).write.parquet(done.folder("facts"))
    collection._record(spark, done, "RUNNING", collection.datetime.now(collection.UTC), None, [], [])
    assert collection.committed(spark, root, "facts") is None and collection.runs(spark, root).first().state == "RUNNING"


def test_run_ids_are_names_of_folders(spark, tmp_path):
    for bad in ("", "a/b", "../x", "a b", "a=b"):
        with pytest.raises(ValueError):
            collection.collect(spark, [], str(tmp_path), "2024-02-01 00:00:00", run_id=bad)


def test_a_missing_table_does_not_part_its_batch(spark, tmp_path, monkeypatch):
    batches, frames = [], collection._frames
    monkeypatch.setattr(collection, "_frames", lambda spark, assets, opts: batches.append(len(assets)) or frames(spark, assets, opts))
    assets = [a for a in data.assets(FOLDER) if a.table_id in ("region", "nation")]
    assets.insert(1, Asset("lake", "sales", "gone", path=str(tmp_path / "nowhere")))
    done = collection.collect(spark, assets, str(tmp_path / "run"), "2024-02-01 00:00:00")
    assert batches == [2] and {r.table_id: r.outcome for r in done.read(spark, "outcomes").collect()} == {"region": "formatted", "gone": "error", "nation": "formatted"}
