import os

from helpers import rows
import pytest
from pyspark.sql import functions as F

from assayer.operators import bucketed, catalog

def order():
    return [F.desc("version"), F.desc("amount")]

SCHEMA = "id string, amount double, version int"


def frame(spark, *found):
    return spark.createDataFrame(list(found), SCHEMA)


def files(folder):
    return {os.path.join(p, n) for p, _, names in os.walk(f"{folder}/data") for n in names if n.endswith(".parquet")}


def read_files(df):
    return {f.split("/data/")[1] for f in df.inputFiles()}


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    documents = spark.range(200).selectExpr("concat('d', id) AS id", "double(id) AS amount", "0 AS version")
    assert bucketed.load(documents, "id", path, order(), bucket_rows=20) == 0
    return path


def test_same_as_a_rewritten_table(spark, store):
    current = bucketed.read(spark, store)
    assert current.count() == 200
    batches = [
        spark.range(150, 260).selectExpr("concat('d', id % 230) AS id", "double(id * 2) AS amount", "int(id % 3) AS version"),
        frame(spark, ("d1", 5.0, 1), ("d1", 7.0, 1), ("new", None, None), ("d2", None, 4)),
    ]
    plain = current
    for n, batch in enumerate(batches, start=1):
        plain = catalog.upsert(plain, batch, "id", order())
        assert bucketed.upsert(batch, store, order()) == n
        assert rows(bucketed.read(spark, store)) == rows(plain)
    ids = spark.createDataFrame([("d1",), ("d199",), ("nobody",), (None,), ("d1",)], "id string")
    bucketed.delete(ids, store)
    plain = catalog.delete(plain, ids.filter("id IS NOT NULL"), "id")
    assert rows(bucketed.read(spark, store)) == rows(plain)
    # what was deleted can come back, and older versions stay as they were
    bucketed.upsert(frame(spark, ("d1", 1.5, 9)), store, order())
    assert rows(bucketed.read(spark, store).filter("id = 'd1'")) == [("d1", 1.5, 9)]
    assert bucketed.read(spark, store, as_of=0).count() == 200
    assert rows(bucketed.read(spark, store, as_of=3)) == rows(plain)
    assert rows(bucketed.versions(spark, store), "version", "kind", "n_rows") == [(0, "full", 200), (1, "upsert", 110), (2, "upsert", 3), (3, "delete", 3), (4, "upsert", 1)]


def test_untouched_buckets_keep_their_files(spark, store):
    before = files(store)
    bucketed.upsert(frame(spark, ("d7", 1.0, 1)), store, order())
    now = bucketed.read(spark, store)
    expected = rows(now)
    added = files(store) - before
    assert len(added) == 1 and before <= files(store)
    assert bucketed.compact(spark, store, share=0.9) == 0
    assert bucketed.compact(spark, store, share=0.01) == 1
    after = bucketed.read(spark, store)
    assert rows(after) == expected
    # one bucket's files are others now; those of the other buckets are the same
    old, new = {f for f in read_files(now)}, {f for f in read_files(after)}
    assert {f.split("/")[1] for f in new - old} == {f.split("/")[1] for f in old - new} and len(new - old) == 1
    assert bucketed.compact(spark, store) == 0


def test_changes_after_a_compaction(spark, store):
    bucketed.upsert(spark.range(0, 200, 3).selectExpr("concat('d', id) AS id", "-1D AS amount", "1 AS version"), store, order())
    bucketed.compact(spark, store, share=0.0)
    bucketed.delete(spark.range(0, 200, 6).selectExpr("concat('d', id) AS id"), store)
    bucketed.upsert(frame(spark, ("d3", 3.5, 2)), store, order())
    found = bucketed.read(spark, store)
    assert found.count() == 200 - 34
    assert found.filter("amount = -1").count() == 32 and rows(found.filter("id = 'd3'")) == [("d3", 3.5, 2)]


def test_whole_buckets_can_be_emptied(spark, store):
    bucketed.delete(bucketed.read(spark, store).select("id"), store)
    assert bucketed.read(spark, store).count() == 0
    assert bucketed.compact(spark, store) > 0
    assert bucketed.read(spark, store).count() == 0
    bucketed.upsert(frame(spark, ("x", 1.0, 1)), store, order())
    assert rows(bucketed.read(spark, store)) == [("x", 1.0, 1)]


def test_a_failed_write_is_never_read(spark, store):
    with pytest.raises(Exception, match="could not be found again"):
        bucketed.upsert(frame(spark, ("d1", 99.0, 9), (None, 1.0, 1)), store, order())
    assert bucketed.read(spark, store).filter("amount = 99 AND version = 9").count() == 0
    assert bucketed.versions(spark, store).count() == 1


def test_new_columns_empty_batches_and_full_loads(spark, store):
    bucketed.upsert(frame(spark).limit(0), store, order())
    bucketed.delete(frame(spark).select("id"), store)
    assert bucketed.read(spark, store).count() == 200
    bucketed.upsert(frame(spark, ("d5", 1.0, 1)).withColumn("owner", F.lit("me")), store, order())
    found = bucketed.read(spark, store)
    assert found.columns == ["id", "amount", "version", "owner"] and found.count() == 200
    assert rows(found.filter("owner IS NOT NULL"), "id", "owner") == [("d5", "me")]
    bucketed.load(frame(spark, ("only", 1.0, 1), ("only", 2.0, 1)), "id", store, order())
    assert rows(bucketed.read(spark, store)) == [("only", 2.0, 1)]


def test_empty_store(spark, tmp_path):
    path = str(tmp_path / "empty")
    with pytest.raises(ValueError, match="holds no documents"):
        bucketed.read(spark, path)
    bucketed.load(frame(spark).limit(0), "id", path, order())
    assert bucketed.read(spark, path).count() == 0
    bucketed.upsert(frame(spark, ("a", 1.0, 1)), path, order())
    assert rows(bucketed.read(spark, path)) == [("a", 1.0, 1)]
