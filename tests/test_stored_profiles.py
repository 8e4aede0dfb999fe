"""Profiles kept by data file and merged."""

import datetime

import pytest
from helpers import rows
from pyspark.sql import functions as F

from assayer.operators import stored_profiles as sp
from assayer.operators.profile import profile_table, store_profile, stored_profile

SCHEMA = "id long, amount double, name string, flag boolean, day date, tags array<string>, `odd name` int"


def table(spark, first, n):
    data = [
        (
            i, None if i % 7 == 0 else i / 4 - 10, None if i % 5 == 0 else "n" * (i % 9), i % 2 == 0, datetime.date(2024, 1, 1 + i % 28),
            None if i % 11 == 0 else ["a"] * (i % 4), None,
        )
        for i in range(first, first + n)
    ]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture
def grown(spark, tmp_path):
    path, store = str(tmp_path / "my table"), str(tmp_path / "store")
    table(spark, 0, 300).repartition(3).write.parquet(path)
    first = sp.refresh(spark, path, store, "t")
    table(spark, 300, 50).coalesce(1).write.mode("append").parquet(path)
    return path, store, first


def test_second_refresh_reads_new_files_only(spark, grown):
    path, store, first = grown
    assert first == sp.Refreshed(3, 0, 0)
    assert sp.refresh(spark, path, store, "t") == sp.Refreshed(1, 3, 0)
    assert sp.refresh(spark, path, store, "t") == sp.Refreshed(0, 4, 0)


def test_merge_equals_a_full_profile(spark, grown):
    path, store, _ = grown
    sp.refresh(spark, path, store, "t")
    found = sp.merged(spark, path, store, "t")
    full = profile_table(spark.read.parquet(path), "t")
    assert found.columns == full.columns
    exact = ["column_name", "ordinal", "data_type", "profile_type", "total_rows", "null_count", "null_percentage", "min", "max", "min_length", "max_length", "min_value", "max_value"]
    assert rows(found, *exact) == rows(full, *exact)
    near = {r.column_name: r for r in full.collect()}
    distinct = spark.read.parquet(path).agg(*[F.countDistinct(f"`{c}`").alias(c) for c in near]).first().asDict()
    for r in found.collect():
        want = near[r.column_name]
        for c in ("avg", "stddev", "avg_length"):
            assert r[c] == pytest.approx(want[c]) if want[c] is not None else r[c] is None
        assert r.distinct_count == pytest.approx(distinct[r.column_name], rel=0.02)
        for c in ("q1", "median", "q3"):
            assert r[c] == pytest.approx(want[c], abs=1.5) if want[c] is not None else r[c] is None


def test_common_values(spark, grown):
    path, store, _ = grown
    sp.refresh(spark, path, store, "t")
    found = {(r.column_name, r["rank"]): (r.value, r.value_count) for r in sp.common_values(spark, path, store, "t", 2).collect()}
    assert found["flag", 1] == ("false", 175) and found["flag", 2] == ("true", 175)
    assert found["name", 1][1] == spark.read.parquet(path).groupBy("name").count().filter("name IS NOT NULL").agg(F.max("count")).first()[0]


def test_files_stored_twice_replaced_or_removed(spark, grown, tmp_path):
    path, store, _ = grown
    sp.refresh(spark, path, store, "t")
    before = rows(sp.merged(spark, path, store, "t"))
    sp.sketched(spark.read.parquet(path), "t").write.mode("append").partitionBy("table_id").parquet(store)
    assert rows(sp.merged(spark, path, store, "t")) == before
    table(spark, 1000, 20).coalesce(1).write.mode("overwrite").parquet(path)
    assert sp.refresh(spark, path, store, "t") == sp.Refreshed(1, 0, 4)
    assert {(r.total_rows, r.min_value) for r in sp.merged(spark, path, store, "t").filter("column_name = 'id'").collect()} == {(20, "1000")}


def test_empty_files_and_new_columns(spark, tmp_path):
    path, store = str(tmp_path / "t"), str(tmp_path / "s")
    assert sp.merged(spark, str(tmp_path), store, "t").count() == 0
    table(spark, 0, 0).coalesce(1).write.parquet(path)
    assert sp.refresh(spark, path, store, "t").scanned == 1
    assert sp.refresh(spark, path, store, "t") == sp.Refreshed(0, 1, 0)
    assert sp.merged(spark, path, store, "t").count() == 0
    spark.range(5).write.mode("append").parquet(path)
    spark.range(5, 10).withColumn("more", F.lit("x")).coalesce(1).write.mode("append").parquet(path)
    sp.refresh(spark, path, store, "t")
    found = {r.column_name: r for r in sp.merged(spark, path, store, "t").collect()}
    assert found["id"].total_rows == found["more"].total_rows == 10 and found["more"].null_count == 5 and found["id"].max_value == "9"
    assert sp.merged(spark, path, store, "another").count() == 0


def test_tables_share_a_store(spark, grown):
    path, store, _ = grown
    assert sp.refresh(spark, path, store, "u").scanned == 4
    assert {r.total_rows for r in sp.merged(spark, path, store, "u").collect()} == {350}
    assert {r.total_rows for r in sp.merged(spark, path, store, "t").collect()} == {300}


def test_a_scan_id_stored_twice_counts_once(spark, tmp_path):
    path = str(tmp_path / "profiles")
    for n in (10, 20):
        store_profile(profile_table(table(spark, 0, n), "t"), path, "scan 1")
    store_profile(profile_table(table(spark, 0, 5), "t"), path, "scan 2")
    assert {r.total_rows for r in stored_profile(spark, path, "scan 1").collect()} == {20}
    assert stored_profile(spark, path, "scan 1").count() == 7 == stored_profile(spark, path, "scan 2").count()


def test_distinct_values_are_sketched_without_texts(spark, tmp_path):
    path, store = str(tmp_path / "t"), str(tmp_path / "s")
    df = spark.sql("""
        SELECT * FROM VALUES
            (1Y, 0.0D, CAST(0.5 AS FLOAT), DATE'2024-01-01', TIMESTAMP_NTZ'2024-01-01', true, X'00', array('a', NULL), ''),
            (1Y, -0.0D, CAST(0.25 AS FLOAT), DATE'2024-01-02', TIMESTAMP_NTZ'2024-01-02', false, X'', array(NULL, 'a'), ' '),
            (NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL)
        AS t(i, d, f, day, moment, flag, raw, list, name)
    """)
    df.coalesce(1).write.parquet(path)
    sp.refresh(spark, path, store, "t")
    found = {r.column_name: (r.distinct_count, r.null_count) for r in sp.merged(spark, path, store, "t").collect()}
    assert found == {c: (1 if c in "id" else 2, 1) for c in ("i", "d", "f", "day", "moment", "flag", "raw", "list", "name")}
    tops = {r.column_name: r.value_count for r in sp.common_values(spark, path, store, "t").collect() if r.value is None}
    assert tops == {}
    assert "string" not in sp._states(sp.profilable(df.schema)[1], sp.SketchOptions())["hll"].lower()


def test_files_with_sketches_of_another_kind_are_read_again(spark, grown):
    path, store, _ = grown
    before = sp.sketched(spark.read.parquet(path), "t").withColumn("format", F.lit(None).cast("int"))
    before.write.mode("overwrite").partitionBy("table_id").parquet(store)
    assert sp.refresh(spark, path, store, "t") == sp.Refreshed(4, 0, 0)
    assert {r.total_rows for r in sp.merged(spark, path, store, "t").collect()} == {350}
