import datetime as dt
import decimal

from helpers import rows
import pytest
from pyspark.sql import functions as F

from assayer.functions.naming import scan_id
from assayer.operators import classify, frequencies, quality
from assayer.operators.profile import (
    ProfileOptions, counts_from_ratios, most_null, profile_table, profile_tables, ratios, store_profile, stored_profile,
)
from assayer.sources.tables import columns_frame, fields, profilable, sample_rows, sampled, sampled_by_key

MIXED = "a int, b double, s string, n string, d date, f boolean, x binary, l array<int>, m map<string,int>, p decimal(10,2), r struct<id:string,deep:struct<v:int>>, g array<struct<k:int>>"


@pytest.fixture(scope="module")
def mixed(spark):
    day = dt.date(2024, 1, 1)
    data = [
        (1, 1.5, "aa", None, day, True, b"xyz", [1, 2], {"a": 1}, decimal.Decimal("1.10"), ("u1", (5,)), [(1,)]),
        (2, None, "b", None, day, False, b"x", [], {"b": 2}, decimal.Decimal("2.20"), ("u2", (None,)), None),
        (3, 10000000.0, "b", None, None, None, None, None, None, None, None, None),
        (4, 4.5, None, None, day, True, b"xyz", [7], {}, decimal.Decimal("3.30"), ("u1", (9,)), []),
    ]
    return spark.createDataFrame(data, MIXED)


def profile_of(df, **options):
    return {r.column_name: r for r in profile_table(df, "t", options=ProfileOptions(**options)).collect()}


def test_every_type_has_the_measures_its_kind_allows(mixed):
    p = profile_of(mixed)
    assert (p["a"].profile_type, p["a"].min, p["a"].max, p["a"].avg, p["a"].null_count) == ("numeric", 1.0, 4.0, 2.5, 0)
    assert (p["a"].min_value, p["b"].max_value) == ("1", "10000000.0")
    assert (p["b"].null_count, p["b"].null_percentage, p["b"].distinct_count) == (1, 25.0, 3)
    assert (p["s"].profile_type, p["s"].min_length, p["s"].max_length, p["s"].distinct_count) == ("string", 1, 2, 2)
    assert (p["x"].profile_type, p["x"].max_length) == ("string", 3)
    assert (p["p"].profile_type, p["p"].max) == ("numeric", 3.3)
    assert (p["d"].profile_type, p["d"].distinct_count, p["d"].min) == ("other", 1, None)
    assert (p["l"].profile_type, p["l"].min_length, p["l"].max_length, p["l"].null_count) == ("other", 0, 2, 1)
    assert (p["m"].null_count, p["m"].distinct_count) == (1, None)
    assert p["n"].null_percentage == 100.0 and p["n"].distinct_count == 0


def test_nested_leaves_are_profiled_and_elements_of_arrays_are_not(mixed):
    p = profile_of(mixed)
    assert (p["r.id"].distinct_count, p["r.id"].null_count) == (2, 1)
    assert (p["r.deep.v"].min, p["r.deep.v"].max, p["r.deep.v"].null_count) == (5.0, 9.0, 2)
    assert "r" not in p and "g.k" not in p and "g" in p


def test_empty_table_has_null_shares(spark):
    empty = spark.createDataFrame([], "a int, s string")
    p = profile_of(empty)
    assert p["a"].total_rows == 0 and p["a"].null_percentage is None and p["s"].max_length is None
    scored = quality.completeness(profile_table(empty, "t")).first()
    assert scored.completeness_score is None


def test_table_without_columns_to_profile(spark):
    assert profile_table(spark.createDataFrame([], "r struct<>"), "t").count() == 0


def test_group_size_does_not_change_the_profile(mixed):
    one, many = profile_of(mixed, columns_per_pass=1), profile_of(mixed, columns_per_pass=100)
    assert one == many


def test_switched_off_parts_are_null(mixed):
    p = profile_of(mixed, cardinality=False, distribution=False)
    assert p["a"].distinct_count is None and p["a"].min is None and p["a"].null_count == 0


def test_approximate_distinct_never_exceeds_filled_cells(spark):
    for n in (100, 1500, 2000):
        assert profile_of(spark.range(n).toDF("a"))["a"].distinct_count <= n


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "x'y")], "`a.b` int, `it's ``odd``` string")
    p = profile_of(df)
    assert set(p) == {"a.b", "it's `odd`"} and p["it's `odd`"].max_length == 3
    assert rows(frequencies.value_frequencies(df)) == [("a.b", "1", 1), ("it's `odd`", "x'y", 1)]


def test_ratios_and_counts_agree(mixed):
    p = profile_table(mixed, "t")
    back = counts_from_ratios(ratios(p).drop("null_count", "distinct_count"))
    assert rows(back, "column_name", "null_count") == rows(p, "column_name", "null_count")


def test_counts_from_stored_ratios(spark):
    stored = spark.createDataFrame(
        [("id", 1000, 0.0, 1.0), ("name", 1000, 0.05, 0.95), ("email", 1000, 0.02, 0.98)], "column_name string, total_rows bigint, null_ratio double, distinct_ratio double"
    )
    assert rows(counts_from_ratios(stored), "column_name", "null_count", "distinct_count") == [
        ("email", 20, 980), ("id", 0, 1000), ("name", 50, 950)
    ]


def test_stored_profiles_are_not_scanned_again(spark, mixed, tmp_path):
    path = str(tmp_path / "profiles")
    first = profile_table(mixed, "t1")
    key = spark.range(1).select(scan_id(F.lit("Sales_EU"), F.lit("t1"))).first()[0]
    assert key == "profile-sales-eu-t1"
    store_profile(first, path, key)
    store_profile(profile_table(mixed.limit(1), "t1"), path, "profile-old", state="PENDING")
    stored = stored_profile(spark, path, key)
    assert stored_profile(spark, path, "profile-old").count() == 0
    # a table that would fail if it were read shows that only the stored rows are used
    broken = spark.range(1).select(F.raise_error(F.lit("scanned")).alias("a"))
    both = profile_tables({"t1": broken, "t2": mixed}, stored=stored)
    assert both.filter("table_id = 't1'").count() == first.count()
    assert both.filter("table_id = 't2'").count() == first.count()


def test_fields_follow_their_parent(spark):
    schema = spark.createDataFrame([], "user struct<id:string,email:string>, tags array<string>, id bigint not null").schema
    assert [(f.dotted, f.type_name, f.mode, f.depth) for f in fields(schema)] == [
        ("user", "struct", "NULLABLE", 0), ("user.id", "string", "NULLABLE", 1), ("user.email", "string", "NULLABLE", 1),
        ("tags", "string", "REPEATED", 0), ("id", "bigint", "REQUIRED", 0),
    ]
    assert [f.dotted for f in profilable(schema)] == ["user.id", "user.email", "tags", "id"]


def test_null_ranking(mixed):
    top = rows(most_null(profile_table(mixed, "t"), k=2), "rank", "column_name", "null_percentage")
    assert top == [(1, "n", 100.0), (2, "r.deep.v", 50.0)]


def test_top_values_and_samples(mixed):
    top = rows(frequencies.top_values(mixed, ["s", "n", "x"]), "column_name", "rank", "value", "value_count", "percentage")
    assert top == [("s", 1, "b", 2, 50.0), ("s", 2, "aa", 1, 25.0), ("x", 1, "<bytes: 3 bytes>", 2, 50.0), ("x", 2, "<bytes: 1 bytes>", 1, 25.0)]
    samples = rows(frequencies.sample_values(mixed, ["a", "s", "n", "l", "r.id"]))
    assert samples == [
        ("a", 1, "1"), ("a", 2, "2"), ("a", 3, "3"), ("l", 1, "[]"), ("l", 2, "[1,2]"), ("l", 3, "[7]"),
        ("r.id", 1, "u1"), ("r.id", 2, "u2"), ("s", 1, "aa"), ("s", 2, "b"),
    ]


def test_samples_of_all_columns(spark):
    wide = spark.range(2).selectExpr(*[f"id + {i} AS c{i}" for i in range(40)])
    assert frequencies.sample_values(wide).select("column_name").distinct().count() == 40


def test_values_that_look_alike_are_counted_apart(spark):
    df = spark.createDataFrame(
        [(bytearray(b"aa"), [1] * 60 + [1]), (bytearray(b"aa"), [1] * 60 + [2]), (bytearray(b"bb"), [1] * 60 + [3])], "b binary, a array<int>"
    )
    assert rows(frequencies.distinct_counts(df)) == [("a", 3, 3), ("b", 3, 2)]
    assert rows(frequencies.top_values(df, ["b"]), "rank", "value", "value_count") == [(1, "<bytes: 2 bytes>", 2), (2, "<bytes: 2 bytes>", 1)]
    assert {r.value for r in frequencies.top_values(df, ["a"]).collect()} == {"[" + ",".join(["1"] * 60)[:99]}


def test_bounds_keep_their_digits(spark):
    df = spark.createDataFrame([(1.234567890123456e-4,), (1e15,)], "x double")
    assert rows(profile_table(df, "t"), "min_value", "max_value") == [("0.0001234567890123456", "1000000000000000.0")]


def test_exact_distinct_and_sketch_agree_on_few_values(spark):
    df = spark.range(10_000).selectExpr("id % 7 AS k", "if(id % 3 = 0, 'hot', string(id % 500)) AS s")
    assert rows(frequencies.distinct_counts(df)) == [("k", 10_000, 7), ("s", 10_000, 501)]
    exact = {(r.column_name, r.value): r.value_count for r in frequencies.top_values(df, ["s"], k=1).collect()}
    sketch = {(r.column_name, r.value): r.value_count for r in frequencies.top_values_sketch(df, ["s"], k=1).collect()}
    assert exact == sketch == {("s", "hot"): 3334}


def test_patterns(spark):
    df = spark.createDataFrame([("Ab-12",), ("Cd-34",), ("é9",), (None,)], "s string")
    assert rows(frequencies.string_patterns(df)) == [("s", 1, "AA-99", 2), ("s", 2, "A9", 1)]


def test_samples_are_subsets(spark):
    df = spark.range(5000).selectExpr("id", "id * 2 AS v")
    assert 0 < sampled(df, percent=10.0).count() < 5000
    assert sampled(df, row_filter="v < 100", target_columns=["v"]).columns == ["v"]
    assert sampled(df, row_filter="v < 100").count() == 50
    with pytest.raises(ValueError):
        sampled(df, percent=0.0)
    kept = sampled_by_key(df, ["id"], 10.0)
    again = sampled_by_key(df.repartition(7), ["id"], 10.0)
    assert 350 < kept.count() < 650 and rows(kept) == rows(again)
    assert rows(sample_rows(df, ["id"], 20)) == rows(sample_rows(df.repartition(5), ["id"], 20))


def test_sensitive_names_and_values(spark, mixed):
    schema = spark.createDataFrame([], "who struct<email_addr:string,age:int>, Patient_Id int, total int").schema
    flags = rows(classify.flag_columns(columns_frame(spark, {"t": schema})), "column_name", "is_pii", "is_phi")
    assert flags == [
        ("Patient_Id", False, True), ("total", False, False), ("who", False, False), ("who.age", False, False), ("who.email_addr", True, False),
    ]
    assert rows(classify.flag_tables(columns_frame(spark, {"t": schema}))) == [("t", True, True)]
    assert rows(classify.flag_tables(columns_frame(spark, {"t": schema}), nested=False)) == [("t", False, True)]
    cells = spark.createDataFrame([("mail me@x.org or 10.0.0.1",), ("call 555-123-4567",), ("123-45-6789",), ("no @ here",), (None,)], "s string")
    found = {r.info_type: r.match_count for r in classify.value_findings(cells, "t").collect()}
    assert found == {"EMAIL_ADDRESS": 1, "PHONE_NUMBER": 1, "US_SOCIAL_SECURITY_NUMBER": 1, "CREDIT_CARD_NUMBER": 0, "IP_ADDRESS": 1}
    assert cells.filter(classify.has_info_type("s")).count() == 3


def test_quality_issues_and_status(mixed):
    found = rows(quality.issues(profile_table(mixed, "t")), "column_name", "issue")
    assert ("n", "all values are null") in found and ("r.deep.v", "mostly null") in found and ("d", "one value only") in found
    graded = mixed.sparkSession.createDataFrame([(0.95,), (0.949,), (0.8,), (0.79,), (None,)], "s double")
    assert rows(graded.select("s", quality.status(F.col("s")))) == [
        (0.79, "POOR"), (0.8, "FAIR"), (0.949, "FAIR"), (0.95, "GOOD"), (None, None)
    ]


def test_common_values_with_long_texts(spark):
    start = "x" * 70
    texts = [start + "b"] * 3 + [start + "a"] * 3 + [start] * 3 + ["x" * 64] * 3 + ["y"] * 5 + [f"{start}{i:03d}" for i in range(200)] + ["z" * 64, None, ""]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, i int").repartition(4)
    found = [(r["rank"], r.value, r.value_count) for r in frequencies.top_values(df, ["t"], 8).orderBy("rank").collect()]
    import collections

    want = sorted(collections.Counter(t for t in texts if t is not None).items(), key=lambda x: (-x[1], x[0]))[:8]
    assert found == [(n, t, c) for n, (t, c) in enumerate(want, 1)]
    assert {r.column_name: r.distinct_count for r in frequencies.distinct_counts(df).collect()} == {"t": len(set(texts)) - 1, "i": len(texts)}
    unique = spark.range(5000).selectExpr("concat(repeat('text', 30), lpad(id, 6, '0')) AS t")
    assert [r.value[-6:] for r in frequencies.top_values(unique, k=3).orderBy("rank").collect()] == ["000000", "000001", "000002"]


def test_distinct_counts_of_numbers_and_times_make_no_texts(spark):
    df = spark.sql("""
        SELECT * FROM VALUES
            (1Y, 0.0D, CAST('NaN' AS FLOAT), DATE'2024-01-01', TIMESTAMP_NTZ'2024-03-31 02:30:00', true, 1.10BD, X'00', array('a', NULL), ''),
            (1Y, -0.0D, CAST('NaN' AS FLOAT), DATE'2024-01-02', TIMESTAMP_NTZ'2024-03-31 03:30:00', false, 1.20BD, X'', array(NULL, 'a'), ' '),
            (NULL, NULL, CAST(0.1 AS FLOAT), NULL, NULL, NULL, NULL, NULL, NULL, NULL)
        AS t(i, d, f, day, moment, flag, price, raw, list, name)
    """)
    expected = {"i": 1, "d": 1, "f": 2, "day": 2, "moment": 2, "flag": 2, "price": 2, "raw": 2, "list": 2, "name": 2}
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        found = frequencies.distinct_counts(df)
        assert {r.column_name: (r.total_rows, r.distinct_count) for r in found.collect()} == {c: (3, n) for c, n in expected.items()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    numbers = frequencies.distinct_counts(df.select("i", "d", "f", "day", "moment"))
    assert "as string" not in numbers._jdf.queryExecution().optimizedPlan().toString().lower().replace("null as string", "")
    assert frequencies.distinct_counts(df, []).collect() == [] == frequencies.distinct_counts(df.limit(0)).collect()
