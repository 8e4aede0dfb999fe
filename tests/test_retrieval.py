"""Pages from a stored index, against scores of all documents."""

import pytest
from pyspark.sql import functions as F

from assayer.operators import retrieval, search

DOCS = "/root/testdata/sf0.01/documents.parquet"


def expected(docs, query, k):
    scored = search.bm25(docs, query, "doc_id", "text").select("doc_id", F.round("score", 9).alias("score"))
    return [(r.doc_id, pytest.approx(r.score, abs=1e-8)) for r in scored.orderBy(F.desc("score"), "doc_id").limit(k).collect()]


def hits(found):
    rows = found.hits.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    return [(r.doc_id, r.score) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(DOCS).select("doc_id", "text").cache()


@pytest.fixture(scope="module")
def path(spark, docs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index") / "i")
    assert retrieval.upsert(docs, "doc_id", "text", folder) == 0
    return folder


@pytest.mark.parametrize("query, k", [("the que", 10), ("passage tion ingthe", 5), ("nowhereword", 10), ("", 10), ("The THE and of", 1), ("license the", 2000)])
def test_same_page_as_a_full_scan(spark, docs, path, query, k):
    want = expected(docs, query, k) if query else []
    assert hits(retrieval.page(spark, path, query, "doc_id", k)) == want


def test_lanes_that_cannot_reach_the_page_are_not_read(spark, docs, path):
    found = retrieval.page(spark, path, "the license", "doc_id", 5)
    assert 0 < found.postings_read < found.postings
    assert found.postings == docs.filter(F.lower("text").rlike(r"(?<![\p{L}\p{N}])the(?![\p{L}\p{N}])")).count() + docs.filter(
        F.lower("text").rlike(r"(?<![\p{L}\p{N}])license(?![\p{L}\p{N}])")
    ).count()


def test_upserts_rewrite_no_segment(spark, docs, tmp_path):
    import os

    folder = str(tmp_path / "i")
    some, rest = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    old = some.withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("the the que "), "text")).otherwise(F.col("text")))
    retrieval.upsert(old, "doc_id", "text", folder)
    files = lambda: {p: set(names) for p, _, names in os.walk(f"{folder}/blocks/segment=0")}
    before = files()
    retrieval.upsert(rest.union(some.filter("doc_id % 4 = 0").withColumn("text", F.lit("que que"))), "doc_id", "text", folder)
    retrieval.upsert(some.filter("doc_id % 4 = 0"), "doc_id", "text", folder)
    assert files() == before
    for query in ("the que", "que"):
        assert hits(retrieval.page(spark, folder, query, "doc_id", 15)) == expected(docs, query, 15)


def test_a_segment_without_totals_does_not_count(spark, docs, tmp_path):
    folder = str(tmp_path / "i")
    one = spark.createDataFrame([(1, "blue bird"), (2, None), (3, "")], "doc_id long, text string")
    retrieval.upsert(one, "doc_id", "text", folder)
    spark.createDataFrame([(9, 2, ["blue"])], "key long, length long, terms array<string>").write.parquet(f"{folder}/docs/segment=1")
    assert [i for i, _ in hits(retrieval.page(spark, folder, "blue", "doc_id"))] == [1]
    retrieval.upsert(spark.createDataFrame([(1, "green")], "doc_id long, text string"), "doc_id", "text", folder)
    assert hits(retrieval.page(spark, folder, "blue", "doc_id")) == []
    assert [i for i, _ in hits(retrieval.page(spark, folder, "green", "doc_id"))] == [1]
    with pytest.raises(ValueError):
        retrieval.page(spark, str(tmp_path / "none"), "blue", "doc_id")


def test_postings_are_counted_where_their_lane_is(spark):
    def blocks(docs):
        rows = docs.selectExpr("key", "words", "size(split(words, ' ')) * 1L AS length")
        return retrieval._lanes(rows)

    many = spark.range(1000).selectExpr("id AS key", "concat('a a w', id % 3) AS words")
    twice = many.limit(0).union(spark.createDataFrame([(7, "b b c"), (7, "b b c"), (None, "b d e")], "key long, words string"))
    found = blocks(many).collect()
    assert sum(r.n for r in found if r.term == "a") == 1000 and max(r.n for r in found) <= retrieval.LANE and {r.most for r in found if r.term == "a"} == {2}
    assert sorted(k for r in found if r.term == "w1" for k in r.key) == [k for k in range(1000) if k % 3 == 1]
    # rows with one key in a lane are one document
    assert {(r.term, tuple(zip(r.key, r.tf))) for r in blocks(twice.coalesce(1)).repartition(1).collect()} >= {("c", ((7, 2),)), ("d", ((None, 1),))}
    # words meet in one shuffle, and postings in none
    assert blocks(many)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
