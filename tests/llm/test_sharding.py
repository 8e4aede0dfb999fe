import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import registered, sharding


def check(docs, found, shards):
    """The law, gapless slots, and the facts of each row; returns the shards of each text's documents."""
    rows = found.collect()
    given = [(r.doc_id, r.text or "") for r in docs.collect()]
    fact = lambda text: (len(text.encode()) + 16, zlib.crc32(text.encode()))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, *fact(t)) for i, t in given)
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    held = defaultdict(Counter)
    for r in rows:
        held[r.size, r.text_crc32][r.shard] += 1
    return held


@pytest.mark.parametrize("shards", [1, 4, 40])
def test_odd_rows(spark, odd, shards):
    check(odd, sharding.shard_documents(odd, shards), shards)


def test_empty(spark, empty):
    assert sharding.shard_documents(empty, 40).count() == 0


def numbered(spark, n, text):
    return spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text")).repartition(6)


def test_pairs_stay_together_when_every_document_is_linked(spark):
    docs = numbered(spark, 4000, F.concat(F.lit("text "), (F.col("id") % 2000).cast("string")))
    held = check(docs, sharding.shard_documents(docs, 8), 8)
    # without propagation an eighth of the pairs would be together
    assert sum(len(x) == 1 for x in held.values()) > 0.9 * len(held)


def test_small_groups_are_whole(spark):
    docs = numbered(spark, 3000, F.concat(F.lit("text "), F.when(F.col("id") < 900, F.col("id") % 150).otherwise(F.col("id")).cast("string")))
    held = check(docs, sharding.shard_documents(docs, 10), 10)
    assert all(len(x) == 1 for x in held.values())


def test_a_third_of_all_rows_is_one_text(spark):
    other = F.when(F.col("id") < 1500, F.col("id") % 500).otherwise(F.col("id"))
    text = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("text "), other.cast("string")))
    docs = numbered(spark, 6000, text)
    held = check(docs, sharding.shard_documents(docs, 20), 20)
    hot = max(held.values(), key=lambda x: x.total())
    # 2000 documents need 7 shards of 300
    assert hot.total() == 2000 and len(hot) <= 10
    assert sum(len(x) == 1 for x in held.values()) > 0.9 * len(held)


def test_equal_rows_without_ids(spark):
    docs = spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    check(docs, sharding.shard_documents(docs, 7), 7)


def test_links_of_another_kind(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.when(F.col("id") < 400, F.col("id") % 40).otherwise(F.col("id")).alias("family"))
    found = sharding.sharded(sharding.described(docs, link=F.col("family")), 5)
    spread = [r[1] for r in found.groupBy("link").agg(F.countDistinct("shard")).filter("link < 40").collect()]
    # what a shard holds beyond its share leaves it at the end: at most one family a shard is cut
    assert len(spread) == 40 and sum(n > 1 for n in spread) <= 5
    assert sorted(r[1] for r in found.groupBy("shard").count().collect()) == [120] * 5


def test_quotas_hold_whatever_leaves():
    assert sharding.quotas(np.array([10.0, 10.0]), np.array([[0, 8], [6, 0]], float), 10.0).tolist() == [6, 6]
    assert sharding.quotas(np.array([10.0, 4.0]), np.array([[0, 8], [0, 0]], float), 10.0).tolist() == [0, 6]
    assert sharding.quotas(np.array([10.0, 10.0]), np.array([[0, 5], [0, 0]], float), 10.0).tolist() == [0, 0]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = check(docs, registered.registry()["op13_sharding"][0](spark, folder), 40)
    assert held
