import random

import pytest
from pyspark.sql import functions as F

from assayer.llm import bpe, packing, registered


def plain(sizes, sources, clusters, capacity):
    """Best fit by looking at every bin."""
    rest, held, out = [], [], {}
    items = sorted((-(s % capacity), i, s // capacity) for i, s in enumerate(sizes) if s % capacity or not s // capacity)
    for size, i, piece in items:
        own = {("s", sources[i]), ("c", clusters[i])} - {("s", None), ("c", None)}
        fits = [(rest[k], k) for k in range(len(rest)) if rest[k] >= -size and not own & held[k]]
        k = min(fits)[1] if fits else len(rest)
        if not fits:
            rest.append(capacity)
            held.append(set())
        rest[k] += size
        held[k] |= own
        out[i, piece] = k
    return out


def test_same_bins_as_a_plain_search():
    random.seed(2)
    for _ in range(200):
        n, capacity = random.randint(0, 60), random.choice([5, 16, 30, 100])
        sizes = [random.randint(0, int(capacity * 1.7)) for _ in range(n)]
        sources = [random.choice([None, 1, 1, 1, 2, 3, 4, 5]) for _ in range(n)]
        clusters = [random.choice([None, 1, 2, 3, *range(10, 40)]) for _ in range(n)]
        full = sum(s // capacity for s in sizes)
        found = {(i, p): k - full for i, p, _, k, _ in packing.packed(sizes, sources, clusters, capacity) if k >= full}
        assert found == plain(sizes, sources, clusters, capacity)


def check(df, rows, capacity):
    source = {r.doc_id: r.source for r in df.collect()}
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
    for inside in bins.values():
        inside.sort(key=lambda r: (r.bin_start, r.n_tokens))
        at = 0
        for r in inside:
            assert r.bin_start == at
            at += r.n_tokens
        assert at <= capacity
        named = [source[r.doc_id] for r in inside if r.doc_id is not None and source[r.doc_id] is not None]
        assert len(named) == len(set(named))


def test_every_document_is_packed_whole(corpus):
    rows = packing.pack_documents(corpus, 512).collect()
    check(corpus, rows, 512)
    size = {r[0]: r[1] for r in corpus.select("doc_id", packing.estimated_tokens(F.col("text"))).collect()}
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total == size
    texts = {r.doc_id: " ".join((r.text or "").lower().split()) for r in corpus.collect()}
    held = {}
    for r in rows:
        if r.n_tokens < 512:
            held.setdefault(r.bin_id, []).append(texts[r.doc_id])
    assert all(len(x) == len(set(x)) for x in held.values())


def test_odd_rows_and_empty_tables(odd, empty):
    rows = packing.pack_documents(odd, 100).collect()
    check(odd, rows, 100)
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd.collect()} and sum(r.doc_id == 5 for r in rows) > 2
    assert packing.pack_documents(empty).count() == 0


def test_hot_source_and_hot_cluster_stay_apart(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 50)) AS source", "if(id % 2 = 0, 'copy', string(id)) AS text", "80 + id % 500 AS n")
    rows = packing.pack(df, F.col("n"), F.col("source"), F.col("text"), 2048).collect()
    check(df, rows, 2048)
    assert len(rows) == 6000 and len({r.bin_id for r in rows if r.doc_id % 2 == 0}) == 3000


def test_sizes_are_the_numbers_of_tokens(spark, odd, corpus, empty, tmp_path):
    path = registered.vocabulary("byte_bpe_50k.json")
    for df, capacity in ((odd, 100), (corpus, 512)):
        rows = packing.pack_documents(df, capacity, path).collect()
        check(df, rows, capacity)
        size, total = {}, {}
        for r in bpe.encode(df, path).collect():
            size[r.doc_id] = size.get(r.doc_id, 0) + len(r.ids)
        for r in rows:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        assert total == size
    assert packing.pack_documents(empty, vocabulary=path).count() == 0
    corpus.write.parquet(f"{tmp_path}/documents.parquet")
    found = registered.op1_packing(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("n_tokens")).collect()
    assert dict(map(tuple, found)) == size


def test_white_space_and_case_make_no_other_cluster(spark, odd):
    texts = ["a b", " A \t\n b ", "a\x0bb", "a\fb\r", "a  b", "a\n\n B", "ab", "a\u00a0b", "\t", " ", "", None, " a", "\n a b", "a \x1c b"]
    df = spark.createDataFrame([(x,) for x in texts], "text string").union(odd.select("text"))
    plain = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    rows = df.select(packing.text_cluster(F.col("text")).alias("a"), F.when(F.length(plain) > 0, F.xxhash64(plain)).alias("b"), "text").collect()
    assert all(r.a == r.b for r in rows) and len({r.a for r in rows[:6]}) == 1 and [r.a for r in rows[8:12]] == [None] * 4
