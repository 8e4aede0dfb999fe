import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from assayer.llm import lexical, registered
from assayer.llm.common import flat
from assayer.plans.check import compare, duckdb_tables

import pyarrow as pa

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def expected(docs, items, k=10):
    """All documents scored for every item."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, bag) for i, bag in bags if bag]
    n, total = len(bags), sum(bag.total() for _, bag in bags)
    df = Counter(t for _, bag in bags for t in bag)
    out = Counter()
    for item, text in set(items):
        scores = []
        for i, bag in bags:
            m, score = 100 - 90 + 90 * bag.total() * n // total, 0
            for t in set(terms(text)):
                if tf := bag[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score:
                scores.append((-score, math.inf if i is None else i))
        for rank, (score, i) in enumerate(sorted(scores)[:k], 1):
            out[item, rank, None if i == math.inf else i, -score] += 1
    return out


def result(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


ITEMS = "item_id long, text string, doc_id long"


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        (0, "passage3 passage9 before ONE two", 1), (1, "one", 1), (2, None, 1), (3, "", 1), (4, "no such terms", 1), (5, " ".join(f"w{i}" for i in range(400)), 1),
        (6, "été 漢字 x endoftext", 1), (1, "one", 1), (7, "w1 w1 w2", 1), (7, "passage1", 1), (None, "three", 1), (8, "a" * 5000 + " tail", 1),
    ]
    return spark.createDataFrame(rows, ITEMS)


def test_odd_rows(spark, odd, items):
    found = result(lexical.search_documents(odd, items))
    assert found == expected([(r.doc_id, r.text) for r in odd.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_empty_tables(spark, odd, empty, items):
    assert lexical.search_documents(empty, items).count() == 0
    assert lexical.search_documents(odd, spark.createDataFrame([], ITEMS)).count() == 0


@pytest.mark.parametrize("k, paired, block, passes", [(10, 96, 4_000_000, 500_000), (3, 12, 20_000, 300), (1, 0, 5_000, 500_000)])
def test_real_documents(spark, corpus, monkeypatch, k, paired, block, passes):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexical, "QUERY_TERMS", passes)
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    found = result(lexical.search(lexical.build(corpus, paired=paired), items, k))
    assert found == expected([(r.doc_id, r.text) for r in corpus.collect()], [(r.item_id, r.text) for r in items.collect()], k)


def small_block(rng, n=600, vocabulary=40):
    """A block of random documents over few terms, frequent ones first."""
    chance = 1 / np.arange(1, vocabulary + 1) ** 0.7
    bags = [Counter(rng.choice(vocabulary, rng.integers(3, 30), p=chance / chance.sum()).tolist()) for _ in range(n)]
    postings = defaultdict(list)
    for d, bag in enumerate(bags):
        for t, tf in bag.items():
            postings[t].append((d, tf))
    own = np.array(sorted(postings), np.int64)
    doc = np.array([d for t in own.tolist() for d, _ in postings[t]], np.int32)
    tf = np.array([f for t in own.tolist() for _, f in postings[t]], np.int64)
    sizes = np.array([bag.total() for bag in bags])
    gain = lexical.gains(tf, sizes[doc], n, int(sizes.sum()))
    dfs = np.array([len(postings[t]) for t in own.tolist()])
    starts = np.concatenate([[0], np.cumsum(dfs)])
    weights = np.floor(1000 * np.log((2 * n + 2) / (2 * dfs + 1))).astype(np.int64)
    joint, _ = lexical.pairs(lexical.dense(own, starts, doc, gain, n, own, weights))
    x = {
        "terms": pa.scalar(own.tolist()), "dfs": pa.scalar(dfs.tolist()), "most": pa.scalar(np.maximum.reduceat(gain, starts[:-1]).tolist()),
        "ids": pa.scalar(np.arange(n).astype("<i8").tobytes()), "docs": pa.scalar(doc.astype("<i4").tobytes()),
        "gains": pa.scalar(gain.astype("<i4").tobytes()), "joint": pa.scalar(joint.astype("<i8").tobytes()),
    }
    return lexical.Block(x, own, weights), weights


def test_pair_bounds_read_less_and_find_the_same():
    rng = np.random.default_rng(3)
    total = np.zeros((2, 2), int)
    for _ in range(20):
        block, weights = small_block(rng)
        for _ in range(10):
            at = np.sort(rng.choice(len(weights), 12, replace=False))
            found = []
            for use in (False, True):
                best = lexical.Best(10)
                total[int(use)] += block.search(at, weights[at], at, best, use)
                found.append((best.score.tolist(), best.id.tolist()))
            every = block.added(at, weights[at])
            want = sorted(zip((-every).tolist(), range(len(every)), strict=True))[:10]
            assert found[0] == found[1] == ([-s for s, _ in want], [i for _, i in want])
    assert total[1, 0] < total[0, 0], total


def test_saved_bounds_hold():
    joint = np.array([[0, 12, 0], [12, 0, 9], [0, 9, 0]])
    bounds, place = np.array([5, 8, 10]), np.array([2, 0, 1])
    # 5 and 8 never meet: together 8 at most, which saves 5; the others save 18 - 12 and 15 - 10
    assert lexical.saved(bounds, place, joint).tolist() == [0, 0, 6]
    assert lexical.saved(bounds, np.array([-1, 0, -1]), joint).tolist() == [0, 0, 0]


def test_terms():
    texts = ["Ab cd_Ab ÉÑ x 12", "", None, "\x7f~"]
    hashes, doc = lexical.terms_of(*flat(pa.array(texts)))
    assert doc.tolist() == [0] * len(terms(texts[0])) and len(set(hashes.tolist())) == len(set(terms(texts[0])))


def test_gains_of_sizes_beyond_64_bits():
    tf, n, docs, total = np.array([1, 3]), np.array([10**9, 5]), 5 * 10**10, 2 * 10**13
    assert lexical.gains(tf, n, docs, total).tolist() == [10**9 * t // (1000 * t + 8 * (10 + 90 * x * docs // total)) for t, x in ((1, 10**9), (3, 5))]


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    query, sql = registered.registry()["op12_ranked_search"]
    assert compare(spark, duckdb_tables(folder), folder, query, sql) is None


@pytest.mark.parametrize("times", [3, 300, 70_000])
def test_postings_take_few_bytes(spark, times):
    """A block's rows are what a task holds: numbers take the bytes that the largest of their block needs, and none is cut."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 60, 40)) for _ in range(300)] + ["w1 " * times + "w2"]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    (block,) = lexical._counted(iter([batch]))
    x = {name: block.column(name)[0] for name in block.schema.names}
    n, wide = sum(len(Counter(terms(t))) for t in texts), 1 if times < 256 else 2 if times < 1 << 16 else 4
    assert sum(x["dfs"].as_py()) == n and len(x["docs"].as_py()) == 2 * n and len(x["tfs"].as_py()) == wide * n
    assert lexical._numbers(x["tfs"], n).max() >= times and lexical._numbers(x["sizes"], len(texts)).tolist() == [len(terms(t)) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    asked = [(0, "w1 w2 w3"), (1, "w1"), (2, "w59 w2")]
    assert result(lexical.search_documents(df, spark.createDataFrame(asked, "item_id long, text string"))) == expected(list(enumerate(texts)), asked)
