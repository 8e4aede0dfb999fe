import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayer.llm import quality, toxicity
from assayer.llm.common import about, flat, held_out
from assayer.llm.words import Hashes, words

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(8).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet").cache()


@pytest.fixture(scope="module")
def judge(docs):
    return quality.fit(docs)


@pytest.fixture(scope="module")
def toxic(docs, labels):
    return toxicity.fit(docs, labels)


def table(rows):
    return {tuple(r[:-1]): r[-1] for r in rows}


def test_quality_agrees_with_hand_labels_it_never_saw(docs, labels, judge):
    found = quality.score(docs, judge).join(labels, "doc_id")
    n = table(found.groupBy("keep", "quality").count().collect())
    assert n.get((False, 1), 0) <= 0.002 * (n[True, 1] + n.get((False, 1), 0))
    assert n.get((True, 0), 0) <= 0.03 * (n[False, 0] + n.get((True, 0), 0))


def test_toxicity_on_held_out_documents(docs, labels, toxic):
    found = toxicity.score(docs, toxic).join(labels, "doc_id").filter(held_out(F.col("doc_id")))
    n = table(found.groupBy("predicted", "toxic").count().collect())
    assert n[1, 1] >= 0.88 * (n[1, 1] + n.get((0, 1), 0)) and n.get((1, 0), 0) <= 0.02 * n[0, 0]
    assert found.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_offending_sentences_are_located(spark, docs, labels, toxic):
    words_ = ["scum", "clown", "loser", "idiot", "disgusting", "worthless", "moron", "pathetic", "trash", "stupid"]
    rows = [(i, f"Eron thha is of. The ande {w} and {w} heen was. Ing thble erly.", "x") for i, w in enumerate(words_)]
    found = toxicity.located(spark.createDataFrame(rows, "doc_id long, text string, score string"), toxic).collect()
    assert len({r.doc_id for r in found}) >= 8 and all(words_[r.doc_id] in r.sentence for r in found)
    text = {r[0]: r[1].encode() for r in rows}
    assert all(text[r.doc_id][r.start : r.end].decode() == r.sentence for r in found)


def test_held_out_labels_teach_nothing(spark, docs, labels, toxic):
    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, flipped)
    assert again.bias == toxic.bias and (again.weights == toxic.weights).all()
    assert [held_out_plain(i) for i in range(50)] == [r[0] for r in spark.range(50).select(held_out(F.col("id"))).collect()]


def held_out_plain(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_noisy_or():
    p, bag = np.array([0.5, 0.5, 0.1, 0.0]), np.array([0, 0, 2, 2])
    assert np.allclose(toxicity.noisy_or(p, bag, 4), [0.75, 0, 0.1, 0])


def test_gradient_of_the_bags():
    """Training lowers the loss that it follows: toxic bags end above clean ones."""
    rng = np.random.default_rng(0)
    labels = (np.arange(200) % 4 == 0).astype(int)
    sentence, bucket, of = [], [], []
    for d in range(200):
        for s in range(3):
            if labels[d] and s == 1 or rng.random() < 0.2:
                sentence.append(3 * d + s)
                bucket.append(5 if labels[d] and s == 1 else 9)
                of.append(d)
    odds = np.zeros(16)
    settings = toxicity.Settings(bits=4)
    model = toxicity.fitted(np.array(sentence), np.array(bucket), np.array(of), np.full(200, 3), labels, odds, settings)
    assert model.weights[5] > 4 and model.weights[9] < 0.5 and model.bias < -2


def test_odd_rows_and_empty_tables(spark, odd, empty, labels, toxic, judge):
    n = odd.count()
    found = toxicity.score(odd, toxic)
    assert found.count() == n and found.filter("doc_id = 0").first().score == 0.0
    found = quality.score(odd, judge).collect()
    assert len(found) == n and all(r.score == 0 and not r.keep for r in found if r.doc_id in (0, 1, 2))
    assert len({r.score for r in found if r.doc_id in (5, 6)}) == 1
    assert quality.score(empty, quality.fit(empty)).count() == 0
    none = toxicity.fit(empty, labels)
    assert toxicity.score(odd, none).agg(F.max("score")).first()[0] < 1e-12 and toxicity.score(empty, none).count() == 0
    strange = spark.createDataFrame([(None, 1), (3, None), (5, 1), (5, 0), (10**9, 1)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.fit(odd, strange)).count() == n
    for kept in (quality.kept(odd, judge), toxicity.kept(odd, toxic)):
        assert kept.schema == odd.schema and 0 < kept.count() <= n


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(4)
    good = rng.random(20_000) < 0.8
    accuracy = [0.95, 0.9, 0.85, 0.7]
    votes = np.stack([np.where(rng.random(20_000) < 0.2, 0, np.where(rng.random(20_000) < a, 1, -1) * np.where(good, 1, -1)) for a in accuracy], 1)
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    found = quality.posteriors(patterns, counts.astype(float))[back.ravel()]
    majority = votes.sum(1) > 0
    assert ((found >= 0.5) == good).mean() > 0.93 and ((found >= 0.5) == good).mean() >= (majority == good).mean()


def test_words_and_hashes():
    texts = ["a bb  ccc", "", " x", "bb\tbb\n"]
    data, starts = flat(pa.array(texts))
    found = words(data, starts)
    assert [data[a:b].tobytes().decode() for a, b in zip(found.start, found.end)] == ["a", "bb", "ccc", "x", "bb", "bb"]
    assert found.doc.tolist() == [0, 0, 0, 2, 3, 3] and found.at.tolist() == [0, 3, 3, 4, 6]
    names = Hashes(data).of(found.start, found.end)
    assert names[1] == names[4] == names[5] and len(set(names.tolist())) == 4


def test_examples_are_drawn_from_tables_of_any_size(spark):
    ids = spark.range(20_000)
    drawn = {i for (i,) in ids.filter(about(5_000, 20_000, "id")).collect()}
    assert 4_500 < len(drawn) < 5_500
    assert ids.filter(about(20_000, 20_000, "id")).count() == ids.filter(about(9, 3, "id")).count() == 20_000
    # a share far below one in 2**20 still has a bound of its own
    plan = ids.filter(about(6_000, 5 * 10**10, "id"))._jdf.queryExecution().optimizedPlan().toString()
    assert str(6_000 * 2**62 // (5 * 10**10)) in plan


def test_ids_that_all_rows_share_are_an_error(spark):
    docs = spark.range(9_000).selectExpr("7L AS doc_id", "concat('some words of text number ', id) AS text")
    settings = quality.Settings(fit_rows=1)
    with pytest.raises(RuntimeError):
        quality.fit(docs, settings)
    empty = docs.selectExpr("doc_id", "'  ' AS text")
    assert quality.score(empty, quality.fit(empty, settings)).count() == 9_000
