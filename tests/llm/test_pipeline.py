import hashlib

import corpus_pipeline
import public_tokenizers
import pytest
import test_packing
import test_repeats
import test_similar
from tokenizers import Tokenizer

from assayer.llm import packing, quality, stages, toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents after each stage."""
    path = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], FOLDER).write.parquet(str(path / name))
        out.append(spark.read.parquet(str(path / name)))
    return out


def ids(df):
    return {r.doc_id for r in df.collect()}


def test_each_stage_against_a_plain_version(spark, steps):
    docs, good, clean, single, cut, bins = steps
    assert all(x.columns == docs.columns for x in steps[1:-1])
    scores = quality.score(docs, quality.fit(docs))
    assert ids(good) == ids(scores.filter("keep")) < ids(docs)
    model = toxicity.fit(good, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert ids(clean) == ids(toxicity.score(good, model).filter("predicted = 0"))
    assert ids(single) == {i for i, n, label in test_similar.expected(clean) if label == i} < ids(clean)
    want = {i: (n, kept) for i, _, n, _, kept in test_repeats.expected(single, 13, True)}
    before = {r.doc_id: r for r in single.collect()}
    assert ids(cut) == set(want)
    for r in cut.collect():
        n, kept = want[r.doc_id]
        if n:
            assert hashlib.sha256(r.text.encode()).hexdigest() == kept and r.n_chars == len(r.text)
        else:
            assert r == before[r.doc_id]
    rows = bins.collect()
    test_packing.check(cut, rows, packing.CAPACITY)
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert total == {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in cut.collect()}


def test_run_equals_the_stages(spark, steps):
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(tuple, steps[-1].collect()))


def test_stages_with_odd_rows_and_empty_tables(spark, odd, empty):
    for df in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, FOLDER)
            assert out.columns == df.columns and out.count() <= df.count()
        assert (stages.packed(spark, df, FOLDER).count() > 0) == (df.count() > 0)
    alone = stages.one_of_each_group(spark, odd, FOLDER)
    assert {r.doc_id for r in alone.collect()} >= {None, 0, 1, 2, 5} and not {6, 7, 8, 15} & {r.doc_id for r in alone.collect()}
