"""Similar items for a table of references, against all cosines."""

import numpy as np
import pytest

from assayer.operators import similarity

SCHEMA = "k long, v array<double>, similarity string, rank int"


def frame(spark, pairs):
    return spark.createDataFrame([(k, v, "x", 1) for k, v in pairs], SCHEMA).repartition(4)


def expected(items, references, threshold, k):
    fine = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    out = {}
    for r, v in references:
        if fine(v):
            hits = [(-float(unit(v) @ unit(w)), i) for i, w in items if fine(w) and len(w) == len(v)]
            out[r] = [(i, round(-s, 9)) for s, i in sorted(h for h in hits if -h[0] >= threshold)[:k]]
    return {r: x for r, x in out.items() if x}


def result(df):
    out = {}
    for row in df.orderBy("ref_k", "rank").collect():
        out.setdefault(row.ref_k, []).append((row.k, round(row.similarity, 9)))
        assert row["rank"] == len(out[row.ref_k])
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 16)) * 4
    v = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16))
    return [(i, x.tolist()) for i, x in enumerate(v)]


@pytest.mark.parametrize("threshold, k, lists", [(0.7, 10, None), (0.95, 3, 40), (-1.0, 5, 7)])
def test_exact(spark, clustered, threshold, k, lists):
    references = clustered[::150]
    found = similarity.similar_for(frame(spark, clustered), frame(spark, references), "v", "k", "k", threshold, k, lists)
    assert result(found) == expected(clustered, references, threshold, k)


def test_nearest_lists_find_nearly_all(spark, clustered):
    references = clustered[::50]
    found = result(similarity.similar_for(frame(spark, clustered), frame(spark, references), "v", "k", "k", 0.7, 10, 30, probes=3))
    want = expected(clustered, references, 0.7, 10)
    hits = sum(len({i for i, _ in found.get(r, [])} & {i for i, _ in x}) for r, x in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_far_blocks_are_passed_over():
    to_centre = np.array([1.0, 0.0, -1.0, 0.6])
    best = similarity._best_possible(to_centre, 0.8)
    assert best[0] >= 1 and best[1] == pytest.approx(0.6) and best[2] == pytest.approx(-0.8) and best[3] == pytest.approx(0.96)


def test_odd_vectors(spark):
    items = [
        (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1e200, 1e200]), (7, [1e-200, 0.0]), (8, [1.0]), (1, [2.0, 0.0]),
        (None, [3.0, 0.0]), (9, [float("inf"), 0.0]), (10, []),
    ]
    references = [(0, [5.0, 0.0]), (2, None), (4, [0.0, 0.0])]
    found = similarity.similar_for(frame(spark, items), frame(spark, references), "v", "k", "k", 0.9, 10)
    assert [(r.ref_k, r.k) for r in found.orderBy("rank").collect() if r.k is not None] == [(0, 1), (0, 1), (0, 7)] and found.count() == 4
    with pytest.raises(ValueError):
        similarity.similar_for(frame(spark, items), frame(spark, [(1, [1.0]), (2, [1.0, 2.0])]), "v", "k", "k")
    for x, y in ((items, []), ([], references), (items, [(1, None)])):
        assert similarity.similar_for(frame(spark, x), frame(spark, y), "v", "k", "k").count() == 0


def test_a_third_of_all_vectors_is_one(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 64)
    rng = np.random.default_rng(2)
    items = [(i, [1.0, 0.5, 0.0] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(2000)]
    built = similarity.index(frame(spark, items), "v", "k", 3, 10)
    sizes = [len(r["keys"]) for r in built.blocks.select("keys").collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 64
    references = items[:4]
    found = similarity.similar_for(frame(spark, items), frame(spark, references), "v", "k", "k", 0.99, 7)
    assert result(found) == expected(items, references, 0.99, 7)


def test_references_in_several_passes(spark, clustered, monkeypatch):
    monkeypatch.setattr(similarity, "REFERENCES", 15)
    references = clustered[::60]
    found = similarity.similar_for(frame(spark, clustered), frame(spark, references), "v", "k", "k", 0.8, 4)
    assert result(found) == expected(clustered, references, 0.8, 4)
