import random
import re
from pathlib import Path
from urllib.parse import unquote, urlparse

import numpy as np
import pytest

from assayer.llm import fingerprints, jaccard, near_vectors
from assayer.llm.components import components
from assayer.session import checkpoint_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def groups(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def expected(df):
    rows = [(r.doc_id, shingles(r.text)) for r in df.collect()]
    real = [(i, s) for i, s in rows if i is not None]
    links = [(a, b) for x, (a, s) in enumerate(real) for b, t in real[:x] if s and 100 * len(s & t) >= 80 * len(s | t)]
    label = groups(links, {i for i, _ in real})
    return sorted(((i, len(s), label.get(i)) for i, s in rows), key=str)


def got(df):
    return sorted((tuple(r) for r in jaccard.join(df).collect()), key=str)


def test_links_of_documents(odd, corpus):
    for df in (odd, corpus):
        assert got(df) == expected(df)


def test_tables_on_the_way_have_few_files(spark, corpus):
    """However many shuffle partitions there are: each written file starts processes on a local file system without native code."""
    want, parent = expected(corpus), Path(unquote(urlparse(checkpoint_dir(spark)).path))
    before, held = set(parent.glob("assayer-cut-*")), {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert got(corpus) == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    files = [len(list(x.glob("*.parquet"))) for x in set(parent.glob("assayer-cut-*")) - before]
    assert len(files) > 5 and max(files) <= 2 * spark.sparkContext.defaultParallelism < 61


def test_empty_table(empty):
    assert jaccard.join(empty).count() == 0


def test_a_large_family_of_near_copies(spark, monkeypatch):
    """Tiles of few sets, so that pivots and visitors are needed."""
    monkeypatch.setattr(jaccard, "TILE", 8)
    random.seed(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(random.choice([0, 1, 1, 2, 2, 3, 4])):
            words[random.randrange(len(words))] = f"x{random.randrange(40)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = expected(df)
    assert got(df) == want and 1 < len({r[2] for r in want}) < 150


@pytest.mark.parametrize("tile", [8, 128])
def test_different_texts_of_one_id_keep_all_their_links(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    text = lambda name, *changed: " ".join(f"{name}x{i}" if i in changed else f"{name}{i}" for i in range(150))
    names = [f"t{k}_" for k in range(12)]
    # ids 1..3 have four texts each, every one near a text of another id, and an empty one
    rows = [(1 + k % 3, text(n)) for k, n in enumerate(names)] + [(100 + k, text(n, 5)) for k, n in enumerate(names)]
    rows += [(100 + k, text(n)) for k, n in enumerate(names[:2])] + [(200 + k, text(names[0], k)) for k in range(40)]
    rows += [(2, ""), (101, ""), (7, text("u")), (9, text("u")), (9, ""), (9, text("v")), (8, text("v", 1)), (9, text("w")), (6, text("w"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = expected(df)
    assert got(df) == want and {r[2] for r in want} == {1, 2, 3, 6}


def test_equal_sets_have_equal_digests_wherever_they_stand():
    key = np.random.default_rng(8).integers(0, 2**63, 300).astype(np.uint64)
    found = jaccard.set_digests(np.concatenate([key[:100], key, key[:100]]), np.array([0, 100, 400, 500]))
    assert found.dtype == np.uint64 and (found[0] == found[2]).all() and (found[0] != found[1]).all()


def test_connected_finds_all_components():
    rng = np.random.default_rng(7)
    for _ in range(40):
        sets = []
        for _ in range(rng.integers(2, 25)):
            base = rng.integers(0, 3)
            sets.append(np.unique(np.concatenate([np.arange(base * 100, base * 100 + rng.integers(20, 40)), rng.integers(0, 400, rng.integers(0, 8))])).astype(np.uint64))
        labels = rng.integers(0, 12, len(sets))
        links = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))]
        same = [(i, j) for i in range(len(sets)) for j in range(i) if labels[i] == labels[j]]
        found = jaccard.connected(sets, labels)
        assert set(map(tuple, map(sorted, found))) <= set(map(tuple, map(sorted, links)))
        assert groups(found + same, range(len(sets))) == groups(links + same, range(len(sets)))


def test_components(spark):
    random.seed(9)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500 + i) for i in range(200)]
    df = spark.createDataFrame([*links, *links[:20]], "a long, b long")
    label = groups(links, {x for p in links for x in p})
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert {tuple(r) for r in components(df).collect()} == {(n, x) for n, x in label.items() if n not in alone}
    assert components(df.limit(0)).count() == 0


def vectors(spark, seed=0, n=700, dim=12):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, dim))
    x = centre[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.3, 2.0], n)[:, None]
    x[: n // 5] = x[0]
    rows = [(i, [float(v) for v in r], "t") for i, r in enumerate(x)]
    rows += [(n, None, "t"), (n + 1, [], "t"), (n + 2, [0.0] * dim, "t"), (n + 3, [float("nan")] + [1.0] * (dim - 1), "t"), (n + 4, [None] + [1.0] * (dim - 1), "t")]
    rows += [(n + 5, [1.0, 2.0], "t"), (n + 6, [2.0, 4.0], "t"), (n + 7, [1e200] * dim, "t"), (n + 8, [1e-200] * dim, "t"), (None, rows[0][1], "t")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, tile string")


@pytest.mark.parametrize("tile", [40, 2048])
def test_links_of_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(near_vectors, "TILE", tile)
    df = vectors(spark)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    good = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            v = np.array(v) / np.abs(v).max()
            good[i] = v / np.linalg.norm(v)
    ids = sorted(good)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.9]
    label, n = groups(links, [i for i, _ in rows if i is not None]), {}
    for p in links:
        for i in p:
            n[i] = n.get(i, 0) + 1
    want = sorted(((i, n.get(i, 0), label.get(i), None if i is None else label[i] == i) for i, _ in rows), key=str)
    assert sorted((tuple(r) for r in near_vectors.linked(df).collect()), key=str) == want
    assert near_vectors.linked(df.limit(0)).count() == 0


def test_different_vectors_of_one_id_keep_their_own_links(spark):
    rng = np.random.default_rng(4)
    a, b, c, d = np.eye(12)[:4] * 2
    near = lambda x: x + rng.normal(size=12) * 0.05
    rows = [(5, a), (5, b), (9, a), (11, b), (3, c), (5, c), (5, a), (40, d), (40, near(d))]
    rows += [(20 + i, near(a)) for i in range(3)] + [(30 + i, near(b)) for i in range(5)]
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.9
    label = groups([(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(hit))], [i for i, _ in rows])
    want = sorted((i, int(h.sum()) - 1, label[i], label[i] == i) for (i, _), h in zip(rows, hit))
    assert sorted(tuple(r) for r in near_vectors.linked(df).collect()) == want


@pytest.mark.parametrize("spread", [True, False])
def test_vectors_are_not_sent_for_each_pair_of_tiles(spark, monkeypatch, spread):
    """Where all tiles are near each other, no vector is shuffled again; where few are, only those meet."""
    monkeypatch.setattr(near_vectors, "TILE", 40)
    monkeypatch.setattr(near_vectors, "ROWS", 16)
    monkeypatch.setattr(near_vectors, "NEAR", 1)
    plans, cut = [], near_vectors.cut_lineage

    def seen(df, *most):
        if "root" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, *most)

    monkeypatch.setattr(near_vectors, "cut_lineage", seen)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 24)) if spread else np.outer(np.repeat([1, -1], 40), np.eye(24)[0]) + rng.normal(size=(80, 24)) * 0.01
    if spread:
        x[40:80] = x[:40] + rng.normal(size=(40, 24)) * 0.05
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.9
    label = groups(list(zip(*(v.tolist() for v in np.nonzero(hit)))), range(len(x)))
    want = [(i, int(h.sum()) - 1, label[i], label[i] == i) for i, h in enumerate(hit)]
    assert sorted(tuple(r) for r in near_vectors.linked(df).collect()) == want
    assert len(plans) == 1 and ("CartesianProduct" in plans[0]) == spread
    assert not spread or "Exchange" not in plans[0]


def test_bounds_never_lose_a_pair():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 40)) + 3 * rng.normal(size=(1, 40))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turned = x @ near_vectors.axes(x)
    i, j = near_vectors.survivors(turned, turned, 0.9)
    assert set(zip(*np.nonzero(x @ x.T >= 0.9))) <= set(zip(i.tolist(), j.tolist()))


# --- fingerprints -------------------------------------------------------------------------------


def prints(texts):
    return fingerprints._all([t.encode() for t in texts])


def test_equal_texts_have_equal_fingerprints_wherever_they_stand():
    texts = ["", "a", "aaaa", "ab", "abc" * 50, "the quick brown fox " * 40, "été 漢字 🙂"]
    assert (prints(texts + texts[::-1]) == np.concatenate([prints(texts), prints(texts)[::-1]])).all()
    assert all((prints([t])[0] == p).all() for t, p in zip(texts, prints(texts)))


def test_neighbours_keep_different_labels():
    rng = np.random.default_rng(1)
    for symbols in (rng.integers(0, 256, 2000).astype(np.uint8), rng.integers(0, 2**63, 2000).astype(np.uint64)):
        symbols = symbols[np.append(True, symbols[1:] != symbols[:-1])]
        first = np.zeros(len(symbols), bool)
        first[[0, 1, 2, 700, 1500]] = True
        label = fingerprints.labels_of(symbols, first)
        inside = ~first[1:]
        assert label.max() < 6 and (label[1:] != label[:-1])[inside].all()


def test_shared_substrings_share_names():
    rng = np.random.default_rng(2)
    words = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 5000, n))
    shared = words(400)
    a, b, c = words(3) + shared, words(50) + shared, words(450)
    x = prints([a, b, c])
    assert fingerprints.likeness(x[:1], x[1:2])[0] > 0.7 and fingerprints.likeness(x[:1], x[2:])[0] < 0.1


def test_compared_with_the_next(spark, odd, corpus, empty):
    for df in (odd, corpus):
        rows = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, (r.text or "").encode()))
        found = fingerprints.compare_next(df).collect()
        want = []
        for r, after in zip(rows, rows[1:] + rows[:1]):
            t, q = r.text or "", len(r.text or "") // 4
            edited = t[: len(t) - q] + (after.text or "")[:q]
            p = prints([t, edited, after.text or ""])
            want.append((r.doc_id, len(t), fingerprints.text_of(p[0]), fingerprints.text_of(p[1]), fingerprints.likeness(p[:1], p[1:2])[0], fingerprints.likeness(p[:1], p[2:])[0]))
        assert sorted(((r.doc_id, r.n_chars, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in found), key=str) == sorted(want, key=str)
    assert fingerprints.compare_next(empty).count() == fingerprints.fingerprint(empty).count() == 0
    one = spark.createDataFrame([(1, "just one document")], "doc_id long, text string")
    assert fingerprints.compare_next(one).first().near_next == 1.0
