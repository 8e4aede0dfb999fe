import hashlib
import random
import re

import numpy as np
import pytest

from assayer.llm import repeats, suffix_array, suffix_tree

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain(rows, window):
    """For (id, sequence) rows, what is covered by a window that starts in a row with a smaller id."""
    first = {}
    for i, s in rows:
        for p in range(len(s) - window + 1):
            k = tuple(s[p : p + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, s in rows:
        gone = [False] * len(s)
        for p in range(len(s) - window + 1):
            if first[tuple(s[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        out.append((i, gone))
    return out


def spans(gone):
    return sum(b and not a for a, b in zip([False, *gone], gone))


def expected(df, window, words):
    rows = [(2**63 - 1 if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in df.collect()]
    rows = [(i, WORD.findall(t) if words else t) for i, t in rows]
    out = []
    for (i, gone), (_, s) in zip(plain(rows, window), rows):
        left = [x for x, g in zip(s, gone) if not g]
        kept = b" ".join(left) if words else bytes(left)
        out.append((None if i == 2**63 - 1 else i, len(s), sum(gone), spans(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df, n):
    rows = df.select("doc_id", n, "n_removed", "n_spans", "kept").collect()
    return sorted(((r[0], r[1], r[2], r[3], hashlib.sha256(r[4].encode() if isinstance(r[4], str) else bytes(r[4])).hexdigest()) for r in rows), key=str)


@pytest.mark.parametrize("hot", [0, 16_384])
def test_words(odd, corpus, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    for df in (odd, corpus):
        assert got(suffix_tree.deduplicated(df), "n_words") == expected(df, 13, True)


def test_bytes(odd, corpus):
    for df in (odd, corpus):
        assert got(suffix_array.deduplicated(df), "n_bytes") == expected(df, 50, False)


def test_other_windows(odd):
    assert got(suffix_tree.deduplicated(odd, 4), "n_words") == expected(odd, 4, True)
    assert got(suffix_array.deduplicated(odd, 20), "n_bytes") == expected(odd, 20, False)


def test_empty_tables_and_carried_columns(odd, empty):
    assert suffix_tree.deduplicated(empty).count() == suffix_array.deduplicated(empty).count() == 0
    out = suffix_tree.deduplicated(odd, carry=["lang", "block", "n_chars"])
    assert out.columns == ["doc_id", "n_words", "n_removed", "n_spans", "kept", "lang", "block", "n_chars"]
    assert sorted(r.n_chars or -1 for r in out.collect()) == sorted(r.n_chars or -1 for r in odd.collect())


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_is_in_order(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(97, 97 + (2, 3, 26)[seed % 3], 3000).astype(np.uint8)
    if seed > 2:
        text[500:900] = 97
        text[2000:2400] = text[1000:1400]
    order = suffix_array.suffix_array(text, 40)
    raw = text.tobytes()
    assert sorted(order.tolist()) == list(range(len(raw)))
    heads = [raw[i : i + 40] for i in order.tolist()]
    assert heads == sorted(heads)
    rising = suffix_array.smaller_than_next(text)
    assert all(rising[i] == (raw[i:] < raw[i + 1 :]) for i in range(len(raw)))


@pytest.mark.parametrize("most", [3, 50, 100_000])
def test_classes_are_equal_windows(monkeypatch, most):
    monkeypatch.setattr(suffix_tree, "GROUP", most)
    random.seed(most)
    segments = [[random.choice("abc") for _ in range(random.randint(5, 30))] for _ in range(40)]
    segments += segments[:5]
    data = np.frombuffer("".join(" ".join(s) + " " for s in segments).encode(), np.uint8)
    starts = np.cumsum([0, *(2 * len(s) for s in segments)])
    windows = np.array([len(s) - 4 for s in segments])
    found = suffix_tree.classes(data, starts, windows, 5)
    flat = [tuple(s[i : i + 5]) for s in segments for i in range(len(s) - 4)]
    assert len(set(zip(found.tolist(), flat))) == len(set(found.tolist())) == len(set(flat))
    found = suffix_array.classes(data, starts, windows * 2 - 1, 9)
    flat = ["".join(w + " " for w in s)[i : i + 9] for s in segments for i in range(2 * len(s) - 9)]
    assert len(set(zip(found.tolist(), flat))) == len(set(found.tolist())) == len(set(flat))
