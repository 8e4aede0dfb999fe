"""Operator 9: removal of repeated byte strings with suffix arrays by two-stage sorting.

Of the suffixes of a text only those smaller than their successors are sorted directly, eight bytes at a time and as deep as
the window. The others follow by scanning the buckets of first bytes in order: each suffix found puts its predecessor, if that is
larger, at the end of what its bucket has so far. Adjacent suffixes of the finished array with a common prefix as long as the window hold equal
windows.

Which strings can repeat at all, and how they travel, is in ``repeats``: whole texts of all documents are searched, and
matches never cross documents.

Null and empty texts have no bytes. Texts shorter than the window lose nothing. Rows with the same id do not count as smaller
than each other. A null id counts as larger than all others. An empty table gives no rows. What is kept is bytes, since a cut
may fall inside a character.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from assayer.llm.common import ragged
from assayer.llm.repeats import Kind, byte_tokens, without_repeats


def eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number, zeros beyond the end."""
    x = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    x = (x[:-1] << np.uint64(8)) | x[1:]
    x = (x[:-2] << np.uint64(16)) | x[2:]
    x = (x[:-4] << np.uint64(32)) | x[4:]
    return x[: len(text)]


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that begins a place later (the empty suffix is the smallest)."""
    n = len(text)
    change = np.ones(n, bool)
    change[:-1] = text[:-1] != text[1:]
    # the last place of each run of equal bytes decides for the run
    last = np.flatnonzero(change)
    up = np.zeros(len(last), bool)
    up[:-1] = text[last[:-1]] < text[last[1:]]
    return np.repeat(up, np.diff(last, prepend=-1))


def directly_sorted(text: np.ndarray, packed: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of their suffixes' first ``depth`` bytes (rounded up to eights); ties keep their order."""
    order = np.argsort(packed[places], kind="stable")
    places = places[order]
    key = packed[places]
    rank = np.cumsum(np.diff(key, prepend=key[:1] + np.uint64(1)) != 0)
    for at in range(8, depth, 8):
        tied = np.zeros(len(places), bool)
        same = rank[1:] == rank[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        open_ = np.flatnonzero(tied)
        if not len(open_):
            break
        some = places[open_]
        where = some + at
        key = np.where(where < len(text), packed[np.minimum(where, len(text) - 1)], np.uint64(0))
        order = np.lexsort((key, rank[open_]))
        places[open_], key = some[order], key[order]
        # ranks stay in order: split a group by adding its members' steps
        group = rank[open_]
        step = np.zeros(len(places), np.int64)
        step[open_[1:]] = (key[1:] != key[:-1]) & (group[1:] == group[:-1])
        rank = rank + np.cumsum(step)
    return places


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes in the order of their first ``depth`` bytes at least."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    rising = smaller_than_next(text)
    direct = directly_sorted(text, eights(text), np.flatnonzero(rising), depth)
    ends = np.concatenate([[0], np.cumsum(np.bincount(text[direct], minlength=256))])
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        layers = list(induced[c])
        new = np.concatenate(layers) if layers else np.zeros(0, np.int64)
        while len(new):
            before = new[new > 0] - 1
            new = before[(text[before] == c) & ~rising[before]]
            if len(new):
                layers.append(new)
        found = np.concatenate([*layers, direct[ends[c] : ends[c + 1]]])
        induced[c] = []
        out.append(found)
        before = found[found > 0] - 1
        first = text[before]
        larger = (first > c) & ~rising[before]
        before, first = before[larger], first[larger]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        edges = np.append(np.flatnonzero(np.diff(first, prepend=first[:1] ^ 1)), len(first))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            induced[first[a]].append(before[a:b])
    return np.concatenate(out)


def common_prefixes(packed: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Whether each suffix of the order shares its first ``most`` bytes with the one before it."""
    alike = np.zeros(len(order), bool)
    live = np.arange(1, len(order))
    for at in [*range(0, most - 8, 8), most - 8] if most >= 8 else []:
        a, b = order[live] + at, order[live - 1] + at
        ok = (a < len(packed)) & (b < len(packed))
        live, a, b = live[ok], a[ok], b[ok]
        live = live[packed[a] == packed[b]]
    alike[live] = True
    return alike


def classes(data: np.ndarray, starts: np.ndarray, windows: np.ndarray, window: int) -> np.ndarray:
    """A number for each window of each segment (in a row); equal windows have equal numbers."""
    order = suffix_array(data, window)
    # only suffixes at which a window begins; their order stays
    place = np.full(len(data), -1, np.int64)
    begins = ragged(starts[:-1], windows)
    place[begins] = np.arange(len(begins))
    order = order[place[order] >= 0]
    alike = common_prefixes(eights(data), order, window)
    out = np.empty(len(begins), np.int64)
    out[place[order]] = np.cumsum(~alike) - 1
    return out


def byte_windows(window: int = 50) -> Kind:
    """Windows of at least 16 bytes."""
    if window < 16:
        raise ValueError("a window has 16 bytes at least")
    return Kind(window, max(8, min(16, window - 8)), byte_tokens, classes)


def deduplicated(df: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the remaining bytes) and the carried columns."""
    return without_repeats(df, byte_windows(window), id_col, text_col, carry, "n_bytes")
