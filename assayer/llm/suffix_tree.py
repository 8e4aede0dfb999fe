"""Operator 4: removal of repeated passages with prefix-partitioned suffix trees over words.

Suffixes of the text are split by prefixes of variable length: a prefix with more suffixes than a group may hold is lengthened word
by word. Each group's subtree is built top-down: a node's suffixes are grouped by their next word, children with one suffix are
leaves and are left. The inner nodes that are as deep as the window are its repeats.

Which suffixes can repeat at all, and how they travel, is in ``repeats``: whole texts of all documents are searched.

Null and empty texts have no words and keep nothing. Texts shorter than the window lose nothing. Rows with the same id do not
count as smaller than each other. A null id counts as larger than all others. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from assayer.llm.common import ragged
from assayer.llm.repeats import Kind, without_repeats
from assayer.llm.words import Hashes, words

#: Suffixes whose subtree is built at once.
GROUP = 200_000


def prefix_groups(words_: np.ndarray, suffixes: np.ndarray, depth: int, most: int, at: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """Groups of suffixes with a common prefix (its length, the suffixes), of at most ``most`` unless the prefix is ``depth`` long.

    Small neighbours in the order of prefixes are put together as long as they share the shorter prefix.
    """
    if len(suffixes) <= most or at == depth:
        yield at, suffixes
        return
    next_ = words_[suffixes + at]
    order = np.argsort(next_, kind="stable")
    suffixes, next_ = suffixes[order], next_[order]
    edges = np.append(np.flatnonzero(np.diff(next_, prepend=next_[:1] - 1)), len(next_))
    a = 0
    while a < len(edges) - 1:
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + most, "right")) - 1)
        some = suffixes[edges[a] : edges[b]]
        if b == a + 1:
            yield from prefix_groups(words_, some, depth, most, at + 1)
        else:
            yield at, some
        a = b


def subtree(words_: np.ndarray, suffixes: np.ndarray, depth: int, at: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The inner nodes at ``depth`` below a group's root: node of each suffix that has one (numbers from 0), and the suffixes."""
    node = np.zeros(len(suffixes), np.int64)
    for d in range(at, depth):
        if not len(suffixes):
            break
        child = node * (int(words_.max(initial=0)) + 1) + words_[suffixes + d]
        order = np.argsort(child, kind="stable")
        child, suffixes = child[order], suffixes[order]
        new = np.diff(child, prepend=child[:1] - 1) != 0
        node = np.cumsum(new) - 1
        inner = np.bincount(node)[node] > 1
        suffixes, node = suffixes[inner], node[inner]
        if len(node):
            node = np.cumsum(np.diff(node, prepend=node[:1] - 1) != 0) - 1
    if len(suffixes):
        yield node, suffixes


def classes(data: np.ndarray, starts: np.ndarray, windows: np.ndarray, window: int) -> np.ndarray:
    """A number for each window of each segment (in a row); equal windows have equal numbers."""
    found = words(data, starts)
    _, symbols = np.unique(Hashes(data).of(found.start, found.end), return_inverse=True)
    suffixes = ragged(found.at[:-1], windows)
    place = np.full(len(symbols), -1, np.int64)
    place[suffixes] = np.arange(len(suffixes))
    out, used = np.full(len(suffixes), -1, np.int64), 0
    for at, group in prefix_groups(symbols, suffixes, window, GROUP):
        for node, members in subtree(symbols, group, window, at):
            out[place[members]] = used + node
            used += int(node.max()) + 1
    alone = np.flatnonzero(out < 0)
    out[alone] = used + np.arange(len(alone))
    return out


def word_windows(window: int = 13) -> Kind:
    from assayer.llm.repeats import word_tokens

    return Kind(window, min(3, window), word_tokens, classes)


def deduplicated(df: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``n_spans``, ``kept`` (the remaining words joined by one space) and the carried columns."""
    return without_repeats(df, word_windows(window), id_col, text_col, carry, "n_words", "string")
