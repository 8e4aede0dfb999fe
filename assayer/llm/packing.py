"""Operator 1: best-fit packing under conflicts.

Documents are placed into bins of ``capacity`` tokens, largest first, each into the fullest bin that has room for it and holds no
document of the same source or of the same cluster of duplicates. Open bins are ordered by what is left in them. Each bin has a
bitmap of its sources and clusters; a search tree over the rests has the common bits of all bins below each node. The search
goes up from the smallest sufficient rest, passes over whole subtrees in which every bin conflicts, and ends at the tightest bin
that takes the document; if there is none, a bin is opened. So a source or cluster with a third of all rows costs no scan over its bins.

A document's size is the number of its tokens, counted in the tasks; without a vocabulary it is estimated from its bytes.
Shards of about ``SHARD_ROWS`` documents, dealt by the hash of the id, are packed on their own; only ids, sizes and hashes are shuffled.
A document over the capacity is cut: its full pieces fill bins of their own, the rest is placed like any other.

Nulls: a null text has size 0; a null source or cluster conflicts with nothing. Ties in size go by id, then by source and cluster.
Repeated rows are packed as rows of their own (equal texts are one cluster). Documents of size 0 are placed too. An empty table
gives no rows.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from assayer.llm import token_files

#: Tokens that a bin holds.
CAPACITY = 2048
#: Rows that are packed together: a task's memory, whatever the table's size.
SHARD_ROWS = 4096


def estimated_tokens(text: Column) -> Column:
    """About four UTF-8 bytes a token: needs no vocabulary, and can be far below the real number."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def text_cluster(text: Column) -> Column:
    """Equal texts, but for letter case and white space, are one cluster; an empty text is in none."""
    # a run of white space becomes one space; single spaces, which are most, are no matches
    plain = F.trim(F.regexp_replace(F.lower(text), r"[\t\n\x0B\f\r]\s*| \s+", " "))
    # asked of the text itself: a condition on ``plain`` would make it twice
    return F.when(text.rlike(r"\S"), F.xxhash64(plain))


class Bins:
    """Open bins of one shard."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaves = 1 << capacity.bit_length()
        #: Bits that all bins below a node have; -1 (all bits) without any bin.
        self.common = [-1] * (2 * self.leaves)
        self.at: dict[int, list[int]] = {}
        self.rest: list[int] = []
        self.bits: list[int] = []

    def _update(self, rest: int) -> None:
        common, node = self.common, self.leaves + rest
        value = -1
        for i in self.at.get(rest, ()):
            value &= self.bits[i]
        while node and common[node] != value:
            common[node] = value
            value &= common[node ^ 1]
            node >>= 1

    def tightest(self, size: int, bits: int) -> int | None:
        """The compatible bin with the smallest rest of at least ``size``; of several the first opened."""
        common = self.common

        def blocked(node: int) -> bool:
            return common[node] == -1 or bool(common[node] & bits)

        node = self.leaves + size
        if blocked(node):
            node = self._next(node, blocked)
        while node:
            if node < self.leaves:
                left, right = 2 * node, 2 * node + 1
                node = left if not blocked(left) else right if not blocked(right) else self._next(node, blocked)
                continue
            for i in self.at.get(node - self.leaves, ()):
                if not self.bits[i] & bits:
                    return i
            node = self._next(node, blocked)
        return None

    @staticmethod
    def _next(node: int, blocked) -> int:
        """The next subtree to the right that is not blocked, or 0."""
        while node > 1:
            if not node & 1 and not blocked(node + 1):
                return node + 1
            node >>= 1
        return 0

    def place(self, size: int, bits: int) -> tuple[int, int]:
        """Bin and position within it."""
        i = self.tightest(size, bits)
        if i is None:
            i = len(self.rest)
            self.rest.append(self.capacity)
            self.bits.append(0)
        else:
            own = self.at[self.rest[i]]
            own.remove(i)
            if not own:
                del self.at[self.rest[i]]
            self._update(self.rest[i])
        start = self.capacity - self.rest[i]
        self.rest[i] -= size
        self.bits[i] |= bits
        insort(self.at.setdefault(self.rest[i], []), i)
        self._update(self.rest[i])
        return i, start


def packed(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows of index, piece, tokens, bin and start, for documents in the order in which ties are broken."""
    bits = [0] * len(sizes)
    used = 0
    for values in (sources, clusters):
        # what stands alone in the shard conflicts with nothing
        several = [v for v, n in Counter(v for v in values if v is not None).items() if n > 1]
        bit = {v: used + i for i, v in enumerate(several)}
        used += len(bit)
        for i, v in enumerate(values):
            if v in bit:
                bits[i] |= 1 << bit[v]
    out, items, full = [], [], 0
    for i, size in enumerate(sizes):
        pieces, rest = divmod(size, capacity)
        out += [(i, p, capacity, -1, 0) for p in range(pieces)]
        if rest or not pieces:
            items.append((-rest, i, pieces))
    full = len(out)
    out = [(i, p, n, k, 0) for k, (i, p, n, _, _) in enumerate(out)]
    bins = Bins(capacity)
    for rest, i, piece in sorted(items):
        k, start = bins.place(-rest, bits[i])
        out.append((i, piece, -rest, full + k, start))
    return out


def pack(df: DataFrame, size: Column, source: Column, cluster: Column, capacity: int = CAPACITY, id_col: str = "doc_id", total: int | None = None) -> DataFrame:
    """``doc_id``, ``piece``, ``n_tokens``, ``bin_id`` and ``bin_start`` of every piece of every document; ``total`` are the rows, if they are known."""
    rows = df.select(
        df[id_col].cast("long").alias("doc_id"),
        F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("size"),
        F.when(source.isNotNull(), F.xxhash64(source)).alias("source"),
        F.when(cluster.isNotNull(), F.xxhash64(cluster)).alias("cluster"),
    )
    shards = max(1, -(-(df.count() if total is None else total) // SHARD_ROWS))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(x, "ascending") for x in ("doc_id", "size", "source", "cluster")])
        shard = group.column("shard")[0].as_py()
        found = np.array(
            packed(*(group.column(x).to_pylist() for x in ("size", "source", "cluster")), capacity), np.int64
        ).reshape(-1, 5)
        return pa.table(
            {
                "doc_id": group.column("doc_id").take(pa.array(found[:, 0])),
                "piece": found[:, 1],
                "n_tokens": found[:, 2],
                "bin_id": (shard << 32) + found[:, 3],
                "bin_start": found[:, 4],
            }
        )

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "size", "source", "cluster"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, "doc_id long, piece long, n_tokens long, bin_id long, bin_start long")


def pack_documents(df: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Documents with ``text`` and ``source``, packed by the tokens that the vocabulary file at that path makes of them (none: by estimated
    tokens); equal texts are clusters."""
    if vocabulary is None:
        return pack(df, estimated_tokens(df["text"]), df["source"], text_cluster(df["text"]), capacity)
    # texts are encoded once: the rows are counted before
    sized = token_files.counted(df.select("doc_id", "source", text_cluster(df["text"]).alias("cluster"), "text"), vocabulary)
    return pack(sized, sized["n_tokens"], sized["source"], sized["cluster"], capacity, total=df.count())
