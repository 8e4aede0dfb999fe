"""Connected components of links, by star contraction on DataFrames.

A round hangs each node's larger neighbours on the smallest node around it, then its smaller ones. Rounds grow with the
logarithm of the longest chain. Each round is written to the shared checkpoint folder, so a lost executor costs one round at
most, and nothing but a count and a checksum reaches the driver. A hub's links are aggregated in the tasks first, and the joins
on hubs are plain equi joins that adaptive execution splits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from assayer.session import cut_lineage


#: Links for each file of a round's table.
FILE_LINKS = 250_000


def _larger_to_smallest(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    found = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return found.distinct()


def _smaller_to_smallest(links: DataFrame) -> DataFrame:
    """``links`` lead from larger to smaller nodes."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("w"), "m")
    found = links.join(least, F.col("a") == F.col("w"))
    return found.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("w", "m")).distinct()


def components(links: DataFrame, files: int | None = None) -> DataFrame:
    """``node`` and ``label`` (the smallest node reachable) of every node with a link to another; ``links`` has columns a and b, without nulls.

    An empty table gives no rows. Links of a node with itself and repeated links change nothing. The first table has at most ``files`` files, those
    of the rounds as many as the links need: a local file system without native code starts processes for each file.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    links = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), files)
    before = None
    while True:
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before or not now[0]:
            break
        before = tuple(now)
        links = cut_lineage(_smaller_to_smallest(_larger_to_smallest(links)), -(-now[0] // FILE_LINKS))
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).union(links.select("b", "b")).distinct()


class Union:
    """Sets of indices that were joined, within a task."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.parent))], np.int64)
