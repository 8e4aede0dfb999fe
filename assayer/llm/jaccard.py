"""Operator 7: similarity join of documents by Jaccard similarity of word n-grams, with set relations.

A document's set is its distinct shingles of five lower-cased words. Two documents link when their sets' Jaccard similarity is at least
``THRESHOLD`` percent. The result is connectivity: every link of different sets counts, but a link between two sets that are
connected already need not be computed. Steps:

1. Shingles are counted over all documents; each block of documents learns which of its shingles other documents have, and
   roughly how many.
2. Within a block, equal sets become one; in order of rarity a set of n shingles can only reach the threshold with another if they
   share one of the first n - ceil(0.8 n) + 1. Shingles of one document fill these places first, so most sets have no candidate.
3. Sets that share such a shingle are a family; families are components of a graph of ids and never hold a pair's halves apart.
4. A family is compared in tiles. Within a tile an index has lists of sets by shingle, ordered by size; only the blocks of a list
   whose sizes can reach the threshold are read, the rest are skipped by position. A first set's overlaps are counted from its lists;
   those of sets that it links with are derived from them, through the few shingles in which the two sets differ. Sets that are
   connected are not compared again.
5. All tiles of a family share a few pivots, so their large components meet. Sets outside the family's largest component
   then visit its other tiles, ``TILE`` at a time. So all pairs of a family are connected or compared.

Null texts and texts without words have an empty set and link with nothing; so do rows without id (their component is null). Rows that share an
id are one node; a set is told by its digest, so different texts of one id keep all their links. Texts with fewer than five words have their whole sequence as one shingle. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayer.llm.common import mixed, ragged
from assayer.llm.components import Union, components
from assayer.llm.repeats import BLOCK_BYTES, NO_ID, _keys_in, _short, _sorted_rows, _texts, blocked, distinct_keys, shared_keys
from assayer.llm.words import LOWER, Hashes, words
from assayer.session import cut_lineage, scratch_path

SHINGLE = 5
#: Percent.
THRESHOLD = 80
#: Sets of a family that are compared in one tile, and sets that all tiles of a family have.
TILE, PIVOTS = 128, 6
#: Parts into which a large family's sets are dealt when something that holds for the family is joined to them.
SALTS = 32


def shingles(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and their documents, repeats included."""
    found = words(data, starts)
    names = Hashes(LOWER[data]).of(found.start, found.end)
    n = np.diff(found.at)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    begin = ragged(found.at[:-1], count)
    doc = np.repeat(np.arange(len(n)), count)
    end = np.minimum(begin + SHINGLE, found.at[1:][doc])
    return Hashes(names).of(begin, end), doc


def set_digests(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits for each set of keys, equal for equal sets wherever they stand: sums that wrap around, never as floats."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (mixed(key), mixed(key ^ np.uint64(0x5DEECE66D)))]
        return np.stack([np.diff(x[at]) for x in sums], 1)


def needed(n: np.ndarray) -> np.ndarray:
    """How many shingles a set of n must share at least with any set that it links with."""
    return -(-n * THRESHOLD // 100)


def linked(overlap, n, m):
    return 100 * overlap >= THRESHOLD * (n + m - overlap)


_SCHEMA = "kind int, doc_id long, n long, rep long, d1 long, d2 long, token long, shingles binary"


def _described(table: pa.Table, reply: pa.Table) -> pa.Table:
    """A block's rows: 0 documents with their block's representative, 1 representatives with their set's digest, 2 candidate sets,
    3 the shingles by which a candidate can meet others."""
    out = {k: [] for k in ("kind", "doc_id", "n", "rep", "d1", "d2", "token", "shingles")}

    def add(kind: int, size: int, **columns) -> None:
        out["kind"].append(np.full(size, kind, np.int32))
        for name in ("doc_id", "n", "rep", "d1", "d2", "token"):
            out[name].append(np.asarray(columns.get(name, np.zeros(size)), np.int64))
        out["shingles"] += columns.get("shingles", [None] * size)

    if table.num_rows:
        table = _sorted_rows(table)
        ids = np.asarray(table.column("doc_id").fill_null(NO_ID)).astype(np.int64)
        pairs = [_keys_in(x) for x in reply.column("anchors").to_pylist()] or [(np.zeros(0, np.uint64), np.zeros(0, np.uint16))]
        shared, times = np.concatenate([x[0] for x in pairs]), np.concatenate([x[1] for x in pairs])
        order = np.argsort(shared)
        shared, times = shared[order], times[order]
        sizes, digests, kept = [], [], {}
        for first, last, data, starts in _texts(table):
            key, doc = distinct_keys(*shingles(data, starts))
            n = np.bincount(doc, minlength=last - first)
            at = np.concatenate([[0], np.cumsum(n)])
            sizes.append(n)
            digests.append(set_digests(key, at))
            if not len(key):
                continue
            place = np.minimum(np.searchsorted(shared, _short(key)), max(len(shared) - 1, 0))
            often = np.where(shared[place] == _short(key), times[place], 1).astype(np.int64) if len(shared) else np.ones(len(key), np.int64)
            # the rarest first; those of one document alone fill the first places
            room = n - needed(n) + 1 - np.bincount(doc, often == 1, last - first).astype(np.int64)
            for i in np.flatnonzero((room > 0) & (n > 0)).tolist():
                x, f = key[at[i] : at[i + 1]], often[at[i] : at[i + 1]]
                some = np.flatnonzero(f > 1)
                kept[first + i] = (x, x[some[np.lexsort((x[some], f[some]))[: room[i]]]])
        n, digest = np.concatenate(sizes), np.concatenate(digests).view(np.int64)
        order = np.lexsort((ids, digest[:, 1], digest[:, 0], n))
        new = np.ones(len(order), bool)
        new[1:] = (n[order][1:] != n[order][:-1]) | (digest[order][1:] != digest[order][:-1]).any(1)
        head = order[new]
        rep = np.empty(len(order), np.int64)
        rep[order] = ids[head][np.cumsum(new) - 1]
        # empty sets and rows without id stand alone
        rep = np.where(n == 0, ids, rep)
        real = ids != NO_ID
        add(0, len(ids), doc_id=np.where(real, ids, NO_ID), n=n, rep=rep)
        head = head[(n[head] > 0) & real[head]]
        add(1, len(head), rep=ids[head], n=n[head], d1=digest[head, 0], d2=digest[head, 1])
        chosen = np.array([i for i in head.tolist() if i in kept], np.int64)
        add(2, len(chosen), rep=ids[chosen], n=n[chosen], d1=digest[chosen, 0], d2=digest[chosen, 1], shingles=[kept[i][0].tobytes() for i in chosen.tolist()])
        tokens = [kept[i][1].view(np.int64) for i in chosen.tolist()]
        times = [len(x) for x in tokens]
        add(3, sum(times), rep=np.repeat(ids[chosen], times), d1=np.repeat(digest[chosen, 0], times), token=np.concatenate([*tokens, np.zeros(0, np.int64)]))
    columns = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items() if k != "shingles"}
    return pa.table({k: pa.array(v, pa.int32() if k == "kind" else pa.int64()) for k, v in columns.items()} | {"shingles": pa.array(out["shingles"], pa.binary())})


def connected(sets: list[np.ndarray], labels: np.ndarray) -> list[tuple[int, int]]:
    """Links (pairs of indices) that connect what is linked; sets of one label count as connected.

    Sets are sorted arrays of distinct hashes. Every pair is connected by the result, or was compared, or cannot reach the
    threshold by its sizes.
    """
    n = np.array([len(x) for x in sets])
    order = np.argsort(n, kind="stable")
    n = n[order]
    sets, labels = [sets[i] for i in order], labels[order]
    joined = Union(len(sets))
    first: dict[int, int] = {}
    for i, label in enumerate(labels.tolist()):
        joined.join(i, first.setdefault(label, i))
    out: list[tuple[int, int]] = []
    token, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    by = np.argsort(inverse, kind="stable")
    lists, begins = owner[by], np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(token)))])
    at = np.concatenate([[0], np.cumsum(n)])
    own = [inverse[at[i] : at[i + 1]] for i in range(len(sets))]

    def counted(tokens: np.ndarray) -> np.ndarray:
        """How many of ``tokens`` each set has."""
        where = ragged(begins[tokens], begins[tokens + 1] - begins[tokens])
        return np.bincount(lists[where], minlength=len(sets))

    done = np.zeros(len(sets), bool)
    for start in range(len(sets)):
        if done[start]:
            continue
        base, base_tokens = counted(own[start]), own[start]
        queue = [start]
        done[start] = True
        while queue:
            q = queue.pop()
            # only sets whose sizes can reach the threshold: a range, since lists are in order of size
            low, high = np.searchsorted(n, -(-n[q] * THRESHOLD // 100)), np.searchsorted(n, n[q] * 100 // THRESHOLD, "right")
            if q == start:
                overlap = base
            else:
                less, more = np.setdiff1d(base_tokens, own[q], True), np.setdiff1d(own[q], base_tokens, True)
                if len(less) + len(more) < len(own[q]):
                    overlap = base - counted(less) + counted(more)
                else:
                    overlap = counted(own[q])
            hit = low + np.flatnonzero(linked(overlap[low:high], n[q], n[low:high]))
            for y in hit.tolist():
                if joined.join(q, y):
                    out.append((q, y))
                if not done[y]:
                    done[y] = True
                    queue.append(y)
        # what is left may still link with sets of this component only through a pair that was compared above
    return [(int(order[a]), int(order[b])) for a, b in out]


def _tile_links(group: pa.Table) -> pa.Table:
    """Links of all tiles of a bucket."""
    group = group.sort_by([("tile", "ascending"), ("rep", "ascending")])
    tile = group.column("tile").to_numpy()
    rep, label, raw = group.column("rep").to_numpy(), group.column("label").to_numpy(), group.column("shingles").to_pylist()
    edges = np.flatnonzero(np.diff(tile, prepend=tile[:1] - 1)).tolist() + [len(tile)]
    found: list[tuple[int, int]] = []
    for a, b in zip(edges, edges[1:], strict=False):
        if b - a > 1:
            sets = [np.frombuffer(x, "<u8") for x in raw[a:b]]
            found += [(a + x, a + y) for x, y in connected(sets, label[a:b])]
    x, y = np.array([p[0] for p in found], np.int64), np.array([p[1] for p in found], np.int64)
    return pa.table({"a": rep[x], "b": rep[y]})


def _compared(sets: DataFrame) -> DataFrame:
    """Links of sets (tile, rep, label, shingles) within their tiles."""
    parts = sets.sparkSession.conf.get("spark.sql.shuffle.partitions")
    bucket = F.pmod(F.xxhash64("tile"), F.lit(4 * int(parts)))
    return sets.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_tile_links, "a long, b long")


def _with_family(sets: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """``sets`` with ``facts`` of large families (few rows), joined by family and a part of it, so no task gets a whole family."""
    salted = sets.withColumn("_salt", F.pmod(F.xxhash64("d1", "d2", F.lit("salt")), F.lit(SALTS)).cast("int"))
    spread = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, ["family", "_salt"], how).drop("_salt")


def _connected_sets(sets: DataFrame, meetings: DataFrame, files: int) -> DataFrame:
    """Links (of reps) that connect all linked sets: ``sets`` (rep, d1, d2, shingles), ``meetings`` (token, d1). Tables on the way have at most ``files`` files.

    A set is its digest (d1, d2); its rep may stand for other texts of the same id too, which is one node anyway. Two sets with the
    same d1 alone only share a family."""
    least = meetings.groupBy("token").agg(F.min("d1").alias("b"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    family = components(meetings.join(least, "token").select(F.col("d1").alias("a"), "b"), files)
    family = family.select(F.col("node").alias("d1"), F.col("label").alias("family"))
    sets = cut_lineage(sets.join(family, "d1"), files)
    size = sets.groupBy("family").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > TILE)
    tiles = F.coalesce(F.ceil(F.col("c") / TILE), F.lit(1)).cast("long")
    # a tile is its family and a number
    dealt = _with_family(sets, size, "left").withColumn("tiles", tiles).withColumn("number", F.pmod(F.xxhash64("d1", "d2"), F.col("tiles")))
    dealt = cut_lineage(dealt.select("family", "tiles", "number", "rep", "d1", "d2", "shingles"), files)
    large = dealt.filter("tiles > 1")
    # pivots: a few sets of each large family, by the hash of their digests
    ranked = large.select("family", "tiles", "number", "d1", "d2", F.xxhash64("d1", "d2", F.lit("pivot")).alias("h"))
    pivots = ranked.groupBy("family", "number").agg(F.min(F.struct("h", "d1", "d2", "tiles")).alias("p"))
    pivots = pivots.filter(f"number < {PIVOTS}").select("family", F.col("number").alias("home"), "p.d1", "p.d2", "p.tiles")
    spread = pivots.join(large.select("d1", "d2", "rep", "shingles"), ["d1", "d2"]).select(
        "family", "home", "rep", "shingles", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("number")
    )
    tile = F.xxhash64("family", "number").alias("tile")
    own = dealt.select(tile, "rep", F.col("rep").alias("label"), "shingles")
    guests = spread.filter("number <> home").select(tile, "rep", F.col("rep").alias("label"), "shingles")
    links = cut_lineage(_compared(own.union(guests)), files)
    if large.isEmpty():
        return links
    # sets outside their family's largest component visit its other tiles
    label = components(links, files)
    known = large.join(label, large["rep"] == label["node"], "left").select("family", "tiles", "number", "rep", "d1", "d2", F.coalesce("label", "rep").alias("label"), "shingles")
    known = cut_lineage(known, files)
    count = known.groupBy("family", "label").agg(F.count(F.lit(1)).alias("c"))
    main = count.groupBy("family").agg(F.max(F.struct("c", "label")).alias("m")).select("family", F.col("m.label").alias("main"))
    known = _with_family(known, main)
    visitors = known.filter("label <> main").select("family", "tiles", "number", "rep", "label", "shingles")
    # the visitors of one tile go together; a pair of tiles has at most TILE members and TILE visitors
    away = visitors.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).filter("to <> number")
    pair = F.xxhash64("family", "to", "number").alias("tile")
    guests = away.select(pair, "rep", "label", "shingles")
    from_ = visitors.select("family", F.col("number").alias("from")).distinct()
    hosts = _with_family(known, from_).filter("from <> number")
    hosts = hosts.select(F.xxhash64("family", "number", "from").alias("tile"), "rep", "label", "shingles")
    return links.union(cut_lineage(_compared(guests.union(hosts)), files)).union(label.select("node", "label"))


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (the smallest id reachable by links) of every row."""
    spark = df.sparkSession
    total = df.agg(F.sum(F.octet_length(df[text_col].cast("string")))).first()[0] or 0
    blocks = max(2 * spark.sparkContext.defaultParallelism, -(-total // BLOCK_BYTES))
    rows = blocked(df, id_col, text_col, blocks, [])
    reply = shared_keys(df, id_col, text_col, shingles, blocks, blocks)
    path = scratch_path(spark, "sets")
    rows.groupBy("block").cogroup(reply.groupBy("block")).applyInArrow(_described, _SCHEMA).write.partitionBy("kind").parquet(path)
    described = spark.read.schema(_SCHEMA).parquet(path)
    classes = described.filter("kind = 1").select("rep", "n", "d1", "d2")
    same = cut_lineage(classes.groupBy("n", "d1", "d2").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("c")), blocks)
    # equal sets of different blocks: one stands for all
    copies = classes.join(same.filter("c > 1"), ["n", "d1", "d2"]).select(F.col("rep").alias("a"), F.col("least").alias("b")).filter("a <> b")
    ones = same.select(F.col("least").alias("rep"), "n", "d1", "d2")
    sets = described.filter("kind = 2").select("rep", "n", "d1", "d2", "shingles").join(ones, ["rep", "n", "d1", "d2"], "left_semi")
    sets = sets.dropDuplicates(["n", "d1", "d2"]).drop("n")
    meetings = described.filter("kind = 3").select("token", "rep", "d1").join(ones, ["rep", "d1"], "left_semi").select("token", "d1").distinct()
    links = copies.union(_connected_sets(sets, meetings, blocks))
    docs = described.filter("kind = 0")
    # rows that share an id are one node, though they lie in different blocks or have different texts
    named = docs.filter(f"doc_id <> {NO_ID}").select("doc_id", "rep")
    several = named.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("c")).filter("b <> c").select("doc_id", "b")
    links = links.union(named.join(several, "doc_id").filter("rep <> b").select("rep", "b"))
    label = components(links, blocks)
    out = docs.join(label, docs["rep"] == label["node"], "left")
    return out.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id") != NO_ID, F.coalesce(F.col("label"), F.col("rep"))).alias("component_id"),
    )
