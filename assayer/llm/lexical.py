"""Operator 12: ranked lexical search with pair-bound MaxScore.

1. Documents become blocks of about ``BLOCK_BYTES`` of text, each with the postings of its own terms. Spark adds up document
   frequencies and lengths over all blocks; the index is written with the impact of every posting and the largest of each list.
   Documents, counts and lengths take the bytes that the largest of their block needs: a task holds several blocks at once.
2. The terms that most documents hold have the longest lists. For every pair of them the index of a block stores the size of the lists'
   intersection and the largest impact that the two reach together in one document of it.
3. Queries come in blocks of bounded size and visit every block of the index. Terms are ordered by their largest impact. The terms
   from the weak end whose bounds together stay below the tenth best score so far need not be read: only documents that hold
   another term are scored, and dropped as soon as what is left cannot lift them. The bound is not the sum of the terms' own maxima:
   pairs are matched by what they save, and a matched pair counts with its joint maximum (or its larger term, where the lists do
   not meet), so more lists are passed over.
4. Each task keeps the ten best of each query; Spark ranks what the tasks have found.

Scores are exact whole numbers. Terms are told by 64-bit hashes.

Nulls and odd rows: null texts have no terms. Items without a term that some document holds have no rows. Equal rows of the items
count once; rows with one id and different texts are ranked on their own. Documents may share an id; a document without an id comes
after others of its score. Terms with weight 0 add nothing. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from assayer.llm.common import chunks, documents, flat, ragged
from assayer.llm.words import LOWER, Hashes, lookup, words
from assayer.session import cut_lineage

#: Bytes of text in a block of the index: a task's memory, whatever the table's size.
BLOCK_BYTES = 4_000_000
#: Terms of the queries that a task holds at once; more queries visit the index in several passes.
QUERY_TERMS = 500_000
#: Terms with stored pairs, by document frequency.
PAIRED_TERMS = 96
#: Rows of a query's candidates meet in two steps.
SALTS = 32
#: ``[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]``: what stands between terms.
BETWEEN = lookup(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: In the place of a null id: after all others.
NO_ID = np.iinfo(np.int64).max
#: Whole numbers up to here are exact in doubles.
EXACT = 1 << 53
COUNTED = "n_docs long, n_terms long, terms array<long>, dfs array<int>, ids binary, sizes binary, docs binary, tfs binary"
INDEXED = "terms array<long>, dfs array<int>, ids binary, docs binary, gains binary, most array<int>, joint binary, shared binary"


def terms_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each term, and its text's number."""
    found = words(data, starts, BETWEEN)
    if not len(found.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return Hashes(LOWER[data]).of(found.start, found.end).view(np.int64), found.doc


def _grouped(term: np.ndarray, doc: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by term, then document; ``times`` of equal pairs added up. ``doc`` must rise within each term."""
    order = np.argsort(term, kind="stable")
    term, doc, times = term[order], doc[order], times[order]
    first = np.ones(len(term), bool)
    first[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    return term[at], doc[at], np.add.reduceat(times, at) if len(at) else times


def _list(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _small(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, each in as few bytes as the largest needs."""
    most = int(values.max(initial=0))
    return values.astype(next(f"<u{n}" for n in (1, 2, 4, 8) if most < 1 << 8 * n)).tobytes()


def _numbers(x: pa.Scalar, n: int) -> np.ndarray:
    """The ``n`` numbers of ``_small``."""
    data = x.as_buffer()
    return np.frombuffer(data, f"<u{data.size // n}") if n else np.zeros(0, np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of postings of ``doc_id`` and ``text``."""
    for batch in batches:
        for a, b in chunks(batch, BLOCK_BYTES):
            block, parts = batch[a:b], []
            for x, y in chunks(block):
                term, doc = terms_of(*flat(block.column(1)[x:y]))
                parts.append(_grouped(term, doc + x, np.ones(len(term), np.int64)))
            term, doc, tf = _grouped(*(np.concatenate(p) for p in zip(*parts, strict=True)))
            at = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
            sizes = np.bincount(doc, tf, b - a).astype(np.int64)
            row = [
                pa.array([int((sizes > 0).sum())]),
                pa.array([int(sizes.sum())]),
                _list(term[at], pa.int64()),
                _list(np.diff(np.append(at, len(term))).astype(np.int32), pa.int32()),
                *(pa.array([v], pa.binary()) for v in (np.asarray(block.column(0).fill_null(NO_ID)).astype("<i8").tobytes(), _small(sizes), _small(doc), _small(tf))),
            ]
            yield pa.record_batch(row, ["n_docs", "n_terms", "terms", "dfs", "ids", "sizes", "docs", "tfs"])


def gains(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """A posting's share of its term's weight, in millionths: ``n`` are the document's terms, ``total`` those of all ``docs``."""
    most = 90 * docs * int(n.max(initial=0))
    m = 10 + (90 * docs * n // total if most < 1 << 62 else np.array([90 * docs * x // total for x in n.tolist()], np.int64))
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


@dataclass
class Index:
    """Blocks with impacts, and the documents that hold each term."""

    blocks: DataFrame
    terms: DataFrame
    docs: int
    total: int
    #: Hashes and weights of the terms with stored pairs.
    paired: np.ndarray
    weights: np.ndarray


def weight(docs: int, df) -> F.Column:
    return F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * docs + 2)) / (F.lit(2.0) * df + F.lit(1.0)))).cast("long")


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paired: int = PAIRED_TERMS) -> Index:
    """Index every document; the blocks and terms are tables in the shared checkpoint folder."""
    counted = cut_lineage(documents(docs, id_col, text_col).mapInArrow(_counted, COUNTED))
    n, total = (x or 0 for x in counted.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    terms = counted.select(F.inline(F.arrays_zip("terms", "dfs"))).groupBy(F.col("terms").alias("term")).agg(F.sum("dfs").alias("df"))
    terms = cut_lineage(terms)
    # at most ``paired`` rows
    top = terms.select("term", "df", weight(n, F.col("df")).alias("w")).orderBy(F.desc("df"), "term").limit(paired).collect() if n else []
    top.sort(key=lambda r: r["term"])
    hashes, weights = np.array([r["term"] for r in top], np.int64), np.array([r["w"] for r in top], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = {name: batch.column(name)[i] for name in batch.schema.names}
                own, dfs = np.asarray(x["terms"].values), np.asarray(x["dfs"].values).astype(np.int64)
                ids, n_postings = np.frombuffer(x["ids"].as_buffer(), "<i8"), int(dfs.sum())
                sizes, doc, tf = (_numbers(x[c], k).astype(np.int64) for c, k in (("sizes", len(ids)), ("docs", n_postings), ("tfs", n_postings)))
                gain = gains(tf, sizes[doc], n, total) if len(doc) else tf
                starts = np.concatenate([[0], np.cumsum(dfs)])
                most = np.maximum.reduceat(gain, starts[:-1]) if len(own) else gain
                joint, shared = pairs(dense(own, starts, doc, gain, len(ids), hashes, weights))
                row = [x["terms"], x["dfs"], x["ids"], x["docs"], gain.astype("<i4").tobytes(), None, joint.astype("<i8").tobytes(), shared.astype("<i4").tobytes()]
                row = [pa.array([v], t) for v, t in zip(row, (pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.binary()] * 3, pa.list_(pa.int32()), *[pa.binary()] * 2), strict=True)]
                row[5] = _list(most.astype(np.int32), pa.int32())
                yield pa.record_batch(row, ["terms", "dfs", "ids", "docs", "gains", "most", "joint", "shared"])

    return Index(cut_lineage(counted.drop("n_docs", "n_terms").mapInArrow(run, INDEXED)), terms, n, total, hashes, weights)


def dense(terms: np.ndarray, starts: np.ndarray, doc: np.ndarray, gain: np.ndarray, size: int, paired: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Impacts of the paired terms in each document of a block; -1 where a document does not hold the term."""
    out = np.full((len(paired), size), -1, np.int64)
    at = np.searchsorted(terms, paired)
    for row, (p, t, w) in enumerate(zip(at.tolist(), paired.tolist(), weights.tolist(), strict=True)):
        if p < len(terms) and terms[p] == t:
            out[row, doc[starts[p] : starts[p + 1]]] = w * gain[starts[p] : starts[p + 1]]
    return out


def pairs(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of terms the largest joint impact in a document that holds both (0: none does), and how many documents do."""
    n = len(held)
    joint, shared = np.zeros((n, n), np.int64), np.zeros((n, n), np.int64)
    for i in range(n):
        mine = np.flatnonzero(held[i] >= 0)
        if len(mine):
            other = held[i + 1 :, mine]
            both = other >= 0
            joint[i, i + 1 :] = np.where(both, other + held[i, mine], 0).max(1)
            shared[i, i + 1 :] = both.sum(1)
    return joint + joint.T, shared + shared.T


def saved(bounds: np.ndarray, place: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """What matching pairs takes from the bounds of terms in rising order, at the later term of each pair.

    ``place`` is a term's row in ``joint`` or -1. A document with one term of a matched pair gets that term's bound at most, one
    with both their joint maximum; so the pair adds no more than the largest of the three.
    """
    out = np.zeros(len(bounds), np.int64)
    at = np.flatnonzero(place >= 0)
    if len(at) > 1:
        own = bounds[at]
        least = np.maximum(np.maximum(own[:, None], own[None, :]), joint[np.ix_(place[at], place[at])])
        gain = np.triu(own[:, None] + own[None, :] - least, 1)
        i, j = np.nonzero(gain)
        free = np.ones(len(at), bool)
        for k in np.argsort(-gain[i, j], kind="stable").tolist():
            a, b = i[k], j[k]
            if free[a] and free[b]:
                free[a] = free[b] = False
                out[at[b]] += gain[a, b]
    return out


class Best:
    """The best documents of a query so far: highest score, then smallest id."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a document must reach."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.append(self.score, score), np.append(self.id, ids)
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]


class Block:
    """One block of the index, ready for queries."""

    def __init__(self, x: dict, paired: np.ndarray, weights: np.ndarray):
        self.terms, dfs, self.most = (np.asarray(x[c].values) for c in ("terms", "dfs", "most"))
        self.starts = np.concatenate([[0], np.cumsum(dfs.astype(np.int64))])
        self.ids, self.doc = np.frombuffer(x["ids"].as_buffer(), "<i8"), _numbers(x["docs"], int(self.starts[-1]))
        self.gain = np.frombuffer(x["gains"].as_buffer(), "<i4").astype(np.int64)
        self.joint = np.frombuffer(x["joint"].as_buffer(), "<i8").reshape(len(paired), len(paired))
        self.held = np.maximum(dense(self.terms, self.starts, self.doc, self.gain, len(self.ids), paired, weights), 0)

    def added(self, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The impacts of whole lists in each document."""
        size = self.starts[at + 1] - self.starts[at]
        i = ragged(self.starts[at], size)
        impact = np.repeat(w, size) * self.gain[i]
        return np.bincount(self.doc[i], impact, len(self.ids)).astype(np.int64)

    def looked_up(self, at: int, w: int, place: int, docs: np.ndarray) -> np.ndarray:
        """The impact of one term in each of ``docs``."""
        if place >= 0:
            return self.held[place, docs]
        own = self.doc[self.starts[at] : self.starts[at + 1]]
        i = np.minimum(np.searchsorted(own, docs), len(own) - 1)
        return np.where(own[i] == docs, w * self.gain[self.starts[at] + i], 0)

    def search(self, at: np.ndarray, w: np.ndarray, place: np.ndarray, best: Best, use_pairs: bool = True) -> tuple[int, int]:
        """Add the block's documents to ``best``; returns how many postings were read in whole lists, and how many looked up."""
        bounds = w * self.most[at]
        order = np.argsort(bounds, kind="stable")
        at, w, place, bounds = at[order], w[order], place[order], bounds[order]
        cut = bounds - saved(bounds, place, self.joint) if use_pairs else bounds
        upto = np.concatenate([[0], np.cumsum(cut)])
        if upto[-1] < best.least:
            return 0, 0
        if upto[-1] >= EXACT:
            raise OverflowError("an item has too many terms for exact sums")
        least = best.least
        if least == 1:
            # the documents of the strongest terms say what must be reached
            strong = np.flatnonzero(np.cumsum((self.starts[at + 1] - self.starts[at])[::-1]) >= 4 * best.k)
            n = int(strong[0]) + 1 if len(strong) else len(at)
            part = self.added(at[-n:], w[-n:])
            top = np.argsort(-part, kind="stable")[: best.k]
            full = part[top]
            for t in range(len(at) - n):
                full = full + self.looked_up(at[t], w[t], place[t], top)
            if len(top) == best.k:
                least = max(least, int(full.min()))
        # the weak terms: documents without another term stay below what must be reached
        weak = int(np.searchsorted(upto[1:], least, "left"))
        score = self.added(at[weak:], w[weak:])
        read, sought = int((self.starts[at[weak:] + 1] - self.starts[at[weak:]]).sum()), 0
        docs = np.flatnonzero((score > 0) & (score + upto[weak] >= least))
        score = score[docs]
        for t in range(weak - 1, -1, -1):
            if not len(docs):
                break
            score = score + self.looked_up(at[t], w[t], place[t], docs)
            sought += len(docs)
            kept = score + upto[t] >= least
            docs, score = docs[kept], score[kept]
        if len(docs):
            best.add(score, self.ids[docs])
        return read, sought


@dataclass
class Queries:
    """Terms and weights of several queries, one after the other."""

    keys: list
    at: np.ndarray
    terms: np.ndarray
    weights: np.ndarray


def query_terms(items: DataFrame, index: Index, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id``, ``key`` (one for each different row), ``term`` and ``w`` of the terms that documents hold and that have a weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch):
                term, doc = terms_of(*flat(batch.column(2)[a:b]))
                term, doc, _ = _grouped(term, doc, np.ones(len(term), np.int64))
                yield pa.record_batch([batch.column(0)[a:b].take(pa.array(doc)), batch.column(1)[a:b].take(pa.array(doc)), pa.array(term)], ["item_id", "key", "term"])

    rows = items.select(items[id_col].cast("long").alias("item_id"), F.coalesce(items[text_col].cast("string"), F.lit("")).alias("text")).distinct()
    rows = rows.select("item_id", F.md5("text").alias("key"), "text").mapInArrow(run, "item_id long, key string, term long")
    found = rows.join(index.terms.withColumnRenamed("term", "_term"), F.col("term") == F.col("_term"))
    return found.select("item_id", "key", "term", weight(index.docs, F.col("df")).alias("w")).filter("w > 0")


def search(index: Index, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Each item's ``k`` best documents: ``item_id``, ``rank``, ``doc_id``, ``score``."""
    spark = items.sparkSession
    asked = cut_lineage(query_terms(items, index, id_col, text_col)) if index.docs else None
    passes = -(-asked.count() // QUERY_TERMS) if asked else 0
    found = None
    for i in range(passes):
        some = asked if passes == 1 else asked.filter(F.pmod(F.xxhash64("item_id", "key"), F.lit(passes)) == i)
        # about QUERY_TERMS rows of two numbers and a key, whatever the number of items
        rows = some.orderBy("item_id", "key", "term").toArrow()
        if not rows.num_rows:
            continue
        item = list(zip(rows.column("item_id").to_pylist(), rows.column("key").to_pylist(), strict=True))
        first = [j for j in range(len(item)) if not j or item[j] != item[j - 1]]
        queries = Queries([item[j] for j in first], np.array([*first, len(item)]), np.asarray(rows.column("term")), np.asarray(rows.column("w")))
        part = index.blocks.mapInArrow(_searcher(spark.sparkContext.broadcast(queries), index.paired, index.weights, k), "item_id long, key string, doc_id long, score long")
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "item_id long, key string, doc_id long, score long")
    best = [F.desc("score"), F.asc("doc_id")]
    found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "key", "salt").orderBy(*best))).filter(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "key").orderBy(*best))).filter(F.col("rank") <= k)
    return found.select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def _searcher(shared, paired: np.ndarray, weights: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best = [Best(k) for _ in queries.keys]
        place = np.searchsorted(paired, queries.terms)
        if len(paired):
            place = np.where(paired[np.minimum(place, len(paired) - 1)] == queries.terms, place, -1)
        else:
            place = np.full(len(queries.terms), -1)
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block({name: batch.column(name)[i] for name in batch.schema.names}, paired, weights)
                if not len(block.terms):
                    continue
                at = np.searchsorted(block.terms, queries.terms)
                there = block.terms[np.minimum(at, len(block.terms) - 1)] == queries.terms
                for q, (a, b) in enumerate(zip(queries.at[:-1].tolist(), queries.at[1:].tolist(), strict=True)):
                    own = there[a:b]
                    if own.any():
                        block.search(at[a:b][own], queries.weights[a:b][own], place[a:b][own], best[q])
        for (item, key), x in zip(queries.keys, best, strict=True):
            if len(x.score):
                n = len(x.score)
                yield pa.record_batch([pa.array([item] * n, pa.int64()), pa.array([key] * n, pa.string()), pa.array(x.id), pa.array(x.score)], ["item_id", "key", "doc_id", "score"])

    return run


def search_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Index all documents and rank them for each item."""
    return search(build(docs), items, k)
