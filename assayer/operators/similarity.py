"""Similar items for a whole table of references: lists of vectors around centres, read by bound or by nearest lists.

Every vector is assigned to its nearest centre and stored in blocks of one list each. A block knows how far its vectors reach
from the centre, so the best cosine that a reference can find in it is known from the two angles. Blocks that cannot reach the
threshold, or the reference's ``k`` best so far, are passed over; the rest is compared exactly. So the answer is exact; with
``probes`` each reference visits only its nearest lists, which reads less and may miss items.

References come in blocks of bounded size and visit the index; items are never joined with references, and a list with a third of
all vectors is many blocks in several tasks. Vectors that are null, zero, or hold nulls or non-finite numbers are similar to nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from assayer.session import cut_lineage, with_package

#: Vectors of a block, and references that a task holds at once.
BLOCK, REFERENCES = 4096, 50_000
#: Vectors that the centres are fitted to, whatever the table's size; every vector is assigned.
FIT_ROWS = 20_000
_SLACK = 1e-9


@dataclass
class VectorIndex:
    """Blocks of unit vectors by list, and the centres of the lists."""

    blocks: DataFrame
    centres: np.ndarray


def _unit(df: DataFrame, vector: str, key: str, dim: int) -> DataFrame:
    """``_key`` and ``_v``, the vector at length one; unusable vectors are left out."""
    v = F.col(vector).cast("array<double>")
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.filter(F.coalesce(fine, F.lit(False))).select(F.col(key).alias("_key"), v.alias("_v"))
    # scaled by the largest entry first, so squares neither overflow nor vanish
    rows = rows.withColumn("_top", F.array_max(F.transform("_v", lambda x: F.abs(x)))).filter("_top > 0")
    rows = rows.withColumn("_v", F.transform("_v", lambda x: x / F.col("_top")))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("_norm", norm).select("_key", F.transform("_v", lambda x: x / F.col("_norm")).alias("_v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def centres_of(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Centres on the unit sphere for the sample's rows: farthest-first starts, then means."""
    if not len(sample):
        return sample
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < min(lists, len(sample)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    centres = sample[chosen]
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


def index(items: DataFrame, vector: str, key: str, dim: int, lists: int | None = None) -> VectorIndex:
    """Assign every vector to a list and write the lists in blocks to the shared checkpoint folder."""
    with_package(items.sparkSession)
    rows = cut_lineage(_unit(items, vector, key, dim))
    total = rows.count()
    lists = lists or max(1, min(1024, int(total**0.5)))
    share = F.lit(int(min(1.0, FIT_ROWS / max(total, 1)) * (2**62)))
    picked = rows.filter(F.pmod(F.xxhash64("_key"), F.lit(2**62)) <= share).limit(2 * FIT_ROWS).select("_v").toArrow()
    sample = _matrix(picked.column("_v").combine_chunks(), dim) if picked.num_rows else np.zeros((0, dim))
    centres = centres_of(sample[: 2 * FIT_ROWS], lists) if len(sample) else np.eye(1, dim)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = _matrix(batch.column(1), dim) @ centres.T
            own = cosine.argmax(1)
            yield pa.record_batch([*batch.columns, pa.array(own.astype(np.int32))], ["_key", "_v", "_list"])

    kind = rows.schema["_key"].dataType.simpleString()
    assigned = rows.mapInArrow(assign, f"_key {kind}, _v array<double>, _list int")
    # ranges of (list, hash): a large list lies in several tasks, a task's rows are in order of lists
    assigned = assigned.withColumn("_at", F.xxhash64("_key")).repartitionByRange("_list", "_at").sortWithinPartitions("_list")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column(2))
            ends = np.append(np.flatnonzero(np.diff(own)) + 1, len(own))
            begins = np.append(0, ends[:-1])
            for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
                for x in range(a, b, BLOCK):
                    y = min(b, x + BLOCK)
                    v = _matrix(batch.column(1)[x:y], dim)
                    least = float((v @ centres[own[x]]).min())
                    keys = pa.ListArray.from_arrays(pa.array([0, y - x], pa.int32()), pa.concat_arrays([batch.column(0)[x:y]]))
                    yield pa.record_batch([pa.array([int(own[x])], pa.int32()), pa.array([least]), keys, pa.array([v.astype("<f8").tobytes()], pa.binary())], ["list", "least", "keys", "vectors"])

    return VectorIndex(cut_lineage(assigned.drop("_at").mapInArrow(block, f"list int, least double, keys array<{kind}>, vectors binary")), centres)


def _best_possible(to_centre: np.ndarray, least: float) -> np.ndarray:
    """The largest cosine that a vector within ``least`` (a cosine) of the centre can have with each reference."""
    between = np.arccos(np.clip(to_centre, -1, 1)) - np.arccos(np.clip(least, -1, 1))
    return np.cos(np.maximum(between, 0)) + _SLACK


def similar_for(
    items: DataFrame, references: DataFrame, vector: str, key: str, ref_key: str, threshold: float = 0.7, k: int = 10, lists: int | None = None, probes: int | None = None
) -> DataFrame:
    """Each reference's ``k`` most similar items of at least ``threshold``: the reference's key, ``rank``, the item's key, ``similarity``.

    Both tables hold their vectors in ``vector``; an item that is a reference is compared with itself too. Ties go by the item's key.
    ``probes`` limits each reference to its nearest lists. References must have one length; items of another length match nothing.
    """
    spark = with_package(items.sparkSession)
    kinds = f"_ref {references.schema[ref_key].dataType.simpleString()}, _key {items.schema[key].dataType.simpleString()}, similarity double"
    shortest, dim = references.filter(F.size(vector) > 0).agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if shortest != dim:
        raise ValueError("references must have one length")
    found = None
    if dim:
        built = index(items, vector, key, dim, lists)
        asked = cut_lineage(_unit(references, vector, ref_key, dim))
        passes = -(-asked.count() // REFERENCES)
        for i in range(passes):
            # about REFERENCES vectors, whatever the number of references
            some = asked.filter(F.pmod(F.xxhash64("_key"), F.lit(passes)) == i).toArrow()
            vectors = _matrix(some.column("_v").combine_chunks(), dim) if some.num_rows else np.zeros((0, dim))
            shared = spark.sparkContext.broadcast((some.column("_key").to_pylist(), vectors))
            part = built.blocks.mapInArrow(_searcher(shared, built.centres, threshold, k, probes), kinds)
            found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], kinds)
    best = [F.desc("similarity"), F.asc("_key")]
    # two steps: a reference's candidates are k rows a task
    found = found.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(32)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("_ref", "_salt").orderBy(*best))).filter(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("_ref").orderBy(*best))).filter(F.col("rank") <= k)
    return found.select(F.col("_ref").alias(f"ref_{ref_key}"), "rank", F.col("_key").alias(key), "similarity")


def _searcher(shared, centres: np.ndarray, threshold: float, k: int, probes: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs, vectors = shared.value
        to_centres = vectors @ centres.T
        allowed = None
        if probes is not None and probes < len(centres):
            allowed = np.zeros(to_centres.shape, bool)
            np.put_along_axis(allowed, np.argpartition(-to_centres, probes - 1, 1)[:, :probes], True, 1)
        least = np.full(len(refs), threshold)
        kept: list[list[tuple]] = [[] for _ in refs]
        kind = None
        for batch in batches:
            kind = batch.schema.field("keys").type.value_type
            for i in range(batch.num_rows):
                own = batch.column(0)[i].as_py()
                fit = _best_possible(to_centres[:, own], batch.column(1)[i].as_py()) >= least
                if allowed is not None:
                    fit &= allowed[:, own]
                at = np.flatnonzero(fit)
                if not len(at):
                    continue
                keys = batch.column(2)[i].values
                held = np.frombuffer(batch.column(3)[i].as_buffer(), "<f8").reshape(len(keys), -1)
                for a in range(0, len(at), 1024):
                    some = at[a : a + 1024]
                    cosine = vectors[some] @ held.T
                    for r, j in _by_row(cosine >= least[some][:, None]):
                        ref = int(some[r])
                        rows = kept[ref] + list(zip((-cosine[r, j]).tolist(), keys.take(pa.array(j)).to_pylist(), strict=True))
                        rows.sort(key=lambda x: (x[0], x[1] is None, x[1]))
                        kept[ref] = rows[:k]
                        if len(rows) >= k:
                            least[ref] = max(threshold, -kept[ref][-1][0])
        rows = [(refs[r], x[1], -x[0]) for r in range(len(refs)) for x in kept[r]]
        for a in range(0, len(rows), 10_000):
            ref, item, cosine = zip(*rows[a : a + 10_000], strict=True)
            yield pa.record_batch([pa.array(ref), pa.array(item, kind), pa.array(cosine, pa.float64())], ["_ref", "_key", "similarity"])

    return run


def _by_row(hits: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The columns of each row that has any."""
    row, column = np.nonzero(hits)
    if not len(row):
        return
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    for a, b in zip(first.tolist(), np.append(first[1:], len(row)).tolist(), strict=True):
        yield int(row[a]), column[a:b]
