"""Operator 5: near-duplicate vectors by PCA-ordered tiled comparison.

Unit vectors are turned into the principal axes of a bounded sample, so their leading coordinates carry most of the length. Tiles are cells of
a k-d tree over those coordinates, split further where a cell has too many vectors. Pairs of tiles whose boxes are too far
apart are never formed, nor are pairs of blocks within two tiles. Within a pair of blocks the leading coordinates' products come first; by
Cauchy and Schwarz the rest adds at most the product of the two suffixes' norms, which stands beside them as one more coordinate. Pairs that
cannot reach the threshold stop there, the others go on, a few coordinates at a time; what survives is decided by the cosine of the vectors
as given, in double precision. The rotation only orders the work: all results are exact.

Tiles are written once. Where few pairs are near, they are joined; where geometry leaves most of them, partitions of the tiles' table are
read pair by pair, so disk grows with the vectors and never with the pairs.

Equal vectors are one class that is compared once. No pair leaves a task: a pair of tiles returns for each vector how many it links with
and a vector that stands for its component there, so rows grow with vectors and tiles, not with links.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing: 0 links, their own component. Vectors of different
lengths do not link. Rows without id link with nothing and have a null component. Rows that share an id count as several
vectors and are one node. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from assayer.llm.components import components
from assayer.llm.common import about, mixed
from assayer.session import cut_lineage

THRESHOLD = 0.9
#: Vectors that the axes and the tree are fitted to, at most; they only order the work.
FIT_ROWS = 4096
#: Classes of equal vectors in a tile, about; long vectors have an eighth of it at least, else as many as these bytes hold.
TILE, TILE_BYTES = 16384, 4 << 20
#: Pairs of tiles are joined up to so many for each tile.
NEAR = 2
#: Rows of a tile that are compared at once, and coordinates that are added at once.
ROWS, STEP = 512, 16
#: What a pair that goes on costs, in products of one coordinate; and how many go on at once.
ON, AT_ONCE = 100_000, 1 << 14
#: Links that are merged to components at once.
LINKS = 1 << 20
#: More than the rounding of any bound in double precision here.
SLACK = 1e-9


def digests(x: np.ndarray) -> np.ndarray:
    """128 bits for each row, equal for equal rows."""
    bits = (x + 0.0).view(np.uint64)
    place = np.arange(1, x.shape[1] + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return np.stack([mixed(mixed(bits ^ mixed(place + np.uint64(s))).sum(1, dtype=np.uint64)) for s in (11, 1 << 40)], 1).view(np.int64)


def kind_of(df: DataFrame, vector_col: str) -> type:
    """Floats stay floats: half the bytes, and the same numbers in double precision."""
    kind = df.schema[vector_col].dataType
    return np.float32 if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else np.float64


def prepared(df: DataFrame, id_col: str, vector_col: str, kind: type | None = None) -> DataFrame:
    """``vec_id``, ``dim`` (0 if the vector cannot link), ``d1``, ``d2`` and, with a ``kind``, the vector's numbers as ``raw``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            size = np.asarray(pc.list_value_length(column).fill_null(0)).astype(np.int64)
            values = column.flatten()
            bad = np.asarray(values.is_null()) if values.null_count else np.zeros(len(values), bool)
            values = np.asarray(values.fill_null(0.0)).astype(np.float64)
            at = np.concatenate([[0], np.cumsum(size)])
            bad |= ~np.isfinite(values)
            wrong = np.diff(np.concatenate([[0], np.cumsum(bad)])[at]) > 0
            wrong |= np.asarray(ids.is_null())
            dim, d = np.where(wrong, 0, size), np.zeros((len(size), 2), np.int64)
            for n in np.unique(dim[dim > 0]):
                rows = np.flatnonzero(dim == n)
                x = values[at[rows][:, None] + np.arange(n)]
                # a vector whose squares vanish or overflow is measured after scaling by its largest component
                most = np.abs(x).max(1, initial=0)
                dim[rows[most == 0]] = 0
                d[rows] = digests(x)
            out = [ids, pa.array(dim.astype(np.int32)), pa.array(d[:, 0]), pa.array(d[:, 1])]
            if kind:
                own = values[np.repeat(dim > 0, size)].astype(kind)
                ends = np.concatenate([[0], np.cumsum(dim)]) * own.itemsize
                if ends[-1] >= 1 << 31:
                    raise OverflowError("a batch of vectors has too many bytes")
                out.append(pa.BinaryArray.from_buffers(pa.binary(), len(dim), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(own)]))
            yield pa.record_batch(out, ["vec_id", "dim", "d1", "d2", "raw"][: len(out)])

    wide = "array<float>" if kind_of(df, vector_col) is np.float32 else "array<double>"
    picked = df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast(wide).alias("v"))
    return picked.mapInArrow(run, "vec_id long, dim int, d1 long, d2 long" + ", raw binary" * bool(kind))


def units(raw, dim: int, kind: type) -> np.ndarray:
    """Unit vectors of the rows whose bytes are in ``raw``."""
    x = np.frombuffer(raw, kind).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def axes(unit: np.ndarray) -> np.ndarray:
    """Principal axes of unit vectors about the origin, the strongest first."""
    value, vector = np.linalg.eigh(unit.T @ unit)
    return np.ascontiguousarray(vector[:, np.argsort(-value)])


def tree(points: np.ndarray, leaves: int) -> list:
    """A k-d tree as nested [axis, border, left, right]; a leaf is its number. At most ``leaves`` leaves with 4 points at least each."""
    number = iter(range(leaves))

    def grow(some: np.ndarray, most: int):
        if most < 2 or len(some) < 8:
            return next(number)
        axis = int(np.argmax(some.var(0)))
        border = float(np.median(some[:, axis]))
        left = some[:, axis] < border
        if not left.any() or left.all():
            return next(number)
        return [axis, border, grow(some[left], most // 2), grow(some[~left], most - most // 2)]

    return grow(points, leaves)


def leaf_of(node, points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int64)

    def walk(node, rows: np.ndarray) -> None:
        if not isinstance(node, list):
            out[rows] = node
            return
        left = points[rows, node[0]] < node[1]
        walk(node[2], rows[left])
        walk(node[3], rows[~left])

    walk(node, np.arange(len(points)))
    return out


def ordered(points: np.ndarray, size: int) -> np.ndarray:
    """Rows in an order where each run of ``size`` is a cell of a k-d tree."""
    out = []

    def split(rows: np.ndarray) -> None:
        if len(rows) <= size:
            out.append(rows)
            return
        some = points[rows]
        half = -(-len(rows) // (2 * size)) * size
        order = np.argsort(some[:, int(np.argmax(some.var(0)))], kind="stable")
        split(rows[order[:half]])
        split(rows[order[half:]])

    split(np.arange(len(points)))
    return np.concatenate(out)


def leading(turned: np.ndarray, threshold: float) -> int:
    """How many coordinates come first: few, but so many that few pairs of these vectors go on."""
    some = turned[:512]
    n, dim = some.shape
    part, best = np.zeros((n, n)), (np.inf, dim)
    for k in range(0, dim, STEP // 2):
        to = min(k + STEP // 2, dim)
        part += some[:, k:to] @ some[:, k:to].T
        rest = np.sqrt((some[:, to:] ** 2).sum(1))
        on = int((part + np.outer(rest, rest) >= threshold - SLACK).sum()) - n
        best = min(best, (to + ON * max(on, 0) / max(n * (n - 1), 1), to))
    return best[1]


class Side:
    """Rotated unit vectors with what bounds their products."""

    def __init__(self, turned: np.ndarray, lead: int):
        self.turned, dim = turned, turned.shape[1]
        self.lead = min(lead, dim)
        square = turned * turned
        self.rest = {k: np.sqrt(square[:, k:].sum(1)) for k in range(self.lead, dim, STEP)}
        # the suffix's norm is one more coordinate
        self.first = np.column_stack([turned[:, : self.lead], *([self.rest[self.lead]] if self.rest else [])]).astype(np.float32, order="C")

    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        """The corners of each block of rows, in the axes that cut the tree."""
        at = np.arange(0, len(self.turned), ROWS)
        return tuple(f.reduceat(self.turned[:, : min(8, self.turned.shape[1])], at) for f in (np.minimum, np.maximum))


def goes_on(a: Side, b: Side, x: int, y: int, threshold: float, into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, of the blocks from ``x`` and ``y``, whose cosine may reach the threshold. ``into`` has room for a block's products."""
    first_a, first_b = a.first[x : x + ROWS], b.first[y : y + ROWS]
    bound = np.matmul(first_a, first_b.T, out=into[: len(first_a) * len(first_b)].reshape(len(first_a), -1))
    # norms of 1: the rounding of single precision is below this
    least = np.float32(threshold - (first_a.shape[1] + 8) * 2.0**-22)
    columns = np.flatnonzero(bound.max(0) >= least)
    if not len(columns):
        return (columns,) * 2
    hit_i, hit_j = np.nonzero(bound[:, columns] >= least)
    hit_i, hit_j = hit_i + x, columns[hit_j] + y
    found = []
    for at in range(0, len(hit_i), AT_ONCE):
        i, j = hit_i[at : at + AT_ONCE], hit_j[at : at + AT_ONCE]
        total = None
        for k, rest in a.rest.items():
            if not len(i):
                break
            if total is None:
                total = np.einsum("ij,ij->i", a.turned[i, :k], b.turned[j, :k])
            keep = total + rest[i] * b.rest[k][j] >= threshold - SLACK
            i, j, total = i[keep], j[keep], total[keep]
            total = total + np.einsum("ij,ij->i", a.turned[i, k : k + STEP], b.turned[j, k : k + STEP])
        found.append((i, j))
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def survivors(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (both rotated unit vectors) whose cosine may reach the threshold."""
    lead = leading(a, threshold)
    a, b = Side(a, lead), Side(b, lead)
    into = np.empty(ROWS * ROWS, np.float32)
    found = [goes_on(a, b, x, y, threshold, into) for x in range(0, len(a.turned), ROWS) for y in range(0, len(b.turned), ROWS)]
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component, after the links of ``i`` and ``j``."""
    while True:
        a, b = label[i], label[j]
        other = a != b
        if not other.any():
            return label
        i, j, a, b = i[other], j[other], a[other], b[other]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def reaching(unit_a: np.ndarray, unit_b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of each pair reaches the threshold."""
    return np.concatenate([np.einsum("ij,ij->i", unit_a[i[s : s + AT_ONCE]], unit_b[j[s : s + AT_ONCE]]) >= threshold for s in range(0, len(i), AT_ONCE)])


def compared(key_a, count_a, unit_a, side_a: Side, key_b, count_b, unit_b, side_b: Side, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two tiles (``key_b`` None: of one with itself): keys of vectors with links, their number of links, and the key of a vector of their
    component. A key is a row of the class's id and digest."""
    alone = key_b is None
    if alone:
        key_b, count_b, unit_b, side_b = key_a, count_a, unit_a, side_a
    n = len(key_a)
    links_a, links_b = np.zeros(n, np.int64), np.zeros(len(key_b), np.int64)
    label = np.arange(n if alone else n + len(key_b))
    shift = 0 if alone else n
    low_a, high_a = side_a.boxes()
    low_b, high_b = side_b.boxes()
    apart = np.maximum(np.maximum(low_a[:, None] - high_b[None], low_b[None] - high_a[:, None]), 0)
    near = (apart * apart).sum(2) <= 2 - 2 * threshold + SLACK
    into, edges, held = np.empty(ROWS * ROWS, np.float32), [], 0
    for x, y in zip(*(v.tolist() for v in np.nonzero(near)), strict=True):
        if alone and y < x:
            continue
        i, j = goes_on(side_a, side_b, x * ROWS, y * ROWS, threshold, into)
        if alone:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        keep = reaching(unit_a, unit_b, i, j, threshold)
        i, j = i[keep], j[keep]
        np.add.at(links_a, i, count_b[j])
        np.add.at(links_a if alone else links_b, j, count_a[i])
        edges.append((i, j + shift))
        held += len(i)
        if held >= LINKS:
            label = merged(label, *(np.concatenate(v) for v in zip(*edges, strict=True)))
            edges, held = [], 0
    if edges:
        label = merged(label, *(np.concatenate(v) for v in zip(*edges, strict=True)))
    if alone:
        key, links = key_a, links_a
    else:
        key, links = np.concatenate([key_a, key_b]), np.concatenate([links_a, links_b])
    hit = links > 0
    return key[hit], links[hit], key[label[hit]]


def linked(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is over 0 and at most 1")
    spark = df.sparkSession
    kind = kind_of(df, vector_col)
    # the vectors themselves are written as classes and as tiles, once each
    rows = cut_lineage(prepared(df, id_col, vector_col))
    good = rows.filter("dim > 0")
    whole = prepared(df, id_col, vector_col, kind).filter("dim > 0")
    classes = cut_lineage(whole.groupBy("dim", "d1", "d2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("c"), F.first("raw").alias("raw")))
    members = good.select("vec_id", "dim", "d1", "d2").join(classes.select("dim", "d1", "d2", "rep", "c"), ["dim", "d1", "d2"])
    total = classes.count()
    sample = classes.select("dim", "raw").filter(about(FIT_ROWS, total, "d1", "d2")).limit(2 * FIT_ROWS).toArrow()
    leaves = max(1, min(FIT_ROWS // 8, -(-total // TILE)))
    fitted = {}
    dims = np.asarray(sample.column("dim"))
    for dim in np.unique(dims).tolist():
        unit = units(b"".join(sample.column("raw")[i].as_py() for i in np.flatnonzero(dims == dim).tolist()), dim, kind)
        basis = axes(unit)
        turned = unit @ basis
        fitted[dim] = basis, tree(turned[:, : min(dim, 8)], leaves), leading(turned, threshold)

    def axes_of(dim: int) -> tuple[np.ndarray, object, int]:
        return fitted.get(dim) or (np.eye(dim), 0, 2 * STEP)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, leaf = np.asarray(batch.column(0)), np.zeros(batch.num_rows, np.int64)
            for n in np.unique(dim).tolist():
                own = np.flatnonzero(dim == n)
                basis, root, _ = axes_of(n)
                unit = units(b"".join(batch.column(5).take(pa.array(own)).to_pylist()), n, kind)
                leaf[own] = leaf_of(root, (unit @ basis)[:, : min(n, 8)])
            yield pa.record_batch([*batch.columns, pa.array(leaf)], ["dim", "rep", "d1", "d2", "c", "raw", "leaf"])

    at = classes.select("dim", "rep", "d1", "d2", "c", "raw").mapInArrow(placed, "dim int, rep long, d1 long, d2 long, c long, raw binary, leaf long")
    most = F.least(F.lit(TILE), F.greatest(F.lit(max(1, TILE // 8)), F.floor(F.lit(TILE_BYTES) / (F.col("dim") * kind().itemsize))))
    size = at.groupBy("dim", "leaf").agg(F.count(F.lit(1)).alias("n")).select("dim", "leaf", F.greatest(F.lit(1), F.round(F.col("n") / most)).cast("long").alias("parts"))
    # a row for each leaf: the vectors stay where they are
    at = at.join(F.broadcast(cut_lineage(size, 1)), ["dim", "leaf"]).withColumn("tile", F.xxhash64("dim", "leaf", F.pmod(F.xxhash64("d1", "d2"), F.col("parts"))))

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by([(x, "ascending") for x in ("rep", "d1", "d2")])
        dim = group.column("dim")[0].as_py()
        raw = np.frombuffer(b"".join(group.column("raw").to_pylist()), np.uint8).reshape(group.num_rows, -1)
        lead = (units(raw.reshape(-1), dim, kind) @ axes_of(dim)[0])[:, : min(dim, 8)]
        order = ordered(lead, ROWS)
        keys = np.stack([group.column(x).to_numpy() for x in ("rep", "d1", "d2")], 1).astype(np.int64)[order]
        return pa.table(
            {
                "tile": group.column("tile").slice(0, 1),
                "dim": pa.array([dim], pa.int32()),
                "low": pa.array([lead.min(0).tolist()], pa.list_(pa.float64())),
                "high": pa.array([lead.max(0).tolist()], pa.list_(pa.float64())),
                "keys": pa.array([keys.tobytes()], pa.binary()),
                "counts": pa.array([group.column("c").to_numpy().astype(np.int64)[order].tobytes()], pa.binary()),
                "raw": pa.array([raw[order].tobytes()], pa.binary()),
            }
        )

    schema = "tile long, dim int, low array<double>, high array<double>, keys binary, counts binary, raw binary"
    tiles = cut_lineage(at.select("tile", "dim", "rep", "d1", "d2", "c", "raw").groupBy("tile").applyInArrow(packed, schema))
    # tiles meet in cells of the first axis as wide as linked unit vectors can be apart, then by the distance of their boxes
    reach = float(np.sqrt(2 - 2 * threshold)) + SLACK
    width = max(reach, 1e-3)
    box = tiles.select("tile", "dim", "low", "high")
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / width), F.floor(high / width))).alias("cell")
    home = box.select("dim", "tile", "low", "high", cells(F.col("low")[0], F.col("high")[0]))
    near = box.select("dim", F.col("tile").alias("tile2"), F.col("low").alias("low2"), F.col("high").alias("high2"), cells(F.col("low")[0] - reach, F.col("high")[0] + reach))
    gap = F.aggregate(
        F.transform(F.sequence(F.lit(0), F.size("low") - 1), lambda k: F.greatest(F.get("low", k) - F.get("high2", k), F.get("low2", k) - F.get("high", k), F.lit(0.0))),
        F.lit(0.0),
        lambda s, g: s + g * g,
    )
    meet = (F.col("tile") <= F.col("tile2")) & (gap <= reach * reach)
    pairs = cut_lineage(home.join(near, ["dim", "cell"]).filter(meet).select("tile", "tile2").distinct())
    other = tiles.select(*(F.col(x).alias(f"{x}2") for x in tiles.columns))
    if pairs.count() <= NEAR * tiles.count():
        met = pairs.join(tiles, "tile").join(other.drop("dim2", "low2", "high2"), "tile2")
    else:
        met = tiles.hint("shuffle_replicate_nl").join(other, (F.col("dim") == F.col("dim2")) & meet)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, ()
        for batch in batches:
            for r in range(batch.num_rows):
                dim, tile, tile2 = (batch.column(x)[r].as_py() for x in ("dim", "tile", "tile2"))
                basis, _, lead = axes_of(dim)

                def side(end: str) -> tuple:
                    keys, counts = (np.frombuffer(batch.column(x + end)[r].as_buffer(), np.int64) for x in ("keys", "counts"))
                    unit = units(batch.column("raw" + end)[r].as_buffer(), dim, kind)
                    return keys.reshape(-1, 3).copy(), counts.copy(), unit, Side(unit @ basis, lead)

                if tile != last:  # a tile meets several in a row
                    last, held = tile, side("")
                key, n, root = compared(*held, *((None,) * 4 if tile == tile2 else side("2")), threshold)
                yield pa.record_batch(
                    [pa.array(v) for v in (np.full(len(key), dim, np.int32), key[:, 0], key[:, 1], key[:, 2], n, root[:, 0])], ["dim", "rep", "d1", "d2", "n", "root"]
                )

    met = met.select("dim", "tile", "keys", "counts", "raw", "tile2", "keys2", "counts2", "raw2")
    found = cut_lineage(met.mapInArrow(links, "dim int, rep long, d1 long, d2 long, n long, root long"))
    label = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).union(members.filter("c > 1").select("vec_id", "rep")))
    # links are counted by class: one id can stand for several
    n_links = found.groupBy("dim", "d1", "d2").agg(F.sum("n").alias("n"))
    known = members.join(n_links, ["dim", "d1", "d2"], "left").select("vec_id", "rep", (F.coalesce("n", F.lit(0)) + F.col("c") - 1).alias("n_links"))
    known = known.join(label, known["rep"] == label["node"], "left").select("vec_id", "n_links", F.coalesce("label", "rep").alias("component_id"))
    alone = rows.filter("dim = 0").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
