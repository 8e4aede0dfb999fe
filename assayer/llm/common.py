"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

from collections.abc import Iterator
import os
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of text that a task turns into arrays at once: some MB of arrays, whatever the size of the table.
CHUNK_BYTES = 500_000


def ready(spark: SparkSession) -> SparkSession:
    """The session, whose Python workers look for this package where the driver found it.

    In local mode, and on machines that share the folder, nothing else is needed; elsewhere ship the package with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(x for x in (root, known.get("PYTHONPATH", "")) if x)
    return spark


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, as ``doc_id`` and ``text`` (null: empty); other columns cannot clash with ours."""
    return df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id's text leaves 2 by 4. A null id counts as its empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def about(rows: int, total: int, *key: Column | str) -> Column:
    """About ``rows`` of ``total`` rows, by a hash of their key: the same ones in any order. 62 bits, so that the share of no table is 0."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 62)) < F.lit(min(rows * (1 << 62) // max(total, 1), 1 << 62))


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; before each, memory that Arrow holds but does not use goes back: workers are kept between tasks and stages. Drop a batch when it is done."""
    pool = pa.default_memory_pool()
    pool.release_unused()
    for batch in batches:
        yield batch
        del batch
        pool.release_unused()


def chunks(batch: pa.RecordBatch, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of ``batch`` whose texts (last column) have about ``most`` bytes together; a longer text is alone."""
    return parts(batch.column(batch.num_columns - 1), most)


def parts(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with about ``most`` bytes together."""
    ends = np.concatenate([[0], np.cumsum(lengths(texts))])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, to
        at = to


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each text."""
    return np.asarray(pc.binary_length(column).fill_null(0)).astype(np.int64)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes in one array, and where each begins (one offset more than texts)."""
    size = lengths(column)
    starts = np.concatenate([[0], np.cumsum(size)])
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    if data is None or not starts[-1]:
        return np.zeros(0, np.uint8), starts
    first = int(np.frombuffer(offsets, kind, count=column.offset + 1)[column.offset])
    return np.frombuffer(data, np.uint8, count=int(starts[-1]), offset=first), starts


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices starts[0] .. starts[0] + sizes[0] - 1, then those of the next, and so on."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    full = sizes > 0
    starts, sizes = starts[full].astype(np.int64), sizes[full].astype(np.int64)
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    ends = np.cumsum(sizes)[:-1]
    step[ends] = starts[1:] - (starts[:-1] + sizes[:-1] - 1)
    return np.cumsum(step)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value for each 64-bit value, one to one."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(29))
        x = x * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(32))


def local_path(uri: str) -> str:
    """The path of a folder that the executors have mounted; other stores cannot be memory-mapped."""
    found = urlparse(uri)
    if found.scheme not in ("", "file"):
        raise ValueError(f"{uri} is not a mounted folder")
    return unquote(found.path)
