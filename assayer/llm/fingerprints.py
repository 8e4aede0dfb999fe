"""Operator 8: document fingerprints by locally consistent parsing.

A text is cut into phrases whose borders depend only on the symbols around them: runs of equal symbols become one; deterministic coin
tossing relabels each symbol by the lowest bit in which it differs from its left neighbour, again and again, until labels are below six;
local maxima of the labels open phrases. A phrase's name is the hash of its symbols, names are the symbols of the next level. So equal
substrings have equal names inside, wherever they stand. A fingerprint keeps the smallest hash of the names in each of
64 classes; the share of equal classes estimates how much of two texts is alike.

Neighbours in the order of ids meet in ranges of ids. Only the ranges' first documents are sent twice, to the range before.

Null and empty texts have an empty fingerprint, like each other fully and no other text. Rows with the same id stand in the order of their
texts; rows without id come first. A single document is its own next. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from assayer.llm.common import documents, mixed
from assayer.llm.repeats import opened, squeezed
from assayer.llm.words import Hashes

#: Levels of phrases; the last one's are about 25 bytes long.
LEVELS = 3
CLASSES = 64
EMPTY = np.uint32(0xFFFFFFFF)
#: Bytes of text in a range of ids, and bytes turned into arrays at once.
RANGE_BYTES = 16_000_000
CHUNK = 400_000
NO_ID = -(2**63)


def tossed(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing: twice the lowest differing bit's place, and that bit. Different neighbours keep different labels.

    ``first`` marks symbols without a left neighbour; they take the place of the symbol to their right (0 if they stand alone).
    """
    x = symbols.astype(np.uint64)
    differ = np.zeros(len(x), np.uint64)
    differ[1:] = x[1:] ^ x[:-1]
    heads = np.flatnonzero(first)
    alone = np.ones(len(heads), bool)
    followed = heads + 1 < len(x)
    alone[followed] = first[heads[followed] + 1]
    differ[heads] = 1
    differ[heads[~alone]] = differ[heads[~alone] + 1]
    with np.errstate(over="ignore"):
        place = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
    return ((place << np.uint64(1)) | ((x >> place) & np.uint64(1))).astype(np.uint8)


def _table(size: int) -> np.ndarray:
    """The round for all pairs of symbols below ``size``."""
    left, right = np.divmod(np.arange(size * size), size)
    pair = np.stack([left, right], 1).ravel()
    return tossed(pair, np.zeros(len(pair), bool))[1::2]


_BYTES, _SIXTEEN, _EIGHT = _table(256), _table(16), _table(8)


def labels_of(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below six; neighbours differ. Small alphabets go through tables."""
    heads = np.flatnonzero(first)
    follows = heads + 1
    inside = follows < len(symbols)
    inside[inside] = ~first[follows[inside]]
    alone, heads, follows = heads[~inside], heads[inside], follows[inside]

    def round_(x: np.ndarray, table: np.ndarray, size: int) -> np.ndarray:
        pair = np.empty(len(x), np.uint16)
        pair[0] = 0
        pair[1:] = x[:-1].astype(np.uint16) * size + x[1:]
        out = table[pair]
        # a head takes its right neighbour's place with its own bit, which differs
        out[heads] = out[follows] ^ 1
        out[alone] = 0
        return out

    if not len(symbols):
        return np.zeros(0, np.uint8)
    if symbols.dtype == np.uint8:
        x = round_(symbols, _BYTES, 256)
    else:
        x = tossed(tossed(symbols, first), first)
    return round_(round_(x, _SIXTEEN, 16), _EIGHT, 8)


def level(symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the next level's phrases, and where each document's begin. Each document with symbols has a phrase."""
    if not len(symbols):
        return np.zeros(0, np.uint64), at
    first = np.zeros(len(symbols), bool)
    first[at[:-1][np.diff(at) > 0]] = True
    opens = first.copy()
    opens[1:] |= symbols[1:] != symbols[:-1]
    begin = np.flatnonzero(opens)
    length = np.diff(np.append(begin, len(symbols)))
    run = symbols[begin]
    head = first[begin]
    label = labels_of(run, head)
    name = mixed(run.astype(np.uint64))
    long = length > 1
    name[long] = mixed(name[long] ^ mixed(length[long].astype(np.uint64)))
    border = head.copy()
    peak = np.ones(len(label), bool)
    peak[1:] = label[1:] > label[:-1]
    peak[:-1] &= (label[:-1] > label[1:]) | head[1:]
    border |= peak
    phrase = np.flatnonzero(border)
    names = Hashes(name).of(phrase, np.append(phrase[1:], len(name)))
    return names, np.searchsorted(begin[phrase], at)


def fingerprints(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of CLASSES 32-bit values for each text; EMPTY in a class without a phrase."""
    names, at = data, starts
    for _ in range(LEVELS):
        names, at = level(names, at)
    out = np.full((len(starts) - 1) * CLASSES, EMPTY, np.uint32)
    names = mixed(names)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(at))
    np.minimum.at(out, doc * CLASSES + (names >> np.uint64(58)).astype(np.int64), np.minimum((names & np.uint64(0xFFFFFFFF)), np.uint64(0xFFFFFFFE)).astype(np.uint32))
    return out.reshape(-1, CLASSES)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal classes among those that either has; 1 for two empty fingerprints."""
    some = (a != EMPTY) | (b != EMPTY)
    n = some.sum(1)
    return np.where(n > 0, ((a == b) & some).sum(1) / np.maximum(n, 1), 1.0)


def text_of(row: np.ndarray) -> str:
    return row.astype(">u4").tobytes().hex()


def _all(texts: list[bytes]) -> np.ndarray:
    """Fingerprints of texts, a chunk at a time."""
    out, part, size = [np.zeros((0, CLASSES), np.uint32)], [], 0
    for i, x in enumerate(texts):
        part.append(x)
        size += len(x)
        if size >= CHUNK or i == len(texts) - 1:
            out.append(fingerprints(np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in part])])))
            part, size = [], 0
    return np.concatenate(out)


def compare_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness; likeness to the next document's.

    Edited: the last quarter of the characters is replaced by as many of the next document's first ones.
    """
    docs = documents(df, id_col, text_col)
    total, low = docs.agg(F.sum(F.octet_length("text")), F.min("doc_id")).first()
    ranges = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-(total or 0) // RANGE_BYTES))
    shares = [i / ranges for i in range(1, ranges)]
    found = docs.select("doc_id").agg(F.percentile_approx("doc_id", shares, 100 * ranges)).first()[0] or []
    # range p holds the ids from bounds[p - 1] on; one bound for each range, so their number is that of the tasks
    bounds = np.unique(np.array([x for x in found if low is None or x > low], np.int64))

    def place(ids: pa.Array) -> np.ndarray:
        return np.searchsorted(bounds, np.asarray(ids.fill_null(NO_ID)).astype(np.int64), "right")

    def first_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, int] = {}
        for batch in batches:
            for p, i in zip(place(batch.column(0)).tolist(), batch.column(0).fill_null(NO_ID).to_pylist(), strict=True):
                if i < least.get(p, i + 1):
                    least[p] = i
        yield pa.record_batch([pa.array(list(least), pa.int32()), pa.array(list(least.values()), pa.int64())], ["part", "first"])

    heads = docs.select("doc_id").mapInArrow(first_ids, "part int, first long").groupBy("part").agg(F.min("first").alias("first")).collect()
    heads = sorted((r["part"], r["first"]) for r in heads)
    # a range's first document goes to the range before, too; the very first to the last
    before = {first: heads[i - 1][0] for i, (_, first) in enumerate(heads)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = place(batch.column(0))
            text = pa.array([squeezed(x.encode("utf-8", "surrogatepass")) for x in batch.column(1).to_pylist()], pa.binary())
            guests = [i for i, x in enumerate(batch.column(0).fill_null(NO_ID).to_pylist()) if x in before]
            own = [before[batch.column(0)[i].as_py() if batch.column(0)[i].is_valid else NO_ID] for i in guests]
            for rows, p, guest in ((None, part, False), (guests, own, True)):
                some = pa.array(range(batch.num_rows) if rows is None else rows, pa.int64())
                yield pa.record_batch(
                    [pa.array(p, pa.int32()), pa.array([guest] * len(some), pa.bool_()), batch.column(0).take(some), text.take(some)], ["part", "guest", "doc_id", "text"]
                )

    def run(group: pa.Table) -> pa.Table:
        keys = [("guest", "ascending"), ("doc_id", "ascending")]
        order = pc.sort_indices(group.select(["guest", "doc_id"]), sort_keys=keys, null_placement="at_start")
        group = group.take(order)
        n = pc.sum(pc.invert(group.column("guest"))).as_py()
        texts = [opened(x) for x in group.column("text").to_pylist()]
        ids = group.column("doc_id").to_pylist()
        # equal ids: in the order of their texts
        final = sorted(range(len(texts)), key=lambda i: (i >= n, NO_ID if ids[i] is None else ids[i], texts[i]))
        final, guest = final[:n], final[n:]
        texts = [texts[i] for i in [*final, *guest[:1]]]
        if not n:
            texts = []
        strings = [x.decode("utf-8", "surrogatepass") for x in texts]
        edited, chars = [], []
        for own, after in zip(strings[:n], strings[1:], strict=False):
            quarter = len(own) // 4
            chars.append(len(own))
            edited.append((own[: len(own) - quarter] + after[:quarter]).encode("utf-8", "surrogatepass"))
        own, changed = _all(texts), _all(edited)
        return pa.table(
            {
                "doc_id": pa.array([ids[i] for i in final], pa.int64()),
                "n_chars": pa.array(chars, pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()),
                "fingerprint": pa.array([text_of(x) for x in own[:n]], pa.string()),
                "edited_fingerprint": pa.array([text_of(x) for x in changed], pa.string()),
                "near_edited": pa.array(likeness(own[:n], changed), pa.float64()),
                "near_next": pa.array(likeness(own[:n], own[1 : n + 1]), pa.float64()),
            }
        )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return docs.mapInArrow(deal, "part int, guest boolean, doc_id long, text binary").groupBy("part").applyInArrow(run, schema)


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every whole text; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _all([x.encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()])
            yield pa.record_batch([batch.column(0), pa.array([text_of(x) for x in found], pa.string())], ["doc_id", "fingerprint"])

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")
