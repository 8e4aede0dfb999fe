"""Repeated windows of a corpus: the distributed part that operators 4 and 9 share.

A window is so many consecutive tokens (words or bytes) of one document. The task is to mark every token covered by a window
whose tokens also start in a document with a smaller id. Steps, each a Spark stage over all documents:

1. *Anchors.* Of the short grams inside a window the one with the smallest hash is its anchor, so equal windows have equal anchors.
   Consecutive windows mostly share it, so there are far fewer anchors than windows. Each task sends each anchor once per block of documents.
2. *Shared anchors.* By anchor: those of at least two documents go back to the blocks that have them.
3. *Segments.* A run of windows with one shared anchor is a segment. Within a block, equal segments collapse to the document with
   the smallest id; for the others the answer is known. One segment each goes to the bucket of its anchor.
4. *Exact comparison.* A bucket has all windows that can equal each other. Equal segments collapse again; where an anchor has
   different segments, the operator's own method (suffix tree, suffix array) finds their equal windows.
5. *Marks* return to the blocks, which put the documents' texts together.

No group grows with a hot text: an anchor has at most one row for each block and distinct segment, and an anchor with more than
``HOT`` documents is split further: each of its windows goes to the bucket of its own hash with a second hash, where only equal windows meet.
Blocks and buckets have a fixed size in bytes; their number grows with the input. All is one lazy plan, so lost tasks are repeated by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayer.llm.common import chunks, flat, mixed, ragged
from assayer.llm.words import Hashes, words

#: UTF-8 bytes of text in a block of documents.
BLOCK_BYTES = 8_000_000
#: Documents of an anchor beyond which its windows are dealt by their own hashes.
HOT = 16_384
#: Text that is turned into arrays at once.
CHUNK = 400_000
#: The largest count that is sent.
MOST = 65_535
#: Keys that a task collects before it sends them; a key is sent once for each such part and block.
HELD_KEYS = 1_500_000
#: Stands for a null id: larger than any other.
NO_ID = 2**63 - 1


def squeezed(raw: bytes) -> bytes:
    """Compressed, after its size."""
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def opened(blob: bytes) -> bytes:
    return pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)


@dataclass
class Tokens:
    #: A symbol for each token; equal tokens have equal symbols.
    symbols: np.ndarray
    #: Where each document's tokens begin, one more than documents.
    at: np.ndarray
    #: Bytes in which consecutive tokens stand as in their plainest text.
    data: np.ndarray
    #: Where each token begins in ``data``, and one more; None if tokens are bytes.
    edges: np.ndarray | None

    def begin(self, token: np.ndarray) -> np.ndarray:
        return token if self.edges is None else self.edges[token]


def byte_tokens(data: np.ndarray, starts: np.ndarray) -> Tokens:
    return Tokens(data, starts, data, None)


def word_tokens(data: np.ndarray, starts: np.ndarray) -> Tokens:
    """Words with one space after each."""
    found = words(data, starts)
    size = found.end - found.start + 1
    edges = np.concatenate([[0], np.cumsum(size)])
    plain = np.append(data, np.uint8(32))[ragged(found.start, size)]
    plain[edges[1:] - 1] = 32
    return Tokens(Hashes(data).of(found.start, found.end), found.at, plain, edges)


@dataclass(frozen=True)
class Kind:
    """What windows are made of, and how equal windows among different segments are found."""

    window: int
    gram: int
    tokens: Callable[[np.ndarray, np.ndarray], Tokens]
    #: (bytes of segments, their starts and one more, windows of each, window) -> class of each window, the segments' windows in a row.
    classes: Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def sliding(pick: Callable, values: np.ndarray, width: int) -> np.ndarray:
    """The least (or most) of each ``width`` neighbours."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def anchored_runs(found: Tokens, hashes: Hashes, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of windows of one document with one anchor: anchor, first window, number of windows, document."""
    none = np.zeros(0, np.int64)
    n = np.diff(found.at)
    if len(found.symbols) < window or n.max(initial=0) < window:
        return none.astype(np.uint64), none, none, none
    first = np.arange(len(found.symbols) - gram + 1)
    least = sliding(np.minimum, hashes.of(first, first + gram), window - gram + 1)
    size = np.maximum(n - window + 1, 0)
    at = ragged(found.at[:-1], size)
    doc = np.repeat(np.arange(len(n)), size)
    own = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    # least hashes crowd at the lower end; mixed again they spread evenly over the buckets
    return mixed(~own[begin]), at[begin], np.diff(np.append(begin, len(at))), doc[begin]


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in the order of the keys' upper 32 bits."""
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _keys_out(keys: np.ndarray, extra: np.ndarray) -> bytes:
    """Sorted keys of 48 bits and a number of 16 bits for each; the upper bits hardly vary and compress well."""
    return (keys >> np.uint64(32)).astype("<u2").tobytes() + keys.astype("<u4").tobytes() + extra.astype("<u2").tobytes()


def _keys_in(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 8
    upper = np.frombuffer(blob, "<u2", n).astype(np.uint64) << np.uint64(32)
    return upper | np.frombuffer(blob, "<u4", n, 2 * n), np.frombuffer(blob, "<u2", n, 6 * n)


def _runs_out(blocks: np.ndarray) -> bytes:
    """Sorted numbers as runs: how many runs, their numbers, their lengths."""
    head = np.flatnonzero(np.diff(blocks, prepend=-1))
    return len(head).to_bytes(8, "little") + blocks[head].astype("<u4").tobytes() + np.diff(np.append(head, len(blocks))).astype("<u4").tobytes()


def _runs_in(blob: bytes) -> tuple[np.ndarray, bytes]:
    """The numbers, and what follows them."""
    n = int.from_bytes(blob[:8], "little")
    return np.repeat(np.frombuffer(blob, "<u4", n, 8).astype(np.int32), np.frombuffer(blob, "<u4", n, 8 + 4 * n)), blob[8 + 8 * n :]


def _short(anchor: np.ndarray) -> np.ndarray:
    return anchor >> np.uint64(16)


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of known types behind one another, compressed."""
    return squeezed(b"".join(x.tobytes() for x in arrays))


def blocked(df: DataFrame, id_col: str, text_col: str, blocks: int, carry: list[str]) -> DataFrame:
    """Rows with their block, the id, the compressed text and the carried columns as ``c0``, ``c1`` ..."""
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    rows = df.select(
        F.pmod(F.xxhash64(df[id_col].cast("long"), text), F.lit(blocks)).cast("int").alias("block"),
        df[id_col].cast("long").alias("doc_id"),
        *(df[c].alias(f"c{i}") for i, c in enumerate(carry)),
        F.encode(text, "utf-8").alias("text"),
    )
    last = len(carry) + 2

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [squeezed(x) for x in batch.column(last).to_pylist()]
            yield batch.set_column(last, "text", pa.array(texts, pa.binary()))

    return rows.mapInArrow(squeeze, rows.schema)


def _sorted_rows(table: pa.Table) -> pa.Table:
    """A block's rows in an order that depends on nothing but the rows."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if table.num_rows > 1 else table


def _texts(table: pa.Table, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a block with their texts' bytes and offsets."""
    rows, size, first = [], 0, 0
    for i, blob in enumerate(table.column("text").to_pylist()):
        rows.append(opened(blob))
        size += len(rows[-1])
        if size >= most or i == table.num_rows - 1:
            yield first, i + 1, np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
            rows, size, first = [], 0, i + 1


def distinct_keys(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once in a document, by document and key."""
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    once = np.ones(len(key), bool)
    once[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[once], doc[once]


def anchors_of(kind: Kind) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A function from texts to their anchors and documents."""

    def keys(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = kind.tokens(data, starts)
        anchor, _, _, doc = anchored_runs(found, Hashes(found.symbols), kind.window, kind.gram)
        return anchor, doc

    return keys


def shared_keys(df: DataFrame, id_col: str, text_col: str, keys: Callable, blocks: int, buckets: int) -> DataFrame:
    """Rows (block, anchors): the keys (their upper 48 bits) of the block that at least two documents have, and of how many (MOST: or more).

    Documents are counted in parts of a task, by block, so a hot key is sent a few times for each block; a part sends one row for each bucket.
    """
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    docs = df.select(F.pmod(F.xxhash64(df[id_col].cast("long"), text), F.lit(blocks)).cast("int").alias("block"), text.alias("text"))

    def rows(found: list[np.ndarray], places: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, place = np.concatenate(found), np.concatenate(places)
        order = np.lexsort((key, place))
        key, place = key[order], place[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1])
        begin = np.flatnonzero(new)
        count = np.minimum(np.diff(np.append(begin, len(key))), MOST)
        key, place = key[begin], place[begin]
        bucket = _bucket(key << np.uint64(16), buckets)
        order = np.argsort(bucket, kind="stable")
        key, place, count, bucket = key[order], place[order], count[order], bucket[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist() + [len(bucket)]
        some = list(zip(edges, edges[1:], strict=False))
        blobs = [_runs_out(place[x:y]) + _keys_out(key[x:y], count[x:y]) for x, y in some]
        yield pa.record_batch([pa.array([int(bucket[x]) for x, _ in some], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "anchors"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, places, held = [], [], 0
        for batch in batches:
            block = np.asarray(batch.column(0))
            for a, b in chunks(batch, CHUNK):
                key, doc = keys(*flat(batch.column(1)[a:b]))
                key, doc = distinct_keys(_short(key), doc)
                found.append(key)
                places.append(block[a:b][doc].astype(np.int32))
                held += len(key)
                if held >= HELD_KEYS:
                    yield from rows(found, places)
                    found, places, held = [], [], 0
        if found:
            yield from rows(found, places)

    def common(group: pa.Table) -> pa.Table:
        runs = [_runs_in(x) for x in group.column("anchors").to_pylist()]
        rows = [_keys_in(rest) for _, rest in runs]
        block = np.concatenate([x[0] for x in runs])
        key, count = np.concatenate([x[0] for x in rows]), np.concatenate([x[1] for x in rows]).astype(np.int64)
        del runs, rows
        order = np.argsort(key, kind="stable")
        key, block, count = key[order], block[order], count[order]
        begin = np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1)))
        total = np.repeat(np.add.reduceat(count, begin), np.diff(np.append(begin, len(key))))
        keep = total >= 2
        key, block, total = key[keep], block[keep], np.minimum(total[keep], MOST)
        order = np.lexsort((key, block))
        key, block, total = key[order], block[order], total[order]
        once = np.ones(len(key), bool)
        once[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
        key, block, total = key[once], block[once], total[once]
        edges = np.flatnonzero(np.diff(block, prepend=-1)).tolist() + [len(block)]
        some = list(zip(edges, edges[1:], strict=False))
        return pa.table(
            {
                "block": pa.array([int(block[x]) for x, _ in some], pa.int32()),
                "anchors": pa.array([_keys_out(key[x:y], total[x:y]) for x, y in some], pa.binary()),
            }
        )

    sent = docs.mapInArrow(send, "bucket int, anchors binary")
    return sent.groupBy("bucket").applyInArrow(common, "block int, anchors binary")


#: What stands for a window of a hot anchor; any other segment is longer.
HASH_BYTES = 8
#: Of each segment: key, document, row in the block, first window, windows, bytes.
_FIELDS = (("key", "<u8"), ("doc", "<i8"), ("row", "<u4"), ("pos", "<u4"), ("size", "<u4"), ("bytes", "<u4"))


def _segments_of(table: pa.Table, reply: pa.Table, kind: Kind, buckets: int) -> pa.Table:
    """A block's segments for the buckets, and the marks that are known already (bucket rows with ``marks``)."""
    schema = {"bucket": [], "block": [], "segments": [], "marks": []}
    if table.num_rows and reply.num_rows:
        table = _sorted_rows(table)
        block = table.column("block")[0].as_py()
        ids = np.asarray(table.column("doc_id").fill_null(NO_ID)).astype(np.int64)
        pairs = [_keys_in(x) for x in reply.column("anchors").to_pylist()]
        shared, hot = np.concatenate([x[0] for x in pairs]), np.concatenate([x[1] for x in pairs]) > HOT
        order = np.argsort(shared)
        shared, hot = shared[order], hot[order]
        parts, kept, base = [], [], 0
        for first, _, data, starts in _texts(table):
            found = kind.tokens(data, starts)
            hashes = Hashes(found.symbols)
            anchor, pos, size, doc = anchored_runs(found, hashes, kind.window, kind.gram)
            if len(anchor):
                at = np.minimum(np.searchsorted(shared, _short(anchor)), len(shared) - 1)
                hit = shared[at] == _short(anchor)
                anchor, pos, size, doc, own = anchor[hit], pos[hit], size[hit], doc[hit], hot[at[hit]]
                # a hot anchor's windows go their own ways, as two hashes each
                single = ragged(pos[own], size[own])
                half = single + kind.window // 2
                second = mixed(hashes.of(single, half)) ^ hashes.of(half, single + kind.window)
                key = np.concatenate([anchor[~own], hashes.of(single, single + kind.window)])
                doc = np.concatenate([doc[~own], np.repeat(doc[own], size[own])])
                pos, size = np.concatenate([pos[~own], single]), np.concatenate([size[~own], np.ones(len(single), np.int64)])
                last = pos + size + kind.window - 1
                name = mixed(hashes.of(pos, last) ^ mixed(key))
                begin = found.begin(pos).copy()
                length = found.begin(last) - begin
                if len(single):
                    begin[-len(single) :] = len(found.data) + HASH_BYTES * np.arange(len(single))
                    length[-len(single) :] = HASH_BYTES
                parts.append((key, name, doc + first, pos - found.at[doc], size, begin + base, length))
                kept.append(np.concatenate([found.data, second.view(np.uint8)]))
            else:
                kept.append(found.data)
            base += len(kept[-1])
        if parts:
            key, name, row, pos, size, begin, length = (np.concatenate(x) for x in zip(*parts, strict=True))
            data = np.concatenate(kept)
            own = ids[row]
            order = np.lexsort((pos, row, own, name))
            key, name, row, pos, size, begin, length, own = (x[order] for x in (key, name, row, pos, size, begin, length, own))
            head = np.flatnonzero(np.diff(name, prepend=name[:1] + np.uint64(1)))
            least = np.repeat(own[head], np.diff(np.append(head, len(name))))
            known = own > least
            if known.any():
                schema["bucket"].append(block % buckets)
                schema["block"].append(block)
                schema["segments"].append(None)
                schema["marks"].append(_marks(row[known], pos[known], pos[known] + size[known] + kind.window - 1))
            key, row, pos, size, begin, length, own = (x[~known] for x in (key, row, pos, size, begin, length, own))
            part = _bucket(key, buckets)
            order = np.lexsort((pos, row, part))
            key, row, pos, size, begin, length, own, part = (x[order] for x in (key, row, pos, size, begin, length, own, part))
            edges = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [len(part)]
            for x, y in zip(edges, edges[1:], strict=False):
                columns = (key, own, row, pos, size, length)
                schema["bucket"].append(int(part[x]))
                schema["block"].append(block)
                schema["segments"].append(
                    (y - x).to_bytes(8, "little")
                    + _packed([*(c[x:y].astype(t) for c, (_, t) in zip(columns, _FIELDS, strict=True)), data[ragged(begin[x:y], length[x:y])]])
                )
                schema["marks"].append(None)
    types = {"bucket": pa.int32(), "block": pa.int32(), "segments": pa.binary(), "marks": pa.binary()}
    return pa.table({k: pa.array(v, types[k]) for k, v in schema.items()})


def _marks(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Ranges of tokens by row, in order, those that touch joined."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    far = row.astype(np.int64) << 33
    reach = np.maximum.accumulate(far + end)
    new = np.ones(len(row), bool)
    new[1:] = (far + start)[1:] > reach[:-1]
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(row)) - 1
    return _packed([row[head].astype("<u4"), start[head].astype("<u4"), (reach[last] - far[last]).astype("<u4")])


def _unmarked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(opened(blob), "<u4").astype(np.int64).reshape(3, -1)
    return x[0], x[1], x[2]


#: Bytes of different segments that are compared together.
BATCH_BYTES = 2_000_000


def _compared(group: pa.Table, kind: Kind) -> pa.Table:
    """Marks of a bucket by block: windows that also start in a document with a smaller id."""
    out_block = [b for b, m in zip(group.column("block").to_pylist(), group.column("marks").to_pylist(), strict=True) if m is not None]
    out_marks = [m for m in group.column("marks").to_pylist() if m is not None]
    fields, texts, blocks = {name: [] for name, _ in _FIELDS}, [], []
    for block, blob in zip(group.column("block").to_pylist(), group.column("segments").to_pylist(), strict=True):
        if blob is None:
            continue
        n, raw, at = int.from_bytes(blob[:8], "little"), opened(blob[8:]), 0
        for name, kind_ in _FIELDS:
            fields[name].append(np.frombuffer(raw, kind_, n, at))
            at += n * np.dtype(kind_).itemsize
        texts.append(np.frombuffer(raw, np.uint8, offset=at))
        blocks.append(np.full(n, block, np.int32))
    if texts:
        key, doc, row, pos, size, length = (np.concatenate(fields[name]) for name, _ in _FIELDS)
        row, pos, size, length = (x.astype(np.int64) for x in (row, pos, size, length))
        data, block = np.concatenate(texts), np.concatenate(blocks)
        del texts, fields
        begin = np.cumsum(length) - length
        name = np.concatenate([Hashes(data[begin[a] : begin[b - 1] + length[b - 1]]).of(begin[a:b] - begin[a], begin[a:b] - begin[a] + length[a:b]) for a, b in _slices(length, CHUNK)])
        order = np.lexsort((doc, name, key))
        key, name, doc, row, pos, size, length, begin, block = (x[order] for x in (key, name, doc, row, pos, size, length, begin, block))
        new_key = np.ones(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        new = new_key.copy()
        new[1:] |= name[1:] != name[:-1]
        head = np.flatnonzero(new)
        segment = np.cumsum(new) - 1
        least = doc[head]
        known = doc > least[segment]
        marks = [(block[known], row[known], pos[known], pos[known] + size[known] + kind.window - 1)]
        # anchors with several different segments
        anchor = (np.cumsum(new_key) - 1)[head]
        several = (np.bincount(anchor)[anchor] > 1) & (length[head] > HASH_BYTES)
        chosen = np.flatnonzero(several)
        # the members of each segment with the least id, for which the windows must be compared
        open_ = np.flatnonzero(~known & several[segment])
        for a, b in _slices(length[head[chosen]], BATCH_BYTES, anchor[chosen]):
            some = chosen[a:b]
            sizes, spans = size[head[some]], length[head[some]]
            starts = np.concatenate([[0], np.cumsum(spans)])
            classes = kind.classes(data[ragged(begin[head[some]], spans)], starts, sizes, kind.window)
            owner = np.repeat(least[some], sizes)
            first = np.full(classes.max(initial=-1) + 1, NO_ID)
            np.minimum.at(first, classes, owner)
            older = first[classes] < owner
            # back to the members: each has its segment's windows
            mine = open_[np.searchsorted(segment[open_], some[0]) : np.searchsorted(segment[open_], some[-1], "right")]
            at = np.concatenate([[0], np.cumsum(sizes)])
            local = segment[mine] - some[0]
            local = np.searchsorted(some, segment[mine])
            where = ragged(at[local], sizes[local])
            offset = where - np.repeat(at[local], sizes[local])
            member = np.repeat(mine, sizes[local])
            hit = older[where]
            member, offset = member[hit], offset[hit]
            marks.append((block[member], row[member], pos[member] + offset, pos[member] + offset + kind.window))
        where, row, start, end = (np.concatenate(x) for x in zip(*marks, strict=True))
        order = np.argsort(where, kind="stable")
        where, row, start, end = where[order], row[order], start[order], end[order]
        edges = np.flatnonzero(np.diff(where, prepend=-1)).tolist() + [len(where)]
        for x, y in zip(edges, edges[1:], strict=False):
            out_block.append(int(where[x]))
            out_marks.append(_marks(row[x:y], start[x:y], end[x:y]))
    return pa.table({"block": pa.array(out_block, pa.int32()), "marks": pa.array(out_marks, pa.binary())})


def _slices(sizes: np.ndarray, most: int, group: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about ``most`` together; members of a group (ascending) stay together."""
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        if group is not None and b < len(sizes):
            b = int(np.searchsorted(group, group[b - 1], "right"))
        yield a, b
        a = b


def without_repeats(
    df: DataFrame, kind: Kind, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, counted: str = "n_tokens", kept: str = "binary"
) -> DataFrame:
    """``doc_id``, the number of tokens (named ``counted``), ``n_removed``, ``n_spans``, ``kept`` (what stays, as this type) and the carried columns of every row.

    Carried columns may have any names, also these.
    """
    carry = list(carry or [])
    total = df.agg(F.sum(F.octet_length(df[text_col].cast("string")))).first()[0] or 0
    blocks = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-total // BLOCK_BYTES))
    rows = blocked(df, id_col, text_col, blocks, carry)
    reply = shared_keys(df, id_col, text_col, anchors_of(kind), blocks, blocks)
    segments = rows.groupBy("block").cogroup(reply.groupBy("block")).applyInArrow(
        lambda table, found: _segments_of(table, found, kind, blocks), "bucket int, block int, segments binary, marks binary"
    )
    marks = segments.groupBy("bucket").applyInArrow(lambda group: _compared(group, kind), "block int, marks binary")
    carried = ", ".join(f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(carry)))
    schema = "doc_id long, n_tokens long, n_removed long, n_spans long, kept binary" + (f", {carried}" if carry else "")
    out = rows.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(lambda table, found: _cut(table, found, kind, len(carry)), schema)
    return out.select("doc_id", F.col("n_tokens").alias(counted), "n_removed", "n_spans", F.col("kept").cast(kept).alias("kept"), *(out[f"c{i}"].alias(c) for i, c in enumerate(carry)))


def _cut(table: pa.Table, found: pa.Table, kind: Kind, carried: int) -> pa.Table:
    """A block's documents without the marked tokens."""
    table = _sorted_rows(table)
    marks = [_unmarked(x) for x in found.column("marks").to_pylist()] or [(np.zeros(0, np.int64),) * 3]
    row, start, end = (np.concatenate(x) for x in zip(*marks, strict=True))
    order = np.argsort(row, kind="stable")
    row, start, end = row[order], start[order], end[order]
    out = {"doc_id": table.column("doc_id"), "n_tokens": [], "n_removed": [], "n_spans": [], "kept": []}
    for a, b, data, starts in _texts(table):
        tokens = kind.tokens(data, starts)
        x, y = np.searchsorted(row, [a, b])
        base = tokens.at[row[x:y] - a]
        change = np.bincount(base + start[x:y], minlength=len(tokens.symbols) + 1) - np.bincount(base + end[x:y], minlength=len(tokens.symbols) + 1)
        gone = np.cumsum(change)[:-1] > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        heads = tokens.at[:-1][np.diff(tokens.at) > 0]
        opens[heads] = gone[heads]
        for name, value in (("n_removed", gone), ("n_spans", opens)):
            total = np.concatenate([[0], np.cumsum(value)])
            out[name].append(np.diff(total[tokens.at]))
        out["n_tokens"].append(np.diff(tokens.at))
        stays = np.flatnonzero(~gone)
        if tokens.edges is None:
            raw, sizes = data[stays], np.diff(tokens.at) - out["n_removed"][-1]
            ends = np.cumsum(sizes)
            begins, cut = ends - sizes, 0
        else:
            size = tokens.edges[stays + 1] - tokens.edges[stays]
            raw = tokens.data[ragged(tokens.edges[stays], size)]
            at = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(stays, tokens.at)]
            begins, ends, cut = at[:-1], at[1:], 1
        raw = raw.tobytes()
        out["kept"] += [raw[i : max(i, j - cut)] for i, j in zip(begins.tolist(), ends.tolist(), strict=True)]
    for name in ("n_tokens", "n_removed", "n_spans"):
        out[name] = pa.array(np.concatenate(out[name]) if out[name] else np.zeros(0, np.int64), pa.int64())
    out["kept"] = pa.array(out["kept"], pa.binary())
    return pa.table(out | {f"c{i}": table.column(f"c{i}") for i in range(carried)})
