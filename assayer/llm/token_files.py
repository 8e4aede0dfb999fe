"""Operator 6: token ids as flat binary files that are memory-mapped.

Format of a folder, for each part ``p`` (five digits), all little endian:

* ``p.ids``: unsigned integers of 16 bits if the vocabulary and end id fit, else of 32 bits; documents in ascending ``doc_id`` order;
* ``p.ends``: 64-bit offsets within the part, one more than documents, beginning with 0;
* ``p.docs``: the documents' 64-bit ids.

Parts follow each other in ``doc_id`` order; a part's base is the sum of the ids in the parts before it. ``write`` deals the
documents into ranges of ``doc_id``, so each task writes one part; only one row for each part comes back to the driver. A
part is written under another name and renamed, so that an attempt that is repeated leaves whole files.

Null and empty texts hold the end id only. Rows with the same id stand next to each other, in the order of their texts;
rows without id come first and are read back with a null id (stored as the smallest 64-bit integer). An empty table gives a
folder whose parts hold nothing.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from assayer.llm.common import chunks, documents, local_path, released
from assayer.llm.pieces import BATCH_BYTES, PieceEncoder

NO_ID = -(2**63)
#: Pieces that can be encoded in a row of their kind, and the letter that begins each one's tokens and no token within.
#: The letters that stand for a space and a line end in byte-level vocabularies.
KINDS = ((re.compile(r" \S+(?:\n+\S+)*"), "\u0120"), (re.compile(r"\n\S+"), "\u010a"))
#: Bytes of text whose tokens are counted together: each batch looks through all known pieces once.
COUNTED_BYTES = 4_000_000
#: Bytes of input text for each part.
PART_BYTES = 32_000_000


@lru_cache(maxsize=2)
def library(path: str) -> tuple[PieceEncoder, int]:
    """The tokenizers library behind the cache of pieces, and the largest id. Other kinds than byte-level BPE get whole texts."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import json

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    kind = spec["pre_tokenizer"] or {}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    plain = spec["model"]["type"] == "BPE" and kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and not spec["normalizer"]
    plain &= not any(x[k] for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
    largest = max([*tokenizer.get_vocab().values(), 0])

    kinds = []
    for pattern, letter in KINDS if plain else ():
        opens = np.zeros(largest + 1, bool)
        opens[[i for token, i in tokenizer.get_vocab().items() if token.startswith(letter)]] = True
        kinds.append((pattern, opens))

    def alone(texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.int32) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_new(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """A space or a line end, and words without other white space than line ends between them, keep their tokens in a row of such; each one's begin at that letter."""
        rest, order, ids, sizes = texts, [], [np.zeros(0, np.int32)], []
        rows: list[tuple[list[str], np.ndarray]] = []
        for pattern, opens in kinds:
            fits = [pattern.fullmatch(x) is not None for x in rest]
            own, rest = list(compress(rest, fits)), list(compress(rest, [not x for x in fits]))
            rows += [(own[a : a + 512], opens) for a in range(0, len(own), 512)]
        for (row, opens), found in zip(rows, alone(["".join(row) for row, _ in rows]), strict=True):
            begins = np.flatnonzero(opens[found])
            if len(begins) == len(row):
                order += row
                ids.append(found)
                sizes.append(np.diff(begins, append=len(found)))
            else:
                rest += row
        for x in (single := alone(rest)):
            sizes.append(np.array([len(x)]))
        return order + rest, np.concatenate(ids + single), np.concatenate([np.zeros(0, np.int64), *sizes])

    encoder = PieceEncoder(encode_new, special if plain else {})
    if not plain:
        encoder.pieces = lambda text: [text] if text else []
        encoder.spaces, encoder.most = False, 20_000
    return encoder, largest


def counted(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``df`` with the number of tokens of every whole text (null: 0) as ``n_tokens`` in place of the text; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = library(path)
        for batch in released(batches):
            for a, b in chunks(batch, COUNTED_BYTES):
                n = encoder.counted(batch.column(batch.num_columns - 1)[a:b].to_pylist())
                yield pa.record_batch([*[x[a:b] for x in batch.columns[:-1]], pa.array(n, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])
            del batch

    others = [df[c] for c in df.columns if c != text_col]
    picked = df.select(*others, F.coalesce(df[text_col].cast("string"), F.lit("")).alias("n_tokens"))
    return picked.mapInArrow(run, StructType([*picked.schema.fields[:-1], StructField("n_tokens", LongType())]))


def write(df: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> list[dict]:
    """Encode every whole text and write the files; returns the parts with their bases, in order."""
    docs = documents(df, id_col, text_col)
    if parts is None:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-total // PART_BYTES))
    target = local_path(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, largest = library(path)
        kind = np.dtype("<u2") if max(largest, end_id) < 1 << 16 else np.dtype("<u4")
        part = TaskContext.get().partitionId()
        os.makedirs(target, exist_ok=True)
        own = f"{target}/.{part:05d}-{uuid.uuid4().hex}"
        n_docs = n_ids = 0
        with open(f"{own}.ids", "wb") as ids_file, open(f"{own}.ends", "wb") as ends_file, open(f"{own}.docs", "wb") as docs_file:
            ends_file.write(np.zeros(1, "<i8").tobytes())
            for batch in batches:
                for a, b in chunks(batch, BATCH_BYTES):
                    ids, at = encoder.encode(batch.column(1)[a:b].to_pylist())
                    ids_file.write(np.insert(ids, at[1:], end_id).astype(kind).tobytes())
                    ends_file.write((n_ids + at[1:] + np.arange(1, b - a + 1)).astype("<i8").tobytes())
                    docs_file.write(np.asarray(batch.column(0)[a:b].fill_null(NO_ID)).astype("<i8").tobytes())
                    n_docs, n_ids = n_docs + b - a, n_ids + len(ids) + b - a
        for x in ("ids", "ends", "docs"):
            os.replace(f"{own}.{x}", f"{target}/{part:05d}.{x}")
        yield pa.record_batch([pa.array([part]), pa.array([kind.str]), pa.array([n_docs]), pa.array([n_ids])], ["part", "kind", "n_docs", "n_ids"])

    found = (
        docs.repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, "part long, kind string, n_docs long, n_ids long")
        .collect()
    )
    out, base = [], 0
    for row in sorted(found, key=lambda r: r["part"]):
        if row["n_docs"]:
            out.append(row.asDict() | {"base": base})
            base += row["n_ids"]
    return out


def read(spark: SparkSession, folder: str, parts: list[dict]) -> DataFrame:
    """One row per document from the mapped files: ``doc_id``, ``start``, ``n_tokens`` and the crc32 of its ids as 32-bit integers."""
    target = local_path(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{target}/{row['part']:05d}"
                ids, ends, docs = np.memmap(f"{name}.ids", row["kind"], "r"), np.memmap(f"{name}.ends", "<i8", "r"), np.memmap(f"{name}.docs", "<i8", "r")
                if len(ids) != row["n_ids"] or len(docs) != row["n_docs"]:
                    raise ValueError(f"{name} does not hold what was written")
                for a in range(0, len(docs), 4096):
                    at = ends[a : a + 4097].tolist()
                    codes = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(at, at[1:], strict=False)]
                    own = np.asarray(docs[a : a + 4096])
                    yield pa.record_batch(
                        [
                            pa.array(own, mask=own == NO_ID),
                            pa.array(np.array(at[:-1]) + row["base"]),
                            pa.array(np.diff(at)),
                            pa.array(codes, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    rows = spark.createDataFrame([(x["part"], x["kind"], x["n_docs"], x["n_ids"], x["base"]) for x in parts], "part long, kind string, n_docs long, n_ids long, base long")
    return rows.repartition(max(1, len(parts))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
