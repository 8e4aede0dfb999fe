"""Operator 2: byte-level BPE encoding and decoding by speculation and verification.

A word's tokens are first guessed by greedy longest match. Byte-pair merging would give exactly these tokens if each token
is what merging makes of its own bytes and no adjacent pair would have merged across its border; the second is tested
for all adjacent pairs of a batch at once, by undoing merges on both sides of the border, latest first. Only words that fail
are merged exactly. Words are cut out of whole texts by the tokenizer's own pattern and cached in each worker.

Null and empty texts have no tokens; repeated rows and ids are encoded row by row; every text is taken whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from assayer.llm.common import chunks, documents, flat, ragged
from assayer.llm.pieces import BATCH_BYTES, PieceEncoder

# The pattern by which byte-level tokenizers cut texts into words.
WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


#: Above every token's number.
NEVER = 1 << 40
#: Bytes of a word beyond which it is merged alone.
LONG = 48


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable bytes for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """One vocabulary. Inside, tokens are numbered by age: the bytes, then the merges in their order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kind = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        raw = {token: bytes(letters[c] for c in token) for token in vocab}
        names = [None] * 256
        for token in vocab:
            if len(raw[token]) == 1:
                names[raw[token][0]] = token
        if None in names:
            raise ValueError(f"{path} has no token for some bytes")
        age = {token: i for i, token in enumerate(names)}
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in spec["model"]["merges"]]
        left, right = list(range(256)), list(range(256))
        self.rank: dict[tuple[int, int], int] = {}
        for a, b in merges:
            if a + b in age:
                raise ValueError(f"{path} merges two pairs into one token")
            age[a + b] = len(left)
            self.rank[age[a], age[b]] = len(left)
            left.append(age[a])
            right.append(age[b])
        self.bytes = [b""] * len(left)
        self.public = np.zeros(len(left), np.int32)
        for token, i in age.items():
            self.bytes[i], self.public[i] = raw[token], vocab[token]
        self.left, self.right = np.array(left), np.array(right)
        self.pairs = np.array([a * len(left) + b for a, b in self.rank], np.int64)
        order = np.argsort(self.pairs)
        self.pairs, self.made = self.pairs[order], np.array(list(self.rank.values()))[order]
        self.token = {b: i for i, b in enumerate(self.bytes)}
        self.starts = {b[:n] for b in self.bytes for n in range(1, len(b) + 1)}
        self.sound = np.array([len(b) == 1 or self.merged(b) == [i] for i, b in enumerate(self.bytes)])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        parts: dict[int, bytes] = {int(p): b for p, b in zip(self.public, self.bytes, strict=True)} | {i: x.encode() for x, i in self.special.items()}
        sizes = np.zeros(max(parts) + 1, np.int64)
        for i, b in parts.items():
            sizes[i] = len(b)
        self.out_sizes = sizes
        self.out_starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.out = np.frombuffer(b"".join(parts.get(i, b"") for i in range(len(sizes))), np.uint8)
        self.names = [str(i) for i in range(len(sizes))]
        self.encoder = PieceEncoder(self.words, self.special)

    def merged(self, word: bytes) -> list[int]:
        """Exact merging of one word: always the oldest pair, the leftmost of several; a queue keeps long words cheap."""
        tokens, n = list(word), len(word)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(made, i, a, b) for i, (a, b) in enumerate(zip(tokens, tokens[1:], strict=False)) if (made := self.rank.get((a, b)))]
        heapq.heapify(queue)
        while queue:
            made, i, a, b = heapq.heappop(queue)
            j = after[i]
            if tokens[i] != a or j < 0 or tokens[j] != b:
                continue
            tokens[i], tokens[j], after[i] = made, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (made := self.rank.get((tokens[x], tokens[y]))):
                    heapq.heappush(queue, (made, x, tokens[x], tokens[y]))
        return [t for t in tokens if t >= 0]

    def merges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair becomes, or NEVER."""
        key = a * len(self.left) + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], NEVER)

    def merged_together(self, words: list[bytes]) -> list:
        """Exact merging of many words, one merge of each word in a round."""
        out: list = [self.merged(w) if len(w) > LONG else None for w in words]
        rest = [i for i, x in enumerate(out) if x is None]
        if not rest:
            return out
        sizes = np.array([len(words[i]) for i in rest])
        tokens = np.frombuffer(b"".join(words[i] for i in rest), np.uint8).astype(np.int64)
        word = np.repeat(np.array(rest), sizes)
        made = np.full(len(tokens), NEVER)
        inner = np.flatnonzero(word[1:] == word[:-1])
        made[inner] = self.merges(tokens[inner], tokens[inner + 1])
        while len(tokens):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            counts = np.diff(np.append(starts, len(word)))
            best = np.minimum.reduceat(made, starts)
            over = best == NEVER
            for s, n in zip(starts[over].tolist(), counts[over].tolist(), strict=True):
                out[word[s]] = tokens[s : s + n]
            live = np.repeat(~over, counts)
            at = np.flatnonzero(live & (made == np.repeat(best, counts)))
            at = at[np.diff(word[at], prepend=-1) != 0]
            tokens[at] = made[at]
            live[at + 1] = False
            place = np.cumsum(live) - 1
            tokens, word, made, at = tokens[live], word[live], made[live], place[at]
            if not len(tokens):
                break
            for x in (at - 1, at):
                ok = (x >= 0) & (x + 1 < len(word))
                ok[ok] = word[x[ok]] == word[x[ok] + 1]
                made[x[ok]] = self.merges(tokens[x[ok]], tokens[x[ok] + 1])
                last = x[~ok & (x >= 0)]
                made[last] = NEVER
        return out

    def guessed(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n, starts, token = [], 0, len(word), self.starts, self.token
        while at < n:
            best, to = at + 1, at + 1
            while to <= n and word[at:to] in starts:
                if word[at:to] in token:
                    best = to
                to += 1
            out.append(token[word[at:best]])
            at = best
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each adjacent pair of tokens: would merging keep the border between them?

        Both sides are taken apart again, the younger token first. ``before`` is the age up to which a merge across
        the border would have come earlier than the merge that was just undone.
        """
        a, b = a.copy(), b.copy()
        out = np.ones(len(a), bool)
        before = np.full(len(a), NEVER)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * len(self.left) + y
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            wrong = (self.pairs[at] == key) & (self.made[at] < before[live])
            out[live[wrong]] = False
            live, x, y = live[~wrong], x[~wrong], y[~wrong]
            first = (x > y) & (x >= 256)
            first |= (y < 256) & (x >= 256)
            second = ~first & (y >= 256)
            before[live[first]] = x[first]
            before[live[second]] = y[second] + 1
            a[live[first]] = self.right[x[first]]
            b[live[second]] = self.left[y[second]]
            live = live[first | second]
        return out

    def words(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The texts, the public ids of all in a row, and how many each has; their words are guessed, tested together and mended."""
        split = [WORDS.findall(x) for x in texts]
        flat = list(chain.from_iterable(split))
        distinct = dict(zip(dict.fromkeys(flat), count(), strict=False))
        raw = [w.encode("utf-8", "surrogatepass") for w in distinct]
        guess = [self.guessed(b) for b in raw]
        sizes = np.fromiter(map(len, guess), np.int64, len(guess))
        tokens = np.fromiter(chain.from_iterable(guess), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(guess)), sizes)
        bad = np.zeros(len(guess), bool)
        bad[word[~self.sound[tokens]]] = True
        inner = np.flatnonzero(word[1:] == word[:-1])
        if len(inner):
            pair, back = np.unique(tokens[inner] * len(self.left) + tokens[inner + 1], return_inverse=True)
            keeps = self.compatible(pair // len(self.left), pair % len(self.left))
            bad[word[inner[~keeps[back]]]] = True
        failed = np.flatnonzero(bad)
        mended = self.merged_together([raw[i] for i in failed.tolist()])
        # the mended words follow the guessed ones, and are looked up there
        starts = np.cumsum(sizes) - sizes
        mended_sizes = np.fromiter(map(len, mended), np.int64, len(mended))
        starts[failed] = len(tokens) + np.cumsum(mended_sizes) - mended_sizes
        sizes[failed] = mended_sizes
        tokens = np.concatenate([tokens, *mended]).astype(np.int64)
        use = np.fromiter(map(distinct.__getitem__, flat), np.int64, len(flat))
        ends = np.concatenate([[0], np.cumsum(sizes[use])])[np.cumsum([0, *map(len, split)])]
        return texts, self.public[tokens[ragged(starts[use], sizes[use])]], np.diff(ends)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and offsets."""
        return self.encoder.encode(texts)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The UTF-8 bytes of each text; bytes that are no UTF-8 become U+FFFD, as in the library."""
        sizes = self.out_sizes[ids]
        data = self.out[ragged(self.out_starts[ids], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[offsets].tolist()
        out = [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        try:
            data.decode()
        except UnicodeDecodeError:
            out = [x.decode("utf-8", "replace").encode() for x in out]
        else:
            out = [x if not x or x[0] & 0xC0 != 0x80 else x.decode("utf-8", "replace").encode() for x in out]
        return out


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The worker's own copy, kept between tasks."""
    return Codec(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch, BATCH_BYTES):
                ids, at = codec(path).encode(batch.column(1)[a:b].to_pylist())
                yield pa.record_batch([batch.column(0)[a:b], pa.ListArray.from_arrays(at.astype(np.int32), ids)], ["doc_id", "ids"])

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``text`` of every list of ids (null: empty; an id outside the vocabulary fails)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(sizes)])
            texts = codec(path).decode(np.asarray(lists.flatten()).astype(np.int64), at)
            yield pa.record_batch([batch.column(0), pa.array([x.decode() for x in texts], pa.string())], ["doc_id", "text"])

    picked = df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].cast("array<int>").alias("ids"))
    return picked.mapInArrow(run, "doc_id long, text string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode its ids, and return digests of both; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for a, b in chunks(batch, BATCH_BYTES):
                ids, at = own.encode(batch.column(1)[a:b].to_pylist())
                names, edges = [own.names[i] for i in ids.tolist()], at.tolist()
                yield pa.record_batch(
                    [
                        batch.column(0)[a:b],
                        pa.array(np.diff(at)),
                        pa.array([hashlib.sha256(",".join(names[x:y]).encode()).hexdigest() for x, y in zip(edges, edges[1:], strict=False)], pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in own.decode(ids, at)], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
