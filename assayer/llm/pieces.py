"""Byte-level BPE of whole texts through a cache of their pieces.

The pattern of byte-level tokenizers takes at most one space before a word and never crosses other white space, so a text
can be cut before a space without changing its tokens, but for a space between two characters of white space (or after
one, at the end). The last white space before other text never belongs to what stands before it, so a text can also be cut
before a line end there. Most pieces are words that have been seen before; only new ones need the merges.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from assayer.llm.common import flat, ragged

#: Bytes of text that are encoded together: each batch looks through the whole cache once.
BATCH_BYTES = 2_000_000
#: Bytes of known pieces in a generation, where they are long.
GENERATION_BYTES = 32_000_000
#: Where a text must not be cut; Python's white space covers the tokenizers' and four control characters more, which is harmless.
UNSAFE = re.compile(r"\s (?:\s|\Z)")

#: The last white space before other text: a text can be cut before it wherever it stands.
LAST_SPACE, LAST_LINE_END = re.compile(r"[ \n](?=\S)"), re.compile(r"\n(?=\S)")

#: Marks that are words of their own at the end of a piece, if a Latin letter stands before them (as Arrow's patterns have it).
MARKS = ".,;:!?"
MARKED = f"[{''.join(c for c in map(chr, range(0x250)) if c.isalpha())}][{MARKS}]\\z"


class PieceEncoder:
    """Token ids of texts; ``encode_new`` encodes strings that were not seen before, each on its own, in an order that it chooses:
    it returns the strings, all their ids in a row, and the number of ids of each.

    Once the cache holds ``most`` pieces, only those are kept that were met in more than one batch: that bounds memory and changes no result.
    """

    def __init__(self, encode_new: Callable[[list[str]], tuple[list[str], np.ndarray, np.ndarray]], special: dict[str, int], most: int = 1_000_000, most_counted: int = 1_000_000):
        self.encode_new, self.most, self.most_counted = encode_new, most, most_counted
        self.special = special
        #: Whether texts may be cut before spaces.
        self.spaces = True
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        #: Pieces whose numbers of ids are known, and these numbers, in two generations.
        self.numbers, self.sizes = self.older, self.older_sizes = self._own = pa.array(["", *special], pa.large_string()), pa.array([0, *[1] * len(special)], pa.int32())
        #: The number of ids of each mark, by its byte.
        self.marks: np.ndarray | None = None
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1 << 12, np.int64)
        self.count = self.used = 0
        self.met = np.zeros(1 << 12, np.uint8)
        self._add(list(self.special), np.array(list(self.special.values()), np.int32), np.ones(len(self.special), np.int64))

    def _add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        total = len(ids)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        if total:
            self.pool[self.used : self.used + total] = ids
        self.known.update(zip(pieces, range(self.count, self.count + len(pieces)), strict=True))
        while self.count + len(pieces) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.met = np.concatenate([self.met, np.zeros_like(self.met)])
        self.ends[self.count + 1 : self.count + 1 + len(pieces)] = self.used + np.cumsum(sizes)
        self.count += len(pieces)
        self.used += total

    def _forget(self) -> None:
        """Keep pieces of several batches; if these are too many as well, none."""
        keep = np.flatnonzero(self.met[: self.count] > 1)
        if len(keep) > self.most // 2:
            keep = keep[:0]
        flags = np.zeros(self.count, bool)
        flags[keep] = True
        names = list(compress(self.known, flags.tolist()))
        starts = self.ends[keep]
        sizes = self.ends[keep + 1] - starts
        ids = self.pool[ragged(starts, sizes)]
        self._clear()
        own = [i for i, x in enumerate(names) if x not in self.special]
        if len(own) < len(names):
            names, sizes, ids = [names[i] for i in own], sizes[own], ids[ragged((np.cumsum(sizes) - sizes)[own], sizes[own])]
        self._add(names, ids, sizes)

    def pieces(self, text: str) -> list[str]:
        """``text`` in pieces that are encoded on their own; joined they give the text."""
        if not text:
            return []
        if self.cut and any(x in text for x in self.special):
            return list(chain.from_iterable([part] if part in self.special else self.pieces(part) for part in self.cut.split(text)))
        if UNSAFE.search(text):
            return [text] if len(text) < 200 else self._by_line(text)
        if "\x00" in text:
            first, *rest = text.split(" ")
            return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]
        pieces = text.replace(" ", "\x00 ").split("\x00")
        return pieces if pieces[0] else pieces[1:]

    def _by_line(self, text: str) -> list[str]:
        """Cut before those spaces that stand after no white space and before none."""
        return re.split(r"(?<=\S)(?= \S)", text)

    def _looked_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' pieces in a row, and where each text's begin; new pieces are encoded."""
        if self.count > self.most:
            self._forget()
        split = [self.pieces(x) for x in texts]
        pieces = list(chain.from_iterable(split))
        found = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            own = [pieces[i] for i in missing]
            self._add(*self.encode_new(list(dict.fromkeys(own))))
            found[missing] = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))
        here = np.zeros(self.count, np.uint8)
        here[found] = 1
        self.met[: self.count] = np.minimum(self.met[: self.count], 250) + here
        return found, np.cumsum([0, *map(len, split)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin (one offset more than texts)."""
        found, at = self._looked_up(texts)
        starts = self.ends[found]
        sizes = self.ends[found + 1] - starts
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.pool[ragged(starts, sizes)], ends[at]

    def counted(self, texts: list[str]) -> np.ndarray:
        """How many ids each text has; the ids are not put together and not kept.

        Pieces stay in Arrow's arrays: each distinct one is looked up once, and only new ones become Python strings. They and their
        numbers of ids are kept in two generations of ``most_counted // 2`` and ``GENERATION_BYTES``: when the younger is full, the older is given up.
        """
        cut: list[str | None] = []
        split: list[list[str]] = []
        for x in texts:
            if not self.spaces or "\x00" in x or (self.cut and self.cut.search(x)):
                cut.append(None)
                split.append(self.pieces(x))
            else:
                # plain replacing is faster, but cuts before every space
                cut.append(LAST_SPACE.sub("\x00\\g<0>", x) if UNSAFE.search(x) else LAST_LINE_END.sub("\x00\n", x).replace(" ", "\x00 "))
                split.append([])
        lists = pc.split_pattern(pa.array(cut, pa.large_string()), "\x00")
        sizes = np.asarray(pc.list_value_length(lists).fill_null(0))
        pieces, own = lists.flatten(), list(chain.from_iterable(split))
        cut_pieces = len(pieces)
        del cut, lists
        found = (pa.concat_arrays([pieces, pa.array(own, pa.large_string())]) if own else pieces).dictionary_encode()
        del pieces
        n = self._sizes_of(found.dictionary)[np.asarray(found.indices)]
        return _sums(n[:cut_pieces], sizes) + _sums(n[cut_pieces:], [*map(len, split)])

    def _sizes_of(self, pieces: pa.Array) -> np.ndarray:
        """How many ids each of these distinct pieces has; a mark behind a Latin word is counted on its own."""
        if not self.spaces:
            return self._looked_up_sizes(pieces)
        marked = pc.and_not(pc.match_substring_regex(pieces, MARKED), pc.is_in(pieces, value_set=self._own[0]))
        words = pc.if_else(marked, pc.utf8_rtrim(pieces, MARKS), pieces).dictionary_encode()
        n = self._looked_up_sizes(words.dictionary)[np.asarray(words.indices)]
        if self.marks is None:
            names, _, sizes = self.encode_new(list(MARKS))
            self.marks = np.zeros(256, np.int64)
            self.marks[[ord(x) for x in names]] = sizes
        letters, starts = flat(pieces)
        at = np.flatnonzero(np.asarray(marked))
        n[at] += self.marks[letters[starts[at + 1] - 1]]
        return n

    def _looked_up_sizes(self, words: pa.Array) -> np.ndarray:
        """How many ids each of these distinct strings has; what is not in the younger generation comes into it."""
        n = np.array(self.sizes.take(pc.index_in(words, value_set=self.numbers)).fill_null(-1), np.int64)
        missing = np.flatnonzero(n < 0)
        if len(missing):
            rest = words.take(pa.array(missing))
            sizes = np.array(self.older_sizes.take(pc.index_in(rest, value_set=self.older)).fill_null(-1), np.int64)
            new = np.flatnonzero(sizes < 0)
            if len(new):
                sizes[new] = self._numbers_of(rest.take(pa.array(new)).to_pylist())
            n[missing] = sizes
            self.numbers = pa.concat_arrays([self.numbers, rest])
            self.sizes = pa.concat_arrays([self.sizes, pa.array(sizes, pa.int32())])
            if len(self.numbers) > min(self.most, self.most_counted) // 2 or self.numbers.nbytes > GENERATION_BYTES:
                (self.older, self.older_sizes), (self.numbers, self.sizes) = (self.numbers, self.sizes), self._own
        return n

    def _numbers_of(self, pieces: list[str]) -> np.ndarray:
        """How many ids each of these new pieces has."""
        names, _, sizes = self.encode_new(pieces)
        number = dict(zip(names, sizes.tolist(), strict=True))
        return np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))


def _sums(n: np.ndarray, sizes: np.ndarray | list[int]) -> np.ndarray:
    """The sums of rows of ``n`` with these sizes."""
    return np.diff(np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *sizes])])
