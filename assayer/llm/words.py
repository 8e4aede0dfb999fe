"""Words of many texts at once, as positions and hashes in flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from assayer.llm.common import mixed

_BASE = 0x9E3779B97F4A7C55 | 1
_MASK = 2**64 - 1
_LETTERS = mixed(np.arange(1, 257, dtype=np.uint64))
_POWERS: dict[str, np.ndarray] = {}


def lookup(chosen: str | bytes) -> np.ndarray:
    """A truth value for each byte."""
    out = np.zeros(256, bool)
    out[list(chosen.encode() if isinstance(chosen, str) else chosen)] = True
    return out


#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = lookup(b" \t\n\x0b\x0c\r")
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base modulo 2**64, and of its inverse."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _POWERS[key] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Hashes:
    """64-bit hashes of any ranges of an array of symbols, from one running sum."""

    def __init__(self, symbols: np.ndarray):
        up, self.down = powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((_LETTERS[symbols] if symbols.dtype == np.uint8 else mixed(symbols)) * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    #: Where each document's words begin, one more than documents.
    at: np.ndarray


def words(data: np.ndarray, starts: np.ndarray, separator: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that are no separators; none crosses a document's border."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(len(starts), np.int64))
    inside = ~separator[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = starts[:-1][np.diff(starts) > 0]
    begins[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    tails = heads[heads > 0] - 1
    ends[tails] = inside[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    at = np.searchsorted(start, starts)
    return Words(start, end, np.repeat(np.arange(len(starts) - 1), np.diff(at)), at)


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of each range at[i] .. at[i + 1] of ``values``; 0 where it is empty."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[at[1:]] - total[at[:-1]]
