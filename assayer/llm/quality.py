"""Operator 10: a quality classifier from weak labels.

Simple heuristics vote on each document: 1 good, -1 bad, 0 no opinion. They overlap and err. Expectation-maximisation over the
counts of vote patterns of *all* documents estimates how often each heuristic votes what, given the unseen class, and so each
pattern's posterior. A linear scorer over hashed features (byte pairs and word shapes) is then fitted to the posteriors of at
most ``Settings.fit_rows`` documents, taken by the hash of their ids; the scorer scores every whole text.

The pattern table has at most 3 ** len(HEURISTICS) rows, whatever the input. No hand label is read.

Null and empty texts get no votes and the score 0: they are rejected. Equal texts have equal scores. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayer.llm.common import about, chunks, documents, flat, mixed, parts
from assayer.llm.words import Hashes, lookup, sums, words


@dataclass(frozen=True)
class Settings:
    #: Most documents to which the scorer is fitted; counts of votes always cover all documents.
    fit_rows: int = 6_000
    buckets: int = 2048
    rounds: int = 60
    #: Share of bad documents from which expectation-maximisation starts.
    prior: float = 0.15
    threshold: float = 0.5


SYMBOLS = lookup("#$%&*|<>{}[]=~^_@\\/+")
UPPER = lookup(bytes(range(65, 91)))
LETTERS = lookup(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
STOPS = lookup(".!?")


def measures(data: np.ndarray, starts: np.ndarray) -> tuple[dict[str, np.ndarray], dict]:
    """Shares by document that the heuristics look at, and the arrays that the scorer uses too."""
    found = words(data, starts)
    n_bytes, n_words = np.maximum(np.diff(starts), 1), np.maximum(np.diff(found.at), 1)
    # the second byte of capital letters like É in UTF-8
    accent = np.zeros(len(data), bool)
    accent[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    upper = UPPER[data] | accent
    letters = LETTERS[data]
    names = Hashes(data).of(found.start, found.end)
    again = np.zeros(len(names), bool)
    next_to = np.zeros(len(names), bool)
    next_to[1:] = (names[1:] == names[:-1]) & (found.doc[1:] == found.doc[:-1])
    for back in (1, 2, 3, 4):
        again[back:] |= (names[back:] == names[:-back]) & (found.doc[back:] == found.doc[:-back])
    shares = {
        "symbols": sums(SYMBOLS[data], starts) / n_bytes,
        "marked_words": sums(SYMBOLS[data[found.end - 1]] if len(found.end) else np.zeros(0, bool), found.at) / n_words,
        "upper": sums(upper, starts) / np.maximum(sums(letters | accent, starts), 1),
        "shouts": sums(data == 33, starts) / n_words,
        "again": sums(again, found.at) / n_words,
        "next_to": sums(next_to, found.at) / n_words,
        "words_a_stop": n_words / np.maximum(sums(STOPS[data], starts), 1),
        "word_bytes": n_bytes / n_words,
        "words": np.diff(found.at),
    }
    return shares, {"words": found, "again": again, "upper": upper}


def between(x: np.ndarray, good: float, bad: float) -> np.ndarray:
    """1 up to ``good``, -1 from ``bad``, 0 between."""
    return np.where(x <= good, 1, np.where(x >= bad, -1, 0)).astype(np.int8)


#: Each heuristic by its name: votes from the measures.
HEURISTICS = {
    "symbols": lambda m: between(m["symbols"], 0.01, 0.03),
    "marked_words": lambda m: between(m["marked_words"], 0.1, 0.3),
    "upper": lambda m: between(m["upper"], 0.2, 0.5),
    "shouts": lambda m: between(m["shouts"], 0.05, 0.3),
    "again": lambda m: np.where(m["words"] < 8, 0, between(m["again"], 0.15, 0.3)),
    "next_to": lambda m: np.where(m["words"] < 8, 0, between(m["next_to"], 0.05, 0.2)),
    "stops": lambda m: np.where(m["words"] < 8, 0, between(m["words_a_stop"], 40, 150)),
    "length": lambda m: np.where((m["word_bytes"] < 2.5) | (m["word_bytes"] > 25), -1, np.where((m["word_bytes"] > 4) & (m["word_bytes"] < 16), 1, 0)),
}


def votes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of votes for each document."""
    found = measures(data, starts)[0]
    out = np.stack([f(found) for f in HEURISTICS.values()], 1).astype(np.int8)
    out[found["words"] == 0] = 0
    return out


def features(data: np.ndarray, starts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features in three flat arrays: bucket, document, weight. Each kind weighs 1 in a document.

    Byte pairs fill the first half of the buckets; the shapes of words (capitals, first and last byte's kind, length, whether one
    of the four words before is the same) the second half.
    """
    own = measures(data, starts)[1]
    found = own["words"]
    half = np.uint64(buckets // 2)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    pair = _PAIRS[data[inner].astype(np.int64) << 8 | data[inner + 1]] % half
    capital = np.concatenate([[0], np.cumsum(own["upper"])])
    size = found.end - found.start
    last = data[found.end - 1] if len(size) else np.zeros(0, np.uint8)
    shape = (
        np.minimum(size, 20) * 64 + np.where(LETTERS[last], 0, 1 + last % 31)
    ) * 8 + own["again"] * 4 + (2 * (capital[found.end] - capital[found.start]) > size) * 2 + (LETTERS[data[found.start]] if len(size) else 0)
    shape = half + mixed(shape.astype(np.uint64)) % half
    weight = np.concatenate([1 / np.maximum(np.diff(starts) - 1, 1)[doc[inner]], 1 / np.maximum(np.diff(found.at), 1)[found.doc]])
    return np.concatenate([pair, shape]).astype(np.int64), np.concatenate([doc[inner], found.doc]), weight


#: Least standard deviation that a feature is scaled by.
FLOOR = 2e-3
_PAIRS = mixed(np.arange(1 << 16, dtype=np.uint64) + np.uint64(77))


def posteriors(patterns: np.ndarray, counts: np.ndarray, settings: Settings = Settings()) -> np.ndarray:
    """P(good) of each vote pattern by expectation-maximisation.

    Given the class, heuristics vote independently; what each votes how often is estimated for either class. The start: any
    vote against a document makes it likely bad. Patterns without any vote keep the prior.
    """
    if not len(patterns):
        return np.zeros(0)
    seen = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)
    against, prior = (patterns == -1).sum(1), settings.prior
    good = np.where(against > 0, 0.1, 1 - prior / 2)
    for _ in range(settings.rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        prior = (weight[0].sum() + 1) / (counts.sum() + 2)
        # how often each heuristic votes what, in the bad and in the good class
        rate = (np.einsum("cp,pjv->cjv", weight, seen) + 0.5) / (weight.sum(1) + 1.5)[:, None, None]
        # a heuristic tells nothing by abstaining
        spoken = rate[:, :, [0, 2]] / rate[:, :, [0, 2]].sum(2, keepdims=True)
        log = np.einsum("pjv,cjv->cp", seen[:, :, [0, 2]], np.log(spoken)) + np.log([prior, 1 - prior])[:, None]
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    return good


def fitted(x: np.ndarray, target: np.ndarray, steps: int = 300, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer for soft targets; features that hardly vary stay small. ``x`` is used up."""
    scale = 1 / np.maximum(x.std(0), FLOOR)
    z = x
    z *= scale.astype(np.float32)
    middle = z.mean(0)
    z -= middle
    w, bias, m, v = np.zeros(x.shape[1] + 1), 0.0, np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(z @ w[:-1].astype(np.float32) + bias, -30, 30)))
        e = (p - target) / len(target)
        g = np.append(e.astype(np.float32) @ z + penalty * w[:-1], e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step
        bias = w[-1]
    own = w[:-1] * scale
    return own, float(bias - (middle * w[:-1]).sum())


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    #: P(good) by vote pattern, as text.
    patterns: dict[str, float]

    def score(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The score of each text: P(good) by the scorer; 0 for texts without words."""
        bucket, doc, weight = features(data, starts, len(self.weights))
        z = np.bincount(doc, self.weights[bucket] * weight, len(starts) - 1) + self.bias
        empty = np.diff(words(data, starts).at) == 0
        return np.where(empty, 0.0, 1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _pattern(rows: np.ndarray) -> list[str]:
    return ["".join("-0+"[v + 1] for v in row) for row in rows.tolist()]


def fit(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Votes of all documents, posteriors of their patterns, and the scorer."""
    docs = documents(df, id_col, text_col)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch):
                yield pa.record_batch([pa.array(_pattern(votes(*flat(batch.column(1)[a:b]))), pa.string())], ["pattern"])

    counted = {r[0]: r[1] for r in docs.mapInArrow(vote, "pattern string").groupBy("pattern").count().collect()}
    names = sorted(counted)
    rows = np.array([["-0+".index(c) - 1 for c in x] for x in names], np.int8).reshape(len(names), len(HEURISTICS))
    good = dict(zip(names, posteriors(rows, np.array([counted[x] for x in names], float), settings).tolist(), strict=True))

    # the sample by the hash of ids: the same rows in any order, at most fit_rows of them
    total = sum(counted.values())
    sampled = total > settings.fit_rows
    picked = docs.filter(about(settings.fit_rows, total, "doc_id", F.lit("fit"))) if sampled else docs

    def example(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch):
                data, starts = flat(batch.column(1)[a:b])
                bucket, doc, weight = features(data, starts, settings.buckets)
                x = np.bincount(doc * settings.buckets + bucket, weight, (b - a) * settings.buckets).reshape(b - a, -1)
                target = [good[p] for p in _pattern(votes(data, starts))]
                full = np.diff(words(data, starts).at) > 0
                # half precision: a share of a text needs no more, and the driver holds all examples
                rows = [x.astype("<f2").tobytes() for x in x[full]]
                yield pa.record_batch([pa.array(rows, pa.binary()), pa.array(np.array(target)[full])], ["x", "target"])

    found = picked.mapInArrow(example, "x binary, target double").limit(2 * settings.fit_rows).toArrow()
    if not found.num_rows:
        if sampled and docs.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).limit(1).count():
            raise RuntimeError("no example to fit the scorer to: ids that most rows share cannot be sampled by")
        return Model(np.zeros(settings.buckets), 0.0, good)
    x = flat(found.column(0).combine_chunks())[0].view("<f2").reshape(found.num_rows, settings.buckets).astype(np.float32)
    target = np.asarray(found.column(1))
    if not ((target >= 0.5).any() and (target < 0.5).any()):
        return Model(np.zeros(settings.buckets), float(np.where(target.mean() >= 0.5, 3, -3)), good)
    return Model(*fitted(x, target), good)


def score(df: DataFrame, model: Model, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` (P(good) by the scorer), ``posterior`` (by the votes alone) and ``keep`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch):
                data, starts = flat(batch.column(1)[a:b])
                found = model.score(data, starts)
                weak = [model.patterns.get(p, 0.5) for p in _pattern(votes(data, starts))]
                yield pa.record_batch(
                    [batch.column(0)[a:b], pa.array(found), pa.array(weak, pa.float64()), pa.array(found >= settings.threshold)], ["doc_id", "score", "posterior", "keep"]
                )

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, score double, posterior double, keep boolean")


def kept(df: DataFrame, model: Model, settings: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """The rows whose text the scorer keeps, with all their columns, whatever these are; nothing is shuffled."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in parts(batch.column(at)):
                yield batch[a:b].filter(pa.array(model.score(*flat(batch.column(at)[a:b])) >= settings.threshold))

    return df.mapInArrow(run, df.schema)
