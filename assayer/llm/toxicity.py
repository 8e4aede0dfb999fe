"""Operator 3: toxicity by multiple-instance learning.

A document is a bag of sentences and only the document has a label. Each sentence gets a score from hashed words; a document is
toxic if any sentence is, so the scores are combined by noisy-or, 1 - prod(1 - p). Training sends the document's error back to
its sentences through that product; afterwards the sentences with a high score are the places to look at.

Labels are learnt only from rows that ``held_out`` leaves; at most ``Settings.fit_rows`` of them, taken by the hash of their ids. Scoring covers every
whole text. A score depends on the text alone; language, source and id never count.

Null and empty texts have no sentence and score 0. Equal texts have equal scores. Without a label of either class every score is
0. Labels that are null, or whose id is null or has no document, teach nothing; an id with several labels takes the largest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayer.llm.common import about, chunks, documents, flat, held_out, mixed, parts
from assayer.llm.words import LOWER, Hashes, lookup, words

#: Words are runs of letters, digits and bytes beyond ASCII; a sentence ends at one of these.
SEPARATOR = ~lookup(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))
STOP = lookup(".!?\n")
#: Bytes of the beginnings of words that count besides the words.
BEGINNINGS = (3, 4, 5, 6)


@dataclass(frozen=True)
class Settings:
    #: Most labelled documents that the model is fitted to.
    fit_rows: int = 16_000
    #: Words are hashed into 2 ** bits buckets.
    bits: int = 20
    #: A word counts if so many documents of the sample have it.
    least_documents: int = 3
    #: Standard errors by which toxic documents must have a word more often.
    least_z: float = 2.5
    #: Least log odds between toxic and clean documents.
    least_odds: float = 1.2
    epochs: int = 250
    penalty: float = 1e-4
    threshold: float = 0.3


def sentences(data: np.ndarray, starts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words and their beginnings, where each sentence's words begin, each sentence's document, and byte ranges of sentences."""
    found = words(data, starts, SEPARATOR)
    hashes = Hashes(LOWER[data])
    names = hashes.of(found.start, found.end)
    # a sentence begins at a document's first word and after a stop
    stops = np.concatenate([[0], np.cumsum(STOP[data])])
    first = np.ones(len(names), bool)
    first[1:] = (found.doc[1:] != found.doc[:-1]) | (stops[found.start[1:]] > stops[found.end[:-1]])
    at = np.flatnonzero(first)
    ends = found.end[np.append(at[1:], len(names)) - 1] if len(at) else at
    size = found.end - found.start
    # a word counts by itself and by its beginnings; a shorter word's beginning is the word
    parts = [names, *(hashes.of(found.start, found.start + np.minimum(size, n)) ^ np.uint64(n << 40) for n in BEGINNINGS)]
    buckets = np.stack([mixed(x) >> np.uint64(64 - bits) for x in parts], 1).astype(np.int64)
    return buckets.ravel(), np.append(at, len(names)) * len(parts), found.doc[at], np.stack([found.start[at], ends], 1) if len(at) else np.zeros((0, 2), np.int64)


def noisy_or(p: np.ndarray, bag: np.ndarray, n: int) -> np.ndarray:
    """1 - prod(1 - p) of each bag; 0 for an empty one."""
    return -np.expm1(np.bincount(bag, np.log1p(-np.minimum(p.astype(float), 1 - 1e-9)), n))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bits: int

    def sentence_scores(self, buckets: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(at) < 2:
            return np.zeros(0)
        hit = np.flatnonzero(self.weights[buckets])
        # a word counts once in a sentence
        both = np.unique((np.searchsorted(at, hit, "right") - 1) * len(self.weights) + buckets[hit])
        z = np.bincount(both // len(self.weights), self.weights[both % len(self.weights)], len(at) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def score(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores of documents; of sentences, with their documents and byte ranges."""
        buckets, at, doc, spans = sentences(data, starts, self.bits)
        p = self.sentence_scores(buckets, at)
        return noisy_or(p, doc, len(starts) - 1), p, doc, spans


def chosen_buckets(counts: np.ndarray, n: np.ndarray, settings: Settings) -> np.ndarray:
    """Which buckets toxic documents have clearly more often: a test of two shares for each.

    ``counts`` has a row (clean documents with it, toxic documents with it) for each bucket, ``n`` all clean and all toxic documents.
    """
    if not n.all():
        return np.zeros(len(counts), bool)
    share = counts.sum(1) / n.sum()
    z = (counts[:, 1] / n[1] - counts[:, 0] / n[0]) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n).sum())
    return (counts.sum(1) >= settings.least_documents) & (z >= settings.least_z) & (log_odds(counts, n) >= settings.least_odds)


def log_odds(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.log((counts[:, 1] + 0.5) / (n[1] + 1)) - np.log((counts[:, 0] + 0.5) / (n[0] + 1))


def fitted(sentence: np.ndarray, bucket: np.ndarray, of: np.ndarray, n: np.ndarray, labels: np.ndarray, odds: np.ndarray, settings: Settings) -> Model:
    """A model from pairs of sentence and bucket (each once), the document of each such pair, and the documents' numbers of sentences and labels.

    Weights start at, and are drawn to, the buckets' log odds between toxic and clean documents: a document that one
    sentence explains teaches nothing about its others, so from zero some words would never be learnt.
    """
    weights = np.zeros(1 << settings.bits, np.float32)
    if not ((labels == 1).any() and (labels == 0).any()):
        return Model(weights, -40.0, settings.bits)
    chosen, place = np.unique(bucket, return_inverse=True)
    # sentences without a chosen bucket all have the same score: they are counted, not listed
    listed, first, own = np.unique(sentence, return_index=True, return_inverse=True)
    of = of[first]
    others = n - np.bincount(of, minlength=len(labels))
    start = odds[chosen] / (1 + len(BEGINNINGS))
    w = np.append(start, -7.0)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, settings.epochs + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(own, w[place], len(listed)) + w[-1], -40, 40)))
        plain = 1 / (1 + np.exp(-np.clip(w[-1], -40, 40)))
        clean = np.bincount(of, np.log1p(-np.minimum(p, 1 - 1e-9)), len(labels)) + others * np.log1p(-plain)
        total = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-9)
        # d loss / d z of a sentence: p for a clean document, -p (1 - P) / P for a toxic one
        back = np.where(labels == 1, -(1 - total) / total, 1.0)
        g = np.append(np.bincount(place, (back[of] * p)[own], len(chosen)), (back[of] * p).sum() + (back * others * plain).sum()) / len(labels)
        g[:-1] += settings.penalty * (w[:-1] - start)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    weights[chosen] = w[:-1]
    return Model(weights, float(w[-1]), settings.bits)


def fit(df: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit to the labelled documents that are not held out. Counts of buckets are added up in Spark; only chosen buckets come to the driver."""
    known = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), (labels[label_col].cast("int") > 0).cast("int").alias("label"))
        .dropna()
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    total = known.count()
    if total > settings.fit_rows:
        known = known.filter(about(settings.fit_rows, total, "doc_id", F.lit("fit")))
    # the sampled labels are at most about fit_rows small rows, a proven bound, so the texts of other documents are not moved
    docs = documents(df, id_col, text_col).filter(~held_out(F.col("doc_id")))
    picked = docs.join(F.broadcast(known), "doc_id").select("doc_id", "label", "text")
    size = 1 << settings.bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = {0: [], 1: []}, [0, 0]
        for batch in batches:
            label = np.asarray(batch.column(1))
            for a, b in chunks(batch):
                buckets, at, doc, _ = sentences(*flat(batch.column(2)[a:b]), settings.bits)
                once = np.unique(np.repeat(doc, np.diff(at)) * size + buckets)
                for y in (0, 1):
                    found[y].append(once[label[a:b][once // size] == y] % size)
                    n[y] += int((label[a:b] == y).sum())
        for y in (0, 1):
            if n[y]:
                bucket, times = np.unique(np.concatenate(found[y]), return_counts=True)
                bucket, times = np.append(bucket, size), np.append(times, n[y])
                yield pa.record_batch([pa.array(bucket), pa.array(times * (1 - y)), pa.array(times * y)], ["bucket", "clean", "toxic"])

    counted = picked.mapInArrow(count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # at most one row a bucket, whatever the input
    counted = counted.filter((F.col("clean") + F.col("toxic") >= settings.least_documents) & (F.col("toxic") > 0) | (F.col("bucket") == size)).toArrow()
    counts = np.zeros((size + 1, 2))
    counts[np.asarray(counted.column("bucket"))] = np.stack([np.asarray(counted.column("clean")), np.asarray(counted.column("toxic"))], 1).reshape(-1, 2)
    chosen = chosen_buckets(counts[:-1], counts[-1], settings)
    odds = log_odds(counts[:-1], counts[-1])

    def example(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch):
                buckets, at, doc, _ = sentences(*flat(batch.column(2)[a:b]), settings.bits)
                hit = np.flatnonzero(chosen[buckets])
                first = np.searchsorted(doc, np.arange(b - a))
                pairs = np.unique((np.searchsorted(at, hit, "right") - 1) * size + buckets[hit])
                place, of = pairs // size, doc[pairs // size] if len(doc) else pairs
                ends = np.searchsorted(of, np.arange(b - a + 1))
                rows = [
                    ((place[x:y] - f).astype("<i4").tobytes(), (pairs[x:y] % size).astype("<i4").tobytes())
                    for x, y, f in zip(ends[:-1].tolist(), ends[1:].tolist(), first.tolist(), strict=True)
                ]
                columns = [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(np.bincount(doc, minlength=b - a))]
                columns += [pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)]
                yield pa.record_batch(columns, ["doc_id", "label", "n", "sentences", "buckets"])

    found = picked.mapInArrow(example, "doc_id long, label int, n long, sentences binary, buckets binary").toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("n", "ascending"), ("buckets", "ascending")])
    n = np.asarray(found.column("n")).astype(np.int64)
    own = [np.frombuffer(x, "<i4") for x in found.column("sentences").to_pylist()]
    pairs = np.array([len(x) for x in own], np.int64)
    base = np.repeat(np.cumsum(n) - n, pairs)
    flat_own = np.concatenate([*own, np.zeros(0, np.int64)]).astype(np.int64)
    bucket = np.frombuffer(b"".join(found.column("buckets").to_pylist()), "<i4").astype(np.int64)
    return fitted(base + flat_own, bucket, np.repeat(np.arange(len(n)), pairs), n, np.asarray(found.column("label")), odds, settings)


def _broadcast(df: DataFrame, model: Model):
    """The model has a fixed size; each executor gets it once."""
    return df.sparkSession.sparkContext.broadcast(model)


def score(df: DataFrame, model: Model, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score``, ``predicted``, ``n_sentences`` and ``n_toxic`` (sentences at or over the threshold) of every whole text."""
    sent = _broadcast(df, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch):
                found, p, doc, _ = sent.value.score(*flat(batch.column(1)[a:b]))
                toxic = np.bincount(doc[p >= settings.threshold], minlength=b - a)
                yield pa.record_batch(
                    [
                        batch.column(0)[a:b],
                        pa.array(found),
                        pa.array((found >= settings.threshold).astype(np.int32)),
                        pa.array(np.bincount(doc, minlength=b - a)),
                        pa.array(toxic),
                    ],
                    ["doc_id", "score", "predicted", "n_sentences", "n_toxic"],
                )

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int, n_sentences long, n_toxic long")


def located(df: DataFrame, model: Model, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The offending sentences: ``doc_id``, ``start`` and ``end`` (UTF-8 bytes), ``sentence``, ``score``."""
    sent = _broadcast(df, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch):
                data, starts = flat(batch.column(1)[a:b])
                _, p, doc, spans = sent.value.score(data, starts)
                hit = np.flatnonzero(p >= settings.threshold)
                raw = data.tobytes()
                yield pa.record_batch(
                    [
                        batch.column(0)[a:b].take(pa.array(doc[hit])),
                        pa.array(spans[hit, 0] - starts[doc[hit]]),
                        pa.array(spans[hit, 1] - starts[doc[hit]]),
                        pa.array([raw[x:y].decode("utf-8", "replace") for x, y in spans[hit].tolist()], pa.string()),
                        pa.array(p[hit]),
                    ],
                    ["doc_id", "start", "end", "sentence", "score"],
                )

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, start long, end long, sentence string, score double")


def kept(df: DataFrame, model: Model, settings: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns, whatever these are; nothing is shuffled."""
    sent, at = _broadcast(df, model), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in parts(batch.column(at)):
                yield batch[a:b].filter(pa.array(sent.value.score(*flat(batch.column(at)[a:b]))[0] < settings.threshold))

    return df.mapInArrow(run, df.schema)
