"""A page of ranked search from a stored index that is read only where the page can come from, and that takes upserts.

Documents are laid out in lanes of ``LANE`` documents of similar length. A term's postings in a lane are one row, with the largest
count and the smallest length among them, which bound what the term can add to a document there. A query reads these figures
first, scores the most promising lanes, and then reads only the lanes whose bound reaches the last score on that page. The page
is that of a full scan; how many postings were read for it is known.

An upsert writes a segment of its own and never rewrites another one: documents that it replaces are listed, and counts of documents,
words and terms are stored as differences, so ranking uses exact figures of the live documents. A segment counts once its
row of totals is written, which comes last.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from assayer.operators.search import _idf, _weight, query_terms, tokens
from assayer.session import cut_lineage

#: Documents of a lane.
LANE = 128
#: Postings of a bucket of terms, about; each task writes a file of each bucket.
BUCKET_POSTINGS = 50_000_000
#: Scores are ranked by nine decimals, so equal documents stay in the order of their keys; bounds get some slack.
_DECIMALS, _SLACK = 9, 1e-6
_TOTALS = "segment int, buckets int, docs bigint, words bigint, blocks bigint"


@dataclass(frozen=True)
class Page:
    """Ranked hits (``rank``, key, ``score``), and how many of the query's postings were read for them."""

    hits: DataFrame
    postings_read: int
    postings: int


def _totals(spark: SparkSession, path: str) -> list:
    """One row a segment, in order."""
    try:
        return spark.read.schema(_TOTALS).parquet(f"{path}/totals").orderBy("segment").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _segments(spark: SparkSession, path: str, name: str, totals: list) -> DataFrame:
    """A table of the segments that count."""
    return spark.read.option("basePath", f"{path}/{name}").parquet(*[f"{path}/{name}/segment={t['segment']}" for t in totals])


def _lanes(rows: DataFrame) -> DataFrame:
    """Blocks ``(term, lane, key, tf, length, most, least, n)``: a term's postings in a lane as three lists, with their bounds.

    Documents of similar length share a lane, so a lane's bound is near what its documents reach. A lane lies in one task, in
    which its postings are counted; words are shuffled once, as texts, and postings not at all.
    """
    kind = rows.schema["key"].dataType.simpleString()
    rows = rows.filter("length > 0").repartitionByRange("length", "key").sortWithinPartitions("length", "key")
    rows = rows.withColumn("lane", F.floor(F.monotonically_increasing_id() / LANE))

    def block(docs: pa.Table) -> Iterator[pa.RecordBatch]:
        lists = pc.split_pattern(docs.column("words").combine_chunks(), " ")
        row = pc.list_parent_indices(lists)
        each = pa.table({"term": pc.list_flatten(lists), "key": docs.column("key").take(row), "length": docs.column("length").take(row)})
        # rows with one key are one document of the lane
        found = each.group_by(["term", "key"], use_threads=False).aggregate([([], "count_all"), ("length", "first")])
        found = found.sort_by([("term", "ascending"), ("key", "ascending")]).combine_chunks()
        term, tf, length = (found.column(c).combine_chunks() for c in ("term", "count_all", "length_first"))
        codes = np.asarray(term.dictionary_encode().indices)
        at = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        ends = pa.array(np.append(at, len(codes)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, values) for values in (found.column("key").combine_chunks(), tf, length)]
        bounds = [np.maximum.reduceat(np.asarray(tf), at), np.minimum.reduceat(np.asarray(length), at), np.diff(np.append(at, len(codes)))]
        lane = pa.array(np.full(len(at), docs.column("lane")[0].as_py()), pa.int64())
        yield pa.record_batch([term.take(pa.array(at)), lane, *lists, *(pa.array(v, pa.int64()) for v in bounds)], ["term", "lane", "key", "tf", "length", "most", "least", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the documents of the lane that is not whole yet, LANE at most
        for batch in batches:
            lane = np.asarray(batch.column("lane"))
            edges = [0, *(np.flatnonzero(lane[1:] != lane[:-1]) + 1).tolist(), len(lane)]
            for at, to in zip(edges[:-1], edges[1:], strict=True):
                if held and to > at and held[0].column("lane")[0].as_py() != lane[at]:
                    yield from block(pa.Table.from_batches(held))
                    held = []
                if to > at:
                    held.append(batch.slice(at, to - at))
        if held:
            yield from block(pa.Table.from_batches(held))

    return rows.mapInArrow(run, f"term string, lane bigint, key array<{kind}>, tf array<bigint>, length array<bigint>, most bigint, least bigint, n bigint")


def upsert(documents: DataFrame, key: str, text: str, path: str) -> int:
    """Add a segment with ``documents``, one row a key; they replace documents that the index has under the same keys. Returns the segment's number.

    A null text is a document without words. The first call makes the index.
    """
    spark = documents.sparkSession
    known = _totals(spark, path)
    segment = known[-1]["segment"] + 1 if known else 0
    folder = lambda name: f"{path}/{name}/segment={segment}"
    rows = documents.select(F.col(key).alias("key"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    # no word has a space, and a text is shuffled with less than an array
    rows = cut_lineage(rows.select("key", F.size("words").cast("bigint").alias("length"), F.array_join("words", " ").alias("words")))
    terms = F.when(F.col("length") > 0, F.array_distinct(F.split("words", " "))).otherwise(F.array().cast("array<string>"))
    rows.select("key", "length", terms.alias("terms")).write.mode("overwrite").parquet(folder("docs"))
    n_postings = rows.sparkSession.read.parquet(folder("docs")).agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    buckets = max(1, -(-n_postings // BUCKET_POSTINGS))
    # every task writes its own lanes, so a common word lies in several files; a file's terms are in order, and a query reads the pages of its words
    dealt = _lanes(rows).withColumn("bucket", F.pmod(F.crc32("term"), F.lit(buckets)).cast("int")).sortWithinPartitions("bucket", "term", "lane")
    dealt = dealt.select("term", "lane", F.arrays_zip("key", "tf", "length").alias("postings"), "most", "least", "n", "bucket")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(folder("blocks"))
    blocks = spark.read.schema("term string, n bigint").parquet(folder("blocks")) if n_postings else dealt
    n_blocks = blocks.count()
    change = blocks.groupBy("term").agg(F.sum("n").alias("df"))
    docs, words = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    if known:
        own = spark.read.parquet(folder("docs")).select("key")
        replaced = _segments(spark, path, "replaced", known).select("key", F.col("of").alias("segment"))
        old = _segments(spark, path, "docs", known).join(replaced, ["key", "segment"], "left_anti")
        gone = cut_lineage(old.join(own, "key", "left_semi").select("key", "segment", "length", "terms"))
        lost, lost_words = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        docs, words = docs - lost, words - lost_words
        change = change.union(gone.select(F.explode("terms").alias("term"), F.lit(-1).cast("bigint").alias("df"))).groupBy("term").agg(F.sum("df").alias("df"))
        # every list of replaced documents names the segment that held them
        gone = gone.select("key", F.col("segment").alias("of"))
    else:
        gone = rows.select("key", F.lit(0).alias("of")).limit(0)
    gone.write.mode("overwrite").parquet(folder("replaced"))
    change.sort("term").write.mode("overwrite").parquet(folder("terms"))
    spark.createDataFrame([(segment, buckets, docs, words, n_blocks)], _TOTALS).coalesce(1).write.mode("append").parquet(f"{path}/totals")
    return segment


def page(spark: SparkSession, path: str, query: str, key: str, k: int = 10) -> Page:
    """The ``k`` live documents with the highest BM25 score for the query's words, ties by key."""
    terms, totals = query_terms(query), _totals(spark, path)
    if not totals:
        raise ValueError(f"{path} has no index")
    n, words = float(sum(t["docs"] for t in totals)), sum(t["words"] for t in totals)
    found = _segments(spark, path, "terms", totals).filter(F.col("term").isin(terms)).groupBy("term").agg(F.sum("df").alias("df")).collect()
    counts = {r["term"]: r["df"] for r in found if r["df"] > 0}  # at most one row a word of the query
    if not counts:
        kind = _segments(spark, path, "docs", totals).schema["key"].dataType.simpleString()
        return Page(spark.createDataFrame([], f"rank int, {key} {kind}, score double"), 0, 0)
    idf = F.create_map(*[x for t, df in counts.items() for x in (F.lit(t), _idf(F.lit(n), F.lit(float(df))))])
    average = F.lit(words / n if n else 1.0)

    def adds(tf: str, length: str):
        return idf[F.col("term")] * _weight(F.col(tf).cast("double"), F.col(length).cast("double"), average)

    own = [(t["segment"], sorted({zlib.crc32(w.encode()) % t["buckets"] for w in counts})) for t in totals]
    place = F.lit(False)
    for segment, buckets in own:
        place = place | ((F.col("segment") == segment) & F.col("bucket").isin(buckets))
    blocks = _segments(spark, path, "blocks", [t for t in totals if t["blocks"]])
    blocks = blocks.filter(place & F.col("term").isin(list(counts)))
    lanes = blocks.select("segment", "lane", "term", "n", adds("most", "least").alias("bound")).groupBy("segment", "lane").agg(F.sum("bound").alias("bound"), F.sum("n").alias("n"))
    lanes = cut_lineage(lanes)
    replaced = _segments(spark, path, "replaced", totals).select("key", F.col("of").alias("segment"))

    def scored(chosen: DataFrame) -> DataFrame:
        read = blocks.join(chosen.select("segment", "lane"), ["segment", "lane"], "left_semi").select("segment", "term", F.inline("postings"))
        live = read.join(replaced, ["key", "segment"], "left_anti")
        sums = live.withColumn("part", adds("tf", "length")).groupBy("key").agg(F.sum("part").alias("score"))
        return sums.withColumn("score", F.round("score", _DECIMALS)).orderBy(F.desc("score"), "key").limit(k)

    # lanes that hold the most promising documents, enough for a page
    first = scored(lanes.orderBy(F.desc("bound"), "segment", "lane").limit(max(4, 2 * math.ceil(k / 8)))).collect()
    reach = first[-1]["score"] - _SLACK if len(first) == k else -math.inf
    chosen = lanes.filter(F.col("bound") >= reach)
    read, every = lanes.agg(F.sum(F.when(F.col("bound") >= reach, F.col("n"))), F.sum("n")).first()
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "key"))  # k rows
    hits = scored(chosen).withColumn("rank", rank).select("rank", F.col("key").alias(key), "score")
    return Page(hits, read or 0, every or 0)
