"""The stages of the corpus pipeline. Each works on all rows of its predecessor; all but the last return the columns of documents.

The classifiers and the removal of repeats decide row by row and carry all columns; only near-duplicates go by id, where a null id
stays. Null texts count as empty ones. Rows that share an id are one document for the near-duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.llm import jaccard, packing, quality, suffix_tree, toxicity
from assayer.llm.common import ready
from assayer.llm.registered import vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps."""
    ready(spark)
    return quality.kept(docs, quality.fit(docs))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the model learns from the labels of documents that are still there."""
    labels = ready(spark).read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return toxicity.kept(docs, toxicity.fit(docs, labels))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id. Texts without words are no duplicates."""
    ready(spark)
    others = jaccard.join(docs).filter("component_id <> doc_id").select(F.col("doc_id").alias("_other")).distinct()
    return docs.join(others, F.col("doc_id") == F.col("_other"), "left_anti")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words that repeat an earlier document's passage of 13 words or more; other texts stay as they are."""
    ready(spark)
    columns = docs.columns
    kept = suffix_tree.deduplicated(docs, carry=columns)
    # the carried columns are taken by position: their names may equal the operator's own
    kept = kept.toDF("_id", "_words", "_removed", "_spans", "_kept", *columns)
    changed = F.col("_removed") > 0
    text = F.when(changed, F.col("_kept")).otherwise(F.col("text"))
    out = {c: F.col(c) for c in columns} | {"text": text}
    if "n_chars" in columns:
        out["n_chars"] = F.when(changed, F.length("_kept").cast("long")).otherwise(F.col("n_chars"))
    return kept.select(*(out[c].alias(c) for c in columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the documents' texts, sized by their tokens; an empty table gives no rows."""
    ready(spark)
    return packing.pack_documents(docs, vocabulary=vocabulary("byte_bpe_50k.json"))
