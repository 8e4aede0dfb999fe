"""Documents in and out: JSON lines, stored catalog rows, plain text and HTML files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayer import schemas


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a JSON-lines file or folder, one row each, parsed and classified."""
    return parse_lines(spark.read.text(path))


def parse_lines(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Parse each line into the document schema and say what may be done with it.

    ``state``: ``blank`` (ignored), ``failed`` (no JSON object), ``skipped`` (no id) or ``ok``.
    """
    raw = F.col(text_col)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = lines.withColumn("_doc", F.from_json(raw, schemas.DOCUMENT + ", _corrupt string", options))
    state = (
        F.when(F.length(F.trim(raw)) == 0, "blank")
        .when(~F.ltrim(raw).startswith("{") | F.col("_doc").isNull() | F.col("_doc._corrupt").isNotNull(), "failed")
        .when(F.coalesce(F.length("_doc.id"), F.lit(0)) == 0, "skipped")
        .otherwise("ok")
    )
    return parsed.withColumn("state", state).select("*", "_doc.id", "_doc.structData", "_doc.content").drop("_doc")


def ingest_summary(parsed: DataFrame, existing_ids: DataFrame, upsert: bool = True) -> DataFrame:
    """One row: total, created, updated, failed, skipped.

    The first valid line of an unknown id creates the document; later lines update it, or are skipped
    when ``upsert`` is off. Ids are counted before the join, so a repeated id never piles up in one task.
    """
    valid = parsed.filter("state = 'ok'").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    known = existing_ids.select("id").distinct().withColumn("known", F.lit(True))
    per_id = valid.join(known, "id", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("valid"),
        F.count_if(F.col("known").isNull()).alias("created"),
    )
    others = parsed.agg(
        F.count_if(F.expr("state != 'blank'")).alias("total"),
        F.count_if(F.expr("state = 'failed'")).alias("failed"),
        F.count_if(F.expr("state = 'skipped'")).alias("no_id"),
    )
    counted = others.withColumn("_v", per_id.select(F.struct("valid", "created")).scalar())
    repeats = F.col("_v.valid") - F.col("_v.created")
    return counted.select(
        "total",
        F.col("_v.created").alias("created"),
        (repeats if upsert else F.lit(0).cast("bigint")).alias("updated"),
        "failed",
        (F.col("no_id") if upsert else F.col("no_id") + repeats).alias("skipped"),
    )


def read_files(spark: SparkSession, path: str, html: bool = False) -> DataFrame:
    """Whole text or HTML files as documents; the file name is the id."""
    files = spark.read.text(path, wholetext=True).select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("id"), F.col("value").alias("raw")
    )
    text = html_text(F.col("raw")) if html else F.col("raw")
    title = html_title(F.col("raw")) if html else F.lit(None).cast("string")
    return files.select("id", title.alias("title"), text.alias("text"))


def html_title(html: Column) -> Column:
    return F.nullif(_unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def html_text(html: Column) -> Column:
    """Readable text of a page: scripts, styles, comments and tags out, entities back, blanks folded."""
    bare = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<title[^>]*>.*?</title>", " ")
    return F.trim(F.regexp_replace(_unescape(F.regexp_replace(bare, r"<[^>]*>", " ")), r"\s+", " "))


def _unescape(text: Column) -> Column:
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def html_links(html: Column) -> Column:
    """Targets of the links of a page, in page order."""
    return F.regexp_extract_all(html, F.lit(r"(?i)href=[\"']([^\"']*)[\"']"), F.lit(1))


def to_jsonl(documents: DataFrame) -> DataFrame:
    """One JSON line per document; null fields are left out."""
    return documents.select(F.to_json(F.struct("id", "structData", "content")).alias("value"))


def write_jsonl(documents: DataFrame, path: str) -> None:
    to_jsonl(documents).write.mode("errorifexists").text(path)
