"""Free-text requests: structured filters out of the text, the rest for ranking.

Works on a whole table of request texts; every step is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.fixed import NUMERIC_FILTER_KEYWORDS, UNIT_BYTES

# Filter patterns that accept a blank between the word and its value, anywhere in a word.
LOOSE = {
    "project_id": r"(?i)(?:project|proj)[\s:=]+['\"]?([a-zA-Z0-9_-]+)['\"]?",
    "dataset_id": r"(?i)(?:dataset|db)[\s:=]+['\"]?([a-zA-Z0-9_-]+)['\"]?",
    "has_pii": r"(?i)(?:has )?pii|contains pii|pii data",
    "has_phi": r"(?i)(?:has )?phi|contains phi|phi data",
    "environment": r"(?i)(?:environment|env)[\s:=]+['\"]?(prod|staging|dev)['\"]?",
    "team": r"(?i)(?:team|owner)[\s:=]+['\"]?([a-zA-Z0-9_-]+)['\"]?",
}

# Whole words only, and a value needs a colon or an equals sign before it.
STRICT = {
    "project_id": r"(?i)\b(?:project|proj)\s*[:=]\s*['\"]?([a-zA-Z0-9_-]+)['\"]?",
    "dataset_id": r"(?i)\b(?:dataset|db)\s*[:=]\s*['\"]?([a-zA-Z0-9_-]+)['\"]?",
    "has_pii": r"(?i)\b(?:contains pii|has pii|pii data|pii)\b",
    "has_phi": r"(?i)\b(?:contains phi|has phi|phi data|phi)\b",
    "environment": r"(?i)\b(?:environment|env)\s*[:=]\s*['\"]?(prod|staging|dev)\b['\"]?",
    "team": r"(?i)\b(?:team|owner)\s*[:=]\s*['\"]?([a-zA-Z0-9_-]+)['\"]?",
}

_NUMBER = r"\s*([><]=?|=)\s*\$?([0-9.]+)\s*(GB|MB|KB)?"


def parse(requests: DataFrame, text: str, strict: bool = True) -> DataFrame:
    """Requests with their filters (null where absent), numeric conditions and ``semantic_query``."""
    patterns = STRICT if strict else LOOSE
    out = requests.withColumn("_rest", F.col(text))
    for name, regex in patterns.items():
        out = _take_flag(out, text, name, regex) if name.startswith("has_") else _take_value(out, text, name, regex)
    for name, words in NUMERIC_FILTER_KEYWORDS.items():
        out = _take_number(out, name, words, strict)
    return out.withColumn("semantic_query", F.trim(F.regexp_replace("_rest", r"\s+", " "))).drop("_rest")


def _take_value(df: DataFrame, text: str, name: str, regex: str) -> DataFrame:
    """The first match's value; its matched text leaves the rest wherever it occurs."""
    whole, value = F.regexp_extract(text, regex, 0), F.regexp_extract(text, regex, 1)
    if name == "environment":
        value = F.lower(value)
    return df.withColumns({
        name: F.nullif(value, F.lit("")),
        "_rest": F.when(F.length(whole) > 0, F.replace("_rest", whole, F.lit(""))).otherwise(F.col("_rest")),
    })


def _take_flag(df: DataFrame, text: str, name: str, regex: str) -> DataFrame:
    found = F.col(text).rlike(regex)
    return df.withColumns({
        name: F.when(found, F.lit(True)),
        "_rest": F.when(found, F.regexp_replace("_rest", regex, "")).otherwise(F.col("_rest")),
    })


def _take_number(df: DataFrame, name: str, words: list[str], strict: bool) -> DataFrame:
    """The first keyword that has a condition gives operator and value; units count in bytes."""
    rest = F.col("_rest")
    bound = r"\b" if strict else ""
    match: Column = F.lit("")
    for word in reversed(words):
        here = F.regexp_extract(rest, rf"(?i){bound}{word}{_NUMBER}", 0)
        match = F.when(F.length(here) > 0, here).otherwise(match)
    df = df.withColumn("_match", match)
    taken = F.col("_match")
    unit = F.upper(F.regexp_extract(taken, rf"(?i){_NUMBER}", 3))
    factor = F.lit(1.0)
    for u, size in UNIT_BYTES.items():
        factor = F.when(unit == u, size).otherwise(factor)
    value = F.regexp_extract(taken, _NUMBER, 2).try_cast("double") * factor
    return df.withColumns({
        f"{name}_op": F.nullif(F.regexp_extract(taken, _NUMBER, 1), F.lit("")),
        f"{name}_value": F.when(F.length(taken) > 0, value),
        "_rest": F.when(F.length(taken) > 0, F.replace("_rest", taken, F.lit(""))).otherwise(rest),
    }).drop("_match")
