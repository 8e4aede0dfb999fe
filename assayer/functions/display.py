"""Numbers, dates, names and descriptions as text (column in, column out)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from assayer.functions.fixed import REPORT_SENSITIVE_KEYWORDS
from assayer.functions.naming import contains_any

KB, MB, GB, TB = 1024, 1024**2, 1024**3, 1024**4


def thousands(n: Column) -> Column:
    return F.format_number(n.cast("bigint"), 0)


def _plain_text(x: Column) -> Column:
    """A double's shortest digits without exponent, for magnitudes from 1e-4 to 1e16."""
    return F.regexp_replace(x.cast("string").cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")


def fixed(x: Column, digits: int = 2) -> Column:
    """Fixed-point text of the double's exact binary value; only exact ties go to the even digit.

    Shortest digits that look like a tie (2.675) mostly lie a little beside it (2.67499...). Which side, the remainder of x
    times a power of ten tells: split in two halves, its products are exact.
    """
    x = x.cast("double")
    scale = float(10 ** (digits + 1))
    tie = _plain_text(x).rlike(rf"\.\d{{{digits}}}5$") & F.abs(x).between(1e-4, 1e11)
    large = x * F.lit(134217729.0)  # 2**27 + 1
    high = large - (large - x)
    beside = (high * scale - F.rint(x * scale)) + (x - high) * scale
    step = F.signum(beside) * F.lit(10.0 ** -(digits + 3))
    moved = F.when(tie & (beside != 0), x + step).otherwise(x)
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", F.bround(moved, digits)))


def number_text(x: Column) -> Column:
    """A double without exponent, with all its digits: ``10000000.0``, ``0.05``."""
    plain = _plain_text(x)
    return F.when(x.isNull(), None).when(F.abs(x).between(1e-4, 1e16) | (x == 0), plain).otherwise(x.cast("string"))


def size_text(n: Column) -> Column:
    return (
        F.when(n < KB, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < MB, F.concat(fixed(n / KB), F.lit(" KB")))
        .when(n < GB, F.concat(fixed(n / MB), F.lit(" MB")))
        .otherwise(F.concat(fixed(n / GB), F.lit(" GB")))
    )


def parse_timestamp(raw: Column) -> Column:
    """A timestamp from ISO text (with or without ``Z``) or from epoch seconds written as text; null if neither."""
    epoch = F.when(raw.rlike(r"^-?\d+(\.\d+)?$"), F.timestamp_seconds(raw.try_cast("double")))
    return F.coalesce(epoch, F.try_to_timestamp(raw))


def utc(ts: Column) -> Column:
    """The instant as UTC wall time, whatever zone the session shows."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))


def minute_text(ts: Column) -> Column:
    return F.concat(F.date_format(utc(ts), "yyyy-MM-dd HH:mm"), F.lit(" UTC"))


def second_text(ts: Column) -> Column:
    """ISO 8601 to the second, in UTC."""
    return F.date_format(utc(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_text(raw: Column) -> Column:
    """ISO 8601 in UTC with a ``Z``; text that is no timestamp is kept as it is."""
    ts = utc(parse_timestamp(raw))
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return (
        F.when(raw.endswith("Z"), raw)
        .when(ts.isNull(), raw)
        .when(micros == "000000", F.concat(whole, F.lit("Z")))
        .otherwise(F.concat(whole, F.lit("."), micros, F.lit("Z")))
    )


def title_case(name: Column) -> Column:
    """Every run of letters starts with a capital, also after a digit; underscores read as blanks."""
    runs = F.regexp_extract_all(F.translate(name, "_", " "), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def plural(n: Column, word: str) -> Column:
    return F.when(n == 1, F.lit(word)).otherwise(F.lit(word + "s"))


def table_description(system: str, table_id: Column, table_type: Column, row_count: Column, column_count: Column) -> Column:
    """The stand-in description of a table that has none."""
    kind = F.when(F.length(table_type) > 0, F.lower(table_type)).otherwise(F.lit("table"))
    head = F.concat(F.lit(f"{system} "), kind, F.lit(" '"), table_id, F.lit("'"))
    columns = F.when(column_count > 0, F.concat(F.lit("with "), column_count.cast("string"), F.lit(" "), plural(column_count, "column")))
    rows = F.when(row_count >= 0, F.concat(F.lit("containing "), thousands(row_count), F.lit(" "), plural(row_count, "row")))
    return F.concat(F.concat_ws(" ", head, columns, rows), F.lit("."))


def column_description(name: Column, data_type: Column, mode: Column) -> Column:
    """The stand-in description of a column that has none, worded by its mode."""
    kind = F.lower(data_type)
    readable = F.concat(title_case(name), F.lit(" - "))
    capital = F.concat(F.upper(F.substring(kind, 1, 1)), F.substr(kind, F.lit(2)))
    return (
        F.when(F.lower(mode) == "repeated", F.concat(readable, F.lit("Array of "), kind, F.lit(" values")))
        .when(F.lower(mode) == "required", F.concat(readable, F.lit("Required "), kind, F.lit(" field")))
        .otherwise(F.concat(readable, capital, F.lit(" field")))
    )


def is_report_sensitive(name: Column) -> Column:
    return contains_any(name, REPORT_SENSITIVE_KEYWORDS)


def sample_text(values: Column) -> Column:
    """At most three values of thirty characters, fifty characters in all: a table cell, not data."""
    joined = F.array_join(F.transform(F.slice(values, 1, 3), lambda v: F.substring(v, 1, 30)), ", ")
    return F.when(F.length(joined) > 50, F.concat(F.substring(joined, 1, 50), F.lit("..."))).otherwise(F.coalesce(joined, F.lit("")))


def snippet(text: Column, chars: int = 200) -> Column:
    """The opening of a hit's text, for result lists."""
    return (
        F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("...")))
        .when(F.length(text) > 0, text)
        .otherwise(F.lit("No content available"))
    )


def description_in(content: Column) -> Column:
    """The description section of a content text, else its first six plain lines."""
    section = F.trim(F.split(F.element_at(F.split(content, "## Description"), 2), "##")[0], F.lit(" \n\t\r"))
    plain = F.filter(F.split(content, "\n"), lambda line: (F.length(F.trim(line)) > 0) & ~line.startswith("#"))
    opening = F.array_join(F.slice(plain, 1, 6), "\n")
    return (
        F.when(content.contains("## Description"), section)
        .when(F.length(opening) > 0, opening)
        .otherwise(F.lit("*No description available*"))
    )
