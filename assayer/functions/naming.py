"""Names of assets: three-part ids, fully qualified names and document ids (column in, column out)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def asset_id(project: Column, dataset: Column, table: Column) -> Column:
    return F.concat_ws(".", project, dataset, table)


def table_fqn(scheme: str, project: Column, dataset: Column, table: Column) -> Column:
    return F.concat(F.lit(f"{scheme}:"), asset_id(project, dataset, table))


def file_fqn(scheme: str, bucket: Column, path: Column) -> Column:
    """``scheme://bucket/path`` with any leading slashes of the path dropped."""
    return F.concat(F.lit(f"{scheme}://"), bucket, F.lit("/"), F.regexp_replace(path, "^/+", ""))


def strip_scheme(fqn: Column) -> Column:
    """Drop a ``scheme:`` prefix, keeping ``scheme://`` file names whole."""
    return F.regexp_replace(fqn, r"^[A-Za-z][A-Za-z0-9+]*:(?!//)", "")


def scan_id(dataset: Column, table: Column) -> Column:
    return F.lower(F.translate(F.concat(F.lit("profile-"), dataset, F.lit("-"), table), "_", "-"))


def document_key(doc_id: Column) -> Column:
    """The id form document stores accept; dots become underscores, so two ids may collide."""
    return F.replace(doc_id, F.lit("."), F.lit("_"))


def run_id(run_timestamp: Column) -> Column:
    """A run's folder name: its start in UTC, to the second."""
    wall = F.convert_timezone(F.current_timezone(), F.lit("UTC"), run_timestamp.cast("timestamp_ntz"))
    return F.date_format(wall, "yyyyMMdd'T'HHmmss")


def report_path(run: Column | None, project: Column, dataset: Column, table: Column) -> Column:
    """Where an asset's report lies below the reports' root; the same for the report's row, its folder and a hit."""
    parts = [F.concat(F.lit(f"{name}="), c) for name, c in (("run", run), ("project_id", project), ("dataset_id", dataset), ("table_id", table)) if c is not None]
    return F.concat_ws("/", *parts)


def contains_any(name: Column, words: list[str]) -> Column:
    lowered = F.lower(name)
    return reduce(lambda a, b: a | b, [lowered.contains(w) for w in words], F.lit(False))


def asset_type(table_type: Column) -> Column:
    """Views keep their type; external and unknown types count as tables."""
    return F.when(table_type.isin("VIEW", "MATERIALIZED_VIEW"), table_type).otherwise(F.lit("TABLE"))


def table_type_or_default(table_type: Column, asset: Column) -> Column:
    def filled(c: Column) -> Column:
        return F.when(F.length(c) > 0, c)

    return F.coalesce(filled(table_type), filled(asset), F.lit("TABLE"))
