"""Readable output of a catalog row: searchable content text and the Markdown report.

Both are column expressions over the nested catalog row, so a million reports are one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions import display as d
from assayer.functions.cost import cost_per_gb
from assayer.functions.naming import report_path, run_id
from assayer.operators.quality import status

NL = "\n"


def _col(df: DataFrame, name: str, kind: str = "string") -> Column:
    """The column, or a typed null when the catalog at hand does not carry it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _t(*parts: Column | str) -> Column:
    """Concatenation; null if any part is null, so an optional line vanishes with its value."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _lines(*lines: Column | str | None) -> Column:
    """Lines that are not null, one per row of text."""
    return F.concat_ws(NL, *[F.lit(x) if isinstance(x, str) else x for x in lines if x is not None])


def _each(items: Column, line) -> Column:
    """One line per array element; null for an empty or missing array."""
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, line), NL))


def _numbered(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x, i: _t(i + 1, ". ", x)), NL))


def _positive(c: Column) -> Column:
    return F.when(c > 0, c)


def _money(c: Column) -> Column:
    return _t("$", d.fixed(c))


def _number_or_na(text: Column) -> Column:
    """Two decimals for a number held as text; ``N/A`` for none."""
    return F.when(F.length(text) > 0, d.fixed(text.try_cast("double"))).otherwise(F.lit("N/A"))


def _profiles(kind: str, most: int | None = None) -> Column:
    chosen = F.filter("column_profiles", lambda p: p["profile_type"] == kind)
    return F.slice(chosen, 1, most) if most else chosen


_DETAILS = (
    "array<struct<column_name:string,profile_type:string,null_count:bigint,null_percentage:double,"
    "distinct_count:bigint,min_length:bigint,max_length:bigint>>"
)


def _strings(catalog: DataFrame) -> Column:
    return F.filter(_col(catalog, "profile_details", _DETAILS), lambda p: p["profile_type"] == "string")


def _by_name(profiles: Column) -> Column:
    return F.array_sort(profiles, lambda a, b: F.when(a["column_name"] < b["column_name"], -1).when(a["column_name"] > b["column_name"], 1).otherwise(0))


def _by_null_share(profiles: Column) -> Column:
    """Highest null share first; equal shares keep column order (the index breaks the tie)."""
    indexed = F.transform(profiles, lambda p, i: F.struct((-p["null_percentage"]).alias("k"), i.alias("i"), p.alias("p")))
    return F.transform(F.array_sort(indexed, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(a["i"] - b["i"])), lambda s: s["p"])


def _sources() -> Column:
    own = F.concat_ws(".", "project_id", "dataset_id", "table_id")
    return F.transform(F.filter("lineage", lambda e: e["target"] == own), lambda e: e["source"])


def _consumers() -> Column:
    own = F.concat_ws(".", "project_id", "dataset_id", "table_id")
    return F.transform(F.filter("lineage", lambda e: e["source"] == own), lambda e: e["target"])


def _beyond(names: Column, total: Column) -> Column:
    """A line for names that only the edge table holds."""
    return F.when(total > F.size(names), _t("- ... and ", total - F.size(names), " more in the edge table"))


# --- content text -----------------------------------------------------------------------------


def content_text(catalog: DataFrame) -> Column:
    """The text a search index stores for an asset: every section that has something to say."""
    c = lambda name, kind="string": _col(catalog, name, kind)
    title = _lines(
        _t("# ", F.col("dataset_id"), ".", F.col("table_id")), "",
        _t("**Type**: ", F.col("table_type")), _t("**Dataset**: ", F.col("dataset_id")), _t("**Project**: ", F.col("project_id")),
    )
    statistics = _lines(
        "", "## Statistics",
        _t("- **Rows**: ", d.thousands(_positive(F.col("row_count")))),
        _t("- **Size**: ", d.fixed(_positive(F.col("size_bytes")) / d.GB), " GB"),
        _t("- **Columns**: ", _positive(F.col("column_count"))),
        _t("- **Last Modified**: ", d.second_text(F.col("last_modified"))),
    )
    described = F.when(F.length("description") > 0, _lines("", "## Description", F.col("description")))

    def field_line(f: Column) -> Column:
        meaning = F.when(F.length(f["description"]) > 0, _t(": ", f["description"])).otherwise(F.lit(""))
        quoted = F.array_join(F.transform(f["sample_values"], lambda v: _t("'", v, "'")), ", ")
        examples = F.when(F.size(f["sample_values"]) > 0, _t(" — Examples: ", quoted)).otherwise(F.lit(""))
        return _t("- **", f["name"], "** (", f["type"], ", ", f["mode"], ")", meaning, examples)

    schema = F.when(F.size("schema") > 0, _lines("", "## Schema", _each(F.col("schema"), field_line)))

    with_nulls = F.filter(F.slice(_by_null_share(F.col("column_profiles")), 1, 10), lambda p: p["null_percentage"] > 0)
    numeric = _each(_profiles("numeric", 10), lambda p: _t(
        "- **", p["column_name"], "**: min=", p["min_value"], ", max=", p["max_value"],
        ", avg=", _number_or_na(p["avg_value"]), ", distinct=", d.thousands(F.coalesce(p["distinct_count"], F.lit(0))),
    ))
    strings = _each(F.slice(_strings(catalog), 1, 10), lambda p: _t(
        "- **", p["column_name"], "**: length=", F.coalesce(p["min_length"].cast("string"), F.lit("None")), "-",
        F.coalesce(p["max_length"].cast("string"), F.lit("None")), ", distinct=", d.thousands(F.coalesce(p["distinct_count"], F.lit(0))),
    ))
    completeness = c("completeness_score", "double")
    quality = F.when(F.size("column_profiles") > 0, _lines(
        "", "## Data Quality", "", "### Null Statistics (Top 10 columns by null %)",
        _each(with_nulls, lambda p: _t("- **", p["column_name"], "**: ", d.fixed(p["null_percentage"], 1), "% null")),
        "", "### Column Profiles",
        F.when(numeric.isNotNull(), _lines("", "**Numeric Columns:**", numeric)),
        F.when(strings.isNotNull(), _lines("", "**String Columns:**", strings)),
        _t("- **Completeness**: ", d.fixed(_positive(completeness) * 100, 1), "%"),
    ))
    lineage = _lines(
        "", "## Lineage", "", "**Upstream Sources:**",
        F.coalesce(_each(_sources(), lambda n: _t("- ", n)), F.lit("- *No upstream sources found*")),
        _beyond(_sources(), c("upstream_total", "bigint")),
        "", "**Downstream Consumers:**",
        F.coalesce(_each(_consumers(), lambda n: _t("- ", n)), F.lit("- *No downstream dependencies found*")),
        _beyond(_consumers(), c("downstream_total", "bigint")),
    )
    governance = _lines(
        "", "## Governance",
        F.when(F.col("has_pii"), F.lit("- **Classification**: Contains PII data")),
        F.when(F.col("has_phi"), F.lit("- **Classification**: Contains PHI data")),
        _t("- **Owner**: ", c("owner_email")), _t("- **Team**: ", c("team")),
        F.when(F.size("labels") > 0, _t("- **Labels**: ", F.array_join(F.transform("labels", lambda x: _t(x["key"], "=", x["value"])), ", "))),
    )
    total = c("monthly_cost_usd", "double")
    cost = F.when(total.isNotNull(), _lines(
        "", "## Cost",
        _t("- **Storage**: ", _money(_positive(c("storage_cost_usd", "double"))), "/month"),
        _t("- **Queries**: ", _money(_positive(c("query_cost_usd", "double"))), "/month"),
        _t("- **Total**: ", _money(_positive(total)), "/month"),
    ))
    insights = F.when(F.size("analytical_insights") > 0, _lines(
        "", "## Analytical Insights", "", "Questions that could be answered using this table:", _numbered(F.col("analytical_insights")),
    ))
    return _lines(title, statistics, described, schema, quality, lineage, governance, cost, insights)


# --- Markdown report --------------------------------------------------------------------------


def _table(header: list[str], rows: Column) -> Column:
    head = "| " + " | ".join(header) + " |"
    rule = "|" + "|".join("-" * (len(h) + 2) for h in header) + "|"
    return _lines(head, rule, rows)


def _row(*cells: Column | str) -> Column:
    parts: list[Column | str] = ["| "]
    for i, cell in enumerate(cells):
        parts += [" | ", cell] if i else [cell]
    return _t(*parts, " |")


def _first_ten(names: Column, none: str, total: Column) -> Column:
    """Ten names and how many more there are; ``total`` counts names beyond those kept inline, if it is known."""
    known = F.coalesce(total, F.size(names))
    more = F.when(known > 10, _t("- *... and ", known - 10, " more*"))
    shown = F.when(F.size(names) > 0, _lines(_each(F.slice(names, 1, 10), lambda n: _t("- `", n, "`")), more))
    return F.coalesce(shown, F.lit(none))


def markdown(catalog: DataFrame) -> Column:
    """The full report of a catalog row; sections without data are left out or say so."""
    c = lambda name, kind="string": _col(catalog, name, kind)
    environment = F.coalesce(F.nullif("environment", F.lit("")), F.lit("unknown"))
    cost = c("monthly_cost_usd", "double")
    volatility = c("volatility")

    badges = F.concat_ws(
        " | ", _t("[", F.upper("table_type"), "]"), F.when(F.col("has_pii"), F.lit("[PII]")),
        F.when(F.col("has_phi"), F.lit("[PHI]")), _t("[", F.upper(environment), "]"),
    )
    header = _lines(_t("# ", F.col("dataset_id"), ".", F.col("table_id")), "", badges)

    facts = F.concat_ws(
        " - ", _t("**", d.thousands(_positive(F.col("row_count"))), "** rows"), _t("**", d.size_text(_positive(F.col("size_bytes"))), "**"),
        _t("**", _positive(F.col("column_count")), "** columns"), _t("**", _money(_positive(cost)), "/month**"),
    )
    summary = _lines(
        "## Executive Summary", "", F.when(F.length(facts) > 0, _lines(facts, "")),
        _t("**Owner**: ", c("owner_email")), _t("**Team**: ", c("team")),
        _t("**Last Modified**: ", d.minute_text(F.col("last_modified"))),
    )
    metrics = _lines("## Key Metrics", "", _table(["Metric", "Value"], _lines(
        _row("Row Count", d.thousands(F.col("row_count"))), _row("Size", d.size_text(F.col("size_bytes"))),
        _row("Columns", F.col("column_count")), _row("Created", d.minute_text(F.col("created"))),
        _row("Last Modified", d.minute_text(F.col("last_modified"))), _row("Last Accessed", d.minute_text(F.col("last_accessed"))),
        _row("Volatility", F.upper(volatility)), _row("Cache TTL", c("cache_ttl")),
    )))
    description = _lines(
        "## Description", "",
        F.coalesce(F.nullif("description", F.lit("")), F.lit("*No description available for this table.*")),
    )
    insights = F.when(F.size("analytical_insights") > 0, _lines(
        "## Analytical Insights", "", "This table can be used to answer questions such as:", "", _numbered(F.col("analytical_insights")),
    ))
    rows = _each(F.col("schema"), lambda f: _row(
        F.concat(f["name"], F.when(d.is_report_sensitive(f["name"]), F.lit(" [SENSITIVE]")).otherwise(F.lit(""))),
        f["type"], f["mode"], F.coalesce(f["description"], F.lit("")), d.sample_text(f["sample_values"]),
    ))
    no_schema = _lines(
        _t("*Schema contains ", F.coalesce(_positive(F.col("column_count")).cast("string"), F.lit("unknown")), " columns*"), "",
        "Run full discovery to see detailed schema information.",
    )
    schema = _lines("## Schema", "", F.when(
        F.size("schema") > 0, _table(["Column", "Type", "Mode", "Description", "Sample Values"], rows)
    ).otherwise(no_schema))

    classes = F.concat_ws(
        ", ", F.when(F.col("has_pii"), F.lit("**PII** (Personally Identifiable Information)")),
        F.when(F.col("has_phi"), F.lit("**PHI** (Protected Health Information)")),
    )
    tags = c("tags", "array<string>")
    governance = _lines(
        "## Security & Governance", "",
        _t("- **Data Classification**: ", F.coalesce(F.nullif(classes, F.lit("")), F.lit("No sensitive data detected"))),
        _t("- **Encryption**: ", c("encryption_type")), _t("- **Owner**: ", c("owner_email")), _t("- **Team**: ", c("team")),
        _t("- **Environment**: ", F.upper(environment)),
        F.when(F.size(tags) > 0, _t("- **Tags**: ", F.array_join(F.transform(tags, lambda t: _t("`", t, "`")), ", "))),
    )
    storage, query = _positive(c("storage_cost_usd", "double")), _positive(c("query_cost_usd", "double"))
    breakdown = F.when(F.coalesce(storage, query).isNotNull(), _lines(
        "", _table(["Component", "Cost"], _lines(
            _row("Storage", _money(storage)), _row("Queries", _money(query)), _row("**Total**", _t("**", _money(cost), "**")),
        )),
    ))
    costs = F.when(cost > 0, _lines(
        "## Cost Analysis", "", _t("**Total Monthly Cost**: ", _money(cost)), breakdown,
        _t("\n*Cost per GB*: ", _money(cost_per_gb(cost, _positive(F.col("size_bytes"))))),
    ))
    scores = [
        _t(f"**{label}**: ", d.fixed(score * 100, 1), "% [", status(score), "]")
        for label, score in (("Completeness", c("completeness_score", "double")), ("Freshness", c("freshness_score", "double")))
    ]
    ranked = _by_null_share(_col(catalog, "profile_details", _DETAILS))
    null_table = F.when(F.size(ranked) > 0, _lines(
        "### Null Statistics", "",
        _table(["Column", "Null Count", "Null %"], _lines(
            _each(F.slice(ranked, 1, 20), lambda p: _row(
                p["column_name"],
                d.thousands(F.coalesce(p["null_count"], F.lit(0))),
                _t(d.fixed(F.coalesce(p["null_percentage"], F.lit(0.0)), 1), "%"),
            )),
            F.when(F.size(ranked) > 20, _t("| *...and ", F.size(ranked) - 20, " more columns* | | |")),
        )), "",
    ))
    any_score = F.coalesce(*scores)
    quality = F.when((F.size("column_profiles") > 0) | any_score.isNotNull(), _lines("## Data Quality", "", null_table, *scores))

    numeric = _each(_by_name(_profiles("numeric")), lambda p: _row(
        p["column_name"], _number_or_na(p["min_value"]), _number_or_na(p["max_value"]), _number_or_na(p["avg_value"]),
        d.thousands(F.coalesce(p["distinct_count"], F.lit(0))),
    ))
    strings = _each(_by_name(_strings(catalog)), lambda p: _row(
        p["column_name"], F.coalesce(p["min_length"].cast("string"), F.lit("None")), F.coalesce(p["max_length"].cast("string"), F.lit("None")),
        d.thousands(F.coalesce(p["distinct_count"], F.lit(0))),
    ))
    others = _each(_by_name(_profiles("other")), lambda p: _row(
        p["column_name"], d.thousands(F.coalesce(p["distinct_count"], F.lit(0))),
        _t(d.fixed(F.coalesce(p["null_percentage"], F.lit(0.0)), 1), "%"),
    ))
    profiles = F.when(F.size("column_profiles") > 0, _lines(
        "## Column Profiles", "",
        F.when(numeric.isNotNull(), _lines("### Numeric Columns", "", _table(["Column", "Min", "Max", "Avg", "Distinct"], numeric), "")),
        F.when(strings.isNotNull(), _lines("### String Columns", "", _table(["Column", "Min Length", "Max Length", "Distinct"], strings), "")),
        F.when(others.isNotNull(), _lines("### Other Columns (Timestamp, etc.)", "", _table(["Column", "Distinct", "Null %"], others), "")),
    ))
    lineage = _lines(
        "## Data Lineage", "", "### Upstream Sources", "", _first_ten(_sources(), "*No upstream sources found*", c("upstream_total", "bigint")), "",
        "### Downstream Dependencies", "", _first_ten(_consumers(), "*No downstream dependencies found*", c("downstream_total", "bigint")),
    )
    queries = c("query_count_30d", "bigint")
    usage = F.when(queries.isNotNull(), _lines(
        "## Usage Patterns", "", _t("**Queries (Last 30 days)**: ", d.thousands(_positive(queries))),
        _t("**Active Users**: ", _positive(c("active_users_30d", "bigint"))),
        _t("**Avg Query Time**: ", d.fixed(_positive(c("avg_query_time_seconds", "double"))), "s"),
    ))
    footer = _lines(
        "---", "", _t("*Report generated at ", d.second_text(F.col("run_timestamp")), "*"), "",
        _t("**Full Path**: `", F.col("project_id"), ".", F.col("dataset_id"), ".", F.col("table_id"), "`"), "",
        "*This report is generated from cached metadata. For real-time information, query the live system.*",
    )
    sections = [header, summary, metrics, description, insights, schema, governance, costs, quality, profiles, lineage, usage, footer]
    return F.concat_ws("\n\n", *sections)


# --- output -----------------------------------------------------------------------------------


def _run_id() -> Column:
    return run_id(F.col("run_timestamp"))


def reports(catalog: DataFrame) -> DataFrame:
    """``run, project_id, dataset_id, table_id, path, markdown`` for every catalog row."""
    run = _run_id()
    path = report_path(run, F.col("project_id"), F.col("dataset_id"), F.col("table_id"))
    return catalog.select(run.alias("run"), "project_id", "dataset_id", "table_id", path.alias("path"), markdown(catalog).alias("markdown"))


def export_summary(report_rows: DataFrame) -> DataFrame:
    """How many reports could be made per dataset; an asset without a text counts as failed and stops no other."""
    return report_rows.groupBy("project_id", "dataset_id").agg(
        F.count("markdown").alias("exported"), F.count_if(F.col("markdown").isNull()).alias("failed"),
        F.coalesce(F.sum(F.length("markdown")), F.lit(0)).alias("total_chars"),
    )


def with_reports_of_run(catalog: DataFrame, report_rows: DataFrame) -> DataFrame:
    """Catalog rows next to the report of the same asset and the same run; null where that run wrote none."""
    run = _run_id()
    found = report_rows.select("run", "project_id", "dataset_id", "table_id", "path", "markdown")
    return catalog.withColumn("run", run).join(found, ["run", "project_id", "dataset_id", "table_id"], "left")


def write_reports(report_rows: DataFrame, path: str) -> None:
    """Reports under run, project, dataset and table folders, one text file each; tables share the write tasks.

    A report that is written again replaces the file of its own run and table.
    """
    keys = ["run", "project_id", "dataset_id", "table_id"]
    rows = report_rows.select(*keys, F.col("markdown").alias("value"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).text(path)


def documents(catalog: DataFrame) -> DataFrame:
    """Catalog rows as documents: id, structured part and content text."""
    c = lambda name, kind="string": _col(catalog, name, kind)
    iso = lambda name: d.second_text(F.col(name))
    structured = F.struct(
        "project_id", "dataset_id", "table_id", c("data_source").alias("data_source"), F.col("table_type").alias("asset_type"),
        "description", "has_pii", "has_phi", c("encryption_type").alias("encryption_type"),
        "row_count", "size_bytes", "column_count",
        iso("created").alias("created_timestamp"), iso("last_modified").alias("last_modified_timestamp"),
        iso("last_accessed").alias("last_accessed_timestamp"), iso("run_timestamp").alias("indexed_at"),
        *[c(n, "double").alias(n) for n in ("monthly_cost_usd", "storage_cost_usd", "query_cost_usd")],
        *[c(n).alias(n) for n in ("owner_email", "team")], "environment", *[c(n).alias(n) for n in ("cache_ttl", "volatility")],
        *[c(n, "double").alias(n) for n in ("completeness_score", "freshness_score")], c("tags", "array<string>").alias("tags"),
    )
    return catalog.select(
        F.concat_ws(".", "project_id", "dataset_id", "table_id").alias("id"),
        structured.alias("structData"),
        F.struct(F.lit("text/plain").alias("mime_type"), content_text(catalog).alias("text")).alias("content"),
    )


def query_ready(hits: DataFrame, reports_frame: DataFrame) -> DataFrame:
    """Hits in the catalog schema with their report text, owner and tags, for tools that write queries."""
    text = reports_frame.select("project_id", "dataset_id", "table_id", F.col("markdown").alias("full_markdown"))
    extras = {"owner_email": "string", "tags": "array<string>"}
    return hits.join(text, ["project_id", "dataset_id", "table_id"], "left").select(
        *hits.columns,
        F.coalesce("full_markdown", F.lit("")).alias("full_markdown"),
        *[F.lit(None).cast(kind).alias(n) for n, kind in extras.items() if n not in hits.columns],
    )
