"""The versioned catalog: row assembly, snapshots, upsert, reconcile, delete, diffs and rollups."""

from __future__ import annotations

from collections.abc import Iterator
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from assayer import schemas
from assayer.functions.display import column_description, number_text
from assayer.functions.naming import document_key
from assayer.operators.ranking import top_ranked

# Names kept inline per table and direction; larger neighbourhoods are whole in ``lineage_neighbours`` and ``lineage_documents``.
INLINE_EDGES = 1000
_DIGESTS = pa.schema([("table_ref", pa.string()), ("direction", pa.string()), ("n", pa.int64()), ("total", pa.int64()), ("digest", pa.string())])


# --- assembly ---------------------------------------------------------------------------------


def schema_arrays(columns: DataFrame, samples: DataFrame) -> DataFrame:
    """Per table the ordered array of fields, each with its sample values. Bounded by the table's width."""
    values = samples.groupBy("table_id", "column_name").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("sample_values")
    )
    described = F.when(F.length("description") > 0, F.col("description")).otherwise(
        column_description(F.col("name"), F.col("data_type"), F.col("mode"))
    )
    entry = F.struct(
        "ordinal",
        F.col("column_name").alias("name"), F.col("data_type").alias("type"), "mode",
        described.alias("description"),
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
    )
    ordered = F.sort_array(F.collect_list(entry))
    without_ordinal = F.transform(ordered, lambda s: F.struct(*[s[n].alias(n) for n in ("name", "type", "mode", "description", "sample_values")]))
    return columns.join(values, ["table_id", "column_name"], "left").groupBy("table_id").agg(without_ordinal.alias("schema"))


def profile_arrays(profile: DataFrame) -> DataFrame:
    """Per table the ordered array of column profiles with values as text."""
    entry = F.struct(
        "ordinal", "column_name", "profile_type",
        F.coalesce("min_value", F.lit("")).alias("min_value"),
        F.coalesce("max_value", F.lit("")).alias("max_value"),
        F.coalesce(number_text(F.col("avg")), F.lit("")).alias("avg_value"),
        "distinct_count", "null_percentage",
    )
    names = ("column_name", "profile_type", "min_value", "max_value", "avg_value", "distinct_count", "null_percentage")
    ordered = F.sort_array(F.collect_list(entry))
    return profile.groupBy("table_id").agg(
        F.transform(ordered, lambda s: F.struct(*[s[n].alias(n) for n in names])).alias("column_profiles")
    )


def lineage_arrays(edges: DataFrame, limit: int = INLINE_EDGES) -> DataFrame:
    """Per table the names of its sources and consumers in order, with exact totals.

    The ranking drops names beyond ``limit`` inside each task, so a hub with a huge neighbourhood never
    gathers in one place; its complete neighbourhood is the edge table itself.
    """
    def one_way(own: str, other: str, label: str) -> DataFrame:
        named = edges.select(F.col(own).alias("table_ref"), F.col(other).alias("name"))
        ranked = top_ranked(named, Window.partitionBy("table_ref").orderBy("name"), limit)
        return ranked.groupBy("table_ref").agg(F.sort_array(F.collect_list("name")).alias(label))

    both = one_way("target", "source", "upstream").join(one_way("source", "target", "downstream"), "table_ref", "full_outer")
    return both.join(lineage_totals(edges), "table_ref")


def lineage_neighbours(edges: DataFrame, size: int = INLINE_EDGES) -> DataFrame:
    """The whole neighbourhood of every asset: ``(table_ref, direction, part, parts, total, names)``.

    A neighbourhood of any size is complete; it is dealt into parts of about ``size`` names by the hash of the name, so a hub
    is spread over many rows and tasks.
    """
    if size < 1:
        raise ValueError("a part has at least one name")
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("target").alias("table_ref"), F.lit("upstream").alias("direction"), F.col("source").alias("name")),
        F.struct(F.col("source").alias("table_ref"), F.lit("downstream").alias("direction"), F.col("target").alias("name")),
    )))
    keys = ["table_ref", "direction"]
    totals = ends.groupBy(*keys).agg(F.count(F.lit(1)).alias("total")).withColumn("parts", F.ceil(F.col("total") / size).cast("bigint"))
    dealt = ends.join(totals, keys).withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")))
    return dealt.groupBy(*keys, "part", "parts", "total").agg(F.sort_array(F.collect_list("name")).alias("names"))


def neighbourhood_digests(parts: DataFrame) -> DataFrame:
    """``(table_ref, direction, n, total, digest)`` of the parts of :func:`lineage_neighbours`: the MD5 of all names in order, joined by commas.

    The names pass through a task in order, a batch at a time, so a hub of any size is never put together.
    """
    keys = ["table_ref", "direction"]
    names = parts.select(*keys, "total", F.explode("names").alias("name"))
    ordered = names.repartition(*keys).sortWithinPartitions(*keys, "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, n, digest = None, 0, 0, None
        for batch in batches:
            table, way, sums, texts = (batch.column(c).to_pylist() for c in ("table_ref", "direction", "total", "name"))
            changes = [i for i in range(len(table)) if (table[i], way[i]) != ((table[i - 1], way[i - 1]) if i else own)]
            out = []
            # the rows of a batch that go on with the last group, then those of each new one
            for at, to in zip([0, *changes], [*changes, len(table)], strict=True):
                if to == at:
                    continue
                key = (table[at], way[at])
                if key != own:
                    if own is not None:
                        out.append((*own, n, total, digest.hexdigest()))
                    own, total, n, digest = key, sums[at], 0, hashlib.md5(usedforsecurity=False)
                digest.update(((b"," if n else b"") + ",".join(texts[at:to]).encode()))
                n += to - at
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _DIGESTS.types)], schema=_DIGESTS)
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*own, n, total, digest.hexdigest()), _DIGESTS.types)], schema=_DIGESTS)

    return ordered.mapInArrow(run, "table_ref string, direction string, n long, total long, digest string")


def lineage_documents(edges: DataFrame, size: int = INLINE_EDGES) -> DataFrame:
    """What a catalog row's lists cannot hold, as further documents ``(id, table_ref, text)``: every name of each neighbourhood over ``size``."""
    heading = F.when(F.col("direction") == "upstream", F.lit("## Upstream Sources")).otherwise(F.lit("## Downstream Consumers"))
    lines = F.array_join(F.transform("names", lambda n: F.concat(F.lit("- "), n)), "\n")
    return lineage_neighbours(edges, size).filter("parts > 1").select(
        F.concat_ws("#", "table_ref", "direction", F.col("part").cast("string")).alias("id"), "table_ref",
        F.concat(F.lit("# "), "table_ref", F.lit("\n"), heading, F.lit("\n"), lines).alias("text"),
    )


def lineage_totals(edges: DataFrame) -> DataFrame:
    """Exact number of sources and consumers per table; null where there is none."""
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("target").alias("table_ref"), F.lit(1).alias("up"), F.lit(None).cast("int").alias("down")),
        F.struct(F.col("source").alias("table_ref"), F.lit(None).cast("int").alias("up"), F.lit(1).alias("down")),
    )))
    return ends.groupBy("table_ref").agg(F.sum("up").alias("upstream_total"), F.sum("down").alias("downstream_total"))


def column_details(columns: DataFrame, profile: DataFrame, samples: DataFrame) -> DataFrame:
    """Every column with its null share, bounds, distinct count and sample values side by side, one row each."""
    keys = ["table_id", "column_name"]
    values = samples.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("sample_values")
    )
    measures = profile.drop("ordinal", "data_type")
    return columns.join(measures, keys, "left").join(values, keys, "left")


def key_metrics(metrics: dict[str, Column]) -> Column:
    """The metrics that have a value, as name and text."""
    pairs = [
        F.when(c.isNotNull(), F.struct(F.lit(name).alias("metric_name"), c.cast("string").alias("metric_value")))
        for name, c in metrics.items()
    ]
    return F.array_compact(F.array(*pairs))


def catalog_rows(
    assets: DataFrame, columns: DataFrame, profile: DataFrame, samples: DataFrame, edges: DataFrame, run_timestamp: Column
) -> DataFrame:
    """The catalog row of every asset, joined from the long frames on the three-part name ``table_ref``.

    ``assets`` carries ``table_ref`` and the flat catalog fields; what it lacks is null.
    """
    joined = (
        assets.join(schema_arrays(columns, samples).withColumnRenamed("table_id", "table_ref"), "table_ref", "left")
        .join(profile_arrays(profile).withColumnRenamed("table_id", "table_ref"), "table_ref", "left")
        .join(lineage_arrays(edges), "table_ref", "left")
    )
    own = F.col("table_ref")
    none = F.array().cast("array<string>")
    pairs = F.concat(
        F.transform(F.coalesce("upstream", none), lambda s: F.struct(s.alias("source"), own.alias("target"))),
        F.transform(F.coalesce("downstream", none), lambda t: F.struct(own.alias("source"), t.alias("target"))),
    )
    have = set(assets.columns)
    metrics = {n: F.col(n) for n in ("completeness_score", "freshness_score", "volatility", "cache_ttl") if n in have}
    computed = {
        "lineage": pairs,
        "labels": F.coalesce(F.map_entries("labels"), F.array()) if "labels" in have else F.array(),
        "key_metrics": key_metrics(metrics),
        "run_timestamp": run_timestamp,
        "insert_timestamp": F.current_timestamp(),
    }
    present = have | {"schema", "column_profiles"}
    catalog = T.DataType.fromDDL(schemas.CATALOG)
    out = []
    for f in catalog.fields:
        value = computed.get(f.name, F.col(f.name) if f.name in present else F.lit(None))
        if isinstance(f.dataType, T.ArrayType):
            value = F.coalesce(value, F.array())
        out.append(value.cast(f.dataType).alias(f.name))
    return joined.select(*out)


def report_input(catalog: DataFrame, extras: DataFrame, profile: DataFrame) -> DataFrame:
    """Catalog rows with what reports show beyond the stored schema.

    ``extras`` brings cost, owner, scores or usage on ``table_ref``; null counts and lengths come from the profile.
    """
    names = ("column_name", "profile_type", "null_count", "null_percentage", "distinct_count", "min_length", "max_length")
    ordered = F.sort_array(F.collect_list(F.struct("ordinal", *names)))
    details = profile.groupBy(F.col("table_id").alias("table_ref")).agg(
        F.transform(ordered, lambda s: F.struct(*[s[n].alias(n) for n in names])).alias("profile_details")
    )
    keyed = catalog.withColumn("table_ref", F.concat_ws(".", "project_id", "dataset_id", "table_id"))
    return keyed.join(extras, "table_ref", "left").join(details, "table_ref", "left").drop("table_ref")


# --- storage ----------------------------------------------------------------------------------


def append(rows: DataFrame, path: str) -> None:
    """Add one run to the catalog folder; runs lie in day folders, so readers of one run prune the others."""
    rows.withColumn("run_date", F.to_date("run_timestamp")).write.mode("append").partitionBy("run_date").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest(catalog: DataFrame, run: str = "run_timestamp", as_of: Column | None = None) -> DataFrame:
    """The newest run (or the newest at or before ``as_of``), without the run column.

    On a stored catalog the newest day folder is found first, so run times are read from that day alone.
    """
    known = catalog if as_of is None else catalog.filter(F.col(run) <= as_of)
    if "run_date" not in catalog.columns:
        return catalog.filter(F.col(run) == known.agg(F.max(run)).scalar()).drop(run)
    if as_of is not None:
        known = known.filter(F.col("run_date") <= F.to_date(as_of))
    day = known.agg(F.max("run_date")).scalar()
    newest = known.filter(F.col("run_date") == day).agg(F.max(run)).scalar()
    return catalog.filter((F.col("run_date") == day) & (F.col(run) == newest)).drop(run, "run_date")


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key in the given order; each task keeps one row per key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The next snapshot: incoming rows replace or add, other rows stay. ``order`` picks among incoming copies."""
    fresh = latest_per_key(incoming, [key], order)  # already placed by key, so the join moves only ``existing``
    return existing.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def upsert_outcome(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Per incoming key whether it is created or updated."""
    known = existing.select(key).distinct().withColumn("_known", F.lit(True))
    keys = incoming.select(key).distinct()
    return keys.join(known, key, "left").select(key, F.when(F.col("_known"), "updated").otherwise("created").alias("outcome"))


def reconcile(existing: DataFrame, incoming: DataFrame, key: str, order: list[Column], mode: str) -> DataFrame:
    """``FULL``: the incoming set replaces everything; ``INCREMENTAL``: absent documents are kept."""
    if mode == "FULL":
        return latest_per_key(incoming, [key], order)
    if mode == "INCREMENTAL":
        return upsert(existing, incoming, key, order)
    raise ValueError("mode must be FULL or INCREMENTAL")


def delete(documents: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return documents.join(ids.select(key).distinct(), key, "left_anti")


def id_collisions(ids: DataFrame, key: str = "id") -> DataFrame:
    """Document keys that stand for more than one id. Ids are made distinct first, so copies count once."""
    distinct = ids.select(F.col(key).alias("id")).distinct()
    return distinct.groupBy(document_key(F.col("id")).alias("document_key")).agg(
        F.count(F.lit(1)).alias("n_ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    ).filter("n_ids > 1")


# --- changes between runs ---------------------------------------------------------------------


def diff(before: DataFrame, after: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """One row per key that was added, removed or changed, with the names of the changed columns."""
    old = before.select(*keys, F.struct(*compare).alias("_old"))
    new = after.select(*keys, F.struct(*compare).alias("_new"))
    joined = old.join(new, keys, "full_outer")
    changed = F.array_compact(F.array(*[
        F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")), F.lit(c)) for c in compare
    ]))
    kind = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(F.size("_changed") > 0, "changed")
    )
    return (
        joined.withColumn("_changed", changed)
        .withColumn("change", kind)
        .filter(F.col("change").isNotNull())
        .select(*keys, "change", F.when(F.col("change") == "changed", F.concat_ws(",", "_changed")).alias("changed_columns"))
    )


def schema_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns added, removed or changed in type or mode between two catalog runs."""
    def columns(catalog: DataFrame) -> DataFrame:
        return catalog.select("project_id", "dataset_id", "table_id", F.inline("schema"))

    return diff(columns(before), columns(after), ["project_id", "dataset_id", "table_id", "name"], ["type", "mode"])


# --- rollups ----------------------------------------------------------------------------------


def dataset_rollup(catalog: DataFrame) -> DataFrame:
    """Tables, rows, bytes, cost and sensitivity flags per dataset, over the whole catalog."""
    return catalog.groupBy("project_id", "dataset_id").agg(
        F.count(F.lit(1)).alias("table_count"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes"),
        F.coalesce(F.sum("monthly_cost_usd"), F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.bool_or("has_pii"), F.lit(False)).alias("has_pii"),
        F.coalesce(F.bool_or("has_phi"), F.lit(False)).alias("has_phi"),
    )


def dataset_tables(catalog: DataFrame) -> DataFrame:
    """The tables of each dataset, one row each: a dataset's list may be any length."""
    return catalog.select("project_id", "dataset_id", "table_id").distinct()


def cost_rollup(catalog: DataFrame) -> DataFrame:
    """Cost per dataset, per project and in all; ``level`` 0 is the dataset, 1 the project, 3 the total."""
    return catalog.rollup("project_id", "dataset_id").agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.count(F.lit(1)).alias("table_count"),
        F.sum("storage_cost_usd").alias("storage_cost_usd"),
        F.sum("query_cost_usd").alias("query_cost_usd"),
        F.sum("monthly_cost_usd").alias("monthly_cost_usd"),
    )


def inspect(
    assets: DataFrame,
    asset: str,
    schema: DataFrame | None = None,
    statistics: DataFrame | None = None,
    edges: DataFrame | None = None,
    usage: DataFrame | None = None,
) -> DataFrame:
    """One asset with the parts asked for, each left joined on ``table_ref`` so a missing part is null."""
    out = assets.filter(F.col("table_ref") == asset)
    if schema is not None:
        out = out.join(schema, "table_ref", "left")
    if statistics is not None:
        out = out.join(statistics, "table_ref", "left")
    if edges is not None:
        out = out.join(lineage_arrays(edges.filter((F.col("source") == asset) | (F.col("target") == asset))), "table_ref", "left")
    if usage is not None:
        out = out.join(usage, "table_ref", "left")
    return out
