"""A collection run: from a list of assets to stored profiles, catalog, reports, documents, lineage events and outcomes.

Tables are read in batches of bounded size, so the driver plans a few tables at a time however many there are, and each batch
is appended as it ends. A table that cannot be read is one ``error`` row among the outcomes and stops no other: if a batch
fails, its tables are tried one by one. Catalog, reports, documents and events are then made from the stored frames, in one
plan each that does not grow with the number of tables.

Many runs share one folder. Every attempt writes below a folder of its own, and one row in the run table, written last, makes all
of its frames visible together. An attempt that failed or died is never read; a run that is repeated under its id takes the place of the
earlier attempt. The run table keeps every attempt with its state, times and counts.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from assayer.functions import cost, display, naming
from assayer.operators import catalog, classify, frequencies, lineage, quality, report
from assayer.operators.profile import ProfileOptions, profile_table
from assayer.operators.usage import cache_ttl, volatility
from assayer.sources.tables import Asset, columns_frame, file_facts, sampled, table_metadata, union_all

_FILES = "table_ref string, size_bytes bigint, file_count bigint, created timestamp, last_modified timestamp"
_OUTCOMES = "table_ref string, project_id string, dataset_id string, table_id string, outcome string, error string, description_generated boolean"


@dataclass(frozen=True)
class CollectionOptions:
    """What a run does with each table. ``required_labels``: tables without them are listed as filtered and not read."""

    batch: int = 20
    sample_percent: float = 100.0
    target_columns: list[str] | None = None
    samples: int = 3
    patterns: int = 5
    environment: str = "prod"
    system: str = "Spark"
    required_labels: dict[str, str] = field(default_factory=dict)
    profile: ProfileOptions = ProfileOptions()


_RUNS = (
    "process string, run_id string, attempt string, state string, started timestamp, ended timestamp, tables bigint, formatted bigint, errors bigint, filtered bigint,"
    " frames array<string>, error string"
)
PROCESS = "discovery/collect"


@dataclass(frozen=True)
class Collected:
    """The stored frames of one attempt at a run, by name, below the folder that all runs share."""

    root: str
    run_id: str
    attempt: str

    def folder(self, name: str) -> str:
        return f"{self.root}/{name}/_run={self.run_id}/_attempt={self.attempt}"

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(self.folder(name))


def runs(spark: SparkSession, root: str) -> DataFrame:
    """Every attempt with its state: ``RUNNING`` (or died), ``COMPLETED`` or ``FAILED``, its times, counts and frames."""
    try:
        rows = spark.read.schema(_RUNS).parquet(f"{root}/runs")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _RUNS)
    last = F.row_number().over(Window.partitionBy("run_id", "attempt").orderBy(F.col("ended").desc_nulls_last()))
    return rows.withColumn("_last", last).filter("_last = 1").drop("_last")


def committed_runs(spark: SparkSession, root: str) -> DataFrame:
    """The attempts that count: of each run the one that was completed last."""
    last = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("ended"), "attempt"))
    return runs(spark, root).filter("state = 'COMPLETED'").withColumn("_last", last).filter("_last = 1").drop("_last")


def committed(spark: SparkSession, root: str, name: str, newest_only: bool = False) -> DataFrame | None:
    """A frame of all completed runs with their ``run_id``, or of the newest run alone; None if no run has it.

    Only the folders of these attempts are listed and read. The driver sees one row a run.
    """
    known = committed_runs(spark, root).filter(F.array_contains("frames", name)).select("run_id", "attempt", "started")
    known = known.orderBy(F.desc("started"), F.desc("run_id"))
    found = (known.limit(1) if newest_only else known).collect()
    if not found:
        return None
    reader = spark.read.option("basePath", f"{root}/{name}")
    # folders named after digits would be read as numbers; the path has the id as it is
    frame = reader.parquet(*[Collected(root, r["run_id"], r["attempt"]).folder(name) for r in found]).drop("_run", "_attempt")
    return frame.withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), f"/{name}/_run=([^/]+)/_attempt=", 1))


def _record(spark: SparkSession, done: Collected, state: str, started: datetime, ended: datetime | None, outcomes: list, frames: list[str], error: str | None = None) -> None:
    count = lambda kind: sum(o[4] == kind for o in outcomes)
    row = (PROCESS, done.run_id, done.attempt, state, started, ended, len(outcomes), count("formatted"), count("error"), count("filtered"), frames, error)
    spark.createDataFrame([row], _RUNS).coalesce(1).write.mode("append").parquet(f"{done.root}/runs")


def _frames(spark: SparkSession, assets: list[Asset], opts: CollectionOptions) -> dict[str, DataFrame]:
    """The frames of one batch, each one plan over its tables."""
    tables = {a.id: a.read(spark) for a in assets}
    seen = {i: sampled(df, opts.sample_percent, target_columns=[c for c in opts.target_columns if c in df.columns] if opts.target_columns else None) for i, df in tables.items()}

    def named(i: str, df: DataFrame, columns: str) -> DataFrame:
        return df.select(F.lit(i).alias("table_id"), *columns.split())

    ref = naming.asset_id(F.col("project_id"), F.col("dataset_id"), F.col("table_id"))
    with_files = [a for a in assets if a.path]
    files = union_all(file_facts(spark, a) for a in with_files) if with_files else spark.createDataFrame([], _FILES.replace("table_ref", "asset_id"))
    return {
        "profile": union_all(profile_table(df, i, options=opts.profile) for i, df in seen.items()),
        "samples": union_all(named(i, frequencies.sample_values(df, k=opts.samples), "column_name rank value") for i, df in seen.items()),
        "patterns": union_all(named(i, frequencies.string_patterns(df, k=opts.patterns), "column_name rank pattern value_count") for i, df in seen.items()),
        "columns": columns_frame(spark, {i: df.schema for i, df in tables.items()}),
        "facts": union_all(table_metadata(tables[a.id], a) for a in assets).withColumn("table_ref", ref),
        "files": files.withColumnRenamed("asset_id", "table_ref"),
    }


def _said(error: PySparkException | Py4JJavaError) -> str:
    said = str(error.java_exception) if isinstance(error, Py4JJavaError) else str(error)
    return said.splitlines()[0]


def _collected(spark: SparkSession, assets: list[Asset], done: Collected, opts: CollectionOptions) -> dict[str, str | None]:
    """Error text by asset, null for those that are stored. Tables that cannot be opened are left out; the others are written whole or tried alone."""
    errors = {}
    for a in assets:
        try:
            a.read(spark)
        except (PySparkException, Py4JJavaError) as error:
            errors[a.id] = _said(error)
    if errors:
        rest = [a for a in assets if a.id not in errors]
        return errors | (_collected(spark, rest, done, opts) if rest else {})
    try:
        # everything is computed before anything is appended, so a failure leaves no half of a table behind
        frames = {name: _computed(df, done, name) for name, df in _frames(spark, assets, opts).items()}
    except (PySparkException, Py4JJavaError) as error:
        if len(assets) == 1:
            return {assets[0].id: _said(error)}
        return reduce(lambda a, b: a | b, [_collected(spark, [a], done, opts) for a in assets])
    for name, df in frames.items():
        df.write.mode("append").parquet(done.folder(name))
    return {a.id: None for a in assets}


def _computed(df: DataFrame, done: Collected, name: str) -> DataFrame:
    path = f"{done.folder('batches')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collect(
    spark: SparkSession, assets: Iterable[Asset], root: str, run_timestamp: str, edges: DataFrame | None = None, opts: CollectionOptions = CollectionOptions(), run_id: str | None = None
) -> Collected:
    """Run over all assets and store below ``root``: profile, samples, patterns, columns, facts, files, outcomes, catalog, reports, documents, events.

    ``edges`` (source, target, edge_type) is the lineage known between the assets; without it, tables are linked by the keys they share.
    ``run_id`` (default: the digits of ``run_timestamp``) names the run; the same id again replaces what the run stored before.
    """
    if opts.batch < 1:
        raise ValueError("a batch has at least one table")
    run_id = re.sub(r"[^0-9A-Za-z]+", "", run_timestamp) if run_id is None else run_id
    if not re.fullmatch(r"[0-9A-Za-z][0-9A-Za-z_.-]*", run_id):
        raise ValueError("a run id has letters, digits, dots, hyphens and underscores")
    done, started = Collected(root, run_id, uuid.uuid4().hex), datetime.now(UTC)
    outcomes: list[tuple] = []
    _record(spark, done, "RUNNING", started, None, [], [])
    try:
        frames = _run(spark, list(assets), done, run_timestamp, started, edges, opts, outcomes)
    except Exception as error:
        _record(spark, done, "FAILED", started, datetime.now(UTC), outcomes, [], f"{type(error).__name__}: {error}"[:1000])
        raise
    _record(spark, done, "COMPLETED", started, datetime.now(UTC), outcomes, frames)
    if "reports" in frames:  # files are copies of what is committed; a repeated run replaces its own
        report.write_reports(done.read(spark, "reports"), f"{root}/report_files")
    return done


def _run(
    spark: SparkSession, known: list[Asset], done: Collected, run_timestamp: str, started: datetime, edges: DataFrame | None, opts: CollectionOptions, outcomes: list[tuple]
) -> list[str]:
    """Write all frames of an attempt and return their names; ``outcomes`` is filled as tables are done."""
    chosen = [a for a in known if all(a.labels.get(k) == v for k, v in opts.required_labels.items())]
    ids = {a.id for a in chosen}
    outcomes += [(a.id, a.project_id, a.dataset_id, a.table_id, "filtered", None, False) for a in known if a.id not in ids]
    for at in range(0, len(chosen), opts.batch):
        batch = chosen[at : at + opts.batch]
        errors = _collected(spark, batch, done, opts)
        outcomes += [
            (a.id, a.project_id, a.dataset_id, a.table_id, "error" if errors[a.id] else "formatted", errors[a.id], not errors[a.id] and not a.description) for a in batch
        ]
    spark.createDataFrame(outcomes, _OUTCOMES).write.mode("append").parquet(done.folder("outcomes"))
    frames = ["outcomes"]
    if any(o[4] == "formatted" for o in outcomes):
        frames += ["profile", "samples", "patterns", "columns", "facts", "files"]
        frames += _assemble(spark, done, {a.id: a.description for a in chosen if a.description}, run_timestamp, started, edges, opts)
    return frames


def _assemble(
    spark: SparkSession, done: Collected, descriptions: dict[str, str], run_timestamp: str, started: datetime, edges: DataFrame | None, opts: CollectionOptions
) -> list[str]:
    """What is made from the stored frames of this attempt alone."""
    profile, columns = done.read(spark, "profile"), done.read(spark, "columns")
    edges = lineage.clean_edges(edges if edges is not None else lineage.key_edges(profile))
    kind = volatility(F.col("table_type"), F.lit(False), F.lit(None).cast("double"))
    given = spark.createDataFrame(list(descriptions.items()), "table_ref string, _given string")
    made = display.table_description(opts.system, F.col("table_id"), F.col("table_type"), F.col("row_count"), F.col("column_count"))
    flat = (
        done.read(spark, "facts")
        .join(done.read(spark, "files"), "table_ref", "left")
        .join(classify.flag_tables(columns).withColumnRenamed("table_id", "table_ref"), "table_ref", "left")
        .join(quality.completeness(profile).select(F.col("table_id").alias("table_ref"), "completeness_score"), "table_ref", "left")
        .join(given, "table_ref", "left")
        .withColumns({"description": F.coalesce("_given", made), "environment": F.lit(opts.environment), "volatility": kind, "cache_ttl": cache_ttl(kind)})
        .drop("_given")
    )
    flat.write.parquet(done.folder("assets"))
    flat = done.read(spark, "assets")
    rows = catalog.catalog_rows(flat, columns, profile, done.read(spark, "samples"), edges, F.lit(run_timestamp).cast("timestamp"))
    catalog.append(rows, done.folder("catalog"))
    extras = flat.select(
        "table_ref", "completeness_score", "volatility", "cache_ttl",
        cost.storage_cost(F.col("size_bytes")).alias("storage_cost_usd"), cost.query_cost(F.col("size_bytes")).alias("query_cost_usd"),
        cost.total_cost(F.col("size_bytes")).alias("monthly_cost_usd"),
    ).join(catalog.lineage_totals(edges), "table_ref", "left")
    shown = catalog.report_input(done.read(spark, "catalog").drop("run_date"), extras, profile)
    report.reports(shown).write.parquet(done.folder("reports"))
    report.documents(shown).write.parquet(done.folder("documents"))
    catalog.lineage_neighbours(edges).write.parquet(done.folder("lineage"))
    start, end = F.lit(started).cast("timestamp"), F.lit(datetime.now(UTC)).cast("timestamp")
    failed = done.read(spark, "outcomes").filter("outcome = 'error'")
    events = [
        lineage.job_events(links.select(F.col("table_ref").alias("source"), F.lit("catalog").alias("target")), *PROCESS.split("/"), start, end, fine)
        for links, fine in ((flat, True), (failed, False))
    ]
    union_all(events).write.parquet(done.folder("events"))
    return ["assets", "catalog", "reports", "documents", "lineage", "events"]
