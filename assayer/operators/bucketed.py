"""A document store that takes upserts and deletes without being rewritten: hashed buckets, change files, merge on read.

A full load starts the store and fixes its number of buckets by its rows. An upsert or delete writes only its own rows, by the
buckets that they fall in. Reading passes buckets without changes through as they are and merges the others: the newest change of
a key decides. Compaction rewrites the buckets whose changes have grown to a share of their base; other buckets keep their files.

Every write goes to a folder of its own and counts once its row of the commit table is written, which comes last: a failed write is
never read, and readers of an older version see it unchanged. One writer at a time. Files that no version needs any more are left
to the owner of the folder.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from assayer.operators.catalog import latest_per_key

#: Rows of a bucket after a full load, about.
BUCKET_ROWS = 500_000
_COMMITS = "version int, kind string, attempt string, key string, n_buckets int, buckets array<int>, n_rows bigint, columns string"
_DELETED, _VERSION = "_deleted", "_version"


@dataclass
class _Layout:
    """What a version consists of: per bucket the commit of its base, and the changes since."""

    version: int
    key: str
    n_buckets: int
    base: dict[int, tuple[int, str]]
    columns: T.StructType
    changes: list = field(default_factory=list)

    def changed(self) -> dict[int, set[int]]:
        """Buckets with changes newer than their base, by the version of the change."""
        found = {c["version"]: {b for b in c["buckets"] if c["version"] > self.base[b][0]} for c in self.changes}
        return {version: buckets for version, buckets in found.items() if buckets}


def versions(spark: SparkSession, path: str) -> DataFrame:
    """The commits so far: ``version``, ``kind`` (``full``, ``upsert``, ``delete`` or ``compact``), rows written, buckets touched."""
    return _commits(spark, path).select("version", "kind", "n_rows", "n_buckets", F.size("buckets").alias("n_touched"))


def _commits(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_COMMITS).parquet(f"{path}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _COMMITS)


def _layout(spark: SparkSession, path: str, as_of: int | None = None) -> _Layout:
    """One row a commit since the last full load comes to the driver, with numbers of buckets, as a scan lists their files there anyway."""
    known = _commits(spark, path)
    known = known if as_of is None else known.filter(F.col("version") <= as_of)
    start = known.filter("kind = 'full'").agg(F.max("version")).first()[0]
    if start is None:
        raise ValueError(f"{path} holds no documents" + ("" if as_of is None else f" as of version {as_of}"))
    first, *later = known.filter(F.col("version") >= start).orderBy("version").collect()
    layout = _Layout(start, first["key"], first["n_buckets"], {b: (start, first["attempt"]) for b in range(first["n_buckets"])}, _columns(first))
    for commit in later:
        layout.version = commit["version"]
        if commit["kind"] == "upsert":  # columns in the order of their arrival
            known_names = layout.columns.names
            layout.columns = T.StructType(layout.columns.fields + [f for f in _columns(commit) if f.name not in known_names])
        if commit["kind"] == "compact":
            layout.base |= {b: (commit["version"], commit["attempt"]) for b in commit["buckets"]}
        else:
            layout.changes.append(commit)
    return layout


def _columns(commit) -> T.StructType:
    return T.StructType.fromJson(json.loads(commit["columns"]))


def _commit(rows: DataFrame, path: str, kind: str, key: str, n_buckets: int, buckets: list[int] | None = None) -> int:
    """Write rows, one a key, by bucket into a new folder, then their row of the commit table."""
    spark = rows.sparkSession
    attempt, found, n = _write(rows, path, key, n_buckets)
    buckets = found if buckets is None else buckets
    columns = T.StructType([f for f in rows.schema if f.name != _DELETED]).json()
    last = _commits(spark, path).agg(F.max("version")).first()[0]
    version = 0 if last is None else last + 1
    row = spark.createDataFrame([(version, kind, attempt, key, n_buckets, buckets, n, columns)], _COMMITS)
    row.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return version


def _write(rows: DataFrame, path: str, key: str, n_buckets: int) -> tuple[str, list[int], int]:
    """Write rows, one a key, by bucket into a new folder. Returns the folder's name, the buckets it has and its rows."""
    attempt = uuid.uuid4().hex
    named = F.coalesce(F.col(key), F.raise_error(F.lit(f"a document without {key} could not be found again")))
    bucket = F.pmod(F.xxhash64(named), F.lit(n_buckets)).cast("int")
    dealt = rows.withColumn("_bucket", bucket).repartition("_bucket").sortWithinPartitions("_bucket", key)
    folder = f"{path}/data/{attempt}"
    dealt.write.partitionBy("_bucket").parquet(folder)
    # an empty write has no bucket folders
    counted = rows.sparkSession.read.schema("_bucket int").parquet(folder).groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"))
    found = counted.collect()  # numbers of buckets
    return attempt, sorted(r["_bucket"] for r in found), sum(r["n"] for r in found)


def load(documents: DataFrame, key: str, path: str, order: list[Column], bucket_rows: int = BUCKET_ROWS) -> int:
    """Replace everything by ``documents`` (a ``FULL`` reconcile); ``order`` picks among rows of one key. Returns the version.

    Rows without a key are an error, here and in an upsert.
    """
    fresh = latest_per_key(documents, [key], order)
    n_buckets = max(1, -(-documents.count() // bucket_rows))
    return _commit(fresh, path, "full", key, n_buckets, list(range(n_buckets)))


def upsert(documents: DataFrame, path: str, order: list[Column]) -> int:
    """Replace or add ``documents`` (an ``INCREMENTAL`` reconcile). Columns that the store lacks become null in its older rows. Returns the version."""
    layout = _layout(documents.sparkSession, path)
    fresh = latest_per_key(documents, [layout.key], order).withColumn(_DELETED, F.lit(False))
    return _commit(fresh, path, "upsert", layout.key, layout.n_buckets)


def delete(ids: DataFrame, path: str) -> int:
    """Delete by the ids in the store's key column; unknown ids and nulls change nothing. Returns the version."""
    layout = _layout(ids.sparkSession, path)
    gone = ids.select(layout.key).distinct().filter(F.col(layout.key).isNotNull()).withColumn(_DELETED, F.lit(True))
    return _commit(gone, path, "delete", layout.key, layout.n_buckets)


def read(spark: SparkSession, path: str, as_of: int | None = None) -> DataFrame:
    """The documents of the newest version, or of version ``as_of``."""
    return _read(spark, path, _layout(spark, path, as_of), None).drop("_bucket")


def _base(spark: SparkSession, path: str, layout: _Layout, buckets: set[int]) -> DataFrame:
    """The base files of these buckets; other folders are pruned."""
    by_attempt = defaultdict(list)
    for b in sorted(buckets):
        by_attempt[layout.base[b][1]].append(b)
    schema = T.StructType([*layout.columns, T.StructField("_bucket", T.IntegerType())])
    frames = []
    for attempt, mine in by_attempt.items():
        found = spark.read.schema(schema).parquet(f"{path}/data/{attempt}")
        frames.append(found if len(mine) == layout.n_buckets else found.filter(F.col("_bucket").isin(mine)))
    return _union(frames) if frames else spark.createDataFrame([], schema)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _changes(spark: SparkSession, path: str, layout: _Layout, buckets: set[int]) -> DataFrame:
    """The changes of these buckets that are newer than their base."""
    schema = T.StructType([*layout.columns, T.StructField(_DELETED, T.BooleanType()), T.StructField("_bucket", T.IntegerType())])
    touched = layout.changed()
    frames = []
    for c in layout.changes:
        mine = sorted(touched.get(c["version"], set()) & buckets)
        if mine:
            found = spark.read.schema(schema).parquet(f"{path}/data/{c['attempt']}").filter(F.col("_bucket").isin(mine))
            frames.append(found.withColumn(_VERSION, F.lit(c["version"])))
    return _union(frames) if frames else spark.createDataFrame([], T.StructType([*schema, T.StructField(_VERSION, T.IntegerType())]))


def _read(spark: SparkSession, path: str, layout: _Layout, buckets: set[int] | None) -> DataFrame:
    wanted = set(layout.base) if buckets is None else buckets
    dirty = set().union(*layout.changed().values()) & wanted
    base = _base(spark, path, layout, wanted - dirty)
    if not dirty:
        return base
    newest = latest_per_key(_changes(spark, path, layout, dirty), [layout.key], [F.desc(_VERSION)])
    # keys that changed leave the base: the join moves only buckets with changes
    kept = _base(spark, path, layout, dirty).join(newest.select(layout.key), layout.key, "left_anti")
    merged = kept.unionByName(newest.filter(~F.col(_DELETED)).drop(_DELETED, _VERSION))
    return base.unionByName(merged) if wanted - dirty else merged


def compact(spark: SparkSession, path: str, share: float = 0.2) -> int:
    """Rewrite the buckets whose changes are at least ``share`` of their base's rows. Returns how many were rewritten; the rest keep their files."""
    layout = _layout(spark, path)
    touched = layout.changed()
    dirty = set().union(*touched.values())
    if not dirty:
        return 0
    size = lambda df, name: df.groupBy("_bucket").agg(F.count(F.lit(1)).alias(name))
    sizes = size(_changes(spark, path, layout, dirty), "n_changes").join(size(_base(spark, path, layout, dirty), "n_base"), "_bucket", "left")
    grown = sizes.filter(F.col("n_changes") >= F.lit(share) * F.coalesce("n_base", F.lit(0)))
    chosen = sorted(r["_bucket"] for r in grown.select("_bucket").collect())  # numbers of buckets
    if chosen:
        merged = _read(spark, path, layout, set(chosen)).drop("_bucket")
        _commit(merged, path, "compact", layout.key, layout.n_buckets, chosen)
    return len(chosen)
