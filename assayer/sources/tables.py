"""Assets as tables: inventory, metadata, schema fields, sampled scans and sample rows."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from assayer import schemas


@dataclass(frozen=True)
class Asset:
    """One table or view to look at. ``path`` is read with ``format``; without a path it is a catalog table."""

    project_id: str
    dataset_id: str
    table_id: str
    path: str | None = None
    format: str = "parquet"
    table_type: str = "TABLE"
    description: str = ""
    labels: dict[str, str] = field(default_factory=dict)

    @property
    def id(self) -> str:
        return f"{self.project_id}.{self.dataset_id}.{self.table_id}"

    def read(self, spark: SparkSession) -> DataFrame:
        if self.path:
            return spark.read.format(self.format).load(self.path)
        return spark.table(f"{self.dataset_id}.{self.table_id}")


def list_catalog(spark: SparkSession, project_id: str = "spark_catalog") -> list[Asset]:
    """Every table and view the session catalog knows: names only, no data is read."""
    found = []
    for database in spark.catalog.listDatabases():
        for table in spark.catalog.listTables(database.name):
            if table.isTemporary:
                continue
            kind = "VIEW" if table.tableType == "VIEW" else "EXTERNAL" if table.tableType == "EXTERNAL" else "TABLE"
            found.append(Asset(project_id, database.name, table.name, table_type=kind, description=table.description or ""))
    return found


def inventory(spark: SparkSession, assets: Iterable[Asset]) -> DataFrame:
    """The asset list as a frame, for the label, exclusion and view filters."""
    rows = [
        (a.project_id, a.dataset_id, a.table_id, a.table_type, a.path, a.format, a.description, a.labels)
        for a in assets
    ]
    return spark.createDataFrame(rows, schemas.ASSETS)


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def table_metadata(df: DataFrame, asset: Asset) -> DataFrame:
    """One row of core facts. The row count reads file footers only; no column is decoded."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(asset.project_id).alias("project_id"),
        F.lit(asset.dataset_id).alias("dataset_id"),
        F.lit(asset.table_id).alias("table_id"),
        F.lit(asset.table_type).alias("table_type"),
        "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
    )


def file_facts(spark: SparkSession, asset: Asset) -> DataFrame:
    """Bytes, file count and first and last file time. The content column is not selected, so no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(asset.path)
    return files.agg(
        F.sum("length").alias("size_bytes"),
        F.count(F.lit(1)).alias("file_count"),
        F.min("modificationTime").alias("created"),
        F.max("modificationTime").alias("last_modified"),
    ).select(F.lit(asset.id).alias("asset_id"), "*")


@dataclass(frozen=True)
class Field:
    path: str
    name: str
    ordinal: int
    depth: int
    data_type: T.DataType
    mode: str
    description: str = ""

    @property
    def type_name(self) -> str:
        if isinstance(self.data_type, T.ArrayType):
            return _type_name(self.data_type.elementType)
        return _type_name(self.data_type)

    @property
    def column(self) -> Column:
        return F.col(".".join(f"`{part}`" for part in self.path.split("\x00")))

    @property
    def dotted(self) -> str:
        return self.path.replace("\x00", ".")


def _type_name(data_type: T.DataType) -> str:
    return "struct" if isinstance(data_type, T.StructType) else data_type.simpleString()


def fields(schema: T.StructType, recursive: bool = True) -> list[Field]:
    """The schema as a flat list; nested fields follow their parent with dotted names.

    Fields inside arrays are listed but have one value per element, so they are not profiled.
    """
    out: list[Field] = []

    def walk(struct: T.StructType, prefix: str, depth: int) -> None:
        for f in struct.fields:
            path = f"{prefix}\x00{f.name}" if prefix else f.name
            repeated = isinstance(f.dataType, T.ArrayType)
            mode = "REPEATED" if repeated else "NULLABLE" if f.nullable else "REQUIRED"
            out.append(Field(path, f.name, len(out) + 1, depth, f.dataType, mode, (f.metadata or {}).get("comment", "")))
            inner = f.dataType.elementType if repeated else f.dataType
            if isinstance(inner, T.StructType) and (recursive or depth == 0):
                walk(inner, path, depth + 1)

    walk(schema, "", 0)
    return out


def _inside_array(schema: T.StructType, path: str) -> bool:
    struct: T.DataType = schema
    for part in path.split("\x00")[:-1]:
        step = struct[part].dataType
        if isinstance(step, T.ArrayType):
            return True
        struct = step
    return False


def profilable(schema: T.StructType) -> list[Field]:
    """Leaf fields outside arrays; structs themselves are skipped."""
    return [
        f for f in fields(schema)
        if not isinstance(f.data_type, T.StructType) and not _inside_array(schema, f.path)
    ]


def columns_frame(spark: SparkSession, schemas_by_table: dict[str, T.StructType]) -> DataFrame:
    """One row per field of every table: schema metadata only."""
    rows = [
        (table_id, f.dotted, f.name, f.ordinal, f.depth, f.type_name, f.mode, f.description)
        for table_id, schema in schemas_by_table.items()
        for f in fields(schema)
    ]
    return spark.createDataFrame(rows, schemas.COLUMNS)


def sampled(
    df: DataFrame,
    percent: float = 100.0,
    row_filter: str | None = None,
    target_columns: list[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """The rows and columns a profile should see. Filter and sample run below the aggregate, at the scan."""
    if not 0.1 <= percent <= 100:
        raise ValueError("percent must lie between 0.1 and 100")
    if row_filter:
        df = df.filter(F.expr(row_filter))
    if target_columns:
        df = df.select(*target_columns)
    return df.sample(withReplacement=False, fraction=percent / 100.0, seed=seed) if percent < 100 else df


def _key_hash(keys: list[str]) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))


def sampled_by_key(df: DataFrame, keys: list[str], percent: float) -> DataFrame:
    """A sample that depends on the key values alone: the same rows on every run, retry and file layout."""
    limit = int(percent / 100.0 * 2**32)
    return df.filter(F.conv(F.substring(_key_hash(keys), 1, 8), 16, 10).cast("bigint") < limit)


def sample_rows(df: DataFrame, keys: list[str], size: int = 100) -> DataFrame:
    """``size`` rows spread over the table, the same on every run (a top-k, not a full sort)."""
    if not 1 <= size <= 1000:
        raise ValueError("size must lie between 1 and 1000")
    return df.orderBy(_key_hash(keys), *keys).limit(size)
