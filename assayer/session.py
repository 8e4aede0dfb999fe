"""Session helpers: a local session for tests and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "assayer", **conf: str) -> SparkSession:
    """A local session with the settings tests and bench use; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def with_package(spark: SparkSession) -> SparkSession:
    """The session, whose Python workers look for this package where the driver found it; on other machines ship it with ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(x for x in (root, known.get("PYTHONPATH", "")) if x)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    Reads ``spark.checkpoint.dir``. A folder of our own is made only in local mode; on a cluster a
    missing setting is an error, because executors could not see a driver-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        current = tempfile.mkdtemp(prefix="assayer-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, for tables a job writes on the way."""
    return f"{checkpoint_dir(spark).rstrip('/')}/assayer-{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, most: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder, in ``most`` files at most, and read it back.

    Loops keep a short plan, lost executors cost no recomputation, and later joins know the table's real size,
    so a small frontier is broadcast and the large side stays where it is.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    (df.coalesce(most) if most else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
