"""Session settings and tables written to the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, tempfile.TemporaryDirectory] = {}


def session(app: str = "creditgrain", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for.

    Timestamps are TIMESTAMP_NTZ throughout, so no result depends on the time
    zone; it is pinned for readers that print local timestamps.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session may do without it: there a temporary folder that
    lives as long as the process is used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.TemporaryDirectory(prefix="creditgrain-")
        context.setCheckpointDir(_local_dirs[app].name)
    return _local_dirs[app].name


def new_shared_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def store(df: DataFrame, name: str = "table", **options: str | int) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The stored table ends the lineage: later jobs see the same bits however
    often their tasks are retried, and scans of it prune columns and rows.
    ``options`` go to the parquet writer.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, name)
    df.write.options(**options).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``store`` wrote and nothing will read again.

    The shuffle files of finished jobs go too (``sweep``).
    """
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        sweep(tables[0].sparkSession)


def sweep(spark: SparkSession) -> None:
    """Have the shuffle files of finished jobs removed.

    Spark does so when the driver collects its garbage, which may be half an hour later.
    """
    spark._jvm.System.gc()
