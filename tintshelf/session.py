"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "tintshelf", master: str | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and the bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    ship_package(spark)
    return spark


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition small rows that are about to fan out, over the session's shuffle partitions.

    Adaptive coalescing looks at input bytes and would put them all into one task; a given number is kept.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def spread_scan(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows that come in fewer partitions than there are cores, before costly work on each of them.

    A file of one large row group is one task; where a scan has partitions enough, nothing is shuffled.
    """
    cores = min(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread(df, *keys) if df.rdd.getNumPartitions() < cores else df


def new_folder(spark: SparkSession) -> str:
    """Path of a new folder under ``spark.checkpoint.dir`` of the session (a shared folder on a cluster).

    Only a local session without it gets a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per session: they need not find it on a path of their own."""
    context = spark.sparkContext
    if getattr(context, "_tintshelf_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.join(tempfile.mkdtemp(prefix="spark-"), "tintshelf_code.zip")  # Spark's file server hands it out from here
    with zipfile.ZipFile(name, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.join("tintshelf", os.path.relpath(os.path.join(folder, f), root)))
    context.addPyFile(name)
    context._tintshelf_shipped = True
