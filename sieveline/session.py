"""Session defaults and the few helpers every job shares."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "sieveline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow; ``master`` only where none is configured."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the cluster names.

    ``spark.checkpoint.dir`` of the session wins; a folder of our own is set only where none is
    configured, as in local tests.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(shared or local_folder(spark))
    return df.checkpoint(eager=True)


def local_folder(spark: SparkSession) -> str:
    """A folder of this machine, for sessions that run on it alone; a cluster must name a shared one."""
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("SIEVELINE_SCRATCH", tempfile.gettempdir()))


def spread(df: DataFrame, *keys: str, minimum: int = 0) -> DataFrame:
    """Repartition CPU-heavy work over all cores when the scan gives too few splits.

    Small files give one split; Python-heavy stages then use one core. The row count of a
    partition stays the same order of magnitude, so this shuffle is paid once and only for the
    columns that the stage needs.
    """
    spark = df.sparkSession
    parts = max(minimum, 2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys) if keys else df.repartition(parts)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python tasks can import it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "sieveline.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)


def spread_if_narrow(df: DataFrame) -> DataFrame:
    """``spread`` only where the scan gives fewer splits than there are cores."""
    narrow = df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism
    return spread(df) if narrow else df
