"""Session helpers: shared scratch folder and lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where the setting and the context's own folder are both missing (local tests) a
    temporary folder is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-tokenmill-"))
        current = context.getCheckpointDir()
    return current


#: Scratch paths of this process, deleted by ``release`` or at its end.
_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder. It is deleted when the driver's process ends."""
    if not _SCRATCH:
        atexit.register(release)
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def release() -> None:
    """Delete all scratch paths; DataFrames that still read them can no longer be evaluated."""
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        with contextlib.suppress(Exception):  # the JVM may be gone before the process
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write the rows to the shared folder and read them back.

    The written table survives lost executors, keeps only the needed columns on disk and gives
    later jobs a short plan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Put a scan of few or uneven row groups on all cores before work that is heavy per row.

    A scan of at least as many files as cores is left alone without looking at it. Below that,
    a count that reads no column tells how many tasks have rows, and how many the largest has: as many rounds of it
    as the cores need may take a fifth longer than evenly dealt rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    tasks = df.select(F.spark_partition_id().alias("p")).groupBy("p").count()
    filled, largest, rows = tasks.agg(F.count(F.lit(1)), F.max("count"), F.sum("count")).first()
    if not rows or -(-filled // cores) * largest * cores <= 1.2 * rows:
        return df
    return df.repartition(2 * cores, *key)
