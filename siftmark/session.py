"""Session helpers: the shared folder and written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def runs_locally(spark: SparkSession) -> bool:
    """Whether driver and tasks share one process and so one disk (not local-cluster)."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a ``local[...]`` session may fall back to a temporary folder of its own.
    """
    named = (
        spark.conf.get(_SETTING, None)
        or spark.sparkContext.getConf().get(_SETTING)
        or spark.sparkContext.getCheckpointDir()
    )
    if named:
        return named.rstrip("/")
    if not runs_locally(spark):
        raise ValueError(f"set {_SETTING} to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="siftmark-")
    return _local_dirs[app]


def _app_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/siftmark-{spark.sparkContext.applicationId}"


def table_path(spark: SparkSession, name: str) -> str:
    return f"{_app_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_tables(spark: SparkSession) -> None:
    """Delete every table this application wrote with :func:`materialize`."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_app_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Cuts lineage without tying the data to any executor, and unlike a checkpoint
    keeps later reads columnar (pruning and filter pushdown).
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """How many partitions ``rows`` deserve: every core busy, none nearly empty.

    ``spark.sql.shuffle.partitions`` is the ceiling, so on large data it decides.
    """
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(most, max(spark.sparkContext.defaultParallelism, rows // rows_each)))


def local_rows(spark: SparkSession, **columns: list) -> DataFrame:
    """A handful of driver-side rows as a local relation.

    Unlike rows shipped as an RDD, Catalyst folds projections over it while
    planning, so collecting them starts no job.
    """
    return spark.createDataFrame(pa.table(columns))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of a session, once.

    Needed when it is run from a checkout rather than installed on every node.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    source = os.path.dirname(os.path.abspath(__file__))
    # The driver serves the archive for as long as the application runs.
    archive = os.path.join(tempfile.mkdtemp(prefix="siftmark-"), "siftmark.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for base, _, names in os.walk(source):
            for name in (n for n in names if n.endswith(".py")):
                path = os.path.join(base, name)
                out.write(path, os.path.relpath(path, os.path.dirname(source)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
