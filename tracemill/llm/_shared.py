"""Tables written in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir, deleted when this process ends.

    Where that is unset, a local session (tests on one machine) gets a temporary
    folder, which is then set; on a cluster it is an error, as executors can't
    see the driver's own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tracemill-')}"
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/tracemill-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended already
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df hasn't."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """df as a table written in the shared folder: its lineage ends there, and the loss of an executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    # the shuffles behind the table are of no more use; Spark deletes their files once the driver's garbage is collected
    gc.collect()
    spark = df.sparkSession
    spark.range(1).repartition(1).count()  # Spark holds on to the plan that it ran last
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has at most so many rows (of a few numbers each); otherwise the join shuffles."""
    return F.broadcast(df) if df.count() <= most else df
