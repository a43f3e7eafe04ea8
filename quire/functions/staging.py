"""Tables in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only where that is unset and driver and executors are one process, a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
        where = _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="quire-"))
    return where.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: an executor lost later costs no recomputation of what led to the table.
    The files go when the driver ends.
    """
    return stage_at(df, name)[0]


def stage_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``stage``, with the path, for tables that are dropped before the driver ends."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path), path


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when the driver ends."""
    path = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}-{name}"
    atexit.register(drop, spark, path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone; the folder's owner cleans up
        return
