"""Places and cuts of lineage that survive the loss of an executor."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import regex
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a folder of our own is made, but only if driver and
    executors are one process on one machine; on a cluster it is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not named and not regex.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="archivolt-"))
        current = context._jsc.sc().getCheckpointDir()
    return named or current.get()


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = os.path.join(shared_dir(spark), f"{what}-{uuid.uuid4().hex}")
    if not _made:
        atexit.register(_clear, spark)
    _made.append(path)
    return path


_made: list[str] = []


def _clear(spark: SparkSession) -> None:
    """Remove what scratch has named, as far as the session is still there."""
    try:
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _made:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there (a reliable checkpoint)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Spread a small input over the cores for costly per-row work.

    Inputs that already have a partition for every core stay as they are, so
    large tables aren't shuffled.
    """
    cores = least or df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores * 2)
