"""Derived tables that are written once in a session's shared folder and read by many jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: dict[tuple[str, ...], str] = {}


def folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where none is set in local mode (tests), a local one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stamp(spark: SparkSession, path: str) -> str:
    """Size and time of change of a file or folder, which tell whether it is still the same."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return f"{files.getContentSummary(at).getLength()} {files.getFileStatus(at).getModificationTime()}"


def once(spark: SparkSession, make: Callable[[], DataFrame], source: str, *key: str) -> DataFrame:
    """The table of ``make``, written at the first call with this key in this application.

    It is written anew where ``source``, the file that it is made from, has changed since.
    """
    key = (spark.sparkContext.applicationId, source, stamp(spark, source), *key)
    if key not in _written:
        path = f"{folder(spark)}/idweft-{uuid.uuid4().hex}"
        make().write.parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])
