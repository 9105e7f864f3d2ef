"""Tables written once and read again."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[tuple, object] = {}


def folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, from `spark.checkpoint.dir`; a local session without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def stored(df: DataFrame) -> DataFrame:
    """The rows, written as a table to the shared folder and read again, for what is read several times."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def signature(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table, so that a changed table is not taken for the old one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files, found = fs.listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def once(spark: SparkSession, key: tuple, make: Callable[[], object], there: Callable[[object], bool] = lambda made: True) -> object:
    """What `make` returns, made once for each key of an application, and again if it is no longer there."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _MADE or not there(_MADE[key]):
        _MADE[key] = make()
    return _MADE[key]
