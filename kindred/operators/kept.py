"""Intermediate tables in the folder that driver and executors share: they cut the lineage, survive lost executors, and are deleted again."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only in local mode a temporary folder stands in for an unset one."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir", None):
        path = spark._jvm.org.apache.hadoop.fs.Path(found)  # a path without a scheme is in the default file system
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-kindred-", dir="/tmp")
    return _OWN[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, from a table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def forget(*frames: DataFrame | None) -> None:
    """Delete the tables behind frames of ``written`` once all that was derived from them is written itself."""
    for df in frames:
        if df is not None and (path := _PATHS.pop(df, None)):
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
