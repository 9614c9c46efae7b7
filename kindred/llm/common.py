"""What several operators of this subpackage need: tables, the shared folder, written intermediates."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only in local mode, where one machine does all, a
    temporary folder stands in for an unset one; a cluster without the setting is an error.
    """
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


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the tables behind frames of ``written`` once all that was derived from them is written itself."""
    for df in frames:
        if path := _WRITTEN.pop(df, None):
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds (null ids: fold -1)."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds, F.lit(-1))


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column | None, most: int) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled rows, the same ones on every run: a documented bound for fitting.

    Rows without an id, a text or a label teach nothing. ``train`` keeps the rows that may be learnt from. Of rows
    that share a doc_id the least text counts, so repeated ids can't bring more rows than ``most``.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    marks = marks.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    if train is not None:
        marks = marks.where(train)
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(marks, "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
