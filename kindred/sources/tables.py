"""Snapshots with change batches, caches, listings, and the files that results go to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, size, modified of all files below a folder; contents are not read unless asked for."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return read.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def current(snapshot: DataFrame, changes: DataFrame, key: str, batch: str = "batch", op: str = "op", sequence: str | None = None) -> DataFrame:
    """The snapshot after the changes (op upsert or delete): of each key the last row, by batch and by ``sequence`` within it.

    The changes of a key are combined before the shuffle, so a key with very many is no task's burden. Two changes of one key in
    one batch need a sequence; without one, the row that sorts last among them counts, so the result is the same on every run.
    """
    columns = snapshot.columns
    order = F.col(sequence).cast("long") if sequence else F.lit(0).cast("long")
    every = snapshot.select(*columns, F.lit(-1).cast("long").alias("_batch"), F.lit(0).cast("long").alias("_sequence"), F.lit("upsert").alias("_op"))
    every = every.unionByName(changes.select(*columns, F.col(batch).cast("long").alias("_batch"), order.alias("_sequence"), F.col(op).alias("_op")))
    row = F.struct("_op", *columns)
    last = every.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.struct("_batch", "_sequence", row) if not sequence else F.struct("_batch", "_sequence")).alias("_last"))
    return last.where(F.col("_last._op") == "upsert").select(*[F.col("_last")[c].alias(c) for c in columns])


def fold_due(base_bytes: int, delta_bytes: int, share: float = 0.2) -> bool:
    """Is it time to write the snapshot anew."""
    return delta_bytes > share * base_bytes


def cached(rows: DataFrame, cache: DataFrame, keys: tuple[str, ...] = ("path", "size", "modified")) -> DataFrame:
    """The rows with the cache's columns where path, size and time are all equal."""
    return rows.join(cache, list(keys), "left")


def refreshed(old: DataFrame, new: DataFrame, key: str, size: str, modified: str, digest: str) -> DataFrame:
    """(key, action): add, remove, analyse (the content changed), date (only the time did) or keep."""
    a, b = old.select(key, *[F.col(c).alias(f"old_{c}") for c in (size, modified, digest)], F.lit(1).alias("_old")), new.select(key, *[F.col(c).alias(f"new_{c}") for c in (size, modified, digest)], F.lit(1).alias("_new"))
    action = (
        F.when(F.col("_old").isNull(), "add")
        .when(F.col("_new").isNull(), "remove")
        .when(F.col(f"old_{digest}").eqNullSafe(F.col(f"new_{digest}")) & F.col(f"old_{size}").eqNullSafe(F.col(f"new_{size}")), F.when(F.col(f"old_{modified}").eqNullSafe(F.col(f"new_{modified}")), "keep").otherwise("date"))
        .otherwise("analyse")
    )
    return a.join(b, key, "full").select(key, action.alias("action"))


def moved(old: DataFrame, new: DataFrame, key: str, size: str, digest: str) -> DataFrame:
    """(old, new) of rows that are gone from one side and stand under another key on the other, if the match is unique."""
    gone = old.join(new.select(key), key, "left_anti").select(F.col(key).alias("old"), size, digest)
    come = new.join(old.select(key), key, "left_anti").select(F.col(key).alias("new"), size, digest)
    # counted on either side first, so that a content with many copies is one row before the join
    once = lambda rows, c: rows.groupBy(size, digest).agg(F.min(c).alias(c), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    met = once(gone, "old").join(once(come, "new"), [size, digest])
    alone = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c)) == 1
    return met.withColumns({"_o": alone("old"), "_n": alone("new")}).where("_o and _n").select("old", "new")


def stamp(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row that is the same for equal listings, whatever their order: count and sums of the rows' hashes."""
    h = F.xxhash64(*columns)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("low"), F.bit_xor(h).alias("mixed"))


def write_results(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """Results ordered by group and falling similarity, as csv with a header or json lines."""
    ordered = rows.orderBy("group_id", F.desc("similarity"), "path")
    if kind == "csv":
        ordered.write.option("header", "true").csv(path)
    else:
        ordered.write.json(path)
