"""Tables that are written again only where they changed: content stamps for groups, partitions and whole listings.

A stamp is the same for equal rows in any order: their number and two sums over a digest of each row, so it is made by a combining
aggregate, whatever a group holds. Nulls, texts and numbers are told apart by type, place and length.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of a row's digest in each of the two sums: 60 bits, so that a sum over 10**20 rows is still exact as a decimal(38).
_DIGITS = 15


def row_text(columns: list[str | Column]) -> Column:
    """The row as one text: each value with its length before it, ``-`` for null."""
    own = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in own])


def sums(columns: list[str | Column]) -> list[Column]:
    """The aggregates behind a stamp: rows, high and low (decimals)."""
    digest = F.sha2(row_text(columns), 256)
    part = lambda at: F.sum(F.conv(F.substring(digest, at, _DIGITS), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(part(1), F.lit(0)).cast("decimal(38,0)").alias("high"), F.coalesce(part(1 + _DIGITS), F.lit(0)).cast("decimal(38,0)").alias("low")]


def stamps(rows: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """(group columns, rows, stamp) of each group: equal stamps, equal rows."""
    text = F.sha2(F.concat_ws(" ", F.col("rows").cast("string"), F.col("high").cast("string"), F.col("low").cast("string")), 256)
    return rows.groupBy(*group).agg(*sums(columns)).select(*group, "rows", F.substring(text, 1, 32).alias("stamp"))


def stamp(rows: DataFrame, columns: list[str]) -> str:
    """The stamp of a whole listing; an empty one has a stamp, too."""
    found = rows.agg(*sums(columns)).first()
    return f"{found['rows']}-{found['high']}-{found['low']}"


def same(a: DataFrame, b: DataFrame, columns: list[str]) -> bool:
    """Are two listings the same rows, repeated ones as often; the order counts for nothing."""
    return stamp(a, columns) == stamp(b, columns)


def changed_groups(old: DataFrame, new: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, change): add, remove or change, of groups whose stamps differ. Only stamps are joined."""
    a, b = (stamps(d, [group], columns).select(group, F.col("stamp").alias(name)) for d, name in ((old, "_old"), (new, "_new")))
    change = F.when(F.col("_old").isNull(), "add").when(F.col("_new").isNull(), "remove").otherwise("change")
    a, b = a.withColumnRenamed(group, "_g_old"), b.withColumnRenamed(group, "_g_new")
    met = a.join(b, F.col("_g_old").eqNullSafe(F.col("_g_new")), "full").where(~F.col("_old").eqNullSafe(F.col("_new")))
    return met.select(F.when(F.col("_new").isNull(), F.col("_g_old")).otherwise(F.col("_g_new")).alias(group), change.alias("change"))


def fetched(asked: str | None, kept: str, listing: DataFrame) -> DataFrame | None:
    """What a device answers that is asked for its listing: None if the asker holds it already (``asked`` is the stamp it kept)."""
    return None if asked == kept else listing


@dataclass
class Saved:
    """What a save did: partitions in all and written, and the bytes of the files written."""

    parts: int
    written: int
    bytes: int


class StampedTable:
    """A table in ``parts`` partitions by the hash of ``group``; a save writes those whose stamps changed and leaves the others' files.

    Layout: a folder of Parquet files for each partition written, under a name of its own, and ``manifest.json``, which names
    the folders, is written aside and renamed into place last: a reader sees the state before or after a save, and what a dead writer left is
    in nobody's way. ``build`` says by which rules the rows were made; a table of other rules is written whole, and ``load`` sets
    it aside (None). The facts of a save (say, when and how long) are in the manifest alone. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, group: str, parts: int = 64, build: str = "1"):
        self.spark, self.folder, self.group, self.parts, self.build = spark, folder.rstrip("/"), group, parts, build
        hadoop = spark._jvm.org.apache.hadoop
        self._path = lambda p: hadoop.fs.Path(f"{self.folder}/{p}")
        self._fs = self._path("x").getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict | None:
        # the copy before counts while a save puts the new one in its place
        for name in ("manifest.json", "manifest.before.json"):
            if self._fs.exists(self._path(name)):
                stream = self._fs.open(self._path(name))
                try:
                    return json.loads(bytes(stream.readAllBytes()).decode())
                finally:
                    stream.close()
        return None

    def _enter(self, manifest: dict) -> None:
        hidden, place, before = self._path(f".{uuid.uuid4().hex}.json"), self._path("manifest.json"), self._path("manifest.before.json")
        out = self._fs.create(hidden, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        if self._fs.exists(place):
            self._fs.delete(before, False)
            self._fs.rename(place, before)
        if not self._fs.rename(hidden, place):
            raise RuntimeError(f"the manifest of {self.folder} could not be put in its place")
        self._fs.delete(before, False)

    def save(self, rows: DataFrame, facts: dict | None = None) -> Saved:
        """Writes the partitions that changed; a save of equal rows writes no file of data. A column ``_part`` gives way.

        The rows are read twice, for stamps and for files: they must come out the same, so pass a table that is written.
        """
        own = [c for c in rows.columns if c != "_part"]
        dealt = rows.select(*own).withColumn("_part", F.pmod(F.xxhash64(self.group), F.lit(self.parts)).cast("int"))
        now = {r["_part"]: f"{r['rows']}-{r['high']}-{r['low']}" for r in dealt.groupBy("_part").agg(*sums([F.to_json(F.struct(c)) for c in own])).collect()}  # one row a partition
        # whether a column may be null is no part of it: that differs between a table made and one read
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*own).schema)
        last = self.manifest()
        usable = last if last and last["build"] == self.build and last["schema"] == schema and last["of"] == self.parts else None
        held = {int(k): v for k, v in usable["parts"].items()} if usable else {}
        fresh = sorted(p for p, s in now.items() if held.get(p, {}).get("stamp") != s)
        size, kept = 0, {p: e for p, e in held.items() if p in now and p not in fresh}
        if fresh:
            run = f"rows-{uuid.uuid4().hex}"
            # rebalanced, not repartitioned: a partition with a very large group is split over tasks
            dealt.where(F.col("_part").isin(fresh)).hint("rebalance", "_part").write.partitionBy("_part").parquet(f"{self.folder}/{run}")
            size = int(self._fs.getContentSummary(self._path(run)).getLength())
            kept |= {p: {"stamp": now[p], "folder": f"{run}/_part={p}"} for p in fresh}
        named = {e["folder"] for e in kept.values()}
        dropped = sorted({e["folder"] for e in (last or {"parts": {}})["parts"].values()} - named)
        self._enter({"build": self.build, "schema": schema, "of": self.parts, "parts": {str(p): kept[p] for p in sorted(kept)}, "dropped": dropped, "facts": facts or {}})
        # what this save took out of the table stays until the next one, for those who are reading it
        for folder in (last or {"dropped": []})["dropped"]:
            self._fs.delete(self._path(folder), True)
        return Saved(len(now), len(fresh), size)

    def load(self) -> DataFrame | None:
        """The rows; None if there are none or other rules made them."""
        last = self.manifest()
        if last is None or last["build"] != self.build:
            return None
        schema = last["schema"]
        folders = [f"{self.folder}/{e['folder']}" for e in last["parts"].values()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def facts(self) -> dict:
        return (self.manifest() or {"facts": {}})["facts"]


# ---- results as JSON -------------------------------------------------------------------------------------------------------


def to_sets(rows: DataFrame, group: str, fields: list[str], name: str = "json") -> DataFrame:
    """(group, json): a set with its items nested, one text each, items in the order of their fields.

    For sets that are read by people and fit in a row; what may be larger is exchanged flat (``to_lines``).
    """
    items = F.array_sort(F.collect_list(F.struct(*fields)))
    return rows.groupBy(group).agg(items.alias("items")).select(group, F.to_json(F.struct(F.col(group).alias("group"), "items"), {"ignoreNullFields": "false"}).alias(name))


def from_sets(texts: DataFrame, json_column: str, group_type: str, fields: str) -> DataFrame:
    """(group, fields) of nested sets: one row an item; a text that is no such set brings no rows."""
    read = F.from_json(json_column, f"group {group_type}, items array<struct<{fields}>>")
    return texts.select(read.alias("_s")).select(F.col("_s.group").alias("group"), F.explode("_s.items").alias("_i")).select("group", "_i.*")


def to_lines(rows: DataFrame, path: str) -> None:
    """A whole table as JSON lines, nulls kept."""
    rows.write.option("ignoreNullFields", "false").json(path)


def from_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table again; a line that does not read as one of its rows is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)

