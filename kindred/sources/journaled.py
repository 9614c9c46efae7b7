"""A keyed table kept as a base and a journal of batches: what changed is appended, and folded in once it is a share of the base.

Layout of a folder: ``log/<number>.json``, one for each base or batch, written last and renamed into place; and the folders of Parquet
files that they name. An entry holds count and check of its rows. A batch is there once its entry is; a batch whose rows do not
check (its writer or its disk died) ends the journal, it and all after it are ignored, and the next batch takes their place.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH, SEQUENCE, OP = "_batch", "_sequence", "_op"


class JournaledTable:
    """The table of ``schema`` under ``folder``, one row a key.

    Changes are rows of the schema with ``_op`` (upsert or delete; other columns of a delete count for nothing) and, where a key
    comes more than once in a batch, ``_sequence``: the largest one counts. One writer at a time; readers need no lock.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: list[str], share: float = 0.2):
        self.spark, self.folder, self.key, self.share = spark, folder.rstrip("/"), key, share
        self.columns = spark.createDataFrame([], schema).columns
        self.schema = schema
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = lambda p: hadoop.Path(f"{self.folder}/{p}")
        self._fs = self._path("log").getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- the log --------------------------------------------------------------------------------------------------------

    def entries(self) -> list[dict]:
        """What the log names from its last base on, in order; as many as there are batches since the last fold."""
        if not self._fs.exists(self._path("log")):
            return []
        found = []
        for status in self._fs.listStatus(self._path("log")):
            name = status.getPath().getName()
            if name.endswith(".json") and not name.startswith("."):
                stream = self._fs.open(status.getPath())
                try:
                    text = bytes(stream.readAllBytes()).decode()
                finally:
                    stream.close()
                found.append(json.loads(text) | {"number": int(name.removesuffix(".json"))})
        found.sort(key=lambda e: e["number"])
        bases = [i for i, e in enumerate(found) if e["kind"] == "base"]
        return found[bases[-1] :] if bases else found

    def _enter(self, number: int, entry: dict) -> None:
        self._fs.mkdirs(self._path("log"))
        hidden = self._path(f"log/.{uuid.uuid4().hex}.json")
        out = self._fs.create(hidden, True)
        out.write(json.dumps(entry).encode())
        out.close()
        if self._fs.exists(self._path(f"log/{number:012d}.json")) or not self._fs.rename(hidden, self._path(f"log/{number:012d}.json")):
            self._fs.delete(hidden, False)
            raise RuntimeError(f"entry {number} of {self.folder} was written by someone else")

    # ---- reading --------------------------------------------------------------------------------------------------------

    def _stored(self, entries: list[dict]) -> DataFrame:
        """The rows of base and batches, each with its entry's number; files that cannot be read bring no rows."""
        kind = self.spark.createDataFrame([], self.schema).schema.add(SEQUENCE, "long").add(OP, "string")
        read = self.spark.read.schema(kind).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
        there = [e for e in entries if self._fs.exists(self._path(e["folder"]))]
        parts = [read.parquet(f"{self.folder}/{e['folder']}").withColumn(BATCH, F.lit(e["number"]).cast("long")) for e in there]
        empty = self.spark.createDataFrame([], kind.add(BATCH, "long"))
        return reduce(DataFrame.unionByName, parts, empty)

    def _checked(self, rows: DataFrame) -> DataFrame:
        h = F.xxhash64(*self.columns, SEQUENCE, OP)
        return rows.groupBy(BATCH).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("low"), F.bit_xor(h).alias("mixed"))

    def valid(self) -> list[dict]:
        """The entries up to the first whose rows do not check. A base that does not check is an error."""
        entries = self.entries()
        found = {r[BATCH]: f"{r['rows']}-{r['low']}-{r['mixed']}" for r in self._checked(self._stored(entries)).collect()} if entries else {}
        out = []
        for e in entries:
            if found.get(e["number"], "0-None-None") != e["check"]:
                if e["kind"] == "base":
                    raise RuntimeError(f"the base of {self.folder} does not check")
                break
            out.append(e)
        return out

    def read(self, entries: list[dict] | None = None) -> DataFrame:
        """The current rows: of each key the last change, by batch and by sequence within it. Changes of a key are combined before the shuffle."""
        rows = self._stored(self.valid() if entries is None else entries)
        last = F.max_by(F.struct(*self.columns, OP), F.struct(BATCH, SEQUENCE)).alias("_last")
        return rows.groupBy(*[F.col(k).alias(f"_key_{k}") for k in self.key]).agg(last).where(F.col("_last")[OP] == "upsert").select(*[F.col("_last")[c].alias(c) for c in self.columns])

    # ---- writing --------------------------------------------------------------------------------------------------------

    def _put(self, rows: DataFrame, kind: str, number: int, name: str | None) -> None:
        folder = f"{kind}-{number:012d}-{uuid.uuid4().hex}"  # a name of its own: what a dead writer has left is in nobody's way
        rows.write.parquet(f"{self.folder}/{folder}")
        stored = self._stored([{"folder": folder, "number": number}])
        found = self._checked(stored).first()
        size = int(self._fs.getContentSummary(self._path(folder)).getLength())
        check = f"{found['rows']}-{found['low']}-{found['mixed']}" if found else "0-None-None"
        self._enter(number, {"kind": kind, "folder": folder, "rows": found["rows"] if found else 0, "check": check, "bytes": size, "name": name})

    def append(self, changes: DataFrame, name: str | None = None) -> bool:
        """Adds a batch; False if one of this ``name`` (say, a stream's batch id) is there already. Folds where it is due."""
        entries = self.valid()
        if name is not None and any(e.get("name") == name for e in entries):
            return False
        # what stands in the log after the last whole batch does not count any more
        keep = entries[-1]["number"] if entries else -1
        for e in self.entries():
            if e["number"] > keep:
                self._fs.delete(self._path(f"log/{e['number']:012d}.json"), False)
                self._fs.delete(self._path(e["folder"]), True)
        sequence = F.col(SEQUENCE).cast("long") if SEQUENCE in changes.columns else F.lit(0).cast("long")
        self._put(changes.select(*self.columns, sequence.alias(SEQUENCE), OP), "delta", keep + 1, name)
        entries = self.entries()
        base = sum(e["bytes"] for e in entries if e["kind"] == "base")
        if sum(e["bytes"] for e in entries if e["kind"] == "delta") > self.share * base:
            self.fold()
        return True

    def fold(self) -> None:
        """The table written whole; names of the batches folded in stay known through the last one."""
        entries = self.valid()
        rows = self.read(entries).select(*self.columns, F.lit(0).cast("long").alias(SEQUENCE), F.lit("upsert").alias(OP))
        number = entries[-1]["number"] + 1 if entries else 0
        self._put(rows, "base", number, entries[-1].get("name") if entries else None)
        for e in entries:
            self._fs.delete(self._path(f"log/{e['number']:012d}.json"), False)
            self._fs.delete(self._path(e["folder"]), True)

    def save(self, now: DataFrame, name: str | None = None) -> int:
        """Appends what makes the table equal to ``now`` (rows new, different or gone); how many changes that were, none: nothing is written."""
        entries = self.valid()
        mark = lambda rows, c: rows.select(*self.columns, F.xxhash64(*self.columns).alias(c))
        a, b = (d.select([F.col(c).alias(f"{x}_{c}") for c in d.columns]) for x, d in (("old", mark(self.read(entries), "hash")), ("new", mark(now, "hash"))))
        same = reduce(lambda p, q: p & q, [F.col(f"old_{k}").eqNullSafe(F.col(f"new_{k}")) for k in self.key])
        met = a.join(b, same, "full").where(~F.col("old_hash").eqNullSafe(F.col("new_hash")))
        gone = F.col("new_hash").isNull()
        from kindred.operators.kept import forget, written

        changes = written(met.select(*[F.when(gone, F.col(f"old_{c}")).otherwise(F.col(f"new_{c}")).alias(c) for c in self.columns], F.when(gone, "delete").otherwise("upsert").alias(OP)), "changes")
        n = changes.count()
        if n:
            self.append(changes, name)
        forget(changes)
        return n

    def prune(self, keep: DataFrame) -> int:
        """Takes out the keys that ``keep`` does not hold (a sidecar store is cut to the paths of its table); how many."""
        kept = self.read().join(keep.select(*self.key).distinct(), self.key, "left_semi")
        return self.save(kept)
