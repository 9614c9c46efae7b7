"""The journaled table and the change feed: writers that die, torn batches, folds, restarts, lost changes."""

import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from kindred.sources import tables
from kindred.sources.change_feed import ChangeFeed
from kindred.sources.journaled import JournaledTable
from kindred.streaming import listing

SCHEMA = "path string, size long, note string"


def changes(spark, rows):
    return spark.createDataFrame(rows, SCHEMA + ", _op string, _sequence long").coalesce(2)


def content(table):
    return sorted((r.path, r.size, r.note) for r in table.read().collect())


def test_reads_are_those_of_a_plain_replay(spark, tmp_path):
    rng = random.Random(4)
    table, plain = JournaledTable(spark, f"file://{tmp_path}/t", SCHEMA, ["path"], share=0.5), {}
    assert content(table) == []
    for number in range(6):
        rows = []
        for n in range(12):
            key, gone = rng.choice("abcdefgh"), rng.random() < 0.3
            rows.append((key, None if gone else rng.randrange(9), rng.choice([None, "x"]), "delete" if gone else "upsert", n))
            plain.pop(key, None) if gone else plain.__setitem__(key, rows[-1][1:3])
        rng.shuffle(rows)
        assert table.append(changes(spark, rows), name=str(number))
        assert not table.append(changes(spark, rows[:3]), name=str(number))
        assert content(table) == sorted((k, *v) for k, v in plain.items())
    kinds = [e["kind"] for e in table.entries()]
    assert kinds[0] == "base" and len(os.listdir(tmp_path / "t")) == len(kinds) + 1  # folded ones are gone


def test_a_writer_that_dies_and_torn_batches(spark, tmp_path):
    table = JournaledTable(spark, f"file://{tmp_path}/t", SCHEMA, ["path"], share=100)
    table.append(changes(spark, [("a", 1, None, "upsert", 0), ("b", 2, None, "upsert", 0)]))
    enter = table._enter
    table._enter = lambda *a: (_ for _ in ()).throw(OSError("killed"))  # between the rows and the entry
    with pytest.raises(OSError):
        table.append(changes(spark, [("c", 3, None, "upsert", 0)]))
    table._enter = enter
    assert content(table) == [("a", 1, None), ("b", 2, None)]
    table.append(changes(spark, [("b", 0, None, "delete", 0), ("d", 4, None, "upsert", 0)]))
    table.append(changes(spark, [("e", 5, None, "upsert", 0)]))
    assert content(table) == [("a", 1, None), ("d", 4, None), ("e", 5, None)]
    entry = table.entries()[-2]
    folder = tmp_path / "t" / entry["folder"]
    for name in os.listdir(folder):
        if name.startswith("part"):
            (folder / name).write_bytes((folder / name).read_bytes()[:-9])
        elif name.endswith(".crc"):
            os.remove(folder / name)
    assert content(table) == [("a", 1, None), ("b", 2, None)]  # the torn batch and what came after it
    table.append(changes(spark, [("z", 9, None, "upsert", 0)]))
    assert content(table) == [("a", 1, None), ("b", 2, None), ("z", 9, None)]
    shutil.rmtree(tmp_path / "t" / table.entries()[-1]["folder"])
    assert content(table) == [("a", 1, None), ("b", 2, None)]


def test_save_writes_what_changed_and_nothing_else(spark, tmp_path):
    table = JournaledTable(spark, f"file://{tmp_path}/t", SCHEMA, ["path"], share=100)
    now = spark.createDataFrame([("a", 1, None), ("b", None, "x"), ("c", 3, "y")], SCHEMA)
    assert table.save(now) == 3 and table.save(now) == 0 and len(table.entries()) == 1
    assert table.save(now.where("path <> 'a'").withColumn("size", F.coalesce("size", F.lit(7)).cast("long"))) == 2
    assert content(table) == [("b", 7, "x"), ("c", 3, "y")]
    assert table.prune(spark.createDataFrame([("c",), ("q",)], "path string")) == 1 and content(table) == [("c", 3, "y")]
    table.fold()
    assert content(table) == [("c", 3, "y")] and [e["kind"] for e in table.entries()] == ["base"]


def test_current_with_two_changes_of_a_key_in_a_batch(spark):
    snapshot = spark.createDataFrame([("a", 1), ("b", 2), (None, 0)], "k string, v int")
    rows = spark.createDataFrame([("a", 5, 1, "delete", 2), ("a", 6, 1, "upsert", 1), ("b", 7, 1, "upsert", 2), ("b", 8, 1, "delete", 1), ("c", 1, 0, "upsert", 0), ("c", 2, 1, "upsert", 0)], "k string, v int, batch int, op string, n int")
    assert sorted(tuple(r) for r in tables.current(snapshot, rows, "k", sequence="n").collect() if r.k) == [("b", 7), ("c", 2)]


def test_a_stream_into_a_journaled_table(spark, tmp_path):
    table = JournaledTable(spark, f"file://{tmp_path}/t", SCHEMA, ["path"])
    for n, rows in enumerate([[("a", 1, None, "upsert", 1), ("a", 2, None, "upsert", 2)], [("a", 0, None, "delete", 3), ("b", 4, None, "upsert", 4)]]):
        changes(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        read = spark.readStream.schema(SCHEMA + ", _op string, _sequence long").parquet(f"{tmp_path}/in").withColumnRenamed("_sequence", "turn")
        listing.keep_table(read, table, f"{tmp_path}/c", "turn").awaitTermination()
        assert content(table) == [[("a", 2, None)], [("b", 4, None)]][n]


def segment(folder, journal, first, paths):
    os.makedirs(folder, exist_ok=True)
    name = f"{journal}-{first}-{first + len(paths)}.jsonl"
    (folder / name).write_text("".join(json.dumps({"usn": first + k, "path": p, "reason": 1}) + "\n" for k, p in enumerate(paths)))
    return folder / name


def test_the_change_feed(spark, tmp_path):
    spark.dataSource.register(ChangeFeed)
    folder = tmp_path / "journal"
    old = segment(folder, "1", 0, ["a", "b"])

    def read(onloss="fail"):
        frame = spark.readStream.format("change_feed").option("path", str(folder)).option("onloss", onloss).load()
        out = str(tmp_path / "out")
        frame.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r.journal, r.usn, r.kind, r.path) for r in spark.read.parquet(out).collect())

    seen = [("1", 0, "change", "a"), ("1", 1, "change", "b")]
    assert read() == seen
    second = segment(folder, "1", 2, ["c", "d", "e"])
    os.remove(old)  # overwritten, but after it was read
    seen += [("1", 2, "change", "c"), ("1", 3, "change", "d"), ("1", 4, "change", "e")]
    assert read() == seen and read() == seen  # a restart reads on from where it was
    os.remove(second)
    segment(folder, "1", 7, ["h"])
    with pytest.raises(Exception, match="are not all in"):
        read()
    seen += [("1", 7, "change", "h"), ("1", 7, "whole", None)]
    assert read("restart") == sorted(seen)
    segment(folder, "2", 0, ["x"])  # the journal was made again
    with pytest.raises(Exception, match="are not all in"):
        read()
    assert read("restart") == sorted([*seen, ("2", 0, "whole", None), ("2", 0, "change", "x")], key=lambda r: (*r[:3], r[3] or ""))
