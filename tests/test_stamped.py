"""Stamped tables: what is written, what a reader sees, other rules, a writer that dies; JSON both ways; pairs from SQL."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kindred.operators import candidates, similarity
from kindred.sources import stamped

SCHEMA = "grp string, path string, size long, score double, tags array<string>"


def report(n=60, changed=()):
    rng = random.Random(4)
    rows = [(f"g{rng.randrange(n)}" if i % 3 else "hot", f"/p/{i}", rng.randrange(9), rng.random(), ["a", None][: i % 3]) for i in range(400)]
    rows += [(None, None, None, None, None), (None, None, None, None, None)]
    return [(g, p, s if i not in changed else -1, x, t) for i, (g, p, s, x, t) in enumerate(rows)]


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def content(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_a_save_writes_what_changed_and_nothing_else(spark, tmp_path):
    saved = stamped.StampedTable(spark, str(tmp_path / "t"), "grp", parts=8)
    assert saved.load() is None
    first = spark.createDataFrame(report(), SCHEMA)
    done = saved.save(first, {"at": 1})
    assert done.parts == done.written > 4 and done.bytes > 0 and content(saved.load()) == content(first)
    before = files(tmp_path / "t")
    # the same rows in another order: no file of data, but the facts of the run
    again = saved.save(first.orderBy(F.desc("path")).repartition(3), {"at": 2})
    assert (again.written, again.bytes, saved.facts()) == (0, 0, {"at": 2}) and files(tmp_path / "t") == before
    # one row: one partition
    second = spark.createDataFrame(report(changed={1}), SCHEMA)
    assert saved.save(second).written == 1
    now = files(tmp_path / "t")
    assert before.items() <= now.items() and len(now) > len(before) and content(saved.load()) == content(second)
    # what was taken out goes with the next save
    assert saved.save(second).written == 0 and not before.items() <= files(tmp_path / "t").items() and content(saved.load()) == content(second)
    # one copy less of a repeated row counts
    assert saved.save(spark.createDataFrame(report(changed={1})[:-1], SCHEMA)).written == 1
    # nothing left
    assert saved.save(first.limit(0)).parts == 0 and saved.load().count() == 0


def test_other_rules_and_other_columns_are_written_whole(spark, tmp_path):
    rows = spark.createDataFrame(report(), SCHEMA)
    stamped.StampedTable(spark, str(tmp_path / "t"), "grp", parts=4).save(rows)
    newer = stamped.StampedTable(spark, str(tmp_path / "t"), "grp", parts=4, build="2")
    assert newer.load() is None
    done = newer.save(rows)
    assert done.written == done.parts and newer.save(rows).written == 0
    done = newer.save(rows.withColumn("_part", F.lit(9)).withColumn("size", F.col("size").cast("int")))
    assert done.written == done.parts and newer.load().schema["size"].dataType.simpleString() == "int" and "_part" not in newer.load().columns


def test_a_writer_that_dies_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    saved = stamped.StampedTable(spark, str(tmp_path / "t"), "grp", parts=4)
    first = spark.createDataFrame(report(), SCHEMA)
    saved.save(first)

    def dies(manifest):
        raise RuntimeError("died")

    monkeypatch.setattr(saved, "_enter", dies)
    with pytest.raises(RuntimeError):
        saved.save(spark.createDataFrame(report(changed={1, 2, 3}), SCHEMA))
    assert content(saved.load()) == content(first)
    monkeypatch.undo()
    # between the two renames only the copy before is there
    (tmp_path / "t" / "manifest.json").rename(tmp_path / "t" / "manifest.before.json")
    assert content(saved.load()) == content(first)
    second = spark.createDataFrame(report(changed={5}), SCHEMA)
    assert saved.save(second).written == 1 and content(saved.load()) == content(second)


def test_stamps_tell_rows_apart(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "a string, b string")
    columns = ["a", "b"]
    one = make(("1", "2"), ("x", None))
    assert stamped.same(one, make(("x", None), ("1", "2")), columns) and stamped.same(one.limit(0), make().limit(0), columns)
    for other in (make(("1", "2")), make(("12", ""), ("x", None)), make(("1", "2"), ("x", "-")), make(("1", "2"), (None, "x")), make(("1", "2"), ("x", None), ("x", None)), make(("1:2", "2"), ("x", None))):
        assert not stamped.same(one, other, columns)
    kept = stamped.stamp(one, columns)
    assert stamped.fetched(kept, kept, one) is None and stamped.fetched("other", kept, one) is one and stamped.fetched(None, kept, one) is one


def test_tables_and_sets_as_json_and_back(spark, tmp_path):
    rows = spark.createDataFrame(report(), SCHEMA)
    stamped.to_lines(rows, str(tmp_path / "lines"))
    assert content(stamped.from_lines(spark, str(tmp_path / "lines"), SCHEMA)) == content(rows)
    (tmp_path / "bad.json").write_text('{"size": "no number"}\n')
    with pytest.raises(Exception, match="(?i)malformed|failfast|parse"):
        stamped.from_lines(spark, str(tmp_path / "bad.json"), SCHEMA).collect()
    texts = stamped.to_sets(rows, "grp", ["path", "size", "score", "tags"])
    back = stamped.from_sets(texts.unionByName(spark.createDataFrame([("x", "no json"), ("y", None)], "grp string, json string")), "json", "string", "path string, size long, score double, tags array<string>")
    assert content(back) == content(rows)


def test_pairs_from_sql_equal_those_of_the_join(spark):
    rng = random.Random(7)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(6)]
    rows = []
    for i in range(300):
        v = [x + rng.gauss(0, 0.1) for x in centres[i % 6]]
        size = sum(x * x for x in v) ** 0.5
        rows.append((f"k{i}", [x / size for x in v]))
    rows += [("null", None), ("same", rows[0][1])]
    vectors = spark.createDataFrame(rows, "id string, v array<double>")
    candidates.register(spark)
    index = similarity.cosine_blocks(vectors, "id", "v", 0.97, room=32)
    got = spark.sql("SELECT * FROM similar_pairs(TABLE({rows}), 'cosine', 0.97)", rows=index)
    want = similarity.cosine_pairs(vectors, "id", "v", 0.97)
    pairs = lambda df, c: sorted((r.a_key, r.b_key, round(r[c], 9)) for r in df.collect())
    assert pairs(got, "value") == pairs(want, "cosine") and got.count() > 3000
    assert spark.sql("SELECT * FROM similar_pairs(TABLE({rows}), 'cosine', 0.97)", rows=index.limit(0)).count() == 0
    for bad in ("TABLE({rows}), 'other', 0.9", "TABLE(SELECT 1 AS key), 'gray', 0.9"):
        with pytest.raises(Exception, match="measure is one of|first argument is a table"):
            spark.sql(f"SELECT * FROM similar_pairs({bad})", **({"rows": index} if "rows" in bad else {})).collect()
