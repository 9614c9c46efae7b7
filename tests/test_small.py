"""Operators that no query runs, each on a few rows worked out by hand."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import media, signal
from kindred.operators import reports, results, similarity, state, verdicts
from kindred.sources import tables


def test_hard_links_and_what_stopped_a_pair(spark):
    rows = [(1, 5, 2.0, "v", 7, 5, 2.0, "v", 7), (2, 5, None, "v", 7, 5, None, "v", 7), (3, 5, 2.0, "v", 7, 5, 2.0, "w", 7), (4, 5, 2.0, "v", 7, 6, 2.0, "v", 7)]
    frame = spark.createDataFrame(rows, "id int, a_size int, a_duration double, a_volume string, a_inode int, b_size int, b_duration double, b_volume string, b_inode int")
    sides = [{c: F.col(f"{x}_{c}") for c in ("size", "duration", "volume", "inode")} for x in "ab"]
    linked = verdicts.hard_link(*sides)
    assert {r.id for r in frame.where(linked).collect()} == {1, 2}
    told = verdicts.explained(frame, {"size": F.col("a_size") == F.col("b_size"), "volume": F.col("a_volume") == F.col("b_volume"), "time": F.col("a_duration") < 9}).collect()
    assert {r.id: r.stopped_by for r in told} == {1: None, 2: "time", 3: "volume", 4: "size"}


def test_what_takes_part(spark):
    rows = [(1, None, True, 0, [1, 2]), (2, "too dark", True, 0, [1, 2]), (3, None, False, 0, [1, 2]), (4, None, True, results.ERRORS, [1, 2]), (5, None, True, 0, [1])]
    frame = spark.createDataFrame(rows, "id int, reason string, probed boolean, flags int, frames array<int>")
    assert [r.id for r in results.comparable(frame, "reason", "frames", 2).collect()] == [1]
    folders = spark.createDataFrame([("/r/cache/a",), ("/r/x/Cache",), ("/cache/r2/x",), ("/r/deep/tmp1",), ("/r",)], "folder string")
    below = results.black_listed_below(F.col("folder"), ["cache", "/r/deep/*"], ["/r", "/cache/r2"])
    assert {r.folder for r in folders.where(below).collect()} == {"/r/cache/a", "/r/x/Cache", "/r/deep/tmp1"}


def test_clips_and_their_sources(spark):
    pairs = spark.createDataFrame([(1, 10, 0.9, 3, False), (2, 10, 0.8, 4, True), (3, 10, 0.7, 5, True), (2, 11, 0.95, 0, True), (1, 12, 0.5, 0, False)], "source int, clip int, similarity double, offset int, ok boolean")
    assigned = results.verified_sources(pairs, F.col("ok"))
    assert sorted((r.source, r.clip) for r in assigned.collect()) == [(2, 10), (2, 11)]
    rows = sorted((r.grp, r["item"], round(r.difference, 6), r.offset) for r in results.clip_rows(assigned).collect())
    assert rows == [(2, 2, 0.0, None), (2, 10, 0.2, 4), (2, 11, 0.05, 0)]


def test_a_dump_without_paths_has_one_running_number(spark):
    frame = spark.createDataFrame([(f"/secret/{i}", [bytes([i]), None]) for i in range(40)], "key string, frames array<binary>").repartition(7)
    rows = results.anonymous(frame).collect()
    assert sorted(r.id for r in rows) == list(range(40)) and rows[0].__fields__ == ["id", "frames"]
    order = [r.frames[0] for r in sorted(rows, key=lambda r: r.id)]
    assert order != sorted(order) and all(r.frames[1] is None for r in rows)


def test_failed_readings_and_caches(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], "path string, size int, modified int")
    failed = spark.createDataFrame([("a", 1, 1, "x"), ("b", 2, 1, "x")], "path string, size int, modified int, why string")
    assert sorted(r.path for r in state.to_try(rows, failed).collect()) == ["b", "c"]
    cache = spark.createDataFrame([("a", 1, 1, "da"), ("c", 1, 9, "dc")], "path string, size int, modified int, digest string")
    assert {r.path: r.digest for r in tables.cached(rows, cache).collect()} == {"a": "da", "b": None, "c": None}
    assert tables.fold_due(100, 21) and not tables.fold_due(100, 20) and tables.fold_due(0, 1)


def test_stamps_files_and_results(spark, tmp_path):
    rows = spark.createDataFrame([(2, 0.5, "b"), (1, 0.5, "x"), (2, 0.9, "a"), (1, 0.5, "a,\"q")], "group_id int, similarity double, path string")
    one, two, three = (tables.stamp(d, ["group_id", "path"]).first() for d in (rows, rows.orderBy("path").repartition(3), rows.where("path <> 'b'")))
    assert one == two != three and one.n == 4
    for kind, read in (("csv", lambda p: spark.read.option("header", True).option("escape", "\\").schema(rows.schema).csv(p)), ("json", lambda p: spark.read.schema(rows.schema).json(p))):
        tables.write_results(rows, f"{tmp_path}/{kind}", kind)
        assert [(r.group_id, r.path) for r in read(f"{tmp_path}/{kind}").collect()] == [(1, 'a,"q'), (1, "x"), (2, "a"), (2, "b")]
    (tmp_path / "tree" / "deep").mkdir(parents=True)
    (tmp_path / "tree" / "deep" / "one.jpg").write_bytes(b"12345")
    (tmp_path / "tree" / "two.txt").write_bytes(b"1")
    found = tables.files(spark, str(tmp_path / "tree"), "*.jpg").collect()
    assert [(r.path.rsplit("/", 1)[1], r["size"]) for r in found] == [("one.jpg", 5)] and isinstance(found[0].modified, datetime.datetime)


def test_report_order_block_sums_and_colours(spark):
    sets = spark.createDataFrame([("similar", 9, "a"), ("copies", 1, "b"), ("copies", 5, "d"), ("copies", 5, "c")], "kind string, reclaim int, key string")
    assert [r.key for r in sets.orderBy(*reports.report_order()).collect()] == ["c", "d", "b", "a"]
    frame = spark.createDataFrame([(list(range(16)), list(range(16, 0, -1)))], "a array<int>, b array<int>")
    row = frame.select(signal.block_sums(F.col("a"), 4, 2).alias("a"), signal.block_sums(F.col("b"), 4, 2).alias("b"), signal.l1(F.col("a"), F.col("b")).alias("whole")).first()
    assert row.a == [10, 18, 42, 50] and sum(abs(x - y) for x, y in zip(row.a, row.b, strict=True)) <= row.whole
    colours = spark.createDataFrame([(1.0, 2.0), (10.0, 5.0), (10.0, 4.9), (3.0, 0.0)], "a double, b double")
    assert [r.k for r in colours.select(media.keeps_colors(F.col("a"), F.col("b")).alias("k")).collect()] == [True, True, False, False]


def test_pictures_that_line_up_in_report_sets(spark):
    from tests.test_aligned import edited, scene

    a = scene(3)
    pictures = [("keep", a), ("crop", edited(a, 0.05, -0.04, 0.8, 0)), ("other", scene(9))]
    pixels = spark.createDataFrame([(p, x.ravel().tolist(), x.shape[1]) for p, x in pictures], "path string, pixels array<double>, width int")
    rows = [("crop", True, "variant", 90.0), ("other", True, "variant", 90.0), ("gone", True, "variant", 90.0), ("crop2", True, "resaved", 99.0), ("film", False, "variant", 90.0), ("far", True, "variant", 50.0)]
    related = spark.createDataFrame([(p, "keep", image, True, relation, percent) for p, image, relation, percent in rows], "i_path string, k_path string, i_image boolean, k_image boolean, relation string, percent double")
    out = {r.i_path: r.lines_up for r in reports.lined_up(related, pixels).collect()}
    assert out == {"crop": True, "other": False, "gone": None, "crop2": None, "film": None, "far": None}


@pytest.mark.parametrize("rows", [1, 5, 64])
def test_codes_near_each_other_in_buffers(rows):
    """Places and bits are those of the whole matrix, whatever the rows of a buffer."""
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 2**63, 33, dtype=np.uint64), rng.integers(0, 2**63, 40, dtype=np.uint64)
    y[:9] = x[:9] ^ np.uint64(0b10110)
    bits = np.bitwise_count(x[:, None] ^ y)
    i, j = np.nonzero(bits <= 24)
    found = similarity._near_codes(x, y, 24, rows)
    assert len(i) > 9 and all((a == b).all() for a, b in zip(found, (i, j, bits[i, j]), strict=True))
    assert [len(c) for c in similarity._near_codes(x[:0], y, 24)] == [len(c) for c in similarity._near_codes(x, y[:0], 24)] == [0] * 3
