"""Rules and operators whose queries have no SQL, against plain versions; cases that the tables do not show."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import media, names, prints
from kindred.operators import reports, results, state, verdicts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_perceptual_hashes_are_those_of_a_plain_cosine_transform(spark):
    rng = np.random.default_rng(1)
    frames = rng.integers(0, 256, size=(4, 1024))
    rows = spark.createDataFrame([(i, f.tolist()) for i, f in enumerate(frames)] + [(9, [1, 2]), (10, None)], "id int, f array<int>")
    got = {r.id: r.h for r in rows.select("id", prints.perceptual_hash(F.col("f")).alias("h")).collect()}
    assert got[9] is None and got[10] is None
    for i, f in enumerate(frames):
        own = [sum(f[y * 32 + x] * math.cos((2 * x + 1) * u * math.pi / 64) * math.cos((2 * y + 1) * v * math.pi / 64) for y in range(32) for x in range(32)) for v in range(1, 9) for u in range(1, 9)]
        middle = sum(sorted(own)[31:33]) / 2
        assert got[i] & (2**64 - 1) == sum(1 << k for k, c in enumerate(own) if c > middle)


def test_gray_frames_file_ends_and_text(spark):
    rng = np.random.default_rng(2)
    rgb = rng.integers(0, 256, size=(224, 224, 3)).astype(np.uint8)
    gray = prints.gray_of(rgb.reshape(1, -1))[0].reshape(32, 32)
    block = rgb[7:14, 21:28].reshape(-1, 3).astype(int)
    assert gray[1, 3] == (sum(299 * r + 587 * g + 114 * b for r, g, b in block) + 49 * 500) // (49 * 1000)
    data = bytes(rng.integers(0, 256, 200_001).astype(np.uint8))
    total = len(data) + sum(int.from_bytes(part[k : k + 8], "little") for part in (data[:65536], data[-65536:]) for k in range(0, 65536, 8))
    rows = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"short")), (3, None)], "id int, c binary")
    assert [r.h for r in rows.orderBy("id").select(prints.file_ends_hash(F.col("c")).alias("h")).collect()] == [f"{total % 2**64:016x}", None, None]
    assert prints.is_text(b"let x: number = 1;\n" * 20) and not prints.is_text(b"") and not prints.is_text(b"a\0b")
    stream = bytearray(b"x" * 1000)
    for k in (5, 193, 381):
        stream[k] = 0x47
    assert not prints.is_text(bytes(stream))


def test_a_greedy_matching_is_that_of_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b), int(w)) for a, b, w in zip(rng.integers(0, 25, 200), rng.integers(0, 25, 200), rng.integers(0, 9, 200), strict=True)]
    pairs = list({(a, b): (a, b, w) for a, b, w in pairs}.values()) + [(100, b, 20) for b in range(20)]
    want, used_a, used_b = set(), set(), set()
    for a, b, w in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in used_a and b not in used_b:
            want.add((a, b))
            used_a.add(a)
            used_b.add(b)
    frame = spark.createDataFrame(pairs, "a int, b int, w int")
    assert {(r.a, r.b) for r in state.one_to_one(frame, [F.desc("w")]).collect()} == want
    assert state.one_to_one(frame.where("false"), [F.desc("w")]).collect() == []


def test_settings_round_as_single_precision():
    s = verdicts.Settings(percent=96, quorum=0.6)
    assert s.most_bits == 2 and s.required(5) == 3 and verdicts.Settings(quorum=0).required(5) == 1
    assert verdicts.sign_bound(384, 1.0) == 0 and verdicts.sign_bound(384, 0.0) == math.ceil(192 + 4.6 * math.sqrt(96))
    assert media.positions(1) == [0.5] and media.positions(3) == [0.25, 0.5, 0.75]


def test_verdicts_on_missing_and_dark_positions(spark):
    v = F.array(F.array(F.lit(127), F.lit(0)), F.lit(None).cast("array<int>"), F.array(F.lit(0), F.lit(127)))
    w = F.array(F.array(F.lit(127), F.lit(0)), F.array(F.lit(0), F.lit(127)), F.lit(None).cast("array<int>"))
    assert one(spark, verdicts.ai_similarity(v, w)) == -1.0 and one(spark, verdicts.ai_similarity(v, v)) == 1.0
    dark = F.array(F.array(F.lit(3), F.lit(4)))
    assert one(spark, verdicts.gray_positions(dark, dark, verdicts.Settings())) == 0.0
    assert one(spark, verdicts.gray_positions(dark, dark, verdicts.Settings(ignore_dark=True))) is None
    assert one(spark, verdicts.usable(F.array(F.array(F.lit(1)), F.lit(None).cast("array<int>")), 1, 2)) is False
    assert one(spark, verdicts.visual_gate(F.lit(0.0), F.array(F.lit(1.0)))) is False and one(spark, verdicts.visual_gate(F.lit(5.0), F.array().cast("array<double>"))) is True


def test_shots_of_names(spark):
    cases = {
        "/a/IMG_1234 (1).jpg": ("img_#", 1234, False), "IMG_1234_Original.JPG": ("img_#", 1234, False), "IMG_1234 - Copy (2).heic": ("img_#", 1234, False), "00001IMG_00001_BURST20260101120000123_COVER.jpg": ("burst20260101120000123", 1, False),
        "IMG_20140830_092242.jpg": ("img_@", 63544987362000 - 62135596800000, True), "20201105_205359_HDR.jpg": ("@", 1604609639000, True), "20201345_000000.jpg": ("20201345_#", 0, False), "Photo.jpg": None, "Photo 2 of 17.png": ("photo 2 of #", 17, False),
    }
    for path, want in cases.items():
        got = one(spark, names.shot(F.lit(path)))
        assert (got and tuple(got)) == want, path
    assert one(spark, names.original_and_edit(F.lit("/a/IMG_1.jpg"), F.lit("/b/img_1-EDITED.jpeg"))) is True and one(spark, names.original_and_edit(F.lit("IMG_1.jpg"), F.lit("IMG_10.jpg"))) is False
    assert names.strategy_name("Keep-Best Resolution") == "keep_best_resolution"
    with pytest.raises(ValueError):
        names.strategy_name("smallest")


def test_relation_ladder_and_original_looking_names(spark):
    day = "2024-01-02 00:00:00"
    rows = spark.createDataFrame([
        (1, "/p/a.jpg", True, 10, 100, 80, 0, 0, 0, None, day, day, False), (1, "/downloads/a.jpg", True, 10, 100, 80, 0, 0, 0, None, day, day, False), (1, "/p/a (1).jpg", True, 10, 100, 80, 0, 0, 0, None, day, day, True),
        (2, "/p/b.jpg", True, 10, 100, 80, 0, 0, 0, None, day, None, False), (2, "/p/c.jpg", True, 10, 90, 80, 0, 0, 0, None, day, day, False),
    ], "grp int, path string, image boolean, size long, width int, height int, seconds int, kilobits int, rate int, audio string, modified string, taken string, synced boolean")
    kept = {r.grp: (r.path, r.reason) for r in reports.photo_keepers(rows.withColumn("modified", F.col("modified").cast("timestamp"))).where("keep").collect()}
    assert kept == {1: ("/p/a (1).jpg", "original name"), 2: ("/p/b.jpg", "resolution")}
    look = lambda **k: one(spark, reports.by_look(*[F.lit(k.get(n)) if k.get(n) is not None else F.lit(None).cast(t) for n, t in (("gray", "double"), ("ai", "double"), ("smaller", "boolean"), ("shorter", "boolean"), ("fewer", "boolean"), ("cell", "int"), ("close", "boolean"))]))
    assert look(gray=99.9, smaller=True) == "smaller" and look(gray=99.9, smaller=False, shorter=False, fewer=True) == "compressed" and look(gray=99.9, cell=9, ai=98.0) == "edited" and look(gray=99.9, close=False) == "variant" and look(ai=96.0) == "variant"


def test_roots_and_lists(spark):
    frame = lambda rows, c: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    got = state.roots(frame(["c", "c/x", "c/x/y", "d/z", "d/z", "e/f"], "folder"), frame(["e"], "folder"), frame(["c/x/y"], "folder"))
    assert sorted(r.folder for r in got.collect()) == ["c", "c/x/y", "d/z"]
    listed = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "gone")], "grp int, path string")
    assert {r.grp for r in results.pruned_lists(listed, frame(["a", "b"], "path")).collect()} == {1}
    outputs, projects = frame(["p/bin", "q/bin", "r/obj"], "path"), frame(["p"], "folder")
    assert [r.path for r in results.orphan_outputs(outputs, projects, frame(["r/obj/kept.txt"], "path")).collect()] == ["q/bin"]
    reads = spark.createDataFrame([("c", 1, True, "first"), ("c", 3, False, "part"), ("c", 2, True, "second")], "drive string, at int, whole boolean, why string")
    assert [tuple(r) for r in results.last_reads(reads).collect()] == [("c", 2, "second")]
    branches = spark.createDataFrame([("r", "a", True, False, False, False), ("r", "main", True, False, True, False), ("r", "b", True, True, False, False), ("r", "c", False, False, False, False)], "repo string, branch string, merged boolean, protected boolean, is_default boolean, checked_out boolean")
    assert [r.branch for r in state.merged_branches(branches).collect()] == ["a"]


def test_languages_of_streams(spark):
    track = lambda i, language: F.struct(F.lit(i).cast("int").alias("index"), F.lit(language).cast("string").alias("language"))
    cached, probed = F.array(track(2, None), track(1, "eng"), track(None, None), track(9, None)), F.array(track(1, "fra"), track(2, "deu"), track(3, "ita"))
    assert one(spark, media.merged_languages(cached, probed)) == ["deu", "eng", "ita", ""]
