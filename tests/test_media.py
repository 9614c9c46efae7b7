"""Closer looks, timelines, readings, chroma, probes and order-dependent groups against plain versions."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from kindred.functions import audio
from kindred.operators import clustering, looks, readings, timelines
from kindred.sources import probe


def test_block_difference_is_that_of_a_plain_loop(spark):
    rng, n, grid = random.Random(1), 8, 4
    a, b = ([rng.randrange(256) for _ in range(n * n)] for _ in "ab")
    soft = lambda f: [[sum(f[min(max(y + dy, 0), n - 1) * n + min(max(x + dx, 0), n - 1)] for dy in (-1, 0, 1) for dx in (-1, 0, 1)) for x in range(n)] for y in range(n)]
    sa, sb = soft(a), soft(b)
    want = max(sum(abs(sa[2 * i + y][2 * j + x] - sb[2 * i + y][2 * j + x]) for y in (0, 1) for x in (0, 1)) for i in range(grid) for j in range(grid)) / 36
    rows = spark.createDataFrame([(bytes(a), bytes(b)), (None, bytes(b)), (b"", bytes(b))], "a binary, b binary")
    got = [r[0] for r in rows.select(looks.block_difference(F.col("a"), F.col("b"), n, grid)).collect()]
    assert got[0] == pytest.approx(want) and got[1:] == [None, None]


def test_look_side_and_detail(spark):
    row = spark.sql("select 300 w, 1000 h, cast(null as int) n, array(0, 10, 5, 9) f").select(
        looks.look_side(F.col("w"), F.col("h")).alias("s"), looks.look_side(F.col("w"), F.col("n")).alias("n"), looks.look_side(F.lit(5)).alias("z"), looks.detail(F.col("f"), 2).alias("d"), looks.detail_kept(F.lit(0.0), F.lit(0.0)).alias("k")
    ).first()
    assert tuple(row) == (256, None, 0, 15.0, 1.0)


def test_a_clip_is_found_at_its_first_best_place(spark):
    rng = random.Random(2)
    long_ = [rng.getrandbits(32) for _ in range(30)]
    clip = [c ^ (1 << rng.randrange(32)) for c in long_[7:17]]
    sources = spark.createDataFrame([(1, long_), (2, clip * 2), (3, [0] * 40), (4, clip[:3])], "id long, codes array<long>")
    clips = spark.createDataFrame([(9, clip), (8, [0] * 5), (7, [])], "id long, codes array<long>")
    got = {(r.source, r.clip): (r.similarity, r.offset) for r in timelines.clips_within(sources, clips, "id", "codes", 0.9).collect()}
    assert got == {(1, 9): (pytest.approx(1 - 10 / 320), 7), (2, 9): (1.0, 0)}


def test_dense_frames_must_agree_on_an_offset(spark):
    rng = random.Random(4)
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    film = [unit([rng.gauss(0, 1) for _ in range(32)]) for _ in range(20)]
    rows = [("film", i * 10.0, v) for i, v in enumerate(film)] + [("cut", i * 10.0, v) for i, v in enumerate(film[5:10])]
    rows += [("mixed", i * 10.0, film[(i * 7 + 3) % 20]) for i in range(6)] + [("few", 0.0, film[1]), ("few", 10.0, None)]
    got = timelines.dense_matches(spark.createDataFrame(rows, "file string, at double, v array<double>"), "file", "at", "v", 0.9).collect()
    assert [(r.source, r.clip, r.offset, r.n) for r in got] == [("film", "cut", 50, 5)]


def test_readings(spark):
    m = readings.MARK
    text = "the quick brown fox jumps over lazy dogs today"
    assert readings.compare(None, "") == ("same", 0, 0, 0)
    assert readings.compare(text, text.replace("brown", "br0wn").replace("quick", "qu ick"))[0] == "same"
    assert readings.compare(text, text.replace("jumps", "jumqs"))[0] == "same"
    assert readings.compare("total 12.50 due", "total 12.90 due")[:2] == ("differs", 1)
    assert readings.compare(text, "an entirely other document about nothing alike here whatsoever")[0] == "unrelated"
    assert readings.compare(f"total{m}95 gr{m}40 due{m}95", "total due")[0] == "same"
    assert [readings.edits(a, b) for a, b in [("", ""), ("", "abc"), ("kitten", "sitting"), ("flaw", "lawn")]] == [0, 3, 3, 2]
    got = spark.createDataFrame([("a b", None)], "a string, b string").select(readings.compared(F.col("a"), F.col("b")).alias("r")).first().r
    assert got.words_b == 0


def test_chroma_of_a_tone_is_its_note(spark):
    tone = [math.sin(2 * math.pi * 440 * i / 11025) for i in range(4096)]
    got = [r[0] for r in spark.createDataFrame([(tone,), ([0.0] * 4096,), ([1.0],), (None,)], "s array<double>").select(audio.chroma(F.col("s"))).collect()]
    assert max(range(12), key=lambda k: got[0][k]) in (0, 11) and sum(x * x for x in got[0]) == pytest.approx(1)
    assert got[1] == [0.0] * 12 and got[2:] == [None, None]


def test_probe(spark):
    one = json.dumps({"streams": [{"index": 0, "width": 1920, "r_frame_rate": "0/0", "disposition": {"attached_pic": 1}}, {"index": 1, "bit_rate": "N/A", "sample_rate": "48000"}], "format": {"duration": "01:02:03.5", "bit_rate": "9000"}})
    rows = [r.m for r in spark.createDataFrame([(one,), ("{}",), (None,), ('{"format": {"duration": "3.9"}}',)], "t string").select(probe.media_info(F.col("t")).alias("m")).collect()]
    a, b = rows[0].streams
    assert rows[0].duration_s == 3723 and (a.width, a.frame_rate, a.is_attached_picture, a.bit_rate, a.language) == (1920, -1, True, 9000, "")
    assert (b.bit_rate, b.sample_rate, b.frame_rate) == (0, 48000, 0) and rows[3].duration_s == 3


def test_merged_groups_join_by_representatives_only(spark):
    # 1-2 found a group of 1, 3-4 one of 3; 2-3 may join them only if 1 and 3 are alike; 5 knows 4 but not 3
    pairs = spark.createDataFrame([(1, 2), (3, 4), (2, 3), (4, 5)], "a long, b long")

    def groups(alike):
        out = clustering.merged_groups(clustering.components(pairs), pairs, spark.createDataFrame(alike, "a long, b long"))
        return {r.id: r.grp for r in out.collect()}

    assert groups([(1, 2), (3, 4), (2, 3), (4, 5)]) == {1: 1, 2: 1, 3: 3, 4: 3}
    assert groups([(1, 3), (1, 4), (1, 5)]) == dict.fromkeys((1, 2, 3, 4, 5), 1)
