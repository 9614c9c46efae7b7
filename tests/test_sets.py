"""Report sets in rounds, differences of frames, codes of sound and headers of files, against plain versions."""

import struct
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import audio, headers
from kindred.operators import looks, reports
from kindred.operators.kept import written
from kindred.plans.reporting import relate

DAY = "date'2024-01-0{}'"


@pytest.fixture(scope="module")
def members(spark):
    rng = np.random.default_rng(4)
    rows = [(g, n, f"/{rng.choice(['Temp', 'Photos'])}/P{n}.{rng.choice(['jpg', 'jpg', 'gif'])}", g % 3 > 0, *map(int, rng.integers(0, 3, 4)), f"2024-01-0{rng.integers(1, 4)}") for g in range(24) for n in range(1, 2 + g % 12)]
    d = spark.createDataFrame(rows, "grp long, n int, path string, image boolean, size long, width int, seconds int, kilobits int, day string")
    series = F.when(F.col("n") % 4 > 0, F.col("n") % 2)
    return d.selectExpr("*", "60 as height", "25 as rate", "if(n % 2 = 0, 'aac', null) as audio", "to_date(day) as modified", "if(n % 3 = 0, to_date(day), null) as taken", "n % 5 = 0 as synced").drop("day").withColumns({"series": series, "shot": F.col("n") % 3}).cache()


def plain_parts(spark, members):
    """Relations of all pairs, and a function for the kept one of a list, each by the operators of one step."""
    i, k = (members.withColumn("_shown", F.lit(False)).select([F.col(c).alias(f"{x}_{c}") for c in [*members.columns, "_shown"]]) for x in "ik")
    both = relate(i.join(k, (F.col("i_grp") == F.col("k_grp")) & (F.col("i_n") != F.col("k_n"))))
    facts = {(r.i_grp, r.i_n, r.k_n): (r.relation, r.percent, r.lines_up) for r in both.collect()}

    def order(grp, rest):
        # the last of each list of what is left, as the kept one of any rest comes by the same rule
        frame = members.where((F.col("grp") == grp) & F.col("n").isin([r.n for r in rest]))
        kept = (reports.photo_keepers if rest[0].image else reports.video_keepers)(frame).where("keep").first().n
        return next(r for r in rest if r.n == kept)

    return facts, order


def test_sets_in_rounds_are_those_of_plain_loops(spark, members):
    facts, keeper = plain_parts(spark, members)
    split, left = {}, {}
    for grp, rows in groupby(sorted(members.collect(), key=lambda r: (r.grp, r.n)), key=lambda r: r.grp):
        rows = list(rows)
        sets, rest = [], list(rows)
        while rest and len(rows) >= 4:
            keep = keeper(grp, rest)
            sets.append([r for r in rest if r is keep or facts[grp, r.n, keep.n][0] in reports.PLAIN])
            rest = [r for r in rest if r not in sets[-1]]
        several = [s for s in sets if len(s) > 1]
        split[grp] = {frozenset(r.n for r in s) for s in (several if len(several) > 1 else [rows])}
        rest, shown, left[grp] = list(rows), set(), set()
        while len(rest) > 1:
            keep = keeper(grp, rest)
            chosen, others = [keep], []
            near = [(r, *facts[grp, r.n, keep.n]) for r in rest if r is not keep]
            for r, relation, percent, lines_up in sorted(near, key=lambda c: (c[1] != "identical", c[1] not in reports.PLAIN, -c[2], c[0].path)):
                if relation == "identical":
                    chosen.append(r)
                elif relation in reports.OTHER_VERSIONS or any(s.series is not None and s.series == r.series and s.shot != r.shot for s in chosen[1:]):
                    others.append(r.n)
                elif relation == "different" or percent < 75 or (relation not in reports.PLAIN and {keep.n, r.n} & shown) or not lines_up:
                    continue
                else:
                    chosen.append(r)
            rest = [r for r in rest if r not in chosen]
            if len(chosen) > 1:
                shown |= set(others)
                left[grp].add(frozenset(r.n for r in chosen))
    number = {(r.grp, r.path): r.n for r in members.collect()}

    def sets_of(frame):
        out = {}
        for r in frame.collect():
            out.setdefault((r.grp, r.part), set()).add(number[r.grp, r.path])
        return {g: {frozenset(s) for (h, _), s in out.items() if h == g} for g in split}

    assert sets_of(reports.split_by_picture(members, relate)) == split
    assert sets_of(reports.leave_out(members, relate)) == left
    assert any(len(s) > 1 for s in split.values()) and any(len(s) > 1 for s in left.values())
    for operator in (reports.split_by_picture, reports.leave_out):
        assert operator(members.where("false"), relate).collect() == []


def test_rounds_of_sets_shuffle_the_open_rows_once_a_table(spark, members, monkeypatch):
    plans, tables = [], []

    def kept(frame, name):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        tables.append(written(frame, name))
        return tables[-1]

    monkeypatch.setattr(reports, "written", kept)
    for operator in (reports.split_by_picture, reports.leave_out):
        found = operator(members, relate)
        number = max(r.part for r in found.collect())
        assert number <= len(tables) <= number + 2 and all(p.count("Exchange hashpartitioning") == 1 and "Join" not in p for p in plans)
        plans.clear()
        tables.clear()


def test_differences_of_frames(spark):
    rng = np.random.default_rng(5)
    wide, high = 40, 30
    a = np.tile(np.linspace(40, 200, wide), (high, 1)) + rng.normal(0, 1, (high, wide))
    b = a * 0.8 + 10  # another brightness and contrast is no difference
    assert not looks.difference_mask(a, b).any() and looks.mask_boxes(looks.difference_mask(a, b)) == []
    b[4:10, 5:15] = 255
    b[20:24, 30:36] = 0
    mask = looks.difference_mask(a, b, 0.5)
    seen, parts = set(), []
    for cell in zip(*np.nonzero(mask), strict=True):
        line, part = [cell], []
        while line:
            y, x = line.pop()
            if (y, x) in seen or not (0 <= y < high and 0 <= x < wide) or not mask[y, x]:
                continue
            seen.add((y, x))
            part.append((y, x))
            line += [(y + v, x + u) for v in (-1, 0, 1) for u in (-1, 0, 1)]
        if len(part) >= 4:
            ys, xs = zip(*part, strict=True)
            parts.append((len(part), min(xs), min(ys), max(xs), max(ys)))
    assert looks.mask_boxes(mask) == sorted(parts, reverse=True) and len(parts) == 2
    assert mask.max() <= 230 and mask[mask > 0].min() >= 90
    near = np.zeros((20, 20), int)
    near[2:4, 2:4], near[2:4, 7:9], near[15:17, 15:17], near[10, 10] = 1, 1, 1, 1  # three apart: one box; a speck goes
    assert looks.mask_boxes(near) == [(8, 2, 2, 8, 3), (4, 15, 15, 16, 16)]
    rows = spark.createDataFrame([(1, a.ravel().tolist(), b.ravel().tolist()), (2, a.ravel().tolist(), [1.0]), (3, None, None), (4, a.ravel().tolist(), a.ravel().tolist())], "id int, a array<double>, b array<double>")
    got = {r.id: r.d for r in rows.select("id", looks.difference_regions(F.col("a"), F.col("b"), wide, high).alias("d")).collect()}
    assert got[2] is None and got[3] is None and got[4] == [] and len(got[1]) == 2
    assert all(0 <= r.x and r.x + r.width <= 1 and r.y + r.height <= 1 for r in got[1])


def test_codes_of_sound_are_those_of_a_plain_loop(spark):
    rng = np.random.default_rng(6)
    t = np.arange(11025 * 4) / 11025
    wave = (9000 * np.sin(2 * np.pi * 440 * (1 + t // 1.3) * t) + rng.normal(0, 300, len(t))).astype(int)
    wave[:6000] = 0
    notes, codes = [], {}
    for i, at in enumerate(range(0, len(wave) - 4096 + 1, 1365)):
        power = np.abs(np.fft.rfft(wave[at : at + 4096] / 32768 * np.hanning(4096))) ** 2
        own = [0.0] * 12
        for k, p in enumerate(power):
            if 27.5 <= k * 11025 / 4096 <= 3520:
                own[int(12 * np.log2(k * 11025 / 4096 / 27.5)) % 12] += p
        size = sum(x * x for x in own) ** 0.5
        notes.append([x / size for x in own] if size**2 >= 1e-10 else [0.0] * 12)
        if i >= 4:
            soft = [sum(w * notes[i - 4 + j][n] for j, w in enumerate((0.25, 0.5, 1, 0.5, 0.25))) for n in range(12)]
            pairs = [(n, (n + 1) % 12) for n in range(12)] + [(n, (n + 3) % 12) for n in range(12)] + [(n, n + 6 if n < 6 else n - 6) for n in range(8)]
            codes.setdefault(i * 1365 // 11025, []).append([soft[x] > soft[y] for x, y in pairs])
    want = [sum(1 << k for k in range(32) if sum(f[k] for f in frames) * 2 > len(frames)) for _, frames in sorted(codes.items())]
    rows = spark.createDataFrame([(1, wave.tolist()), (2, []), (3, None), (4, [None] * 20000)], "id int, s array<int>")
    got = {r.id: r.c for r in rows.select("id", audio.sound_codes(F.col("s")).alias("c")).collect()}
    assert got == {1: want, 2: [], 3: None, 4: [0, 0]} and len(want) == 4


def test_headers_of_pictures(spark):
    def table(mark, entries, after=b""):
        return struct.pack(mark + "H", len(entries)) + b"".join(struct.pack(mark + "HHI", *e[:3]) + e[3] for e in entries) + b"\0" * 4 + after

    def exif(mark):
        number = lambda n: struct.pack(mark + "I", n)
        first = table(mark, [(0x0132, 2, 20, number(38)), (0x8769, 4, 1, number(58))], b"2020:01:01 00:00:00\0")
        inner = table(mark, [(0x9003, 2, 20, number(76))], b"2023:11:05 20:53:59\0")
        return (b"II*\0" if mark == "<" else b"MM\0*") + number(8) + first + inner

    block = exif("<")
    app = b"\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block
    frame = b"\xff\xc2" + struct.pack(">HBHH", 11, 8, 480, 640) + b"\0" * 6
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + b"\0" * 4
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", 3, 4) + b"\0" * 5) + chunk(b"eXIf", exif(">")) + chunk(b"IDAT", b"x")
    webp = b"RIFF\0\0\0\0WEBP" + b"VP8 " + struct.pack("<I", 3) + b"abc\0" + b"EXIF" + struct.pack("<I", len(block) + 6) + b"Exif\0\0" + block
    files = {
        "jpeg": b"\xff\xd8" + app + frame, "cut": b"\xff\xd8" + app[:30], "png": png, "gif": b"GIF89a" + struct.pack("<HH", 7, 9), "bmp": b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -6),
        "webp": webp, "tiff": exif(">"), "text": b"hello, this is no picture", "empty": b"", "none": None, "zero": b"GIF89a" + b"\0" * 4,
    }
    rows = spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in files.items()], "n string, c binary")
    got = {r.n: (r.s.width, r.s.height, r.d and str(r.d)) for r in rows.select("n", headers.image_size(F.col("c")).alias("s"), headers.date_taken(F.col("c")).alias("d")).collect()}
    taken = "2023-11-05 20:53:59"
    sizes = {"jpeg": (640, 480, taken), "png": (3, 4, taken), "gif": (7, 9, None), "bmp": (5, 6, None), "webp": (None, None, taken), "tiff": (None, None, taken)}
    assert got == {n: sizes.get(n, (None, None, None)) for n in files}
