"""Joins that leave out dark or bright places, mirrored frames, and global places, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import signal
from kindred.operators import ordering, results, similarity, verdicts

SIDE = 4


def made(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 256, (12, SIDE * SIDE))
    rows = [np.clip(base[i % 12] + rng.integers(-12, 13, SIDE * SIDE), 0, 255) for i in range(48)]
    rows += [np.where(r > 128, r, rng.integers(0, 33, r.size)) for r in rows[:12]]  # alike but for their dark places
    rows += [r.reshape(SIDE, SIDE)[:, ::-1].ravel() for r in rows[12:20]] + [np.zeros(16, int), np.zeros(16, int), np.full(16, 255)]
    return [[int(x) for x in r] for r in rows]


def difference(a, b, dark, bright):
    kept = [(x, y) for x, y in zip(a, b, strict=True) if not (dark and min(x, y) <= 0x20) and not (bright and max(x, y) >= 0xF0)]
    return sum(abs(x - y) for x, y in kept) / len(kept) / 256 if kept else None


def turned(f):
    return [x for r in range(SIDE) for x in f[r * SIDE : (r + 1) * SIDE][::-1]]


@pytest.mark.parametrize("dark,bright", [(True, False), (False, True), (True, True)])
def test_pairs_of_places_that_count(spark, dark, bright):
    frames = made(1)
    got = {(r.a_key, r.b_key): r.difference for r in similarity.gray_pairs(spark.createDataFrame(list(enumerate(frames)), "id int, frame array<int>"), "id", "frame", SIDE, 0.05, dark, bright).collect()}
    want = {(i, j): d for i, a in enumerate(frames) for j, b in enumerate(frames) if i < j and (d := difference(a, b, dark, bright)) is not None and d <= 0.05}
    assert got.keys() == want.keys() and len(want) > 20
    assert all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("dark,bright,flips", [(False, False, True), (True, False, True), (True, True, False)])
def test_verdicts_of_pairs_under_all_settings(spark, dark, bright, flips):
    frames = made(2)
    s = verdicts.Settings(percent=95.0, use_ai=False, ignore_dark=dark, ignore_bright=bright)
    rows = [(i, i % 2 == 0, [f, frames[(i + 5) % len(frames)]] if i % 2 else [f, f], None, None) for i, f in enumerate(frames)]
    items = spark.createDataFrame(rows, "key long, image boolean, frames array<array<int>>, hashes array<long>, vectors array<array<double>>")
    got = {(r.a_key, r.b_key): (round(r.difference, 9), flips and r.flipped) for r in verdicts.pairs(items, 2, SIDE, s, flips).collect()}

    def verdict(a, b, image):
        each = [difference(x, y, dark, bright) for x, y in zip(a, b, strict=True)][: 1 if image else 2]
        return sum(each) / len(each) if None not in each and sum(each) <= s.most_difference * len(each) else None

    want = {}
    for i, image, a, *_ in rows:
        for j, other, b, *_ in rows:
            if i < j and image == other:
                plain, mirrored = verdict(a, b, image), verdict([turned(f) for f in a], b, image) if flips else None
                found = [d for d in (plain, mirrored) if d is not None]
                if found:
                    want[i, j] = (round(min(found), 9), mirrored is not None and (plain is None or mirrored < plain))
    assert got == want and (not flips or any(f for _, f in want.values()))


def test_places_of_all_rows(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 1, 1, 1, 2, 3]), rng.random()) for i in range(500)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "id int, a int, b double, place int")
    for parts in (1, 7):
        got = {r.id: r.place for r in ordering.placed(frame, [F.desc("a"), F.asc("b"), F.asc("id")], parts=parts).collect()}
        assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == [r[0] for r in sorted(rows, key=lambda r: (-(r[1] or 0), r[2], r[0]))]
        assert sorted(got.values()) == list(range(1, 501))
    assert ordering.placed(frame.limit(0), [F.asc("id")]).collect() == []
    last = {}
    for i, a, _ in sorted(rows, key=lambda r: r[0]):
        last.setdefault(a, []).append(i)
    before = {i: own[k - 1] if k else None for own in last.values() for k, i in enumerate(own)}
    assert {r.id: r.before_id for r in ordering.beside(frame, "a", [F.asc("id")], ["id"]).collect()} == before


@pytest.mark.parametrize("mode", results.SORT_MODES)
def test_ten_modes(spark, mode):
    rng = random.Random(1)
    rows = [(g, p, f"/f{rng.randrange(4)}/{p}", rng.randrange(5), rng.randrange(3), rng.random() < 0.3, rng.random() < 0.5, rng.randrange(4), rng.randrange(3), rng.randrange(3)) for g in range(20) for p in range(rng.randrange(1, 4))]
    names = "grp place path size similarity checked live created seconds frame".split()
    frame = spark.createDataFrame(rows, "grp int, place int, path string, size int, similarity int, checked boolean, live boolean, created int, seconds int, frame int")
    sets = {}
    for r in rows:
        sets.setdefault(r[0], []).append(dict(zip(names, r, strict=True)))
    figure = {
        "wasted space": lambda m: sum(x["size"] for x in m) - max(x["size"] for x in m), "total size": lambda m: sum(x["size"] for x in m), "largest file": lambda m: max(x["size"] for x in m), "file count": len,
        "similarity": lambda m: max(x["similarity"] for x in m), "date created": lambda m: max(x["created"] for x in m), "duration": lambda m: max(x["seconds"] for x in m), "resolution": lambda m: max(x["frame"] for x in m),
        "folder path": lambda m: min(x["path"] for x in m), "checked": lambda m: any(x["checked"] for x in m),
    }[mode]
    member = {"wasted space": "size", "total size": "size", "largest file": "size", "similarity": "similarity", "date created": "created", "duration": "seconds", "resolution": "frame", "folder path": "path"}.get(mode)
    for down in (False, True):
        order = sorted(sets)
        order.sort(key=lambda g: figure(sets[g]), reverse=down)
        if down:  # reverse keeps equal ones in order too
            order = [g for v in sorted({figure(m) for m in sets.values()}, reverse=True) for g in sorted(sets) if figure(sets[g]) == v]
        want = []
        for g in order:
            own = sorted(sets[g], key=lambda x: x["place"])
            if member:
                own = [x for v in sorted({x[member] for x in own}, reverse=down) for x in own if x[member] == v]
            want += [(g, x["place"]) for x in own]
        got = [(r.grp, r.place) for r in results.listed(frame, mode, down).orderBy("listed").collect()]
        assert got == want


def test_a_listing_deals_out_only_what_it_keeps(spark, monkeypatch):
    rows = [(1 + i % 3, i, f"/p{i}", True, 10.0 * (i % 4), False, True, i, "2024-01-01", 1.0, 1) for i in range(12)]
    frame = spark.createDataFrame(rows, "grp long, place long, path string, image boolean, similarity double, checked boolean, live boolean, size long, created string, seconds double, frame int")
    whole = {(r.grp, r.place): r.listed for r in results.listed(frame, "similarity", True).collect()}
    columns = []
    monkeypatch.setattr(results.ordering, "written", lambda d, name: columns.append(set(d.columns)) or d)
    got = results.listed(frame, "similarity", True, ["grp", "place"])
    assert got.columns == ["grp", "place", "listed"] and {(r.grp, r.place): r.listed for r in got.collect()} == whole
    assert columns == [{"grp", "place", "similarity", "_set_most_alike", "_place_at"}]


@pytest.mark.parametrize("told_apart", [False, True])
@pytest.mark.parametrize("combine", [False, True])
def test_pairs_found_twice_are_rows_once(spark, monkeypatch, combine, told_apart):
    """By frames, codes and embeddings at once, with missing ones: the verdict of each pair, without bringing all that was found together."""
    rng = np.random.default_rng(31)
    rows = []
    for i in range(48):
        k = i % 8
        own = np.random.default_rng(k)  # eight families whose members differ by more and more
        frames = np.clip(own.integers(40, 200, (4, 16)) + rng.integers(-1 - i // 3, 2 + i // 3, (4, 16)), 0, 255).tolist()
        codes = [int(c) ^ int(rng.integers(0, 1 << (i // 4))) for c in own.integers(-(2**63), 2**63, 4)]
        vectors = own.normal(size=(4, 8)) + rng.normal(size=(4, 8)) * i / 60
        vectors = [(v / np.linalg.norm(v)).tolist() if rng.random() > 0.2 else None for v in vectors]
        if i % 11 == 5:
            codes[1] = None
        if i % 13 == 6:
            frames[2][3] = None
        rows.append((i, k == 3, frames, codes, vectors))
    items = spark.createDataFrame(rows, "key long, image boolean, frames array<array<int>>, hashes array<bigint>, vectors array<array<double>>")
    s = verdicts.Settings(percent=95.0, ai_percent=80.0, quorum=0.5, combine=combine)
    monkeypatch.setattr(similarity, "cosines_told_apart", lambda *a: told_apart)
    out = verdicts.pairs(items, 4, 4, s)
    quantised = items.withColumn("vectors", F.transform("vectors", signal.quantised))
    a, b = (quantised.select(*[F.col(c).alias(f"{x}_{c}") for c in quantised.columns]) for x in "ab")
    both = a.join(b, F.expr("a_key < b_key and a_image = b_image"))
    v = verdicts.union(*[{c: F.col(f"{x}_{c}") for c in ("frames", "hashes", "vectors")} for x in "ab"], F.col("a_image"), 4, s)
    want = both.select("a_key", "b_key", *v.columns()).where("difference is not null")
    told = [{(r.a_key, r.b_key): (round(r.difference, 9), r.by_gray, r.by_hash, r.by_ai) for r in d.collect()} for d in (out, want)]
    assert told[0] == told[1] and len(told[1]) > 60 and len({x[1:] for x in told[1].values()}) >= 2 + 2 * combine and out.count() == len(told[1])
    assert "max(gray" not in out._jdf.queryExecution().optimizedPlan().toString()
