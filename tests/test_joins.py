"""Similarity joins against all pairs, how many pairs they compare, and cases of rules that the tables do not show."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import names
from kindred.operators import blocks, candidates, ranking, reasons, rollups, similarity, timelines


def clustered(rng, n, centres, dims, spread):
    middle = rng.normal(size=(centres, dims))
    x = middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pair_set(frame):
    return {(r.a_key, r.b_key) for r in frame.collect()}


def test_cosine_pairs_are_those_of_all_and_few_are_compared(spark):
    rng = np.random.default_rng(1)
    x = clustered(rng, 1500, 60, 24, 0.02)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None), (5001, [float("nan")] * 24), (5002, []), (5003, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    q = np.clip(np.rint(x * 127), -127, 127).astype(int)
    want = {(i, j) for i in range(len(q)) for j in np.flatnonzero(q[i] @ q.T / 16129.0 >= 0.97) if i < j}
    assert pair_set(similarity.cosine_pairs(frame, "id", "v", 0.97)) == want
    seen = blocks.compared(similarity.cosine_blocks(frame, "id", "v", 0.97, room=200)).agg(F.sum("n")).first()[0]
    assert len(want) <= seen < 0.1 * len(x) * (len(x) - 1) / 2


@pytest.mark.parametrize("room", [50, 4096])
def test_gray_pairs_are_those_of_all_and_few_are_compared(spark, room):
    rng = np.random.default_rng(2)
    base = np.clip(rng.normal(128, 60, size=(50, 1, 1)) + rng.normal(0, 50, size=(50, 4, 4)), 0, 255)
    x = np.clip(np.repeat(base, 16, 0).reshape(800, 4, 4).repeat(4, 1).repeat(4, 2) + rng.integers(-3, 4, size=(800, 16, 16)), 0, 255).astype(int).reshape(800, -1)
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, f array<int>")
    want = {(i, j) for i in range(800) for j in np.flatnonzero(np.abs(x - x[i]).sum(1) <= 0.015 * 256 * 256) if i < j}
    assert pair_set(similarity.gray_pairs(frame, "id", "f", 16, 0.015)) == want
    seen = sum(blocks.compared(d).agg(F.sum("n")).first()[0] for d in similarity.gray_blocks(frame, "id", "f", 0.015, room=room))
    assert len(want) <= seen and (room > 50 or seen < 0.1 * 800 * 799 / 2)


def test_equal_frames_only(spark):
    frame = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [1, 2, 3, 4]), (3, [1, 2, 3, 5])], "id long, f array<int>")
    assert pair_set(similarity.gray_pairs(frame, "id", "f", 2, 0.0)) == {(1, 2)}
    assert similarity.gray_pairs(frame.where("false"), "id", "f", 2, 0.1).collect() == []


@pytest.mark.parametrize("most", [3, 15, 16, 24])
def test_hamming_pairs_are_those_of_all(spark, most):
    rng = np.random.default_rng(most)
    codes = [int(c) for c in rng.integers(-(2**63), 2**63 - 1, 40)]
    codes += [c ^ sum(1 << int(b) for b in rng.permutation(63)[: rng.integers(0, 30)]) for c in codes] + [codes[0], -1, 0]
    frame = spark.createDataFrame(list(enumerate(codes)), "id long, c long")
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    want = {(i, j): bits(a, b) for i, a in enumerate(codes) for j, b in enumerate(codes) if i < j and bits(a, b) <= most}
    assert {(r.a_key, r.b_key): r.bits for r in similarity.hamming_pairs(frame, "id", "c", most).collect()} == want


def test_tolerance_of_durations(spark):
    cases = [(100.0, 0, 1, 5, 5.0), (100.0, 0, 4, 2, 4.0), (100.0, 10, 1, 5, 5.0), (100.0, 10, 1, 0, 10.0), (100.0, 1, 0, 5, 1.0), (100.0, 0.5, 1, 5, 1.0), (100.0, 0, 0, 0, 0.0)]
    for d, percent, least, most, want in cases:
        assert spark.range(1).select(similarity.tolerance(F.lit(d), percent, least, most).alias("t")).first().t == want
    rows = spark.createDataFrame([(1, 100.0), (2, 104.0), (3, 100.0), (4, 1000.0), (5, 1080.0)], "key long, d double")
    assert pair_set(similarity.duration_pairs(rows, "key", "d", 0, 0, 0)) == {(1, 3)}
    assert pair_set(similarity.duration_pairs(rows, "key", "d", 8, 0, 0)) == {(1, 2), (1, 3), (2, 3), (4, 5)}


def test_user_conditions():
    for good in ("size > 10 and lower(name) like 'a%'", "a in (1, 2) or b is not null", "not (x between 1 and 2)", "coalesce(a, 0) * 2 >= b"):
        assert reasons.user_condition(good) is not None
    for bad in ("id in (select\n1)", "exists(select\t1)", "java_method('a', 'b')", "reflect('a')", "a = 1; drop table x", "a -- b", "a /* b */ = 1", "input_file_name() = 'x'", "x -> x", "", "a = $1", "(with t as (select 1) select 1)"):
        with pytest.raises(ValueError):
            reasons.user_condition(bad)
    with pytest.raises(ValueError):
        reasons.user_condition("other > 1", ["size"])
    assert reasons.user_condition("SIZE > 1", ["size"]) is not None


def test_names_of_any_script_and_log_keys(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(names.plain_name(F.lit("  Ведьмак 3: Дикая Охота "))) == "ведьмак 3 дикая охота"
    assert one(names.plain_name(F.lit("Pokémon—日本 II"))) == "pokémon 日本 ii"
    for message, want in (("read 12 of 345", "1|read # of #"), ("can't open 'C:\\x 1' now", "1|can'*'C:\\x #'"), ("a \"b\" 'c' 7", "1|a \"*\" '*' #"), ("open 'never closed 12", "1|open '"), ("\"it's\" 5", "1|\"*\" #"), ("'a' 'b 9", "1|'*' '"), ("", "1|")):
        assert one(names.log_key(F.lit(1), F.lit(message))) == want


def test_missing_values_count(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, None), (2, None), (3, "a"), (3, None), (4, "b")], "g int, v string")
    odd = sorted((r.g, r.v or "", r.odd) for r in rollups.odd_ones(rows, "g", "v").collect())
    assert odd == [(1, "", True), (1, "a", False), (1, "a", False), (2, "", False), (2, "", False), (3, "", True), (3, "a", True), (4, "b", False)]
    same = {r.g: r.same_v for r in rollups.group_headers(rows.withColumn("s", F.lit(1)), "g", "s", ["v"], {}).collect()}
    assert same == {1: False, 2: True, 3: False, 4: True}


def test_series_and_bursts(spark):
    rows = [(1, "d", "img#", 10), (2, "d", "img#", 10), (3, "d", "img#", 13), (4, "d", "img#", 40), (5, "e", "img#", 25), (6, "e", "other#", 11), (7, "f", "img#", 70)]
    frame = spark.createDataFrame(rows, "id long, folder string, series string, n long").withColumn("timed", F.lit(False))
    near = {r.id: r.in_series for r in ranking.burst_neighbours(frame, ["folder", "series"], "n", 5).collect()}
    assert near == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False, 7: False}
    assert pair_set(ranking.burst_pairs(frame, "id", "folder", "series", "n", "timed")) == {(1, 3), (2, 3), (1, 5), (2, 5), (3, 5)}


@pytest.mark.parametrize("room", [40, 100_000])
def test_burst_counts_are_those_of_the_pairs(spark, room):
    rng = np.random.default_rng(4)
    rows = [(int(k), f"f{rng.integers(4)}", f"s{rng.integers(2)}", int(rng.integers(0, 4_000_000) if t else rng.integers(-60, 90)), bool(t)) for k, t in zip(rng.integers(0, 400, 500), rng.integers(0, 2, 500), strict=True)]
    series = [(k, f, f"{s}{t}", n, t) for k, f, s, n, t in rows] + [(1, "g", "s", None, False), (2, "g", "alone", 7, False)]
    frame = spark.createDataFrame(series, "id long, folder string, series string, n long, timed boolean")
    # an id is of several rows here, so its folder is told by a number of the row
    inside = {(r.folder, r.series, r.n): r.in_series for r in ranking.burst_neighbours(frame.where("n is not null"), ["folder", "series"], "n", F.when(F.col("timed"), 60_000).otherwise(5)).collect()}
    want = {}
    for ka, fa, sa, na, ta in series:
        for kb, fb, sb, nb, _ in series:
            if None not in (na, nb) and ka < kb and sa == sb and 0 < abs(na - nb) <= (300_000 if ta else 20) and (inside[fa, sa, na] or inside[fb, sb, nb]):
                want[fa] = want.get(fa, 0) + 1
    assert {r.folder: r.pairs for r in ranking.burst_counts(frame, "id", "folder", "series", "n", "timed", room).collect()} == want


def test_burst_counts_make_no_rows_of_pairs(spark):
    n = 40_000  # 2 million pairs a number
    frame = spark.range(n).selectExpr("id", "'f' AS folder", "'s' AS series", "id % 4 AS n", "false AS timed")
    assert [tuple(r) for r in ranking.burst_counts(frame, "id", "folder", "series", "n", "timed", 5000).collect()] == [("f", 6 * (n // 4) ** 2)]


@pytest.mark.parametrize(("percent", "least", "most"), [(0, 0, 0), (0.7, 1, 5), (2, 0, 0), (0, 3, 1)])
def test_duration_counts_are_those_of_the_pairs(spark, percent, least, most):
    rng = np.random.default_rng(6)
    rows = [(i, "ab"[i % 2], float(d)) for i, d in enumerate(np.round(rng.uniform(0, 400, 500), 1))] + [(900, "a", None), (901, None, 3.0), (902, "c", 5.0)]
    frame = spark.createDataFrame(rows, "key long, kind string, d double")
    want = {}
    for r in similarity.duration_pairs(frame, "key", "d", percent, least, most, F.col("a_kind") == F.col("b_kind"), ("kind",)).collect():
        n, far = want.get(r.a_kind, (0, 0))
        want[r.a_kind] = (n + 1, max(far, r.b_key - r.a_key))
    assert {r.kind: (r.pairs, r.widest) for r in similarity.duration_counts(frame, "key", "d", percent, least, most, ["kind"]).collect()} == want


def test_duration_counts_make_no_rows_of_pairs(spark):
    frame = spark.range(200_000).selectExpr("id AS key", "'a' AS kind", "CAST(100 + id % 3 AS double) AS d")
    assert [tuple(r) for r in similarity.duration_counts(frame, "key", "d", 0.25, 1.0, 5.0, ["kind"]).collect()] == [("a", 200_000 * 199_999 // 2 - 66_667 * 66_666, 199_999)]


@pytest.mark.parametrize("room", [3, 1000])
def test_folder_pairs_are_those_of_all(spark, room):
    rng = np.random.default_rng(8)
    tails = ["", "/x", "/y/x"]
    rows = [(int(g), f"p{f}{tails[t]}") for g, f, t in zip(rng.integers(0, 60, 900), rng.integers(0, 9, 900), rng.integers(0, 3, 900), strict=True)] + [(1, None), (None, "p1"), (2, "lone")]
    frame = spark.createDataFrame(rows, "g int, f string")
    sets = {}
    for g in range(60):
        own = sorted({f for h, f in rows if h == g and f})
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                x, y = a.split("/"), b.split("/")
                while x and y and x[-1] == y[-1]:
                    x, y = x[:-1], y[:-1]
                sets.setdefault(tuple(sorted(["/".join(x), "/".join(y)])), set()).add(g)
    want = {p: len(s) for p, s in sets.items() if len(s) >= 9}
    assert len(want) > 10 and {tuple(r.pair): r.sets for r in rollups.folder_pairs(frame, "g", "f", 9, room).collect()} == want


def test_folder_pairs_sum_before_they_are_rows(spark):
    """Only sums leave the tasks: 380,000 rows of pairs before, now one each of 190 pairs a task."""
    import pyarrow as pa

    g, f = np.repeat(np.arange(2000), 20), np.tile(np.arange(20), 2000)
    zeros = pa.array(np.zeros(len(g), np.int32))
    out = rollups._pairs_of_sets(pa.table({"g": pa.array(g), "lo": zeros, "hi": zeros, "me": zeros, "folder": pa.array([f"d{x}" for x in f])}))
    assert out.num_rows == 190 and set(out["n"].to_pylist()) == {2000}


def test_l1_distances_of_bytes_and_of_any_values():
    rng = np.random.default_rng(9)
    for low, high in ((0, 256), (-300, 3000)):
        x, y = (rng.integers(low, high, (n, 300)).astype("<i2") for n in (70, 45))
        far = np.abs(x[:, None].astype(int) - y[None])
        assert (similarity.l1_distances(x, y) == far.sum(2)).all()
        p, q = x > 40, y > 90
        assert (similarity.l1_distances(x, y, p, q) == (far * (p[:, None] & q[None])).sum(2)).all()


@pytest.mark.parametrize("ignore", [False, True])
def test_frames_of_several_parts_meet_whole(spark, ignore):
    """Every pair is alike in its first part; only pairs whose mean over the parts is within the limit are rows."""
    rng = np.random.default_rng(10)
    x = rng.integers(20, 250, (120, 4, 16))
    x[:, 0] = 100
    x[60:] = np.clip(x[:60] + rng.integers(-30, 31, (60, 1, 1)), 0, 255)
    frame = spark.createDataFrame([(i, r.ravel().tolist()) for i, r in enumerate(x)], "id long, f array<int>")
    want = {}
    for i in range(120):
        for j in range(i + 1, 120):
            ok = (np.minimum(x[i], x[j]) > 32) & (np.maximum(x[i], x[j]) < 240) if ignore else np.ones((4, 16), bool)
            if ok.any(1).all() and (mean := ((np.abs(x[i] - x[j]) * ok).sum(1) / ok.sum(1) / 256.0).mean()) <= 0.05:
                want[i, j] = pytest.approx(mean)
    got = {(r.a_key, r.b_key): r.difference for r in similarity.gray_pairs(frame, "id", "f", 4, 0.05, ignore, ignore, parts=4).collect()}
    assert 10 < len(want) < 120 and got == want


def test_mean_cosine_pairs_are_those_of_all(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(90, 3, 8))
    x /= np.linalg.norm(x, axis=2, keepdims=True)
    there = rng.random((90, 3)) < 0.7
    rows = [(i, i % 2, [v.tolist() if t else None for v, t in zip(r, m, strict=True)]) for i, (r, m) in enumerate(zip(x, there, strict=True))]
    frame = spark.createDataFrame([*rows, (900, 1, None), (901, 1, []), (902, 0, [None, None, [float("nan")] * 8])], "id long, g int, v array<array<double>>")
    q, want = np.rint(x * 127), {}
    for i in range(90):
        for j in range(i + 2, 90, 2):
            if (both := there[i] & there[j]).sum() >= 2 and (c := ((q[i] * q[j]).sum(1)[both] / 16129.0).mean()) >= 0.2:
                want[i, j] = pytest.approx(c)
    got = {(r.a_key, r.b_key): r.cosine for r in similarity.mean_cosine_pairs(frame, "id", "v", "g", 0.2, room=20).collect()}
    assert len(want) > 50 and got == want


def test_clips_of_any_length_are_found_wherever_their_errors_lie(spark):
    rng = np.random.default_rng(12)
    sources = [[int(c) for c in rng.integers(0, 2**32, 30)] for _ in range(12)]
    clips = []
    for i, s in enumerate(sources):
        n, at = int(rng.integers(1, 12)), int(rng.integers(0, 15))
        bits = [0] * n
        for _ in range(int(0.1 * 32 * n) + i % 2):  # up to the limit, or one bit beyond it; crowded at an end
            bits[0 if i % 3 == 0 else n - 1 if i % 3 == 1 else int(rng.integers(n))] += 1
        if max(bits) <= 32:
            clips.append((100 + i, [c ^ sum(1 << int(b) for b in rng.permutation(32)[:k]) for c, k in zip(s[at : at + n], bits, strict=True)]))
    frames = [spark.createDataFrame(r, "id int, codes array<bigint>") for r in ([*enumerate(sources), (50, [0] * 30), (51, [])], [*clips, (200, [0, 0])])]
    want = {}
    for i, s in enumerate(sources):
        for j, c in clips:
            for at in range(len(s) - len(c) + 1):
                alike = 1 - sum((x ^ y).bit_count() for x, y in zip(c, s[at:], strict=False)) / (32 * len(c))
                if alike >= 0.9 and alike > want.get((i, j), (0, 0))[0]:
                    want[i, j] = (alike, at)
    got = {(r.source, r.clip): (r.similarity, r.offset) for r in timelines.clips_within(*frames, "id", "codes", 0.9).collect()}
    assert 3 <= len(want) < len(clips) and got == want
    looked = timelines._ahead("codes")
    assert [len(x) for x in frames[0].where("id = 1").select(looked.alias("x")).first().x[-4:]] == [4, 3, 2, 1]


def test_table_function_takes_bytes_as_they_are(spark):
    """Frames are judged in the width that they come in: the same pairs as all."""
    x = np.random.default_rng(13).integers(0, 256, (80, 16))
    x[40:] = np.clip(x[:40] + 3, 0, 255)
    candidates.register(spark)
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, f array<int>")
    (index,) = similarity.gray_blocks(frame, "id", "f", 0.02, room=16)
    got = {(r.a_key, r.b_key) for r in spark.sql("SELECT * FROM similar_pairs(TABLE({rows}), 'gray', 0.02)", rows=index).collect()}
    assert got == {(i, j) for i in range(80) for j in range(i + 1, 80) if np.abs(x[i] - x[j]).sum() <= 0.02 * 256 * 16} and len(got) >= 40


def test_folder_pairs_below_the_least_are_no_rows(spark):
    """Sets whose pairs are nearly all different: before, each was a row that was shuffled; now a block holds all sets of its pairs."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    g, f = np.repeat(np.arange(400), 12), np.concatenate([rng.choice(3000, 12, replace=False) for _ in range(400)])
    g, f = np.concatenate([g, np.repeat(np.arange(6), 2)]), np.concatenate([f, np.tile([9000, 9001], 6)])  # one pair in six sets
    order = np.argsort(g, kind="stable")
    blocks = rollups._dealt(pa.table({"g": g[order], "id": f[order]}), 3)
    ids = np.unique(f)
    more = pa.table({"id": ids, "last": ids, "leaf": np.ones(len(ids), bool), "alone": np.zeros(len(ids), bool), "folder": [f"d{i}" for i in ids]})
    found = []
    for b in sorted(set(blocks["block"].to_pylist())):
        own = blocks.filter(pa.compute.equal(blocks["block"], b)).to_pylist()
        found += rollups._counted_block(pa.Table.from_pylist(own + more.to_pylist(), schema=rollups._HELD), 6).to_pylist()
    assert len(set(blocks["block"].to_pylist())) == 6 and found == [{"a": "d9000", "b": "d9001", "n": 6, "once": True}]


@pytest.mark.parametrize("table", [1 << 25, 1 << 6])
@pytest.mark.parametrize("least", [1, 5])
@pytest.mark.parametrize("full", [False, True])
def test_counted_pairs_are_those_of_all(table, least, full):
    """With a counter for each pair, with fewer than pairs, and in sets that nearly all folders are in."""
    rng = np.random.default_rng(6)
    sides = [[rng.choice(n, rng.integers(n // 2 if full else 0, n if full else 5), replace=False) for _ in range(60)] for n in (12, 15)]
    flat = [(np.concatenate(s).astype(np.int32), np.array([len(x) for x in s])) for s in sides]
    kept = lambda x, y, n: n >= least
    for second in (sides[1], None):
        want = {}
        for i, x in enumerate(sides[0]):
            for p in [(u, v) for u in x for v in second[i]] if second else [(u, v) for u in x for v in x if u < v]:
                want[p] = want.get(p, 0) + 1
        x, y, n = rollups._counted(*flat[0], *(flat[1] if second else (None, None)), (12, 15) if second else (12, 12), kept, least, table)
        assert dict(zip(zip(x.tolist(), y.tolist(), strict=True), n.tolist(), strict=True)) == {(int(u), int(v)): c for (u, v), c in want.items() if c >= least}


def test_only_seconds_that_start_a_match_leave_the_cells_of_clips(spark, monkeypatch):
    """Chance candidates are judged in the tasks: before, every pair of seconds with an equal byte was a row. Cells of many rows are dealt in chunks."""
    rng = np.random.default_rng(21)
    series = [(i, [int(c) for c in rng.integers(0, 2**32, 40)]) for i in range(60)] + [(60, [7] * 400)]
    clips = [(100 + i, [c ^ 3 for c in s[10:25]]) for i, s in series[:60:3]] + [(200, [7] * 12)]
    frames = [spark.createDataFrame(r, "id int, codes array<bigint>") for r in (series, clips)]
    held, chunks = [], []
    writing, dealing = timelines.written, timelines._chunks_of
    monkeypatch.setattr(timelines, "written", lambda df, name: held.append(writing(df, name)) or held[-1])
    monkeypatch.setattr(timelines, "_chunks_of", lambda p, room: chunks.append(dealing(p, room)) or chunks[-1])
    got = {(r.source, r.clip): (r.similarity, r.offset) for r in timelines.clips_within(*frames, "id", "codes", 0.9, 50).collect()}
    assert got == {(i, 100 + i): (1 - 2 / 32, 10) for i in range(0, 60, 3)} | {(60, 200): (1.0, 0)}
    assert max(chunks[0]) >= 8 and {(r.source, r.clip) for r in held[0].collect()} == set(got)
