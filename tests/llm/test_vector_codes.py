"""Vector codes against plain Python integers: screening intervals, ties, nulls, repeated rows, few vectors, lengths."""

import hashlib
import math

import numpy as np
import pytest

from kindred.llm.vector_codes import LARGEST, VectorCodes, nearest, screened


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """rows (vec_id, vector, label): {row: (code, error, label_error)} and the digest, in Python integers."""
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    w = width // parts
    cut = lambda v: [(v + [0] * (width - len(v)))[p * w : (p + 1) * w] for p in range(parts)]
    start = sorted(((i, v) for i, v, _ in kept if i is not None))[:entries]
    books = [[cut(v)[p] for _, v in start] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda a, book: min(range(len(book)), key=lambda e: (dist(a, book[e]), e))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            of = {}
            for _, v, _ in kept:
                of.setdefault(pick(cut(v)[p], books[p]), []).append(cut(v)[p])
            for e, own in of.items():
                new[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
        books = new
    out, by_label = [], {}
    for i, v, lab in kept:
        best = [pick(cut(v)[p], books[p]) for p in range(parts)]
        error = sum(dist(cut(v)[p], books[p][e]) for p, e in enumerate(best))
        by_label[lab] = by_label.get(lab, 0) + error
        out.append((i, "".join(f"{e:02x}" for e in best), error, lab))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[lab]) for i, c, e, lab in out), key=repr), digest


def run(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "vec_id long, embedding array<float>, label int, code string, error double")
    codes = VectorCodes(**kw).fit(frame)
    found = codes.errors(codes.coded(frame)).collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in found), key=repr), codes.digest()


@pytest.mark.parametrize("entries", [1, 7, 256])
def test_against_plain_integers(spark, entries):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=8)], int(i) % 3 if i % 5 else None) for i in rng.permutation(60)]
    rows += [(3, rows[0][1], 1)] * 4 + [(None, [0.5] * 8, 2), (61, None, 1), (62, [0.1, None] * 4, 1), (63, [float("nan")] * 8, 1), (64, [float("inf")] * 8, None), (-5, [0.25] * 8, None)]
    assert run(spark, rows, entries=entries) == plain(rows, entries=entries)


def test_lengths_equal_vectors_and_empty_tables(spark):
    rows = [(1, [0.5, -0.25, 0.125], 0), (2, [], 0), (3, [1.0, 2.0, 3.0, 4.0, 5.0], 1), *((i, [0.75] * 5, None) for i in range(4, 30))]
    assert run(spark, rows) == plain(rows)
    assert run(spark, [(1, [], None), (2, [], 3)])[0] == plain([(1, [], None), (2, [], 3)])[0]
    assert run(spark, [(1, None, None)])[0] == [] and run(spark, [])[0] == []
    assert run(spark, [(None, [0.5], 1)])[0] == []  # no entry can start


@pytest.mark.parametrize("size", [3, 1000, LARGEST])
def test_intervals_hold_the_nearest(size):
    """Entries one step apart, where float32 cannot tell them apart, and ties between them."""
    rng = np.random.default_rng(size)
    base = rng.integers(-size, size + 1, (1, 16))
    entries = np.concatenate([np.clip(base + rng.integers(-1, 2, (40, 16)), -size, size), rng.integers(-size, size + 1, (20, 16))])
    entries = entries[rng.integers(0, 60, 80)]
    v = np.concatenate([np.clip(base + rng.integers(-2, 3, (300, 16)), -size, size), entries])
    d = ((v[:, None] - entries[None]) ** 2).sum(2)
    best, error = nearest(v, entries, most=1000)
    assert (best == d.argmin(1)).all() and (error == d.min(1)).all()
    assert screened(v, entries)[np.arange(len(v)), d.argmin(1)].all()
    assert screened(v, entries).sum() < v.shape[0] * len(entries) or size == 3


def test_screening_leaves_few(spark):
    rng = np.random.default_rng(1)
    v, entries = rng.integers(-500, 500, (2000, 16)), rng.integers(-500, 500, (256, 16))
    assert screened(v, entries).sum() < 1.01 * len(v)


def test_too_large(spark):
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(1, [1e9], 0)])
