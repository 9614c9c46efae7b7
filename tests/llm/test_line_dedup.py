"""Line dedup against plain loops: nulls, ties, repeated rows and ids, white space, clashing columns, many documents."""

import random
from collections import defaultdict

import pytest

from kindred.llm.line_dedup import LineDedup

SPACE = " \t\n\x0b\x0c\r"
LONG = "All rights of this page are reserved by its publisher and authors"


def plain(rows, least=40, documents=5):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least and i is not None:
                held[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held[key(x)]) >= documents and max(held[key(x)]) != i)]
        out.append((i, t, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def got(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, 1, "k", [2]) for r in rows], "doc_id long, text string, kept int, digest string, positions array<int>")
    out = LineDedup(**kw).kept(frame).collect()
    return sorted(((r.doc_id, r.text, r.kept, r.n_lines, r.n_dropped) for r in out), key=repr)


@pytest.mark.parametrize("slices", [1, 64])
def test_against_plain_loops(spark, slices):
    rng = random.Random(3)
    pool = [LONG, LONG.upper(), f"\t {LONG}\r", LONG + " é", "x" * 39, "X" * 40, "", "  ", "é" * 40, "É" * 40, "own line of some length that is long enough to count"]
    rows = [(i, "\n".join(rng.choice(pool) + (f" {i}" if rng.random() < 0.2 else "") for _ in range(rng.randint(0, 9)))) for i in range(60)]
    rows += [(None, LONG + "\nown"), (None, None), (70, None), (71, ""), (72, "\n"), (72, "\n"), (73, f"{LONG}\n{LONG}"), (73, f"{LONG}\nother text of one id"), (73, f"{LONG}\n{LONG}")]
    rng.shuffle(rows)
    assert got(spark, rows, slices=slices) == plain(rows)


def test_limits(spark):
    four, five = [(i, f"{'a' * 40}\nb") for i in range(4)], [(i, f"{'c' * 40}\nb") for i in range(10, 15)]
    rows = four + five + [(3, f"{'a' * 40}\nb")] * 3
    out = got(spark, rows)
    assert out == plain(rows)
    assert sum(r[4] for r in out) == 4


def test_very_long_text_and_empty_table(spark):
    rows = [(1, "\n".join([LONG, "z"] * 30_000)), *((i, LONG) for i in range(2, 8))]
    assert got(spark, rows) == plain(rows)
    assert LineDedup().kept(spark.createDataFrame([], "doc_id long, text string")).collect() == []
