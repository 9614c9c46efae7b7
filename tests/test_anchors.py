"""Words in common of two readings, in bounded room, against the whole table."""

import random
import tracemalloc

from kindred.operators.readings import anchors


def whole_table(a, b):
    rest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            rest[i][j] = max(rest[i + 1][j], rest[i][j + 1], rest[i + 1][j + 1] + 1 if a[i] == b[j] else 0)
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif rest[i + 1][j] >= rest[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_anchors_equal_those_of_the_whole_table():
    rng = random.Random(1)
    for _ in range(400):
        kinds = rng.choice([1, 2, 3, 6, 30])
        a, b = ([str(rng.randrange(kinds)) for _ in range(rng.choice([0, 1, 2, 4, 9, 17, 40]))] for _ in "ab")
        assert anchors(a, b) == whole_table(a, b)


def test_long_readings_take_little_room():
    rng = random.Random(2)
    a, b = ([str(rng.randrange(300)) for _ in range(4000)] for _ in "ab")
    tracemalloc.start()
    found = anchors(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(a[i] == b[j] for i, j in found) and most < 16_000_000  # the whole table: 64 MB
