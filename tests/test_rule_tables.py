"""Thousands of rules as rows against a plain loop."""

import random
import re

from pyspark.sql import functions as F

from kindred.operators import rules
from kindred.operators.results import black_listed


def test_ten_thousand_rules_against_a_plain_loop(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcDE.+") for _ in range(rng.randrange(1, 5)))
    folders = ["/".join([""] + [word() for _ in range(rng.randrange(1, 5))]) for _ in range(300)] + [None, "", "/", "x"]
    entries = []
    for _ in range(10_000):
        kind = rng.randrange(4)
        base = rng.choice(folders[:300]) if kind % 2 else word() + word() + word()
        if kind == 1:
            base = base[: rng.randrange(2, len(base) + 1)] + rng.choice(["", "/", "zz"])
        if kind > 1:
            k = rng.randrange(len(base) + 1)
            base = base[:k] + rng.choice("*?") + base[k + rng.randrange(3) :] + rng.choice(["", "q"])
        entries.append(base)
    entries += [None, "[a]*", "E\\*"]

    def covers(entry, folder):
        low, f = entry.lower(), folder.lower()
        chain = ["/".join(f.split("/")[:n]) for n in range(1, len(f.split("/")) + 1)]
        own = chain if "/" in low else [s for s in f.split("/") if s]
        if re.search("[*?]", low):
            pattern = re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in low), re.S)
            return any(pattern.fullmatch(s) for s in own)
        return low.rstrip("/") in own if "/" in low else low in own

    places = list(range(len(entries)))
    rng.shuffle(places)
    table = spark.createDataFrame(list(zip(places, entries, ["why"] * len(places), strict=True)), "place long, entry string, reason string")
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(folders)], "id int, path string")
    got = {r.id: r.rule and (r.rule.place, r.rule.reason) for r in rules.first_rule(rows, "path", table).collect()}
    by_place = sorted(zip(places, entries, strict=True))
    want = {}
    for i, f in enumerate(folders):
        hit = None if f is None else next((p for p, e in by_place if e is not None and covers(e, f)), None)
        want[i] = None if hit is None else (hit, "why")
    assert got == want and len({v for v in want.values() if v}) > 20
    assert rules.first_rule(rows, "path", table.limit(0)).where("rule is not null").isEmpty()


def test_rules_say_what_single_expressions_say(spark):
    entries = ["b", "/a/b", "c*", "/a/*/d", "?", "B?"]
    rows = spark.createDataFrame([(f,) for f in ("/a/b/c", "/A/x/D", "/q/bc", "/q", "/zz/cde")], "folder string")
    for n, e in enumerate(entries):
        one = spark.createDataFrame([(n, e)], "place int, entry string")
        got = {r.folder: r.rule is not None for r in rules.first_rule(rows, "folder", one).collect()}
        assert got == {r.folder: r.hit for r in rows.select("folder", black_listed(F.col("folder"), e).alias("hit")).collect()}
