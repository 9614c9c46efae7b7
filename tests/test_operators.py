import random

import pytest
from pyspark.sql import functions as F

from kindred.functions import names, signal
from kindred.operators import clustering, ranking, reasons, similarity
from kindred.plans.queries import QUERIES
from kindred.sources import tables
from kindred.streaming import listing


def test_hamming_pairs_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    codes = [rng.getrandbits(63) for _ in range(60)]
    codes += [c ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for c in codes[:30]]
    got = {(r.a_key, r.b_key) for r in similarity.hamming_pairs(spark.createDataFrame(list(enumerate(codes)), "id long, code long"), "id", "code", 3).collect()}
    assert got == {(i, j) for i in range(90) for j in range(i + 1, 90) if (codes[i] ^ codes[j]).bit_count() <= 3}


def test_gray_difference_ignoring_dark_is_null_without_pixels(spark):
    row = spark.sql("select array(1, 2) a, array(3, 200) b, array(100, 100) c, array(110, 130) d").select(
        signal.gray_difference_ignoring(F.col("a"), F.col("b")).alias("none"), signal.gray_difference_ignoring(F.col("c"), F.col("d")).alias("some")
    ).first()
    assert row.none is None and row.some == pytest.approx(20 / 256)


def test_pruned_groups_cut_a_chain(spark):
    # 0-1-2 all match; 3 matches 2 only; 4 matches 3 only
    pairs = spark.createDataFrame([(0, a, b) for a, b in [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4)]], "root long, a long, b long")
    members = spark.createDataFrame([(i, 0) for i in range(5)], "id long, root long")
    out = {r.id: r.grp for r in clustering.pruned_groups(members, pairs).collect()}
    assert out[0] == out[1] == out[2] and 3 not in out or out.get(3) != out[0]


def test_groups_of_copies_are_those_of_all_their_pairs(spark, tmp_path):
    """A third of the rows are alike; both queries against the pairs of all rows, worked off one by one."""
    rng = random.Random(3)
    base = [[rng.choice((-1.0, 1.0)) for _ in range(64)] for _ in range(4)]

    def near(v, n):
        flip = set(rng.sample(range(64), n))
        return [-x if i in flip else x for i, x in enumerate(v)]

    vectors = [base[0]] * 40 + [near(rng.choice(base), rng.choice((4, 8, 10, 12))) for _ in range(60)]
    vectors += [vectors[40 + rng.randrange(60)] for _ in range(20)] + [[rng.choice((-1.0, 1.0)) for _ in range(64)]] * 2
    rng.shuffle(vectors)
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    match = [{j for j, w in enumerate(vectors) if j != i and sum(x != y for x, y in zip(v, w, strict=True)) <= 16} for i, v in enumerate(vectors)]
    pruned, todo = {}, [(set(range(len(vectors))), 1)]
    while todo:
        # what is connected, then what leaves it; who leaves a second time fits nowhere
        left, level = todo.pop()
        while left:
            line, part = [left.pop()], set()
            while line:
                part.add(line[-1])
                line += match[line.pop()] & left
                left -= set(line)
            alive = set(part)
            while len(alive) > 2:
                least = min(alive, key=lambda i: (len(match[i] & alive), i))
                if len(match[least] & alive) >= len(alive) // 2:
                    break
                alive.discard(least)
            if len(alive) > 1:
                pruned |= dict.fromkeys(alive, min(alive))
            if level < 2:
                todo.append((part - alive, level + 1))
    head = {}
    for a, b in sorted((a, b) for a in range(len(vectors)) for b in match[a] if a < b):
        x, y = head.get(a), head.get(b)
        if x is None and y is None:
            head[a] = head[b] = a
        elif x is None and a in match[y]:
            head[a] = y
        elif x is not None and y is None and b in match[x]:
            head[b] = x
        elif x is not None and y is not None and x != y and y in match[x]:
            head |= {i: x for i in head if head[i] == y}
    got = {name: {r.id: r.grp for r in QUERIES[name](spark, str(tmp_path)).collect()} for name in ("pruned_groups", "merged_groups")}
    assert got == {"pruned_groups": pruned, "merged_groups": head}


def test_many_copies_make_no_pairs(spark):
    """3000 copies and three near ones: the pairs of the different four are all there is to hand over."""
    same = clustering.copies(spark.range(3000).selectExpr("id", "7L as code").union(spark.createDataFrame([(5000, 1), (5001, 2), (5002, 3)], "id long, code long")), "id", "code")
    pairs = spark.createDataFrame([(0, 5000), (0, 5001), (5001, 5002)], "a long, b long")
    roots = clustering.components(pairs)
    want = dict.fromkeys([*range(3000), 5000, 5001], 0)
    assert {r.id: r.grp for r in clustering.merged_groups(roots, pairs, pairs, same).collect()} == want
    out = {r.id: r.grp for r in clustering.pruned_groups(roots, pairs.selectExpr("0L as root", "a", "b"), same).collect()}
    assert out == want


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    roots = {r.id: r.root for r in clustering.components(pairs).collect()}
    assert {roots[i] for i in range(41)} == {0} and roots[101] == 100


def test_keeper_narrows_with_near_ties_and_says_why(spark):
    rows = spark.createDataFrame([(1, 1, 100.0, 5), (1, 2, 99.5, 9), (1, 3, 50.0, 99), (2, 4, 1.0, 1)], "g long, id long, d double, s int")
    out = {r.id: (r.keep, r.reason) for r in ranking.keeper(rows, "g", "id", [ranking.Criterion("duration", F.col("d"), near=1.0), ranking.Criterion("size", F.col("s"))]).collect()}
    assert out == {1: (False, "size"), 2: (True, "size"), 3: (False, "size"), 4: (True, None)}


def test_moves_must_be_unique(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 2, "y")], "path string, size int, digest string")
    new = spark.createDataFrame([("p", 1, "x"), ("q", 2, "y")], "path string, size int, digest string")
    assert [tuple(r) for r in tables.moved(old, new, "path", "size", "digest").collect()] == [("a", "p")]


def test_moves_count_copies_before_they_join(spark):
    """300 copies on either side are no 90,000 pairs, and a move to a smaller key is one too."""
    old = spark.createDataFrame([(2 * i, 1, "hot") for i in range(300)] + [(1000, 2, "x"), (1002, 3, "y")], "id long, size int, digest string")
    new = spark.createDataFrame([(2 * i + 1, 1, "hot") for i in range(300)] + [(901, 2, "x"), (1003, 3, "y")], "id long, size int, digest string")
    found = tables.moved(old, new, "id", "size", "digest")
    assert sorted(tuple(r) for r in found.collect()) == [(1000, 901), (1002, 1003)]
    todo, joined = [found._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind.endswith("JoinExec"):
            joined.append(node.metrics().apply("numOutputRows").value())
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        todo += inner + [node.children().apply(i) for i in range(node.children().size())]
    assert joined and max(joined) <= 302


def test_the_current_listing_takes_the_first_events(spark, tmp_path):
    spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(5, 1, "click", 10.0), (6, 3, "purchase", 30.0), (7, 9, "view", 90.0)], "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(tuple(r) for r in QUERIES["current_listing"](spark, str(tmp_path)).collect()) == [(1, 10.0), (2, 2.0), (9, 90.0)]


def test_user_conditions_are_conditions_only(spark):
    assert spark.range(5).where(reasons.user_condition("id > 2")).count() == 2
    for bad in ("id > 1; drop table x", "java_method('a', 'b')", "id in (select 1)"):
        with pytest.raises(ValueError):
            reasons.user_condition(bad)


def test_names(spark):
    row = spark.sql("select 'x/a/b' p, 'y/a/b' q").select(names.folder_pair(F.col("p"), F.col("q")).alias("pair"), names.under(F.col("p"), F.lit("x/a")).alias("under"), names.same_tail(F.col("p"), F.col("q"), 2).alias("tail"), names.language_code(F.lit(" deu")).alias("lang")).first()
    assert row.pair == ["x", "y"] and row.under and row.tail and row.lang == "GER"


def test_a_stream_of_changes_and_first_seen(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 5, True), ("b", 6, True), ("a", 7, True)], "key string, at long, present boolean").coalesce(1).write.parquet(source)
    read = lambda: spark.readStream.schema("key string, at long, present boolean").parquet(source)
    listing.keep_listing(read(), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    query = listing.first_seen(read()).writeStream.format("memory").queryName("seen").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.key, r.first_seen) for r in spark.table("seen").collect()} == {("a", 5), ("b", 6)}
