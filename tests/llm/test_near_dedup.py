import random
import re

import pytest

from kindred.llm.near_dedup import NearDedup, least_agreeing


def brute(texts, percent=85):
    sets = []
    for t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))], [len(s) for s in sets]


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("size", [40, 160])
def test_components_are_those_of_all_pairs(spark, size):
    """A large group of near copies on both sides of the limit, exact copies, short, empty and null texts."""
    rng = random.Random(size)
    base = [f"v{rng.randrange(5000)}" for _ in range(120)]
    texts = [edited(base, rng, rng.choice([0, 1, 1, 2, 2, 3, 5])) for _ in range(size)]
    texts += [None, "", " \n", "one two", "One  TWO", "one two three", edited(base, rng, 60)] + ["same text of six words here"] * 5
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, id string")
    out = {r.doc_id: r for r in NearDedup().components(docs).collect()}
    roots, sizes = brute(texts)
    assert [out[i].component_id for i in range(len(texts))] == roots
    assert [out[i].n_shingles for i in range(len(texts))] == sizes
    assert [out[i].kept for i in range(len(texts))] == [i == r for i, r in enumerate(roots)]


def test_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert NearDedup().components(docs).collect() == []


def test_kept_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", 3), (2, "a b c d e f", "y", 4), (None, "a b c d e f", "z", 5)], "doc_id long, text string, root string, n long")
    assert sorted((r.doc_id or 0, r.root) for r in NearDedup().kept(docs).collect()) == [(0, "z"), (1, "x")]


def check(spark, texts, **parameters):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    out = {r.doc_id: r for r in NearDedup(**parameters).components(docs).collect()}
    roots, sizes = brute(texts, parameters.get("percent", 85))
    assert [out[i].component_id for i in range(len(texts))] == roots
    assert [out[i].n_shingles for i in range(len(texts))] == sizes
    return roots


def test_an_open_key_of_many_members(spark):
    """300 texts share a long passage, so their keys have many members that do not match the leader; some match each other."""
    rng = random.Random(3)
    word = lambda: f"u{rng.randrange(10**6)}"
    passage = [word() for _ in range(150)]
    texts = []
    for _ in range(100):
        tail = [word() for _ in range(60)]
        texts += [" ".join(passage + tail), " ".join(passage + tail + [word() for _ in range(rng.choice([2, 10, 60]))]), " ".join(passage + [word() for _ in range(60)])]
    rng.shuffle(texts)
    roots = check(spark, texts)
    assert 100 < len(set(roots)) < 300


def test_pairs_just_over_the_limit_of_the_pipeline(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(60):
        words = [f"t{rng.randrange(10**6)}" for _ in range(100)]
        texts += [" ".join(words), " ".join(words + [f"t{rng.randrange(10**6)}" for _ in range(rng.choice([20, 23, 24, 25, 30]))])]
    check(spark, texts, percent=80, bands=12)


def test_words_of_like_structure_have_their_own_hashes(spark):
    """Complementary words of this make have one polynomial hash modulo 2**64."""
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    check(spark, [a, b, f"{a} x y z w", f"{b} x y z w", a])


def test_a_very_long_text_and_repeated_ids(spark):
    long = " ".join(f"w{i % 7919}" for i in range(300_000))
    docs = spark.createDataFrame([(4, long), (2, long + " end"), (5, "a b c d e f"), (5, "g h i j k l"), (5, "a b c d e f"), (3, "g h i j k l")], "doc_id long, text string")
    out = sorted((r.doc_id, r.component_id, r.kept) for r in NearDedup().components(docs).collect())
    assert out == [(2, 2, True), (3, 3, True), (4, 2, False), (5, 3, False), (5, 5, True), (5, 5, True)]
    assert sorted((r.doc_id, r.text[:1]) for r in NearDedup().kept(docs).collect()) == [(2, "w"), (3, "g"), (5, "a")]


@pytest.mark.parametrize(("n", "percent"), [(48, 85), (72, 80), (16, 90)])
def test_the_least_agreement_loses_one_pair_in_a_million(n, percent):
    from math import comb

    below = lambda k: sum(comb(n, i) * (percent / 100) ** i * (1 - percent / 100) ** (n - i) for i in range(k))
    k = least_agreeing(n, percent)
    assert below(k) <= 1e-6 < below(k + 1)
