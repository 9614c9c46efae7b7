"""Block-max search against plain loops: ties, repeated rows and items, nulls, scripts, shards and blocks of any size."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kindred.llm import textarrays as ta
from kindred.llm.block_max import BlockMax, Shard, indexed, packed, strings, terms, unpacked

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
WORDS = "the of and Élan naïve x1 42 日本語 pebble river stone granite über öl k é".split()


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    held = [(i, Counter(split(t)), len(split(t))) for i, t in docs if split(t)]
    n, length = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in held:
            m = 100 - 75 + (75 * size * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in split(text) if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def made(seed, n):
    rng = np.random.default_rng(seed)
    draw = lambda most: " ".join(WORDS[min(int(x), len(WORDS) - 1)] for x in rng.exponential(4, int(rng.integers(0, most))))
    docs = [(int(i), draw(30)) for i in rng.permutation(n)]
    docs += [(docs[0][0], docs[0][1])] * 3 + [(docs[1][0], "THE pebble, the pebble"), (None, "pebble river"), (None, None), (n, None), (n + 1, ""), (n + 2, " -- "), (n + 3, "pebble " * 5000)]
    items = [(0, "The pebble and the river"), (0, "granite"), (1, None), (2, "unknown"), (3, ""), (4, "the the THE of"), (5, draw(30)), (None, "stone é 日本語"), (6, "x" * 300)]
    return docs, items


def found(spark, docs, asked, **kw):
    d = spark.createDataFrame([(*r, 7, "t") for r in docs], "doc_id long, text string, n long, term string")
    i = spark.createDataFrame([(*r, 1) for r in asked], "item_id long, text string, doc_id int")
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in BlockMax(**kw).search(d, i).collect()), key=repr)


@pytest.mark.parametrize("kw", [{}, {"shard": 7, "block": 2, "items": 2, "first": 3, "k": 4}, {"shard": 40, "block": 1, "filter_bits": 64}])
def test_against_plain_loops(spark, kw):
    docs, items = made(3, 150)
    assert found(spark, docs, items, **kw) == plain(docs, items, kw.get("k", 10))


def test_empty_tables(spark):
    docs, items = made(1, 5)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], items) == []


def test_terms_and_codes():
    texts = ["A b-c_d\x00E", None, "", "é日 x\u0080y", "\x7fZ"]
    data, offsets = ta.flat(pa.array(texts))
    spans = terms(data, offsets)
    assert strings(spans, np.arange(len(spans.start))).to_pylist() == [t for x in texts for t in split(x)]
    assert spans.doc.tolist() == [d for d, x in enumerate(texts) for _ in split(x)]
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**56 - 1, 5])
    assert (unpacked(packed(values)[0]) == values).all() and (packed(np.zeros(0, np.int64))[0] == unpacked(np.zeros(0, np.uint8))).all()


def test_blocks_below_the_threshold_stay_compressed():
    """Only one stretch of documents holds both terms often; the other blocks are never opened."""
    n = 4000
    rows = {"no": [], "id": [], "n": [], "term": [], "tf": []}
    for d in range(n):
        tf = 9 if 2000 <= d < 2020 else 1
        for term in (None, "a", "b"):
            for c, v in zip(rows, (d, d, 40, term, 0 if term is None else tf), strict=True):
                rows[c].append(v)
    table = pa.table(rows, schema=pa.schema([("no", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("term", pa.string()), ("tf", pa.int64())]))
    shard = Shard(indexed(0, table, n, 40 * n, 128))
    best, score = shard.top(["a", "b"], np.array([3, 2]), 10, 1)
    assert best.tolist() == list(range(2000, 2010)) and len(set(score.tolist())) == 1
    assert len(shard.open) == 64 and shard.open.sum() <= 8
    shard = Shard(indexed(0, table, n, 40 * n, 128))
    assert len(shard.top(["a", "b"], np.array([3, 2]), 10, int(score[0]) + 1)[0]) == 0 and not shard.open.any()
    full = np.zeros(n)
    shard.decompress(np.arange(64))
    for t, w in (("a", 3), ("b", 2)):
        lo, hi = shard.of[t]
        full[shard.doc[shard.post[lo] : shard.post[hi]]] += w * shard.impact[shard.post[lo] : shard.post[hi]]
    assert (shard.doc.reshape(2, n) == np.arange(n)).all() and full[2005] == score[0]
