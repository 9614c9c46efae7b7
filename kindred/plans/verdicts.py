"""Queries on verdicts. An item is four vectors in a row (vec_id div 4): frames, sign codes and embeddings at four positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.functions import signal
from kindred.operators import embedding, verdicts
from kindred.plans.registry import query
from kindred.sources.tables import table

S = verdicts.Settings(percent=93.0, ai_percent=15.0, quorum=0.6, combine=True)
LOOSE = verdicts.Settings(percent=60.0, ai_percent=15.0, quorum=0.6, use_hashes=True)


def _items(spark, sf):
    v = table(spark, sf, "embeddings").where("embedding is not null")
    frame = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int"))
    vector = F.when(F.col("vec_id") % 5 != 0, F.transform("embedding", lambda x: x.cast("double")))
    rows = v.select(F.floor(F.col("vec_id") / 4).alias("key"), F.struct("vec_id", frame.alias("frame"), signal.sign_code(F.col("embedding")).alias("hash"), vector.alias("vector")).alias("p"))
    rows = rows.groupBy("key").agg(F.array_sort(F.collect_list("p")).alias("p")).where("size(p) = 4")  # four at most by their key
    part = lambda c: F.transform("p", lambda x: x[c])
    return rows.select("key", (F.col("key") % 7 == 0).alias("image"), part("frame").alias("frames"), part("hash").alias("hashes"), part("vector").alias("vectors"))


_ITEMS = """items AS (SELECT vec_id // 4 AS key, (vec_id // 4) % 7 = 0 AS image,
  list(list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS BIGINT)) ORDER BY vec_id) AS frames,
  list(CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] < 0 THEN CAST(pow(2, i - 1) AS HUGEINT) ELSE 0 END)) AS UBIGINT) ORDER BY vec_id) AS hashes,
  list(CASE WHEN vec_id % 5 <> 0 THEN list_transform(embedding, lambda x: CAST(greatest(-127, least(127, round_even(CAST(x AS DOUBLE) * 127, 0))) AS BIGINT)) END ORDER BY vec_id) AS vectors
  FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 4)"""
_GRAY = "list_transform(range(1, 5), lambda i: list_sum(list_transform(list_zip({a}.frames[i], {b}.frames[i]), lambda z: abs(z[1] - z[2]))) / 64 / 256.0)"
_BITS = "list_transform(range(1, 5), lambda i: bit_count(xor({a}.hashes[i], {b}.hashes[i])))"
_COS = "list_filter(list_transform(range(1, 5), lambda i: CASE WHEN {a}.vectors[i] IS NOT NULL AND {b}.vectors[i] IS NOT NULL THEN greatest(-1, least(1, list_sum(list_transform(list_zip({a}.vectors[i], {b}.vectors[i]), lambda z: z[1] * z[2])) / 16129.0)) END), lambda c: c IS NOT NULL)"


def _judged(join: str) -> str:
    g, h, c = (x.format(a="a", b="b") for x in (_GRAY, _BITS, _COS))
    return f"j AS (SELECT a.key AS a_key, b.key AS b_key, a.image AS a_image, {g} AS g, {h} AS h, {c} AS c FROM items a JOIN items b ON {join})"


def _verdict(percent: float, bits: int, ai: float, extra: str) -> str:
    """SQL of the combined verdict: x has gray, hash and ai (null: no match)."""
    return f"""x AS (SELECT *, CASE WHEN a_image THEN CASE WHEN g[1] <= CAST({percent} AS FLOAT) THEN g[1] END WHEN list_sum(g) <= CAST({percent} AS FLOAT) * 4 THEN list_sum(g) / 4 END AS gray,
  CASE WHEN NOT a_image AND len(list_filter(h, lambda z: z <= {bits})) >= 3 THEN list_sum(h) / 64.0 / 4 END AS hash, CASE WHEN len(c) >= 2 AND list_sum(c) / len(c) >= {ai} THEN 1 - list_sum(c) / len(c) END AS ai {extra} FROM j)"""


_X = _verdict(S.most_difference, S.most_bits, 0.15000000596046448, "")


@query(f"""WITH {_ITEMS}, {_judged("a.key < b.key AND a.image = b.image")}, {_X}
SELECT a_key, b_key, round(coalesce(least(gray, hash), ai), 6) AS difference, gray IS NOT NULL AS by_gray, hash IS NOT NULL AS by_hash, gray IS NULL AND hash IS NULL AS by_ai FROM x WHERE coalesce(gray, hash, ai) IS NOT NULL""")
def union_pairs(spark, sf):
    return verdicts.pairs(_items(spark, sf), 4, 8, S).withColumn("difference", F.round("difference", 6))


_WIDE_ITEMS = _ITEMS.replace("CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS BIGINT)", "CAST(greatest(0, least(255, floor((4 * CAST(x AS DOUBLE) + 1) * 127.5))) AS BIGINT)", 1)
_KEPT = "list_transform(range(1, 5), lambda i: list_filter(list_zip(a.frames[i], b.frames[i]), lambda z: z[1] > 32 AND z[2] > 32 AND z[1] < 240 AND z[2] < 240))"


def _wide_items(spark, sf):
    """Items whose frames reach from black to white."""
    wide = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") * 4 + 1) * 127.5))).cast("int")
    v = table(spark, sf, "embeddings").where("embedding is not null")
    rows = v.select(F.floor(F.col("vec_id") / 4).alias("key"), F.struct("vec_id", F.transform("embedding", wide).alias("frame")).alias("p"))
    rows = rows.groupBy("key").agg(F.array_sort(F.collect_list("p")).alias("p")).where("size(p) = 4")
    none = F.lit(None).cast("array<bigint>")
    return rows.select("key", (F.col("key") % 7 == 0).alias("image"), F.transform("p", lambda x: x["frame"]).alias("frames"), none.alias("hashes"), F.lit(None).cast("array<array<double>>").alias("vectors"))


@query(f"""WITH {_WIDE_ITEMS}, j AS (SELECT a.key AS a_key, b.key AS b_key, a.image AS image, {_KEPT} AS k FROM items a JOIN items b ON a.key < b.key AND a.image = b.image),
x AS (SELECT *, list_transform(k, lambda p: CASE WHEN len(p) > 0 THEN list_sum(list_transform(p, lambda z: abs(z[1] - z[2]))) / len(p) / 256.0 ELSE 9 END) AS d FROM j),
y AS (SELECT a_key, b_key, CASE WHEN image THEN CASE WHEN d[1] <= CAST(0.18 AS FLOAT) THEN d[1] END WHEN list_sum(d) <= CAST(0.18 AS FLOAT) * 4 THEN list_sum(d) / 4 END AS difference FROM x)
SELECT a_key, b_key, round(difference, 6) AS difference FROM y WHERE difference IS NOT NULL""")
def pairs_ignoring_dark_and_bright(spark, sf):
    s = verdicts.Settings(percent=82.0, use_ai=False, ignore_dark=True, ignore_bright=True)
    return verdicts.pairs(_wide_items(spark, sf), 4, 8, s).select("a_key", "b_key", F.round("difference", 6).alias("difference"))


@query(f"""WITH {_ITEMS}, j AS (SELECT a.key AS a_key, b.key AS b_key, a.image AS a_image, {_GRAY.format(a="a", b="b")} AS g,
list_transform(range(1, 5), lambda i: list_sum(list_transform(range(0, 64), lambda k: abs(a.frames[i][(k // 8) * 8 + (7 - k % 8) + 1] - b.frames[i][k + 1]))) / 64 / 256.0) AS m FROM items a JOIN items b ON a.key < b.key AND a.image = b.image),
x AS (SELECT a_key, b_key, CASE WHEN a_image THEN CASE WHEN g[1] <= CAST(0.06 AS FLOAT) THEN g[1] END WHEN list_sum(g) <= CAST(0.06 AS FLOAT) * 4 THEN list_sum(g) / 4 END AS plain,
CASE WHEN a_image THEN CASE WHEN m[1] <= CAST(0.06 AS FLOAT) THEN m[1] END WHEN list_sum(m) <= CAST(0.06 AS FLOAT) * 4 THEN list_sum(m) / 4 END AS mirrored FROM j)
SELECT a_key, b_key, round(least(plain, mirrored), 6) AS difference, mirrored IS NOT NULL AND (plain IS NULL OR mirrored < plain) AS flipped FROM x WHERE coalesce(plain, mirrored) IS NOT NULL""")
def pairs_with_flips(spark, sf):
    s = verdicts.Settings(percent=94.0, use_ai=False)
    return verdicts.pairs(_items(spark, sf), 4, 8, s, flips=True).select("a_key", "b_key", F.round("difference", 6).alias("difference"), "flipped")


def _next(spark, sf):
    """Each item beside the next one."""
    items = _items(spark, sf).withColumn("vectors", F.transform("vectors", signal.quantised))
    a, b = (items.select([F.col(c).alias(f"{x}_{c}") for c in items.columns]) for x in "ab")
    return a.join(b, F.col("a_key") + 1 == F.col("b_key"))


def _sides():
    return [{c: F.col(f"{x}_{c}") for c in ("frames", "hashes", "vectors")} for x in "ab"]


@query(f"""WITH {_ITEMS}, {_judged("a.key + 1 = b.key")}
SELECT a_key AS key, round(CASE WHEN list_sum(g) <= CAST({LOOSE.most_difference} AS FLOAT) * 4 THEN list_sum(g) / 4 END, 6) AS gray,
round(CASE WHEN len(list_filter(h, lambda z: z <= {LOOSE.most_bits})) >= 3 THEN list_sum(h) / 64.0 / 4 END, 6) AS hash, round(CASE WHEN len(c) >= 2 THEN list_sum(c) / len(c) ELSE -1 END, 6) AS ai FROM j""")
def position_verdicts(spark, sf):
    a, b = _sides()
    gray, hashes, ai = verdicts.gray_positions(a["frames"], b["frames"], LOOSE), verdicts.hash_quorum(a["hashes"], b["hashes"], 4, LOOSE), verdicts.ai_similarity(a["vectors"], b["vectors"])
    return _next(spark, sf).select(F.col("a_key").alias("key"), F.round(gray, 6).alias("gray"), F.round(hashes, 6).alias("hash"), F.round(ai, 6).alias("ai"))


_FLIP = "list_transform(range(1, 5), lambda i: list_sum(list_transform(range(0, 64), lambda k: abs(a.frames[i][(k // 8) * 8 + (7 - k % 8) + 1] - b.frames[i][k + 1]))) / 64 / 256.0)"


@query(f"""WITH {_ITEMS}, j AS (SELECT a.key AS a_key, a.image AS a_image, {_GRAY.format(a="a", b="b")} AS g, {_FLIP} AS m FROM items a JOIN items b ON a.key + 1 = b.key),
x AS (SELECT a_key, CASE WHEN a_image THEN CASE WHEN g[1] <= CAST(0.08 AS FLOAT) THEN g[1] END WHEN list_sum(g) <= CAST(0.08 AS FLOAT) * 4 THEN list_sum(g) / 4 END AS plain,
CASE WHEN a_image THEN CASE WHEN m[1] <= CAST(0.08 AS FLOAT) THEN m[1] END WHEN list_sum(m) <= CAST(0.08 AS FLOAT) * 4 THEN list_sum(m) / 4 END AS mirrored FROM j)
SELECT a_key AS key, round(least(plain, mirrored), 6) AS difference, mirrored IS NOT NULL AND (plain IS NULL OR mirrored < plain) AS flipped FROM x""")
def flipped_verdicts(spark, sf):
    a, b = _sides()
    s = verdicts.Settings(percent=92.0, use_ai=False)
    v, flipped = verdicts.with_flips(a | {"mirrored_hashes": a["hashes"]}, b, F.col("a_image"), 4, 8, s)
    return _next(spark, sf).select(F.col("a_key").alias("key"), F.round(v.difference, 6).alias("difference"), F.coalesce(flipped, F.lit(False)).alias("flipped"))


@query("""WITH p AS (SELECT a.o_orderkey AS id, a.o_custkey % 90 + 0.5 AS clip, a.o_totalprice / 1000 AS source, CAST(a.o_orderkey % 3 AS DOUBLE) * 4 AS prints, CAST(a.o_custkey % 40 AS DOUBLE) AS start FROM orders a),
w AS (SELECT *, CASE WHEN prints > 0 THEN least(clip, source - start, prints) ELSE least(clip, source - start) END AS w FROM p),
t AS (SELECT id, CASE WHEN w > 0 THEN list_filter(list_transform(CASE WHEN w >= 9 THEN [0.25, 0.5, 0.75] WHEN w >= 3 THEN [0.33, 0.66] ELSE [0.5] END, lambda f: CAST(f AS DOUBLE) * w), lambda t: t < clip - 0.1 AND start + t < source - 0.1) ELSE [] END AS t FROM w)
SELECT id, CAST(len(t) AS INTEGER) AS n, round(coalesce(list_sum(t), 0), 8) AS total FROM t""")
def sample_times(spark, sf):
    o = table(spark, sf, "orders")
    source, clip, prints, at = F.col("o_totalprice") / 1000, F.col("o_custkey") % 90 + F.lit(0.5), (F.col("o_orderkey") % 3).cast("double") * 4, (F.col("o_custkey") % 40).cast("double")
    return o.select(F.col("o_orderkey").alias("id"), verdicts.sample_times(source.cast("double"), clip.cast("double"), prints, at).alias("t")).select("id", F.size("t").alias("n"), F.round(F.aggregate("t", F.lit(0.0), lambda s, x: s + x), 8).alias("total"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a, list_transform(embedding, lambda x: round_even(CAST(x AS DOUBLE) * 127, 0)) AS b FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 50 <> 7),
c AS (SELECT list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(a, lambda z: z * z))) * sqrt(list_sum(list_transform(b, lambda z: z * z)))) AS c FROM v)
SELECT (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 50 = 7) AS missing, round((SELECT min(c) FROM c), 9) AS least_cosine, false AS good""")
def embedding_check(spark, sf):
    """Quantised vectors against the table's: some are missing, so the check says no."""
    rows = table(spark, sf, "embeddings").where("embedding is not null")
    got = rows.where("vec_id % 50 <> 7").select("vec_id", F.transform("embedding", lambda x: F.rint(x.cast("double") * 127)).alias("vector"))
    told = embedding.embedding_check(got, rows.select("vec_id", F.col("embedding").alias("vector")), "vec_id", 0.99)
    return told.withColumn("least_cosine", F.round("least_cosine", 9))


def _row_sums():
    """A model: how much darker or brighter each of the eight rows is than all of them."""

    def model(x):
        rows = x.reshape(len(x), 8, 8).sum(2)
        return rows - rows.mean(1, keepdims=True)

    return model


@query("""WITH f AS (SELECT vec_id, list_transform(range(0, 8), lambda r: list_sum(list_transform(embedding[8 * r + 1 : 8 * r + 8], lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS BIGINT)))) AS s FROM embeddings WHERE embedding IS NOT NULL),
d AS (SELECT vec_id, list_transform(s, lambda x: abs(8 * x - list_sum(s))) AS d FROM f) SELECT vec_id, CAST(list_position(d, list_max(d)) AS INTEGER) AS strongest FROM d""")
def embedded_frames(spark, sf):
    """Each frame through a supplied model, and which component of its vector is the largest (of equal ones the first)."""
    frame = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("float"))
    out = embedding.embedded(table(spark, sf, "embeddings").where("embedding is not null").select("vec_id", frame.alias("frame")), "frame", 64, _row_sums, channels=1)
    size = F.transform("vector", lambda x: F.round(F.abs(x.cast("double")), 6))
    return out.select("vec_id", F.array_position(size, F.array_max(size)).cast("int").alias("strongest"))


@query()
def principal_directions(spark, sf):
    """The four main directions of all vectors, a row each."""
    main = embedding.principal(table(spark, sf, "embeddings"), "embedding", 64, 4)
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(main)], "direction int, vector array<double>")
