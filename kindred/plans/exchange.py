"""Queries on stamps, results as JSON and candidates from SQL: order lines stand for members of sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.operators import candidates, similarity
from kindred.plans.registry import query
from kindred.sources import stamped
from kindred.sources.tables import table

_LINES = """m AS (SELECT l_orderkey AS grp, l_partkey AS part, l_suppkey AS supp, l_linenumber AS line, CASE WHEN l_linenumber % 5 > 0 THEN l_returnflag END AS flag FROM lineitem)"""
_FIELDS = ["part", "supp", "line", "flag"]


def _lines(spark, sf):
    line = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), line.alias("line"), F.when(line % 5 > 0, F.col("l_returnflag")).alias("flag"))


_TEXT = ", ".join(f"coalesce(concat(length(CAST({c} AS VARCHAR)), ':') || CAST({c} AS VARCHAR), '-')" for c in _FIELDS)
_SUM = "CAST(sum(CAST('0x' || substr(h, {}, 15) AS UBIGINT)) AS VARCHAR)"


@query(f"""WITH {_LINES}, h AS (SELECT grp, sha256(concat({_TEXT})) AS h FROM m)
SELECT grp, count(*) AS rows, substr(sha256(concat_ws(' ', CAST(count(*) AS VARCHAR), {_SUM.format(1)}, {_SUM.format(16)})), 1, 32) AS stamp FROM h GROUP BY grp""")
def set_stamps(spark, sf):
    return stamped.stamps(_lines(spark, sf), ["grp"], _FIELDS)


@query(f"""WITH {_LINES}, n AS (SELECT grp, part, CASE WHEN grp % 11 = 0 AND line = 1 THEN supp + 1 ELSE supp END AS supp, line, flag FROM m WHERE grp % 7 > 0 UNION ALL SELECT grp + 100000000, part, supp, line, flag FROM m WHERE grp % 13 = 0),
a AS (SELECT grp, list_sort(list(row(part, supp, line, coalesce(flag, '?')))) AS v FROM m GROUP BY grp), b AS (SELECT grp, list_sort(list(row(part, supp, line, coalesce(flag, '?')))) AS v FROM n GROUP BY grp)
SELECT coalesce(a.grp, b.grp) AS grp, CASE WHEN a.grp IS NULL THEN 'add' WHEN b.grp IS NULL THEN 'remove' ELSE 'change' END AS change FROM a FULL JOIN b ON a.grp = b.grp WHERE a.v IS DISTINCT FROM b.v""")
def changed_sets(spark, sf):
    """Which sets a later report adds, changes or no longer has."""
    old = _lines(spark, sf)
    supp = F.when((F.col("grp") % 11 == 0) & (F.col("line") == 1), F.col("supp") + 1).otherwise(F.col("supp"))
    new = old.where("grp % 7 > 0").withColumn("supp", supp).unionByName(old.where("grp % 13 = 0").withColumn("grp", F.col("grp") + 100000000))
    return stamped.changed_groups(old, new, "grp", _FIELDS)


@query(f"""WITH {_LINES} SELECT grp AS "group", part, supp, line, flag FROM m""")
def results_through_json(spark, sf):
    """Sets as nested JSON texts and read back as flat rows."""
    texts = stamped.to_sets(_lines(spark, sf), "grp", _FIELDS)
    return stamped.from_sets(texts, "json", "long", "part long, supp long, line int, flag string")


_FRAME = "list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS BIGINT))"
_L1 = "list_sum(list_transform(list_zip(a.f, b.f), lambda z: abs(z[1] - z[2])))"


@query(f"""WITH f AS (SELECT vec_id, {_FRAME} AS f FROM embeddings)
SELECT a.vec_id AS a_key, b.vec_id AS b_key, {_L1} / 64 / 256.0 AS difference FROM f a JOIN f b ON a.vec_id < b.vec_id WHERE {_L1} <= 0.05 * 256 * 64""")
def candidates_from_sql(spark, sf):
    """The pairs of near frames by the table function, called in SQL on index rows."""
    frames = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("long")).alias("frame"))
    candidates.register(spark)
    index = similarity.gray_blocks(frames, "vec_id", "frame", 0.05, room=16384)  # rows come to the function one by one: large chunks, fewer copies of a row
    found = [spark.sql("SELECT a_key, b_key, value AS difference FROM similar_pairs(TABLE({rows}), 'gray', 0.05)", rows=rows) for rows in index]
    out = frames.select(F.col("vec_id").alias("a_key"), F.col("vec_id").alias("b_key"), F.lit(0.0).alias("difference")).where("false")
    for f in found:
        out = out.unionByName(f)
    return out
