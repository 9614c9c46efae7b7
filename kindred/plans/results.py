"""Queries on result rows: parts stand for files, order lines for members of sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.operators import ordering, results, rules
from kindred.plans.registry import query
from kindred.sources.tables import table

_FILES = """f AS (SELECT p_partkey AS id, concat('/r', p_size % 3, '/', split_part(p_name, ' ', 1), '/s', p_size, '/x', p_partkey, '.jpg') AS path, concat('/r', p_size % 3, '/', split_part(p_name, ' ', 1), '/s', p_size) AS folder, p_partkey % 2 = 0 AS image,
CASE WHEN p_partkey % 17 = 0 THEN 1 WHEN p_partkey % 13 = 0 THEN 8 WHEN p_partkey % 11 = 0 THEN 512 WHEN p_partkey % 7 = 0 THEN 4 ELSE 32 END AS flags, CAST(p_retailprice * 1000 AS BIGINT) AS size, p_partkey % 19 > 0 AS listed, p_retailprice AS seconds FROM part)"""


def _files(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_size")
    folder = F.concat(F.lit("/r"), (n % 3).cast("string"), F.lit("/"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("/s"), n.cast("string"))
    flags = F.when(k % 17 == 0, 1).when(k % 13 == 0, 8).when(k % 11 == 0, 512).when(k % 7 == 0, 4).otherwise(32)
    return table(spark, sf, "part").select(k.alias("id"), F.concat(folder, F.lit("/x"), k.cast("string"), F.lit(".jpg")).alias("path"), folder.alias("folder"), (k % 2 == 0).alias("image"), flags.alias("flags"), F.round(F.col("p_retailprice") * 1000).cast("long").alias("size"), (k % 19 > 0).alias("listed"), F.col("p_retailprice").alias("seconds"))


@query(f"""WITH {_FILES} SELECT id, CASE WHEN regexp_matches(folder, '/s1(/|$)') OR regexp_matches(folder, '/s[^/]2(/|$)') OR regexp_matches(folder, '^/r1/.*/s4$') THEN 'excluded folder' WHEN NOT (starts_with(folder || '/', '/r0/') OR starts_with(folder || '/', '/r1/')) THEN 'outside the included folders'
WHEN flags & 1 = 1 THEN 'excluded by hand' WHEN flags & 8 = 8 THEN 'too dark' WHEN NOT listed THEN 'missing' WHEN size / 1048576.0 < 1 OR size / 1048576.0 > 1.6 THEN 'size out of range' WHEN flags & 512 = 512 THEN 'link' WHEN path LIKE '%77.jpg' THEN 'path matches an excluded pattern' END AS reason FROM f""")
def exclusions(spark, sf):
    scope = results.Scope(black_list=["S1", "s?2", "/R1/*/s4"], roots=["/r0", "/r1"], size=(1, 1.6), must_not_match=["*77.JPG"])
    return _files(spark, sf).select("id", results.exclusion(scope).alias("reason"))


_RULES = """r AS (SELECT p_partkey AS place, CASE p_partkey % 5 WHEN 0 THEN upper(split_part(p_name, ' ', 1)) || 'x' || p_size WHEN 1 THEN '/R1/' || split_part(p_name, ' ', 1) WHEN 2 THEN left(split_part(p_name, ' ', 2), 3) || '?*' || p_size % 10 WHEN 3 THEN '/r?/' || left(p_name, 4) || '*/s' || p_size % 9 ELSE 's' || p_size END AS entry FROM part)"""


@query(f"""WITH {_FILES}, {_RULES}, d AS (SELECT DISTINCT folder FROM f),
m AS (SELECT d.folder, r.place, CASE WHEN NOT contains(entry, '/') AND NOT regexp_matches(entry, '[*?]') THEN list_contains(string_split(lower(folder), '/'), lower(entry))
WHEN NOT regexp_matches(entry, '[*?]') THEN starts_with(lower(folder) || '/', lower(entry) || '/')
WHEN NOT contains(entry, '/') THEN len(list_filter(string_split(lower(folder), '/'), lambda s: regexp_full_match(s, replace(replace(lower(entry), '*', '.*'), '?', '.')))) > 0
ELSE len(list_filter(range(1, len(string_split(folder, '/')) + 1), lambda n: regexp_full_match(array_to_string(string_split(lower(folder), '/')[1:n], '/'), replace(replace(lower(entry), '*', '.*'), '?', '.')))) > 0 END AS hit FROM d, r)
SELECT f.id, (SELECT min(m.place) FROM m WHERE m.folder = f.folder AND hit) AS rule FROM f""")
def first_rules(spark, sf):
    """Which of the rules of a table, some literal, some patterns, is the first to cover each file's folder."""
    word = lambda n: F.split_part("p_name", F.lit(" "), F.lit(n))
    n, size = F.col("p_partkey") % 5, F.col("p_size")
    entry = F.when(n == 0, F.concat(F.upper(word(1)), F.lit("x"), size)).when(n == 1, F.concat(F.lit("/R1/"), word(1))).when(n == 2, F.concat(F.substring(word(2), 1, 3), F.lit("?*"), size % 10))
    entry = entry.when(n == 3, F.concat(F.lit("/r?/"), F.substring("p_name", 1, 4), F.lit("*/s"), size % 9)).otherwise(F.concat(F.lit("s"), size))
    found = rules.first_rule(_files(spark, sf).select("id", "folder"), "folder", table(spark, sf, "part").select(F.col("p_partkey").alias("place"), entry.alias("entry")))
    return found.select("id", F.col("rule.place").alias("rule"))


@query(f"""WITH {_FILES} SELECT CAST(count(*) FILTER (flags & 1 > 0) AS BIGINT) AS excluded, count(*) FILTER (flags & 8 > 0) AS dark, count(*) FILTER (flags & 134 > 0) AS errors FROM f""")
def flag_counts(spark, sf):
    return results.flag_counts(_files(spark, sf), {"excluded": 1, "dark": 8})


@query(f"""WITH {_FILES}, e AS (SELECT * FROM f WHERE NOT image AND contains(lower(path), '/r1/')) SELECT id, row_number() OVER (ORDER BY CASE WHEN flags & 8 > 0 THEN 0 ELSE 1 END, size DESC, lower(path), path, id) AS place FROM e""")
def editor_listing(spark, sf):
    """All of the editor's rows, each with its place in the listing."""
    rows = results.editor_rows(_files(spark, sf), kind="videos", search="/R1/")
    return ordering.placed(rows, [*results.editor_order("size", 8), F.asc("id")]).select("id", "place")


@query(f"""WITH {_FILES} SELECT id, row_number() OVER (ORDER BY path, id) - 1 AS place FROM f""")
def path_places(spark, sf):
    """The list index of each file: ordinal order of paths, from 0."""
    rows = ordering.placed(_files(spark, sf).select("id", "path"), [F.asc("path"), F.asc("id")])
    return rows.select("id", (F.col("place") - 1).alias("place"))


_SETS = """m AS (SELECT l_orderkey AS grp, l_partkey * 10 + l_linenumber AS place, concat('/p', l_suppkey, '/f', l_partkey) AS path, l_partkey % 2 = 0 AS image, l_discount * 1000 AS similarity, l_tax > 0.07 AS checked, l_returnflag <> 'R' AS live,
CAST(l_quantity AS BIGINT) AS size, CAST(l_shipdate AS DATE) AS created, l_extendedprice AS seconds, l_suppkey % 5 AS frame, l_linestatus AS same_key FROM (SELECT l_orderkey, l_partkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_discount) AS l_discount, min(l_tax) AS l_tax, min(l_returnflag) AS l_returnflag, min(l_quantity) AS l_quantity, min(l_shipdate) AS l_shipdate, min(l_extendedprice) AS l_extendedprice, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY ALL))"""


def _sets(spark, sf):
    """One row for each order, part and line number, so that places are unique in a set."""
    others = "l_suppkey l_discount l_tax l_returnflag l_quantity l_shipdate l_extendedprice l_linestatus".split()
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in others])
    path = F.concat(F.lit("/p"), F.col("l_suppkey").cast("string"), F.lit("/f"), F.col("l_partkey").cast("string"))
    return rows.select(
        F.col("l_orderkey").alias("grp"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("place"), path.alias("path"), (F.col("l_partkey") % 2 == 0).alias("image"), (F.col("l_discount") * 1000).alias("similarity"), (F.col("l_tax") > 0.07).alias("checked"),
        (F.col("l_returnflag") != "R").alias("live"), F.col("l_quantity").cast("long").alias("size"), F.col("l_shipdate").cast("date").alias("created"), F.col("l_extendedprice").alias("seconds"), (F.col("l_suppkey") % 5).alias("frame"), F.col("l_linestatus").alias("same_key"),
    )


@query(f"""WITH {_SETS}, g AS (SELECT grp FROM m GROUP BY grp HAVING bool_or(path LIKE '/p_/%' OR path LIKE '%/f1_') AND NOT bool_or(checked) AND count(*) FILTER (live) > 1) SELECT grp, place FROM m WHERE grp IN (SELECT grp FROM g) AND image AND similarity BETWEEN 20 AND 80""")
def filtered_results(spark, sf):
    return results.filtered_results(_sets(spark, sf).withColumn("path", F.when(F.rlike("path", F.lit("/f1.$")), F.concat(F.lit("/p1/"), F.col("path"))).otherwise(F.col("path"))), "/p?/*", True, (20, 80), True, True).select("grp", "place")


@query(f"""WITH {_SETS}, h AS (SELECT grp, count(*) AS files, sum(size) - max(size) AS wasted, min(similarity) AS least_alike, max(similarity) AS most_alike, count(*) FILTER (live) AS live FROM m GROUP BY grp)
SELECT grp, files, CAST(wasted AS BIGINT) AS wasted, round(least_alike, 4) AS least_alike, round(most_alike, 4) AS most_alike, live, row_number() OVER (ORDER BY h.wasted DESC, grp) AS place FROM h""")
def sorted_sets(spark, sf):
    groups, _ = results.sort_orders("wasted space", True)
    h = ordering.placed(results.headers(_sets(spark, sf)), groups)
    return h.select("grp", "files", "wasted", F.round("least_alike", 4).alias("least_alike"), F.round("most_alike", 4).alias("most_alike"), "live", "place")


@query(f"""WITH {_SETS}, h AS (SELECT grp, max(similarity) AS most_alike FROM m GROUP BY grp) SELECT grp, m.place AS member, row_number() OVER (ORDER BY h.most_alike DESC, grp, m.similarity DESC, m.place) AS place FROM m JOIN h USING (grp)""")
def listed_members(spark, sf):
    """All members of all sets in the order of the listing: sets by their likeness, members by their own."""
    return results.listed(_sets(spark, sf), "similarity", True, ["grp", "place"]).select("grp", F.col("place").alias("member"), F.col("listed").alias("place"))


@query(f"""WITH {_SETS}, h AS (SELECT grp, max(created) AS newest, min(lower(path)) AS first_path, count(*) AS files FROM m GROUP BY grp), o AS (SELECT grp, row_number() OVER (ORDER BY newest, grp) AS by_date, row_number() OVER (ORDER BY first_path DESC, grp) AS by_folder, row_number() OVER (ORDER BY files DESC, grp) AS by_count FROM h) SELECT * FROM o""")
def sets_in_three_orders(spark, sf):
    h = results.headers(_sets(spark, sf)).select("grp", "newest", "first_path", "files")
    for name, mode, down in (("by_date", "date created", False), ("by_folder", "folder path", True), ("by_count", "file count", True)):
        h = ordering.placed(h, results.sort_orders(mode, down)[0], name)
    return h.select("grp", "by_date", "by_folder", "by_count")


@query(f"""WITH {_SETS}, s AS (SELECT *, CASE grp % 5 WHEN 0 THEN 'size' WHEN 1 THEN 'duration' WHEN 2 THEN 'name' WHEN 3 THEN 'date' ELSE 'other' END AS sort, split_part(path, '/', -1) AS name FROM m)
SELECT grp, place AS member, row_number() OVER (ORDER BY grp, CASE WHEN sort = 'name' THEN name END NULLS FIRST, CASE sort WHEN 'name' THEN NULL WHEN 'size' THEN CAST(size AS DOUBLE) WHEN 'duration' THEN CAST(seconds AS DOUBLE) WHEN 'date' THEN CAST(created - DATE '1970-01-01' AS DOUBLE) ELSE CAST(similarity AS DOUBLE) END DESC NULLS LAST, place) AS place FROM s""")
def web_members(spark, sf):
    """Members as the web page lists them, each set by the order chosen for it."""
    chosen = F.element_at(F.array(*[F.lit(x) for x in ("size", "duration", "name", "date", "other")]), (F.col("grp") % 5 + 1).cast("int"))
    rows = _sets(spark, sf).withColumn("sort", chosen).withColumn("created", F.unix_date("created")).withColumn("kilobits", F.col("size"))
    return results.web_listed(rows).select("grp", F.col("place").alias("member"), F.col("listed").alias("place"))


@query(f"""WITH {_SETS}, h AS (SELECT *, size > 20 AS hit FROM m) SELECT grp, place, whole FROM (SELECT *, bool_and(hit) OVER (PARTITION BY grp) AS whole FROM h) WHERE hit""")
def condition_matches(spark, sf):
    return results.partition_matches(_sets(spark, sf), F.col("size") > 20).select("grp", "place", "whole")


@query(f"""WITH {_SETS}, a AS (SELECT *, first_value(same_key) OVER w AS k, min(place) OVER (PARTITION BY grp) AS p FROM m WINDOW w AS (PARTITION BY grp ORDER BY place)), b AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY created, place) AS r FROM a WHERE same_key = k OR place = p) SELECT grp, place FROM b WHERE r > 1""")
def cluster_selection(spark, sf):
    return results.cluster_selection(_sets(spark, sf), "same but size", "newest").select("grp", "place")


@query(f"""WITH {_SETS}, k AS (SELECT *, min(place) OVER (PARTITION BY grp) = place AS keep, frame > min(frame) OVER (PARTITION BY grp) AS upgrade FROM m) SELECT a.grp, a.place, CASE WHEN a.size > b.size THEN 'better' WHEN a.size < b.size THEN 'worse' ELSE 'equal' END AS size_chip, CASE WHEN a.frame < b.frame THEN 'better' WHEN a.frame > b.frame THEN 'worse' ELSE 'equal' END AS frame_chip, a.upgrade FROM k a JOIN k b ON a.grp = b.grp AND b.keep""")
def comparison_chips(spark, sf):
    rows = _sets(spark, sf)
    kept = rows.groupBy("grp").agg(F.min("place").alias("_p"))
    rows = results.hdr_upgrades(rows.join(kept, "grp").withColumn("keep", F.col("place") == F.col("_p")), "frame")
    return results.chips(rows, "grp", "place", {"size": True, "frame": False}).join(rows.select("grp", "place", "upgrade"), ["grp", "place"])


@query("""WITH e AS (SELECT CASE WHEN event_id % 3 > 0 THEN concat('b:', event_id // 20) ELSE concat('k:', event_id) END AS entry, ts, event_id FROM events) SELECT entry, max(ts) AS "at", CAST(sum(event_id) AS BIGINT) AS bytes, count(*) AS n FROM e GROUP BY entry ORDER BY max(ts) DESC, entry LIMIT 100""")
def decision_history(spark, sf):
    e = F.col("event_id")
    rows = table(spark, sf, "events").select(e.alias("key"), F.when(e % 3 > 0, F.floor(e / 20)).alias("batch"), F.col("ts").alias("at"), e.alias("bytes"))
    return results.history(rows)


@query("""WITH r AS (SELECT event_id, user_id % 10 AS drive, event_id AS t, CAST(value * 1073741824 AS BIGINT) AS free, 107374182400 AS total FROM events) SELECT event_id, CASE WHEN free < total * 0.1 THEN 'alert' WHEN free < total * 0.15 THEN 'warn' ELSE 'ok' END AS level, coalesce(lag(free) OVER (PARTITION BY drive ORDER BY t) - free > 5368709120, false) AS grown FROM r""")
def disk_levels(spark, sf):
    rows = table(spark, sf, "events").select("event_id", (F.col("user_id") % 10).alias("drive"), F.col("event_id").alias("at"), F.round(F.col("value") * 1073741824).cast("long").alias("free"), F.lit(107374182400).alias("total"))
    return results.disk_levels(rows).select("event_id", "level", "grown")


@query(f"""WITH {_FILES}, p AS (SELECT unnest(['/r0', '/r1/' || (SELECT min(split_part(p_name, ' ', 1)) FROM part), '/none']) AS place) SELECT place, CAST(sum(size) AS BIGINT) AS bytes, max(seconds) AS newest FROM f JOIN p ON starts_with(path, place || '/') GROUP BY place""")
def measured_places(spark, sf):
    word = table(spark, sf, "part").agg(F.min(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("w")).select(F.explode(F.array(F.lit("/r0"), F.concat(F.lit("/r1/"), F.col("w")), F.lit("/none"))).alias("place"))
    return results.measured(_files(spark, sf).select("path", "size", F.col("seconds").alias("modified")), word)


@query("""WITH c AS (SELECT p_brand AS project, split_part(p_type, ' ', 1) AS label, count(*) AS n FROM part GROUP BY ALL) SELECT project, string_agg(CASE WHEN n > 1 THEN concat(label, ' x', n) ELSE label END, ', ' ORDER BY CASE WHEN n > 1 THEN concat(label, ' x', n) ELSE label END) AS labels FROM c GROUP BY project""")
def output_labels(spark, sf):
    return results.output_labels(table(spark, sf, "part").select(F.col("p_brand").alias("project"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("label")))


@query("""SELECT s_suppkey AS drive, count(DISTINCT l.k) AS files, count(DISTINCT o.o_orderkey) AS sets, coalesce(max(o.r), 0) AS reclaim FROM supplier LEFT JOIN (SELECT l_suppkey, row_number() OVER () AS k FROM lineitem WHERE l_suppkey % 3 > 0) l ON l_suppkey = s_suppkey
LEFT JOIN (SELECT o_orderkey, o_custkey % 50 AS d, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey % 50) AS BIGINT) AS r FROM orders) o ON o.d = s_suppkey GROUP BY 1""")
def drive_cards(spark, sf):
    files = table(spark, sf, "lineitem").where("l_suppkey % 3 > 0").select(F.col("l_suppkey").alias("drive"))
    sets = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("drive"), F.col("o_orderkey").alias("reclaim"))
    return results.drive_cards(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("drive")), files, sets)


@query("""SELECT c_custkey FROM customer WHERE c_acctbal >= 1000 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)""")
def unclaimed_customers(spark, sf):
    from kindred.operators import folders

    claimed = table(spark, sf, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return folders.leftovers(table(spark, sf, "customer"), claimed, "c_custkey", "c_acctbal", 1000).select("c_custkey")
