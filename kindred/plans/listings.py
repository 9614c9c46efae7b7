"""Queries on state: journals, plans, moved and missing files, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.operators import state
from kindred.plans.registry import query
from kindred.sources.tables import table


@query("""WITH r AS (SELECT user_id % 3 AS root, concat('/u', user_id, '/', event_type) AS spot, event_id % 5 > 0 AS exact, CASE WHEN event_id % 7 = 0 THEN concat('/u', user_id) END AS left_out, event_id % 4 = 0 AS is_folder,
CASE event_id % 3 WHEN 0 THEN 256 WHEN 1 THEN 512 ELSE 1 END AS reason, CASE WHEN event_id % 6 > 1 THEN concat('/u', user_id, '/new') END AS now_ FROM events WHERE event_id % 9 > 0),
p AS (SELECT root, 'left out' AS place, left_out AS folder FROM r WHERE left_out IS NOT NULL UNION SELECT root, 'subtree', now_ FROM r WHERE left_out IS NULL AND is_folder AND reason <> 1 AND now_ IS NOT NULL
UNION SELECT root, 'emptied', spot FROM r WHERE left_out IS NULL AND ((is_folder AND reason <> 1 AND (now_ IS NULL OR reason = 512)) OR (NOT is_folder AND NOT exact)) UNION SELECT root, 'dirty', spot FROM r WHERE left_out IS NULL AND NOT is_folder AND exact)
SELECT DISTINCT * FROM p""")
def placed_changes(spark, sf):
    e, user = F.col("event_id"), F.concat(F.lit("/u"), F.col("user_id").cast("string"))
    records = table(spark, sf, "events").select(
        (F.col("user_id") % 3).alias("root"), F.when(e % 9 > 0, F.concat(user, F.lit("/"), F.col("event_type"))).alias("spot"), (e % 5 > 0).alias("exact"), F.when(e % 7 == 0, user).alias("left_out"), (e % 4 == 0).alias("is_folder"),
        F.when(e % 3 == 0, state.CREATED).when(e % 3 == 1, state.DELETED).otherwise(1).alias("reason"), F.when(e % 6 > 1, F.concat(user, F.lit("/new"))).alias("now"), F.lit(None).cast("string").alias("now_left_out"),
    )
    return state.placed(records)


@query("""WITH f AS (SELECT DISTINCT c_nationkey % 5 AS disk, CASE WHEN c_custkey % 4 = 0 THEN concat('n', c_nationkey) WHEN c_custkey % 4 = 1 THEN concat('n', c_nationkey, '/s', c_custkey % 10) ELSE concat('n', c_nationkey, 'x/s', c_custkey % 10, '/t', c_custkey) END AS folder FROM customer WHERE c_custkey % 4 <> 0 OR c_nationkey % 2 = 0)
SELECT * FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.disk = a.disk AND starts_with(a.folder, b.folder || '/'))""")
def outermost_folders(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    folder = F.when(k % 4 == 0, F.concat(F.lit("n"), n)).when(k % 4 == 1, F.concat(F.lit("n"), n, F.lit("/s"), (k % 10).cast("string"))).otherwise(F.concat(F.lit("n"), n, F.lit("x/s"), (k % 10).cast("string"), F.lit("/t"), k.cast("string")))
    rows = table(spark, sf, "customer").where((k % 4 != 0) | (F.col("c_nationkey") % 2 == 0)).select((F.col("c_nationkey") % 5).alias("disk"), folder.alias("folder"))
    return state.outermost(rows, "disk", "folder")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 31 = 0 THEN 'no listing yet' WHEN o_orderkey % 29 = 0 THEN 'settings changed' WHEN o_orderkey % 23 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'asked for' ELSE 'no listing yet' END WHEN o_orderkey % 19 = 0 THEN 'another journal'
WHEN o_orderdate < TIMESTAMP '1996-01-01' - INTERVAL 7 DAY THEN 'a week since the last whole listing' WHEN o_orderkey % 2 = 0 THEN 'asked for' WHEN o_orderkey % 17 = 0 THEN 'the journal no longer reaches back' WHEN o_orderkey % 13 = 0 THEN 'the last listing is missing'
WHEN o_orderkey % 11 = 0 THEN 'the folder is not there' WHEN o_orderkey % 7 = 0 THEN 'a change could not be placed' END AS why FROM orders""")
def listing_modes(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        "o_orderkey", (k % 31 > 0).alias("known"), (k % 29 > 0).alias("same_settings"), F.when(k % 23 > 0, 1).alias("journal"), F.when(k % 19 > 0, 1).otherwise(2).alias("journal_now"), F.col("o_orderdate").alias("walked"),
        F.when(k % 2 == 0, "asked for").alias("pending"), (k % 17 > 0).alias("readable"), (k % 13 > 0).alias("listing_there"), (k % 11 > 0).alias("folder_there"), (k % 7 == 0).alias("lost"),
    )
    return state.listing_mode(rows, F.lit("1996-01-01").cast("timestamp")).select("o_orderkey", "why")


_NOW = "TIMESTAMP '1999-01-01'"


@query(f"""WITH s AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 10 = 0 THEN 'look-alikes' END AS barred, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate END AS seen, o_orderkey % 9 = 0 AS held,
CASE WHEN o_orderkey % 6 = 0 AND o_orderkey % 12 = 0 THEN 'in use' END AS failed FROM orders), r AS (SELECT *, coalesce(barred, CASE WHEN failed IS NOT NULL THEN concat('could not be moved: ', failed) END) AS reason FROM s),
d AS (SELECT key, reason, held, CASE WHEN reason IS NULL AND NOT held THEN greatest(coalesce(seen, {_NOW}), TIMESTAMP '1997-06-01') + INTERVAL 30 DAY END AS due FROM r)
SELECT *, coalesce(due <= {_NOW}, false) AS due_now FROM d""")
def cleanup_plan(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    now = F.lit("1999-01-01").cast("timestamp")
    sets = o.select(k.alias("key"), F.when(k % 10 == 0, "look-alikes").alias("barred_by"))
    failed = o.where(k % 6 == 0).select(k.alias("key"), F.when(k % 12 == 0, now - F.expr("interval 2 hours")).otherwise(now - F.expr("interval 2 days")).alias("at"), F.lit("in use").alias("reason"))
    seen = o.where(k % 4 > 0).select(k.alias("key"), F.col("o_orderdate").alias("first_seen"))
    return state.plan(sets, seen, o.where(k % 9 == 0).select(k.alias("key")), failed, F.lit("1997-06-01").cast("timestamp"), 30, now)


@query("""WITH l AS (SELECT DISTINCT o_custkey AS key FROM orders) SELECT key, coalesce(CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2020-01-01' + to_days(CAST(c_custkey % 300 AS INTEGER)) END, TIMESTAMP '2024-01-01') AS first_seen FROM l LEFT JOIN customer ON c_custkey = key""")
def first_seen_state(spark, sf):
    old = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), (F.lit("2020-01-01").cast("timestamp") + F.make_interval(days=(F.col("c_custkey") % 300).cast("int"))).alias("first_seen"))
    return state.observed(old, table(spark, sf, "orders").select(F.col("o_custkey").alias("key")), F.lit("2024-01-01").cast("timestamp"))


@query("""SELECT count(*) AS waiting, count(*) FILTER (c_custkey % 100 > 40) AS fresh FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)""")
def sets_waiting(spark, sf):
    sets = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    return state.waiting(sets, sets.withColumn("first_seen", F.col("key") % 100), table(spark, sf, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("key")), F.lit(40))


_ROWS = "r AS (SELECT p_partkey AS id, concat('d', p_size % 4, '/f', p_size, '/', p_partkey) AS path, p_size % 4 AS drive, p_partkey % 3 > 0 AS comparable, p_size % 8 AS flags FROM part)"
_STATE = f"""{_ROWS}, s AS (SELECT *, CASE WHEN id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND id % 4 > 0 THEN 'there' WHEN drive = 3 OR drive = 1 THEN 'offline' WHEN comparable THEN 'tombstone' ELSE 'ghost' END AS state FROM r)"""


def _rows(spark, sf):
    n, k = F.col("p_size"), F.col("p_partkey")
    path = F.concat(F.lit("d"), (n % 4).cast("string"), F.lit("/f"), n.cast("string"), F.lit("/"), k.cast("string"))
    return table(spark, sf, "part").select(k.alias("id"), path.alias("path"), (n % 4).alias("drive"), (k % 3 > 0).alias("comparable"), (n % 8).alias("flags"))


def _present(spark, sf):
    rows = _rows(spark, sf)
    there = table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_partkey % 4 > 0").select(F.col("l_partkey").alias("id")).distinct().join(rows.select("id", "path"), "id").select("path")
    drives = spark.range(3).select(F.col("id").cast("int").alias("drive"), (F.col("id") != 1).alias("ready"))
    return state.presence(rows, there, drives)


@query(f"WITH {_STATE} SELECT id, state, flags & 6 = 0 AND state = 'there' AS plain, flags & 6 = 0 AND state <> 'ghost' AS remembering FROM s")
def file_states(spark, sf):
    rows = _present(spark, sf)
    out = rows.select("id", "state")
    for name, remember in (("plain", False), ("remembering", True)):
        left = state.cleaned(rows, remember).select("id", F.lit(True).alias(name))
        out = out.join(left, "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


@query(f"WITH {_ROWS} SELECT id FROM r WHERE NOT ((starts_with(path, 'd1/') OR starts_with(path, 'd2/f2/')) AND id NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_partkey % 2 = 0))")
def forgotten_rows(spark, sf):
    rows = _rows(spark, sf)
    listing = table(spark, sf, "lineitem").where("l_returnflag = 'A' and l_partkey % 2 = 0").select(F.col("l_partkey").alias("id")).distinct().join(rows.select("id", "path"), "id")
    return state.forgotten(rows, listing, spark.createDataFrame([("d1",), ("d2/f2",)], "root string")).select("id")


@query(f"""WITH {_ROWS}, c AS (SELECT l_partkey AS id, bit_or(CASE WHEN l_linestatus = 'O' THEN 16 WHEN l_returnflag = 'R' THEN 32 ELSE 0 END) AS mark FROM lineitem WHERE l_partkey % 5 = 0 GROUP BY ALL) SELECT id, flags | coalesce(mark, 0) AS flags FROM r LEFT JOIN c USING (id)""")
def quarantine_flags(spark, sf):
    rows = _rows(spark, sf)
    phase = F.when(F.col("l_linestatus") == "O", "decode").when(F.col("l_returnflag") == "R", "probe").otherwise("other")
    crumbs = table(spark, sf, "lineitem").where("l_partkey % 5 = 0").select(F.col("l_partkey").alias("id"), phase.alias("phase")).join(rows.select("id", "path"), "id")
    return state.quarantined(rows, crumbs, {"decode": 16, "probe": 32}).select("id", "flags")


@query(f"""WITH {_ROWS} SELECT id, concat('e:/new/', substr(path, 4)) AS new_path FROM r WHERE starts_with(lower(path), 'd2/')""")
def moved_prefixes(spark, sf):
    return state.with_prefix(_rows(spark, sf), "path", "D2", "e:/new").select("id", "new_path")


_SIDE = "SELECT concat('{s}', o_orderkey) AS path, o_custkey % 700 AS size, o_orderdate + to_seconds(CAST({t} AS INTEGER)) AS modified, CAST(o_orderkey % 50 AS DOUBLE) + {d} AS seconds FROM orders WHERE o_orderkey % 5 {w}"


@query(f"""WITH m AS ({_SIDE.format(s="m", t="o_orderkey % 3", d="0", w="= 0")}), f AS ({_SIDE.format(s="f", t="o_orderkey % 4", d="o_orderkey % 3 * 0.4", w="> 2")}), c AS (SELECT size, count(*) AS same, min(path) AS only_ FROM f GROUP BY ALL),
n AS (SELECT m.path, count(*) AS n, min(f.path) AS to_ FROM m JOIN f ON f.size = m.size AND abs(epoch_us(f.modified) - epoch_us(m.modified)) <= 2000000 AND abs(round(m.seconds, 2) - f.seconds) <= 0.5 GROUP BY ALL)
SELECT m.path, CASE WHEN same = 1 THEN only_ WHEN n = 1 THEN to_ END AS new_path, CASE WHEN same IS NULL THEN 'not found' WHEN same = 1 THEN 'size' WHEN n = 1 THEN 'size, time and duration' WHEN n > 1 THEN 'ambiguous' ELSE 'not found' END AS confidence FROM m LEFT JOIN c USING (size) LEFT JOIN n ON n.path = m.path""")
def relocated_files(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")

    def side(name, late, longer, rows):
        at = F.col("o_orderdate") + F.make_interval(secs=late.cast("decimal(18,6)"))
        return o.where(rows).select(F.concat(F.lit(name), k.cast("string")).alias("path"), (F.col("o_custkey") % 700).alias("size"), at.alias("modified"), ((k % 50).cast("double") + longer).alias("seconds"))

    return state.relocated(side("m", k % 3, F.lit(0.0), k % 5 == 0), side("f", k % 4, (k % 3) * F.lit(0.4), k % 5 > 2))


@query("""SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 9 > 0))""")
def whole_findings(spark, sf):
    findings = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_suppkey").alias("path"), "l_partkey", "l_linenumber")
    listing = table(spark, sf, "supplier").where("s_suppkey % 9 > 0").select(F.col("s_suppkey").alias("path"))
    return state.whole_findings(findings, listing).select(F.col("grp").alias("l_orderkey"), "l_partkey", "l_linenumber")


@query("""SELECT o_orderkey, coalesce(o_custkey % 40 > 0 AND TIMESTAMP '1996-01-01' - to_minutes(CAST(greatest(15, o_custkey % 40) AS INTEGER)) >= o_orderdate, false) AS due,
o_custkey % 40 > 0 AND TIMESTAMP '1996-01-01' >= o_orderdate - INTERVAL 2 MINUTE AND TIMESTAMP '1996-01-01' < o_orderdate + INTERVAL 1 DAY + to_minutes(CAST(greatest(15, o_custkey % 40) AS INTEGER)) - INTERVAL 2 MINUTE AS covered,
CASE WHEN o_orderkey % 3 > 0 THEN date_trunc('second', o_orderdate) END AS taken FROM orders""")
def schedule_times(spark, sf):
    at, every, now = F.col("o_orderdate").cast("timestamp"), (F.col("o_custkey") % 40).cast("int"), F.lit("1996-01-01").cast("timestamp")
    text = F.when(F.col("o_orderkey") % 3 > 0, F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")).otherwise("0000:00:00 00:00:00")
    return table(spark, sf, "orders").select("o_orderkey", state.scan_due(at, at - F.expr("interval 1 day"), every, now).alias("due"), state.bump_covers(at, at + F.expr("interval 1 day"), now, every).alias("covered"), state.exif_time(text).alias("taken"))


@query()
def one_to_one_matches(spark, sf):
    """Parts and suppliers of order lines, matched greedily, the dearest first."""
    pairs = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.max("l_extendedprice").alias("price"))
    return state.one_to_one(pairs, [F.desc("price")])
