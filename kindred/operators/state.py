"""State between runs: what a change journal means for a listing, what may be cleaned and when, files that moved, rows to forget.

All are joins and grouped aggregates on tables of the last state and of what is there now; nothing is gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import names

#: Reasons of journal records, error flags of rows, days after which a failed move is tried again and a whole listing is due.
CREATED, DELETED, RENAMED_OLD, RENAMED_NEW, ATTRIBUTES, LINKED = 0x100, 0x200, 0x1000, 0x2000, 0x8000, 0x100000
RESHAPED = CREATED | DELETED | RENAMED_OLD | RENAMED_NEW | ATTRIBUTES | LINKED
METADATA_ERROR, THUMBNAIL_ERROR = 2, 4
RETRY_DAYS, WALK_DAYS, MOST_DAYS = 1, 7, 365


# ---- change journal -----------------------------------------------------------------------------------------------


def placed(records: DataFrame) -> DataFrame:
    """(root, place, folder): what the journal's records say of a listing, each folder once.

    records: root, spot (the folder a record happened in, or the nearest one left; null: elsewhere), exact (is it that folder
    itself), left_out (the excluded folder it is in, null: none), is_folder, reason, now (where a changed folder is; null: gone
    or elsewhere), now_left_out. place is dirty (list it again), subtree (with all below), emptied or left out.
    """
    live = records.where(F.col("spot").isNotNull())
    told = lambda place, folder: F.struct(F.lit(place).alias("place"), folder.alias("folder"))
    shaped = F.col("is_folder") & (F.col("reason").bitwiseAND(RESHAPED) != 0)
    moved = F.col("now").isNull() | (F.col("reason").bitwiseAND(DELETED | RENAMED_OLD) != 0)
    found = F.array(
        F.when(F.col("left_out").isNotNull(), told("left out", F.col("left_out"))),
        F.when(F.col("left_out").isNull() & shaped & F.col("now").isNotNull() & F.col("now_left_out").isNotNull(), told("left out", F.col("now_left_out"))),
        F.when(F.col("left_out").isNull() & shaped & F.col("now").isNotNull() & F.col("now_left_out").isNull(), told("subtree", F.col("now"))),
        F.when(F.col("left_out").isNull() & ((shaped & moved) | (~F.col("is_folder") & ~F.col("exact"))), told("emptied", F.col("spot"))),
        F.when(F.col("left_out").isNull() & ~F.col("is_folder") & F.col("exact"), told("dirty", F.col("spot"))),
    )
    return live.select("root", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("root", "x.place", "x.folder").distinct()


def outermost(folders: DataFrame, group: str, folder: str) -> DataFrame:
    """The folders that are inside no other one of their group (each once): an anti join with their ancestors."""
    each = folders.select(group, folder).distinct()
    up = each.withColumn("_up", F.explode(names.ancestors(F.col(folder))))
    inside = up.join(each.select(F.col(group).alias("_g"), F.col(folder).alias("_f")), (F.col(group) == F.col("_g")) & (F.col("_up") == F.col("_f"))).select(group, folder).distinct()
    return each.join(inside, [group, folder], "left_anti")


def listing_mode(roots: DataFrame, now: Column) -> DataFrame:
    """The roots with ``why`` a whole walk is needed (null: the journal will do): the first of the reasons in their order.

    roots: known, same_settings, journal (the one read last; null: none), journal_now, walked (time of the last whole walk),
    pending (a reason noted between scans), readable, listing_there, folder_there, lost (a record that could not be placed).
    """
    late = F.col("walked").cast("timestamp") < now - F.make_interval(days=F.lit(WALK_DAYS))
    why = (
        F.when(~F.col("known"), "no listing yet")
        .when(~F.col("same_settings"), "settings changed")
        .when(F.col("journal").isNull(), F.coalesce("pending", F.lit("no listing yet")))
        .when(~F.col("journal").eqNullSafe(F.col("journal_now")), "another journal")
        .when(late, "a week since the last whole listing")
        .when(F.col("pending").isNotNull(), F.col("pending"))
        .when(~F.col("readable"), "the journal no longer reaches back")
        .when(~F.col("listing_there"), "the last listing is missing")
        .when(~F.col("folder_there"), "the folder is not there")
        .when(F.col("lost"), "a change could not be placed")
    )
    return roots.withColumn("why", why)


# ---- cleaning ------------------------------------------------------------------------------------------------------


def observed(state: DataFrame, listed: DataFrame, now: Column) -> DataFrame:
    """(key, first_seen) after a run: new keys are seen now, known ones keep their time, those no longer listed go."""
    return listed.select("key").distinct().join(state.select("key", "first_seen"), "key", "left").select("key", F.coalesce("first_seen", now).alias("first_seen"))


def plan(sets: DataFrame, seen: DataFrame, held: DataFrame, failed: DataFrame, since: Column | None, days: int, now: Column) -> DataFrame:
    """The sets with reason (why they wait), held, due and due_now.

    sets: key, barred_by (null: may be cleaned). seen (key, first_seen), held (key), failed (key, at, reason): a failed move is
    tried again a day later. A set is due ``days`` after it was first seen, or after the rule was switched on (``since``).
    """
    fresh = failed.where(F.col("at").cast("timestamp") > now - F.make_interval(days=F.lit(RETRY_DAYS))).groupBy("key").agg(F.max("reason").alias("_failed"))
    out = sets.join(seen, "key", "left").join(held.select("key").distinct().withColumn("_held", F.lit(True)), "key", "left").join(fresh, "key", "left")
    start = F.coalesce(F.col("first_seen").cast("timestamp"), now)
    if since is not None:
        start = F.greatest(start, since)
    reason = F.coalesce("barred_by", F.when(F.col("_failed").isNotNull(), F.concat(F.lit("could not be moved: "), F.col("_failed"))))
    is_held = F.coalesce("_held", F.lit(False))
    due = F.when(reason.isNull() & ~is_held, start + F.make_interval(days=F.lit(min(max(days, 0), MOST_DAYS))))
    return out.withColumns({"reason": reason, "held": is_held, "due": due}).withColumn("due_now", F.coalesce(F.col("due") <= now, F.lit(False))).drop("_held", "_failed", "first_seen", "barred_by")


def waiting(sets: DataFrame, seen: DataFrame, decided: DataFrame, visited: Column) -> DataFrame:
    """(waiting, fresh): sets without a decision, and those of them first seen after the last visit."""
    left = sets.select("key").join(decided.select("key"), "key", "left_anti").join(seen, "key", "left")
    return left.agg(F.count(F.lit(1)).alias("waiting"), F.count_if(F.col("first_seen") > visited).alias("fresh"))


# ---- rows whose files went ------------------------------------------------------------------------------------------


def presence(rows: DataFrame, files: DataFrame, drives: DataFrame) -> DataFrame:
    """The rows with state: there, tombstone (gone from a mounted drive), ghost (a tombstone with nothing to compare), offline.

    rows: path, drive, comparable; files: path; drives: drive, ready.
    """
    out = rows.join(files.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left").join(drives.select("drive", F.col("ready").alias("_ready")), "drive", "left")
    ready = F.coalesce("_ready", F.lit(False))
    state = F.when(F.col("_there"), "there").when(~ready, "offline").when(F.col("comparable"), "tombstone").otherwise("ghost")
    return out.withColumn("state", state).drop("_there", "_ready")


def cleaned(rows: DataFrame, remember: bool) -> DataFrame:
    """The rows of ``presence`` that a clean-up leaves: without errors, and there; with ``remember`` also tombstones and offline ones."""
    good = F.col("flags").bitwiseAND(METADATA_ERROR | THUMBNAIL_ERROR) == 0
    return rows.where(good & (F.col("state") != "ghost" if remember else F.col("state") == "there"))


def forgotten(rows: DataFrame, listing: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows that stay: those under no listed root, and those in the listing."""
    under = rows.withColumn("_up", F.explode(names.ancestors(F.col("path")))).join(roots.select(F.col("root").alias("_up")).distinct(), "_up", "left_semi").select("path").distinct()
    gone = under.join(listing.select("path"), "path", "left_anti")
    return rows.join(gone, "path", "left_anti")


def quarantined(rows: DataFrame, crumbs: DataFrame, flags_of: dict[str, int]) -> DataFrame:
    """The rows with the flags of the phases in which reading them crashed (crumbs: path, phase)."""
    bit = F.lit(0)
    for phase, flag in flags_of.items():
        bit = F.when(F.col("phase") == phase, flag).otherwise(bit)
    marks = crumbs.groupBy("path").agg(F.bit_or(bit).alias("_mark"))
    return rows.join(marks, "path", "left").withColumn("flags", F.col("flags").bitwiseOR(F.coalesce("_mark", F.lit(0)))).drop("_mark")


def to_try(rows: DataFrame, failures: DataFrame) -> DataFrame:
    """The rows whose reading has not failed before as they are now: a failure counts for one size and time."""
    return rows.join(failures.select("path", "size", "modified"), ["path", "size", "modified"], "left_anti")


# ---- files that moved -------------------------------------------------------------------------------------------------


def with_prefix(rows: DataFrame, path: str, old: str, new: str) -> DataFrame:
    """The rows under the old folder with new_path, where they would be under the new one; any case, whole segments."""
    old, new = old.rstrip("/") + "/", new.rstrip("/") + "/"
    return rows.where(F.startswith(F.lower(path), F.lit(old.lower()))).withColumn("new_path", F.concat(F.lit(new), F.expr(f"substring(`{path}`, {len(old) + 1})")))


def relocated(missing: DataFrame, found: DataFrame, by_time: bool = True, by_duration: bool = True) -> DataFrame:
    """(path, new_path, confidence): where missing files are now.

    missing and found: path, size, modified, seconds. One file of the size is it; of several, those within two seconds of the
    time and half a second of the duration. Sizes that very many files have are counted before they are joined.
    """
    sizes = found.groupBy("size").agg(F.count(F.lit(1)).alias("_same"), F.min("path").alias("_only"))
    rows = missing.join(sizes, "size", "left")
    # only what needs a closer look meets the files themselves, in cells of two seconds where the time counts
    close = rows.where("_same > 1")
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    near = found.select(F.col("path").alias("_path"), F.col("size").alias("_size"), at("modified").alias("_at"), F.col("seconds").alias("_seconds"))
    on = (F.col("size") == F.col("_size"))
    if by_time:
        near = near.withColumn("_cell", F.explode(F.array(*[F.floor(F.col("_at") / 2_000_000) + d for d in (-1, 0, 1)])))
        close = close.withColumn("_own", F.floor(at("modified") / 2_000_000))
        on = on & (F.col("_own") == F.col("_cell")) & (F.abs(at("modified") - F.col("_at")) <= 2_000_000)
    if by_duration:
        on = on & (F.col("seconds").isNull() | (F.abs(F.round(F.col("seconds"), 2) - F.col("_seconds")) <= 0.5))
    met = close.join(near, on).groupBy("path").agg(F.count(F.lit(1)).alias("_n"), F.min("_path").alias("_to"))
    out = rows.join(met, "path", "left")
    sure = "size, time and duration" if by_duration else "size and time" if by_time else "size"
    confidence = F.when(F.col("_same").isNull(), "not found").when(F.col("_same") == 1, "size").when(F.col("_n") == 1, sure).when(F.col("_n") > 1, "ambiguous").otherwise("not found")
    return out.select("path", F.when(F.col("_same") == 1, F.col("_only")).when(F.col("_n") == 1, F.col("_to")).alias("new_path"), confidence.alias("confidence"))


def one_to_one(pairs: DataFrame, order: list[Column]) -> DataFrame:
    """The pairs (a, b) that a greedy matching takes in this order: one whose sides are both still free.

    In rounds: a pair that comes first for both of its sides is taken, and what touches it goes. Each round takes the first
    pair of all at least, and many at once, so there are few rounds; the state is cut by a written table each time.
    """
    from kindred.operators.clustering import written

    def firsts(left: DataFrame) -> DataFrame:
        first = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(*order, "a", "b")) == 1
        return left.withColumns({"_a": first("a"), "_b": first("b")})

    left, taken = written(pairs, "pairs"), None
    while not left.isEmpty():
        ranked = firsts(left)
        new = written(ranked.where("_a and _b").drop("_a", "_b"), "taken")
        taken = new if taken is None else taken.unionByName(new)
        left = written(left.join(new.select("a"), "a", "left_anti").join(new.select("b"), "b", "left_anti"), "pairs")
    return left if taken is None else taken


# ---- times ---------------------------------------------------------------------------------------------------------------


def scan_due(last: Column, started: Column, every: Column, now: Column) -> Column:
    """Is a scan due: so many minutes (15 at least) after the last one ended or began; never without one or with 0 minutes."""
    latest = F.greatest(last, started)
    return F.coalesce((every > 0) & (now - F.make_interval(mins=F.greatest(F.lit(15), every)) >= latest), F.lit(False))


def bump_covers(first: Column, last: Column, run: Column, every: Column) -> Column:
    """Does a scan brought forward stand in for the run: from two minutes before its first slot to two before the one after its last."""
    grace = F.expr("interval 2 minutes")
    return (every > 0) & (run >= first - grace) & (run < last + F.make_interval(mins=F.greatest(F.lit(15), every)) - grace)


def exif_time(text: Column) -> Column:
    """A picture's time as cameras write it, "2023:11:05 20:53:59"; null for none, also for zeros."""
    return F.try_to_timestamp(F.trim(F.substring(text, 1, 19)), F.lit("yyyy:MM:dd HH:mm:ss"))


# ---- lists of roots, branches, findings -----------------------------------------------------------------------------------


def roots(candidates: DataFrame, excluded: DataFrame, unreachable: DataFrame) -> DataFrame:
    """The folders to scan: not inside an excluded one, and inside another one only if its scan does not get there.

    candidates and excluded: folder; unreachable: folder (inside a scanned one, but passed over by it).
    """
    chain = F.explode(F.array_append(names.ancestors(F.col("folder")), F.col("folder")))
    each = candidates.select("folder").distinct()
    barred = each.withColumn("_up", chain).join(excluded.select(F.col("folder").alias("_up")).distinct(), "_up", "left_semi").select("folder").distinct()
    left = each.join(barred, "folder", "left_anti")
    inside = left.withColumn("_up", F.explode(names.ancestors(F.col("folder")))).join(left.select(F.col("folder").alias("_up")), "_up", "left_semi").select("folder").distinct()
    passed = left.withColumn("_up", chain).join(unreachable.select(F.col("folder").alias("_up")).distinct(), "_up", "left_semi").select("folder").distinct()
    return left.join(inside.join(passed, "folder", "left_anti"), "folder", "left_anti")


def whole_findings(findings: DataFrame, listing: DataFrame) -> DataFrame:
    """The sets of another machine of which every file was listed (findings: grp, path)."""
    broken = findings.join(listing.select("path").distinct(), "path", "left_anti").select("grp").distinct()
    return findings.join(broken, "grp", "left_anti")


def merged_branches(branches: DataFrame) -> DataFrame:
    """(repo, branch) that may go: merged, not protected, not the default one, checked out nowhere."""
    return branches.where("merged and not protected and not is_default and not checked_out").select("repo", "branch")
