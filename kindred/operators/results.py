"""Rows before and after the comparison: what is left out, how result sets are listed, filtered, selected and summed up."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import names
from kindred.operators import ordering, reasons

#: Flags of rows.
EXCLUDED, ERRORS, TOO_DARK, REPARSE = 1, 2 | 4 | 128, 8, 512


def any_of(tests: list[Column]) -> Column:
    return reduce(Column.__or__, tests, F.lit(False))


# ---- what is left out -------------------------------------------------------------------------------------------------


def black_listed(folder: Column, entry: str) -> Column:
    """Does one entry of a black list cover a folder: a name any segment, a path itself and all below, a pattern any segment or ancestor."""
    pattern = "*" in entry or "?" in entry
    segments = names.segments(folder)
    if "/" not in entry:
        return F.exists(segments, lambda s: names.wildcard(s, entry)) if pattern else F.exists(segments, lambda s: F.lower(s) == entry.lower())
    if not pattern:
        return names.under(F.lower(folder), F.lit(entry.lower().rstrip("/")))
    return F.exists(F.array_append(names.ancestors(folder), folder), lambda f: names.wildcard(f, entry))


def black_listed_below(folder: Column, entries: list[str], roots: list[str]) -> Column:
    """The same for built-in entries, which judge only what lies below the deepest root that holds the folder."""
    low = F.lower(folder)
    depth = F.coalesce(F.greatest(F.lit(0), *[F.when(names.under(low, F.lit(r.lower())), len(r)) for r in roots]), F.lit(0))
    chain = F.filter(F.array_append(names.ancestors(folder), folder), lambda f: F.length(f) > depth)
    tests = [lambda f, e=e: names.wildcard(names.file_name(f), e) if "/" not in e else names.wildcard(f, e) for e in entries]  # noqa: B023
    return F.exists(chain, lambda f: any_of([t(f) for t in tests]))


@dataclass(frozen=True)
class Scope:
    """What a scan takes in; sizes in MB."""

    images: bool = True
    black_list: list[str] = field(default_factory=list)
    built_in: list[str] = field(default_factory=list)
    roots: list[str] = field(default_factory=list)
    missing_too: bool = False
    size: tuple[float, float] | None = None
    must_match: list[str] = field(default_factory=list)
    must_not_match: list[str] = field(default_factory=list)
    no_links: bool = True


def exclusion(s: Scope) -> Column:
    """Why a row (path, folder, image, flags, size, listed) is left out: the first of eleven reasons; null if it is not."""
    flag = lambda f: reasons.has_all(F.col("flags"), f)
    mb = F.col("size") / 1048576.0
    rules = [
        ("images are off", ~F.lit(s.images) & F.col("image")),
        ("excluded folder", any_of([black_listed(F.col("folder"), e) for e in s.black_list]) | (black_listed_below(F.col("folder"), s.built_in, s.roots) if s.built_in else F.lit(False))),
        ("outside the included folders", ~any_of([names.under(F.lower("folder"), F.lit(r.lower())) for r in s.roots]) if s.roots else F.lit(False)),
        ("excluded by hand", flag(EXCLUDED)),
        ("too dark", flag(TOO_DARK)),
        ("missing", ~F.lit(s.missing_too) & ~F.col("listed")),
        ("unsafe path", F.rlike("path", F.lit("[\\x{D800}-\\x{DFFF}\\x{FFFD}]"))),
        ("size out of range", ((mb < s.size[0]) | (mb > s.size[1])) if s.size else F.lit(False)),
        ("path does not match", ~any_of([names.wildcard(F.col("path"), p) for p in s.must_match]) if s.must_match else F.lit(False)),
        ("link", F.lit(s.no_links) & flag(REPARSE)),
        ("path matches an excluded pattern", any_of([names.wildcard(F.col("path"), p) for p in s.must_not_match])),
    ]
    return reasons.first_reason(rules)


def comparable(rows: DataFrame, reason: str, frames: str, positions: int) -> DataFrame:
    """The rows that take part in the comparison: not left out, probed, without an error, with enough frames."""
    return rows.where(F.col(reason).isNull() & F.col("probed") & (F.col("flags").bitwiseAND(ERRORS) == 0) & (F.size(frames) >= positions))


def editor_rows(rows: DataFrame, kind: str | None = None, errors_only: bool = False, flag: int = 0, search: str = "") -> DataFrame:
    """Rows of the database editor: by type (images, videos), errors, one flag, and a part of the path."""
    tests = [F.lit(True)]
    if kind:
        tests.append(F.col("image") == F.lit(kind == "images"))
    if errors_only:
        tests.append(reasons.has_any(F.col("flags"), ERRORS))
    if flag:
        tests.append(reasons.has_any(F.col("flags"), flag))
    if search:
        tests.append(F.contains(F.lower("path"), F.lit(search.lower())))
    return rows.where(reduce(Column.__and__, tests))


def editor_order(mode: str, flag_first: int = 0) -> list[Column]:
    """size, created, duration or bit rate, the largest first; else the path; rows with a flag before all if asked."""
    own = {"size": [F.desc("size")], "created": [F.desc("created")], "duration": [F.desc("seconds")], "bit rate": [F.desc("kilobits")]}.get(mode, [])
    first = [F.when(reasons.has_any(F.col("flags"), flag_first), 0).otherwise(1).asc()] if flag_first else []
    return [*first, *own, F.lower("path").asc(), F.col("path").asc()]


def flag_counts(rows: DataFrame, flags: dict[str, int]) -> DataFrame:
    """How many rows have each flag, and any error, in one pass."""
    return rows.agg(*[F.count_if(reasons.has_any(F.col("flags"), f)).alias(n) for n, f in flags.items()], F.count_if(reasons.has_any(F.col("flags"), ERRORS)).alias("errors"))


# ---- result sets ----------------------------------------------------------------------------------------------------------


def filtered_results(rows: DataFrame, pattern: str = "", image: bool | None = None, similarity: tuple[float, float] | None = None, hide_checked: bool = False, several_live: bool = False) -> DataFrame:
    """Result rows: whole sets by a pattern that one path at least matches, by checked members and by live ones; rows by type and similarity.

    rows: grp, path, image, similarity, checked, live. Sets are judged by counts that are combined before the shuffle.
    """
    if pattern or hide_checked or several_live:
        keep = rows.groupBy("grp").agg(F.bool_or(names.wildcard(F.col("path"), pattern) if pattern else F.lit(True)).alias("_m"), F.bool_or("checked").alias("_c"), F.count_if("live").alias("_l"))
        keep = keep.where(F.col("_m") & (~F.col("_c") if hide_checked else F.lit(True)) & ((F.col("_l") > 1) if several_live else F.lit(True)))
        rows = rows.join(keep.select("grp"), "grp", "left_semi")
    if image is not None:
        rows = rows.where(F.col("image") == image)
    if similarity:
        rows = rows.where(F.col("similarity").between(*similarity))
    return rows


def headers(rows: DataFrame) -> DataFrame:
    """Per set what its header shows and what sets can be sorted by: sums, extremes, the similarity's range, live and checked ones."""
    return rows.groupBy("grp").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("total"), (F.sum("size") - F.max("size")).alias("wasted"), F.max("size").alias("largest"), F.min("similarity").alias("least_alike"), F.max("similarity").alias("most_alike"),
        F.count_if("live").alias("live"), F.bool_or("checked").alias("checked"), F.max("created").alias("newest"), F.max("seconds").alias("longest"), F.max("frame").alias("frame"), F.min(F.lower("path")).alias("first_path"),
    )


#: What each mode sorts sets and their members by (null: members keep their order).
SORT_MODES = {
    "wasted space": ("wasted", "size"), "total size": ("total", "size"), "largest file": ("largest", "size"), "file count": ("files", None), "similarity": ("most_alike", "similarity"),
    "date created": ("newest", "created"), "duration": ("longest", "seconds"), "resolution": ("frame", "frame"), "folder path": ("first_path", "path"), "checked": ("checked", None),
}


def sort_orders(mode: str, descending: bool) -> tuple[list[Column], list[Column]]:
    """Orders of sets and of members in a mode; ties keep the order of ``grp`` and ``place``."""
    group, member = SORT_MODES[mode]
    turn = lambda c: F.col(c).desc() if descending else F.col(c).asc()
    return [turn(group), F.asc("grp")], [*([turn(member)] if member else []), F.asc("place")]


def listed(rows: DataFrame, mode: str, descending: bool, keep: list[str] | None = None) -> DataFrame:
    """The members of all sets with ``listed``, their place in the whole listing of a mode: set after set, member after member.

    rows: grp, place and what ``headers`` reads. A member meets its set's figures by its group; sets and members are then one
    order over all rows, so no set is gathered in a task. ``keep``: the columns to return beside ``listed`` (None: all); others
    are neither joined nor dealt out unless the order needs them, and of a set's figures only the one of the mode is worked out.
    """
    group, member = SORT_MODES[mode]
    keep = rows.columns if keep is None else keep
    # narrowed before figures meet them, as ranges are written whole
    figures = headers(rows).select("grp", F.col(group).alias(f"_set_{group}"))
    rows = rows.select(*dict.fromkeys(["grp", "place", *([member] if member else []), *keep]))
    turn = lambda c: F.col(c).desc() if descending else F.col(c).asc()
    order = [turn(f"_set_{group}"), F.asc("grp"), *([turn(member)] if member else []), F.asc("place")]
    return ordering.placed(rows.join(figures, "grp"), order, "listed").select(*keep, "listed")


#: What the web page sorts the members of a set by, as chosen for each set: the largest first, names from A on.
WEB_SORTS = {"similarity": "similarity", "size": "size", "duration": "seconds", "bitrate": "kilobits", "resolution": "frame", "date": "created"}


def web_listed(rows: DataFrame) -> DataFrame:
    """The members (grp, place, sort and what is sorted by) with ``listed``: sets in order, each by its own ``sort``, else by similarity."""
    value = F.coalesce(*[F.when(F.col("sort") == name, F.col(c).cast("double")) for name, c in WEB_SORTS.items()], F.col("similarity").cast("double"))
    name = F.when(F.col("sort") == "name", F.element_at(F.split("path", "[/\\\\]"), -1))
    return ordering.placed(rows, [F.asc("grp"), F.asc_nulls_first(name), F.desc_nulls_last(F.when(name.isNull(), value)), F.asc("place")], "listed")


def partition_matches(rows: DataFrame, test: Column) -> DataFrame:
    """The rows that a condition matches, with ``whole``: does it match all of their set, so that nothing would be left."""
    w = Window.partitionBy("grp")
    out = rows.withColumn("_hit", F.coalesce(test, F.lit(False)))
    return out.withColumn("whole", F.count_if("_hit").over(w) == F.count(F.lit(1)).over(w)).where("_hit").drop("_hit")


def cluster_selection(rows: DataFrame, identical: str, by_date: str | None = None) -> DataFrame:
    """The members of each set to check: those like the first one, all but the one that is kept.

    identical: "same" (equal in all of ``same_key`` and size), "same but size", "different" or "any". by_date: "newest" checks the
    newest and keeps the oldest, "oldest" the other way round; without it the first member is kept.
    """
    w = Window.partitionBy("grp")
    first = lambda c: F.first(c).over(w.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = rows.withColumns({"_key": first("same_key"), "_size": first("size"), "_at": F.min("place").over(w)})
    same = F.col("same_key").eqNullSafe(F.col("_key"))
    like = {"same": same & F.col("size").eqNullSafe(F.col("_size")), "same but size": same, "different": ~(same & F.col("size").eqNullSafe(F.col("_size"))), "any": F.lit(True)}[identical]
    out = out.where(like | (F.col("place") == F.col("_at"))).drop("_key", "_size", "_at")
    order = {None: [F.asc("place")], "newest": [F.asc("created"), F.asc("place")], "oldest": [F.desc("created"), F.asc("place")]}[by_date]
    return out.withColumn("_n", F.row_number().over(w.orderBy(*order))).where("_n > 1").drop("_n")


def hdr_upgrades(rows: DataFrame, rank: str) -> DataFrame:
    """upgrade: does the row have a higher rank than the least of its set."""
    return rows.withColumn("upgrade", F.col(rank) > F.min(rank).over(Window.partitionBy("grp")))


def chips(rows: DataFrame, group: str, key: str, fields: dict[str, bool]) -> DataFrame:
    """Each member against the kept one, field by field: better, worse or equal (True: more is better)."""
    kept = rows.where("keep").groupBy(group).agg(*[F.first(c).alias(f"_{c}") for c in fields])
    out = rows.join(kept, group)
    for c, more in fields.items():
        gap = (F.col(c) - F.col(f"_{c}")) * (1 if more else -1)
        out = out.withColumn(f"{c}_chip", F.when(gap > 0, "better").when(gap < 0, "worse").otherwise("equal"))
    return out.select(group, key, *[f"{c}_chip" for c in fields])


def pruned_lists(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Black-listed sets of which every path is still there (listed: grp, path)."""
    gone = listed.join(files.select("path").distinct(), "path", "left_anti").select("grp").distinct()
    return listed.join(gone, "grp", "left_anti")


def clip_rows(assigned: DataFrame) -> DataFrame:
    """Rows of partial matches: each source once with difference 0, each clip with its offset (assigned: source, clip, similarity, offset)."""
    sources = assigned.select(F.col("source").alias("grp"), F.col("source").alias("item")).distinct().withColumns({"difference": F.lit(0.0), "offset": F.lit(None).cast("long")})
    clips = assigned.select(F.col("source").alias("grp"), F.col("clip").alias("item"), (1 - F.col("similarity")).alias("difference"), F.col("offset").cast("long").alias("offset"))
    return sources.unionByName(clips)


def verified_sources(pairs: DataFrame, passes: Column) -> DataFrame:
    """Each clip's first source whose check passes: what assigning, checking and trying the next one comes to."""
    row = F.struct(*[F.col(c) for c in pairs.columns])
    first = pairs.where(passes).groupBy(F.col("clip").alias("_clip")).agg(F.min_by(row, "source").alias("row"))
    return first.select("row.*")


# ---- histories and sums ------------------------------------------------------------------------------------------------------


def history(decisions: DataFrame, k: int = 100) -> DataFrame:
    """The newest k entries: decisions of one batch are one, with their last time, bytes and number (key, batch or null, at, bytes)."""
    entry = F.coalesce(F.concat(F.lit("b:"), F.col("batch").cast("string")), F.concat(F.lit("k:"), F.col("key").cast("string")))
    out = decisions.groupBy(entry.alias("entry")).agg(F.max("at").alias("at"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("at"), "entry").limit(k)


def disk_levels(readings: DataFrame) -> DataFrame:
    """Each reading of a drive (drive, at, free, total) with level (alert under 10 %, warn under 15 %) and grown: 5 GiB or more since the one before."""
    before = F.lag("free").over(Window.partitionBy("drive").orderBy("at"))
    level = F.when(F.col("free") < F.col("total") * 0.1, "alert").when(F.col("free") < F.col("total") * 0.15, "warn").otherwise("ok")
    return readings.withColumns({"level": level, "grown": F.coalesce(before - F.col("free") > F.lit(5 * 2**30), F.lit(False))})


def measured(rows: DataFrame, places: DataFrame) -> DataFrame:
    """(place, bytes, newest) of all files at or below each place (rows: path, size, modified; places: place)."""
    up = rows.withColumn("place", F.explode(F.array_append(names.ancestors(F.col("path")), F.col("path"))))
    return up.join(places.select("place").distinct(), "place", "left_semi").groupBy("place").agg(F.sum("size").alias("bytes"), F.max("modified").alias("newest"))


def output_labels(outputs: DataFrame) -> DataFrame:
    """Per project its build outputs as "bin x2, obj" (outputs: project, label)."""
    counted = outputs.groupBy("project", "label").agg(F.count(F.lit(1)).alias("n"))
    text = F.when(F.col("n") > 1, F.concat(F.col("label"), F.lit(" x"), F.col("n").cast("string"))).otherwise(F.col("label"))
    return counted.groupBy("project").agg(F.array_join(F.array_sort(F.collect_list(text)), ", ").alias("labels"))


def orphan_outputs(outputs: DataFrame, projects: DataFrame, tracked: DataFrame) -> DataFrame:
    """Build outputs without a project in their folder, none of whose files is tracked (outputs: path; projects: folder; tracked: path)."""
    kept = tracked.withColumn("_up", F.explode(names.ancestors(F.col("path")))).select("_up").distinct()
    alone = outputs.withColumn("_folder", names.parent(F.col("path"))).join(projects.select(F.col("folder").alias("_folder")).distinct(), "_folder", "left_anti")
    return alone.join(kept.withColumnRenamed("_up", "path"), "path", "left_anti").drop("_folder")


def last_reads(reads: DataFrame) -> DataFrame:
    """Per drive when it was last read whole, and why (reads: drive, at, whole, why)."""
    return reads.where("whole").groupBy("drive").agg(F.max("at").alias("at"), F.max_by("why", F.struct("at", "why")).alias("why"))


def drive_cards(drives: DataFrame, files: DataFrame, sets: DataFrame) -> DataFrame:
    """Per drive: files, pending sets, what they free; drives without either have zeros (files, sets: drive, ...; sets: reclaim)."""
    f = files.groupBy("drive").agg(F.count(F.lit(1)).alias("files"))
    s = sets.groupBy("drive").agg(F.count(F.lit(1)).alias("sets"), F.sum("reclaim").alias("reclaim"))
    return drives.join(f, "drive", "left").join(s, "drive", "left").fillna(0, ["files", "sets", "reclaim"])


def anonymous(rows: DataFrame) -> DataFrame:
    """A dump without paths: one running number over all rows in an order that tells nothing, frames in base 64 (rows: key, frames as binary by position)."""
    own = rows.select(F.sha2(F.col("key").cast("string"), 256).alias("_h"), F.transform("frames", lambda f: F.base64(f)).alias("frames"))
    return ordering.placed(own, [F.asc("_h")], "id").select((F.col("id") - 1).alias("id"), "frames")
