"""Report sets: which member is kept, what each other one is to it, and what a set as a whole is.

Rows are members of sets with the columns named in ``ITEM``; facts on pairs (member, keeper) come from the verdict columns. All
choices are windows over one partitioning by set, so a set is never gathered in one row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import aligned, names
from kindred.operators.clustering import written

#: Columns of a member: set, path, image, size, width, height, seconds, kilobits, rate, audio (null: none), modified, taken (null: no capture date), synced.
ITEM = "grp path image size width height seconds kilobits rate audio modified taken synced".split()
#: Limits in percent and gray steps for plain copies, edits and soundtracks; words that mark copies and passing folders.
PLAIN_PERCENT, PLAIN_CELL, SAME_AI, SAME_SOUND = 99.5, 8, 97.0, 90.0
COPY_MARKERS = [" - copy", " copy", "(1)", "(2)", "(3)", "_1.", "-1."]
TRANSIENT = ["/downloads/", "/temp/", "/tmp/", "/desktop/", "/whatsapp", "/telegram"]
PLAIN = ["identical", "smaller", "compressed", "resaved"]


def original_order(path: str = "path") -> list[Column]:
    """What looks most like the original comes first: synced, in no passing folder, without a copy's mark, oldest, shortest name."""
    low, name = F.lower(path), F.lower(names.file_name(F.col(path)))
    passing = F.greatest(*[F.contains(F.concat(low, F.lit("/")), F.lit(f)) for f in TRANSIENT])
    marked = F.greatest(*[F.contains(name, F.lit(m)) for m in COPY_MARKERS])
    return [F.when(F.col("synced"), 0).otherwise(1).asc(), passing.asc(), marked.asc(), F.col("modified").asc(), F.length(name).asc(), low.asc(), F.col(path).asc()]


def photo_keepers(rows: DataFrame, by: tuple[str, ...] = ("grp",)) -> DataFrame:
    """The rows with keep and reason: highest resolution, the only ones with a capture date, oldest within two seconds, largest, original-looking.

    Each step narrows the choice of the set; the reason is the step that left one. ``by``: the columns that tell sets apart.
    """
    w = Window.partitionBy(*by)
    left = lambda c: F.count_if(F.col(c)).over(w)
    frame = F.col("width") + F.col("height")
    out = rows.withColumn("_1", frame == F.max(frame).over(w)).withColumn("_n1", left("_1"))
    out = out.withColumn("_d", F.col("_1") & F.col("taken").isNotNull()).withColumn("_nd", left("_d"))
    out = out.withColumn("_2", F.when(F.col("_nd") > 0, F.col("_d")).otherwise(F.col("_1")))
    age = F.unix_micros(F.col("modified").cast("timestamp"))
    out = out.withColumn("_3", F.col("_2") & (age - F.min(F.when(F.col("_2"), age)).over(w) < 2_000_000)).withColumn("_n3", left("_3"))
    out = out.withColumn("_4", F.col("_3") & (F.col("size") == F.max(F.when(F.col("_3"), F.col("size"))).over(w))).withColumn("_n4", left("_4"))
    first = F.row_number().over(w.orderBy(F.when(F.col("_4"), 0).otherwise(1), *original_order()))
    reason = F.when(F.col("_n1") == 1, "resolution").when(F.col("_nd") == 1, "capture date").when(F.col("_n3") == 1, "oldest").when(F.col("_n4") == 1, "largest").otherwise("original name")
    # a later step decides only among what an earlier one left
    return out.withColumns({"keep": first == 1, "reason": reason}).drop("_1", "_n1", "_d", "_nd", "_2", "_3", "_n3", "_4", "_n4")


def video_keepers(rows: DataFrame, by: tuple[str, ...] = ("grp",)) -> DataFrame:
    """The rows with keep and reason: longest, with sound, resolution, bit rate, frame rate, oldest, smallest; the reason tells it from the second."""
    frame = F.col("width") + F.col("height")
    ranked = {"longest": F.rint("seconds"), "with sound": F.col("audio").isNotNull().cast("int"), "resolution": frame, "bit rate": F.col("kilobits"), "frame rate": F.col("rate")}
    w = Window.partitionBy(*by).orderBy(*[c.desc() for c in ranked.values()], F.col("modified").asc(), F.col("size").asc(), F.col("path").asc())
    out = rows.withColumns({f"_v{i}": c for i, c in enumerate(ranked.values())} | {"_place": F.row_number().over(w)})
    reason = F.coalesce(*[F.when(F.col(f"_v{i}") > F.lead(f"_v{i}").over(w), F.lit(name)) for i, name in enumerate(ranked)], F.lit("oldest"))
    out = out.withColumn("reason", reason)
    out = out.withColumn("reason", F.max(F.when(F.col("_place") == 1, F.col("reason"))).over(Window.partitionBy(*by)))
    return out.withColumn("keep", F.col("_place") == 1).drop("_place", *[f"_v{i}" for i in range(len(ranked))])


def by_look(gray: Column, ai: Column, smaller: Column, shorter: Column, fewer_bytes: Column, cell: Column, close: Column) -> Column:
    """What two pictures of different bytes are by look alone: smaller, compressed, resaved, edited or variant.

    gray and ai are percentages, cell the largest difference in one place, close whether they are the same up close (null: not asked).
    """
    plain = F.coalesce((gray >= PLAIN_PERCENT) & ~F.coalesce(cell > PLAIN_CELL, F.lit(False)) & F.coalesce(close, F.lit(True)), F.lit(False))
    same = F.when(smaller, "smaller").when(shorter, "variant").when(fewer_bytes, "compressed").otherwise("resaved")
    return F.when(plain, same).when(ai >= SAME_AI, "edited").otherwise("variant")


def relation(i: dict[str, Column], keep: dict[str, Column], facts: dict[str, Column]) -> Column:
    """What a member is to the kept one: the first of twelve that holds.

    Sides have path, image, size, width, height, seconds, audio, modified, taken. facts: burst, language, same_bytes, sound
    (percent, null: unknown), gray and ai (percent), cell, close, words ("same", "differs", "unrelated").
    """
    both_films, photos = ~i["image"] & ~keep["image"], i["image"] & keep["image"]
    frame = lambda x: x["width"] + x["height"]
    look = by_look(facts["gray"], facts["ai"], (frame(i) > 0) & (frame(i) < frame(keep)), ~i["image"] & (F.rint(i["seconds"]) < F.rint(keep["seconds"])), i["size"] < keep["size"], F.when(photos, facts["cell"]), F.when(photos, facts["close"]))
    older = i["modified"].cast("timestamp") < keep["modified"].cast("timestamp") - F.expr("interval 1 hour")
    may_be_original = older | (i["taken"].isNotNull() & keep["taken"].isNull())
    told = F.when((look == "smaller") & photos & may_be_original, "original").otherwise(look)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(facts["burst"]), "burst")
        .when(both_films & yes(facts["language"]), "language")
        .when(yes((i["size"] == keep["size"]) & facts["same_bytes"]), "identical")
        .when(names.original_and_edit(i["path"], keep["path"]), "edited")
        .when(both_films & yes(facts["sound"] < SAME_SOUND), "soundtrack")
        .when(both_films & (i["audio"].isNull() != keep["audio"].isNull()), "variant")
        .when(names.may_be_animated(i["path"]) | names.may_be_animated(keep["path"]), "variant")
        .when(photos & yes(facts["words"] == "differs"), "wording")
        .when(photos & yes(facts["words"] == "unrelated"), "different")
        .otherwise(told)
    )


def built(rows: DataFrame) -> DataFrame:
    """Per set: key, kind (identical, copies, similar), reclaim (bytes of its plain copies) and how many members.

    rows: grp, path, size, relation ("keep" for the kept one).
    """
    plain = F.col("relation").isin(PLAIN)
    kind = F.when(F.bool_and(F.col("relation").isin("keep", "identical")), "identical").when(F.bool_or(plain), "copies").otherwise("similar")
    keys = names.group_key(F.collect_list("path"))
    return rows.groupBy("grp").agg(keys.alias("key"), kind.alias("kind"), F.coalesce(F.sum(F.when(plain, F.col("size"))), F.lit(0)).alias("reclaim"), F.count(F.lit(1)).alias("n"))


def report_order() -> list[Column]:
    """Sets of copies before look-alikes, those that free most first."""
    return [F.when(F.col("kind") == "similar", 1).otherwise(0).asc(), F.col("reclaim").desc(), F.col("key").asc()]


def gathered(members: DataFrame, closeness: DataFrame) -> DataFrame:
    """(path, grp): copies of equal content that are split over sets move to the set that is closest to them.

    members: grp, path, content (size and digest; null: unknown). closeness: grp, content, percent of the set's other files
    to the copies in it; a set of nothing but these copies counts as 100, ties go to the smaller set. A set that is left
    with one file goes.
    """
    whole = members.groupBy("grp").agg(F.count(F.lit(1)).alias("_all"))
    held = members.where("content is not null").groupBy("content", "grp").agg(F.count(F.lit(1)).alias("_n")).join(whole, "grp")
    held = held.join(closeness.groupBy("grp", "content").agg(F.max("percent").alias("percent")), ["grp", "content"], "left")
    held = held.withColumn("percent", F.when(F.col("_n") == F.col("_all"), 100.0).otherwise(F.coalesce("percent", F.lit(0.0))))
    target = held.groupBy("content").agg(F.max(F.struct("percent", (-F.col("grp")).alias("back"))).alias("best"), F.count(F.lit(1)).alias("_sets")).where("_sets > 1")
    moved = members.join(target.select("content", (-F.col("best.back")).alias("_to")), "content", "left").select("path", F.coalesce("_to", "grp").alias("grp"))
    # the count of a set is combined before the shuffle, so a large set is not gathered
    return moved.join(moved.groupBy("grp").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("grp"), "grp", "left_semi").select("path", "grp")


def may_clean(rows: DataFrame) -> DataFrame:
    """The sets with ``barred_by``: why automatic cleaning may not take a set (null: it may).

    rows: grp, kind, image, any_synced. Sets of copies only; of videos only identical ones; nothing synced.
    """
    why = F.when(F.col("kind") == "similar", "look-alikes").when(~F.col("image") & (F.col("kind") != "identical"), "video copies").when(F.col("any_synced"), "synced")
    return rows.withColumn("barred_by", why)


def dry_run(rows: DataFrame, checked: Column) -> DataFrame:
    """Per set: how many members would go and stay, what that frees, and whether none would stay."""
    out = rows.groupBy("grp").agg(F.count_if(checked).alias("removed"), F.count_if(~checked).alias("kept"), F.coalesce(F.sum(F.when(checked, F.col("size"))), F.lit(0)).alias("freed"))
    return out.where("removed > 0").withColumn("all_go", F.col("kept") == 0)


#: Relations of other versions, and how alike in percent what stays with a kept file is.
OTHER_VERSIONS, ALIKE = ["burst", "language", "soundtrack"], 75.0
def lined_up(related: DataFrame, pictures: DataFrame) -> DataFrame:
    """related (i_path, k_path, i_image, k_image, relation, percent) with lines_up: do the kept picture and the other line up.

    Only photos that are alike enough to stay but no plain copies are asked; all others, and those whose pixels are not there or too
    even, have null. pictures: path, pixels (row by row), width, each path once; a pair fetches its pixels, nothing else moves.
    """
    asked = F.col("i_image") & F.col("k_image") & (F.col("percent") >= ALIKE) & ~F.col("relation").isin(*PLAIN, *OTHER_VERSIONS, "different")
    keys = related.where(F.coalesce(asked, F.lit(False))).select(F.col("i_path").alias("_i"), F.col("k_path").alias("_k")).distinct()
    for x in "ik":
        keys = keys.join(pictures.select(F.col("path").alias(f"_{x}"), F.col("pixels").alias(f"_{x}_pixels"), F.col("width").alias(f"_{x}_width")), f"_{x}")
    told = written(keys.select("_i", "_k", aligned.look(F.col("_k_pixels"), F.col("_k_width"), F.col("_i_pixels"), F.col("_i_width"))["lines_up"].alias("lines_up")), "looks")
    return related.drop("lines_up").join(told, (F.col("i_path") == F.col("_i")) & (F.col("k_path") == F.col("_k")), "left").drop("_i", "_k")


_SET = "grp", "_open"


def _beside_keeper(rest: DataFrame, relate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows with ``_keep``, whether they are the one that their set's open rows keep, and what ``relate`` says of them beside that one."""
    mine = [c for c in rest.columns if c not in STATE]
    out = rest.withColumn("_photos", F.min_by("image", F.struct(F.lower("path"), "path")).over(Window.partitionBy(*_SET)))
    out = photo_keepers(out, _SET).withColumnRenamed("keep", "_photo").drop("reason")
    out = video_keepers(out, _SET)
    out = out.withColumn("_keep", F.col("_open") & F.when(F.col("_photos"), F.col("_photo")).otherwise(F.col("keep")))
    out = out.withColumn("_kept", F.first(F.when(F.col("_keep"), F.struct(*mine)), ignorenulls=True).over(Window.partitionBy(*_SET)))
    related = relate(out.select(*STATE, "_keep", *[F.col(c).alias(f"i_{c}") for c in mine], *[F.col("_kept")[c].alias(f"k_{c}") for c in mine]))
    told = [c for c in ("relation", "percent", "lines_up") if c in related.columns]
    return related.select(*STATE, "_keep", *[F.col(f"i_{c}").alias(c) for c in mine], F.col("k__shown"), *told)


#: Of a row in rounds: is it open still, the number of its part (null: none), is it the kept one of its part.
STATE = "_open _part _head".split()


def _worked_off(rows: DataFrame, relate: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame, Column], DataFrame]) -> DataFrame:
    """(grp, path, _part, _head) of rows (with _open) when none is open any more.

    judge: from rows beside their kept ones and a round's number the same rows with their new state. What a round asks of
    a set are windows over one dealing by set, and the kept row reaches the others in one of them, so a round shuffles the
    open rows once and writes them once. Two rounds over one dealing cost more, as closed rows go through the second.
    """
    state = rows.withColumns({"_part": F.lit(None).cast("int"), "_head": F.lit(False)} | ({} if "_shown" in rows.columns else {"_shown": F.lit(False)}))
    mine, done, number = [c for c in state.columns if c not in (*STATE, "grp", "path")], [], 0
    while True:
        number += 1
        state = judge(_beside_keeper(state.repartition("grp"), relate), F.lit(number)).select("grp", "path", *mine, *STATE)
        # a row alone in its set has nothing to be beside
        state = state.withColumn("_open", F.col("_open") & (F.count(F.lit(1)).over(Window.partitionBy(*_SET)) > 1))
        held = written(state.select("grp", "path", *STATE, *[F.when(F.col("_open"), F.col(c)).alias(c) for c in mine]), "rounds")
        done.append(held.where("not _open").select("grp", "path", "_part", "_head"))
        state = held.where("_open")
        if state.isEmpty():
            return reduce(DataFrame.unionByName, done)


def split_by_picture(rows: DataFrame, relate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(grp, path, part): a set that holds two sets of copies or more becomes one for each, and what copies nothing goes; others stay whole (part 0).

    relate: from rows of i_ and k_ columns (a member, the kept one) the same rows with relation; the kept one stands beside itself
    too, and what is said of that counts for nothing. All sets are worked off at once, in rounds: a round keeps one file a set and
    takes its copies out, so there are as many rounds as pictures in the set of most, and a row meets one other row a round. Paths
    are unique within a set.
    """

    def judge(beside: DataFrame, number: Column) -> DataFrame:
        taken = F.col("_open") & (F.col("_keep") | F.coalesce(F.col("relation").isin(PLAIN), F.lit(False)))
        return beside.withColumns({"_head": F.col("_head") | F.col("_keep"), "_part": F.when(taken, number).otherwise(F.col("_part")), "_open": F.col("_open") & ~taken})

    whole = Window.partitionBy("grp")
    parts = _worked_off(rows.withColumn("_open", F.count(F.lit(1)).over(whole) >= 4), relate, judge).repartition("grp")
    parts = parts.withColumn("_n", F.when(F.col("_part").isNotNull(), F.count(F.lit(1)).over(Window.partitionBy("grp", "_part"))))
    parts = parts.withColumn("_k", F.count_if(F.col("_head") & (F.col("_n") > 1)).over(whole)).where("_k < 2 or _n > 1")
    return parts.select("grp", "path", F.when(F.col("_k") < 2, 0).otherwise(F.col("_part")).alias("part"))


def leave_out(rows: DataFrame, relate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(grp, path, part): what stays with each kept file, as sets of two or more, in the order found.

    Copies, edits and look-alikes from 75 percent on stay; other versions (by relation, or of one series as another shot that
    stays) leave, and so do look-alikes of what a set has shown another version of. What is left is judged again around its own
    kept file. rows: ``ITEM`` with series and shot (null series: none). relate adds relation, percent and lines_up (null: not
    asked). Rounds as in ``split_by_picture``; the order within a set is by windows.
    """
    plain, same, other = F.col("relation").isin(PLAIN), F.col("relation") == "identical", F.col("relation").isin(OTHER_VERSIONS)

    def judge(beside: DataFrame, number: Column) -> DataFrame:
        alike = (F.col("relation") != "different") & F.coalesce(F.col("percent") >= ALIKE, F.lit(False)) & (plain | ~(F.col("k__shown") | F.col("_shown"))) & F.coalesce("lines_up", F.lit(True))
        # the kept row is not among those that are put in order
        others = "grp", "_open", "_keep"
        place = F.row_number().over(Window.partitionBy(*others).orderBy(same.desc(), plain.desc(), F.col("percent").desc(), "path"))
        judged = beside.withColumns({"_same": same, "_other": other & ~same, "_may": ~same & ~other & alike, "_place": place})
        # within a series the identical ones come first; after them the shot of the first that stays
        series = Window.partitionBy(*others, "series")
        before = series.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
        shot = F.when(F.col("_same") | F.col("_may"), F.col("shot"))
        own = F.when(F.col("_same"), F.col("shot"))
        judged = judged.withColumns({"_first": F.first(shot, ignorenulls=True).over(before), "_low": F.min(own).over(series), "_high": F.max(own).over(series)})
        sibling = F.coalesce(F.col("series").isNotNull() & ((F.col("_first") != F.col("shot")) | (F.col("_first").isNotNull() & (F.col("_low") != F.col("_high")))), F.lit(False))
        yes = lambda c: F.coalesce(c, F.lit(False))
        judged = judged.withColumns({"_stays": F.col("_open") & (F.col("_keep") | yes(F.col("_same") | (F.col("_may") & ~sibling))), "_version": ~F.col("_keep") & yes(~F.col("_same") & (F.col("_other") | sibling))})
        judged = judged.withColumn("_set", F.count_if("_stays").over(Window.partitionBy(*_SET)) > 1)
        return judged.withColumns({
            "_part": F.when(F.col("_stays") & F.col("_set"), number).otherwise(F.col("_part")), "_open": F.col("_open") & ~F.col("_stays"),
            "_shown": F.col("_shown") | (F.col("_version") & F.col("_set")),
        })

    found = _worked_off(rows.withColumn("_open", F.count(F.lit(1)).over(Window.partitionBy("grp")) > 1).where("_open"), relate, judge)
    return found.where("_part is not null").select("grp", "path", F.col("_part").alias("part"))


def pair_walk(decisions: DataFrame, count: str) -> DataFrame:
    """Per step of a walk through a set's files: left, right, check, keep (-1: neither) and finished.

    decisions: grp, step (from 1, one for each pair), decision (left, right, other: none) and the number of files in ``count``.
    The first file begins on the left; a challenger that wins stays there.
    """
    before = Window.partitionBy("grp").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    left = F.coalesce(F.max(F.when(F.col("decision") == "right", F.col("step"))).over(before), F.lit(0))
    out = decisions.where(F.col("step") < F.col(count)).withColumns({"left": left.cast("int"), "right": F.col("step").cast("int")})
    side = lambda a, b: F.when(F.col("decision") == "left", F.col(a)).when(F.col("decision") == "right", F.col(b)).otherwise(-1)
    return out.withColumns({"check": side("right", "left"), "keep": side("left", "right"), "finished": F.col("step") + 1 >= F.col(count)})
