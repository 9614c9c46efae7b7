"""Aggregates over groups, folders, drives, types and weeks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import names
from kindred.operators.kept import written


def group_headers(rows: DataFrame, group: str, size: str, same: list[str], any_of: dict[str, Column]) -> DataFrame:
    """Per group: count, total, what all but the largest take, whether all values of a column are equal, whether any row is so."""
    out = [F.count(F.lit(1)).alias("n"), F.sum(size).alias("total"), (F.sum(size) - F.max(size)).alias("wasted")]
    # a missing value is a value too: beside another one it is not the same
    out += [(F.min(c).eqNullSafe(F.max(c)) & F.count(c).isin(0, F.count(F.lit(1)))).alias(f"same_{c}") for c in same]
    return rows.groupBy(group).agg(*out, *[F.bool_or(c).alias(k) for k, c in any_of.items()])


def group_statistics(rows: DataFrame, group: str) -> DataFrame:
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("items"), F.max("n").alias("largest"), F.count_if(F.col("n") > 5).alias("over_5"), F.count_if(F.col("n") > 10).alias("over_10"))


def subtree_sizes(rows: DataFrame, path: str, size: str) -> DataFrame:
    """Files and bytes of every folder with all below it. Folders are summed first, so few rows meet their ancestors."""
    own = rows.groupBy(names.parent(F.col(path)).alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"))
    every = own.select(F.explode(F.array_append(names.ancestors(F.col("folder")), F.col("folder"))).alias("folder"), "files", "bytes")
    return every.groupBy("folder").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


def top_and_rest(rows: DataFrame, kind: str, size: str, k: int) -> DataFrame:
    """The k largest kinds and one row for all others."""
    sums = rows.groupBy(F.col(kind).alias("kind")).agg(F.sum(size).alias("bytes"))
    top = sums.orderBy(F.desc("bytes"), "kind").limit(k)
    rest = sums.join(top.select("kind"), "kind", "left_anti").agg(F.sum("bytes").alias("bytes")).where("bytes is not null").select(F.lit("(rest)").alias("kind"), "bytes")
    return top.unionByName(rest)


def hot_spots(rows: DataFrame, folder: str, group: str, size: str, k: int) -> DataFrame:
    sums = rows.groupBy(folder).agg(F.count_distinct(group).alias("sets"), F.sum(size).alias("bytes"))
    return sums.orderBy(F.desc("bytes"), folder).limit(k)


def majority_bits(rows: DataFrame, key: list[str], code: str, bits: int) -> DataFrame:
    """Bit by bit, what more than half of a key's codes have."""
    on = [F.count_if(F.shiftright(code, i).bitwiseAND(F.lit(1).cast("long")) == 1).alias(f"_{i}") for i in range(bits)]
    sums = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *on)
    value = reduce(Column.bitwiseOR, [F.when(F.col(f"_{i}") * 2 > F.col("_n"), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(bits)])
    return sums.select(*key, value.alias("code"))


def odd_ones(rows: DataFrame, group: str, value: str) -> DataFrame:
    """odd: the row's value is not the group's majority value; with a tie of the most frequent all are odd.

    A missing value counts as a value. All windows share the partitioning by group, so there is one shuffle.
    """
    w = Window.partitionBy(group)
    out = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(group, value))).withColumn("_most", F.max("_n").over(w))
    top = F.when(F.col("_n") == F.col("_most"), F.struct(F.col(value)))
    tied = F.min(top).over(w) != F.max(top).over(w)
    return out.withColumn("odd", (F.col("_n") < F.col("_most")) | tied).drop("_n", "_most")


def weekly(rows: DataFrame, at: str, kind: str, kinds: list[str], size: str, weeks: int) -> DataFrame:
    """Sums by week and kind for the last weeks up to the newest one; weeks without rows have zeros."""
    summed = rows.groupBy(F.date_trunc("week", at).cast("date").alias("week")).pivot(kind, kinds).agg(F.sum(size))
    last = rows.agg(F.date_trunc("week", F.max(at)).cast("date").alias("last"))
    every = last.select(F.explode(F.sequence(F.date_sub("last", 7 * (weeks - 1)), "last", F.expr("interval 7 days"))).alias("week"))
    return every.join(summed, "week", "left").select("week", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])


def collapsed(rows: DataFrame, session: str, message: str, order: str) -> DataFrame:
    """Messages of a session that differ in numbers and quoted parts only, counted once, with the first of them."""
    keyed = rows.withColumn("message_key", names.message_key(F.col(message)))
    return keyed.groupBy(session, "message_key").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))


def log_groups(rows: DataFrame, session: str, severity: str, message: str, order: str) -> DataFrame:
    """(session, log_key, n, first): messages of one session and severity that differ in numbers and quoted parts only."""
    keyed = rows.withColumn("log_key", names.log_key(F.col(severity), F.col(message)))
    return keyed.groupBy(session, "log_key").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))


def _meetings(a: np.ndarray, na: np.ndarray, b: np.ndarray | None, nb: np.ndarray | None, most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of sets, some millions at a time: na of a in each set meet those after them in it, or with b its nb of b."""
    if b is None:
        other, start = a, np.arange(len(a)) + 1
        reach = np.repeat(np.cumsum(na), na) - start
    else:
        other, start, reach = b, np.repeat(np.cumsum(nb) - nb, na), np.repeat(nb, na)
    total, lo = np.cumsum(reach), 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        own = reach[lo:hi]
        j = np.arange(own.sum()) + np.repeat(start[lo:hi] - (np.cumsum(own) - own), own)
        yield np.repeat(a[lo:hi], own), other[j]
        lo = hi


def _tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each is there."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _counted(a: np.ndarray, na: np.ndarray, b: np.ndarray | None, nb: np.ndarray | None, sizes: tuple[int, int], kept: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], least: int, table: int = 1 << 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, n) of the pairs of ``_meetings`` for which kept(x, y, n) holds; it must hold for no n above 0 below one for which it does not.

    Without b, x < y. Counters are ``table`` at most: where more pairs are possible, several share one, which counts no less than each
    of them, and only pairs that it lets through are counted on their own.
    """
    wide = sizes[1]
    room = sizes[0] * wide
    dense = room <= table
    counts = np.zeros(room if dense else table, np.int32)
    slot = lambda k: k if dense else (k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - table.bit_length())).astype(np.int64)

    def keys() -> Iterator[np.ndarray]:
        for x, y in _meetings(a, na, b, nb):
            yield (np.minimum(x, y) if b is None else x).astype(np.int64) * wide + (np.maximum(x, y) if b is None else y)

    pairs = float(na @ (na - 1)) / 2 if b is None else float(na @ nb)
    if dense and len(na) * float(room) * 0.1 < pairs * 30:  # sets so full that a product of matrices is less work
        step = max(1, (1 << 23) // max(sizes))
        ends = [np.concatenate([[0], np.cumsum(n)]) for n in (na, na if nb is None else nb)]
        for lo in range(0, len(na), step):
            hi = min(lo + step, len(na))
            there = []
            for v, n, e, m in zip((a, b), (na, nb), ends, sizes, strict=True):
                if v is not None:
                    there.append(np.zeros((hi - lo, m), np.float32))
                    there[-1][np.repeat(np.arange(hi - lo), n[lo:hi]), v[e[lo] : e[hi]]] = 1
            counts += (there[0].T @ there[-1]).astype(np.int32).ravel()
        if b is None:
            counts = np.triu(counts.reshape(sizes), 1).ravel()
    else:
        for k in keys():
            at, n = _tallied(slot(k))
            counts[at] += n.astype(np.int32)
    if dense:
        found = np.flatnonzero(counts)
        n = counts[found].astype(np.int64)
    else:
        held, some = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        for k in keys():
            k = k[kept(k // wide, k % wide, counts[slot(k)])]
            held.append(_tallied(k))
            some += len(held[-1][0])
            if some > 1 << 23:
                held, some = [_summed(held)], 0
        found, n = _summed(held)
    x, y = found // wide, found % wide
    good = kept(x, y, n)
    return x[good], y[good], n[good]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    k, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(n, first) if len(k) else n


def _pairs_of_sets(t: pa.Table) -> pa.Table:
    """(a, b, n): in how many sets two folders stand, of rows g, lo, hi, me, folder that are sorted by g, lo, hi, me; the sets' chunks lo and hi meet."""
    keys = [np.asarray(c.combine_chunks().dictionary_encode().indices) for c in (t["g"], t["lo"], t["hi"])]
    me, lo, hi = (t[c].to_numpy() for c in ("me", "lo", "hi"))
    new = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
    which = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(me))))
    words = t["folder"].combine_chunks().dictionary_encode()
    order = np.asarray(pc.sort_indices(words.dictionary))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place, size = rank[np.asarray(words.indices)], (len(order),) * 2
    every, whole, first = (lambda x, y, n: n > 0), lo == hi, me == lo
    own = np.bincount(which[whole], minlength=len(new))
    found = [_counted(place[whole], own, None, None, size, every, 1)]
    sides = [(place[m], np.bincount(which[m], minlength=len(new))) for m in (~whole & first, ~whole & ~first)]
    x, y, n = _counted(*sides[0], *sides[1], size, every, 1)
    found.append((np.minimum(x, y), np.maximum(x, y), n))
    x, y, n = (np.concatenate(c) for c in zip(*found, strict=True))
    pairs, n = _summed([(x * len(order) + y, n)])
    take = lambda at: words.dictionary.take(pa.array(order[at]))
    return pa.table({"a": take(pairs // len(order)), "b": take(pairs % len(order)), "n": pa.array(n)})


#: What a block gets: sets of two parts, as numbers in bytes (which of ``words`` the sets' folders are, and how many each set has), and folders.
_BLOCK = "block int, a binary, na binary, b binary, nb binary, words binary, other_words binary, id long, last long, leaf boolean, alone boolean, folder string"
_HELD = pa.schema([("block", pa.int32()), *[(c, pa.binary()) for c in ("a", "na", "b", "nb", "words", "other_words")], ("id", pa.int64()), ("last", pa.int64()), ("leaf", pa.bool_()), ("alone", pa.bool_()), ("folder", pa.string())])


def _dealt(t: pa.Table, parts: int) -> pa.Table:
    """Rows g, id that are sorted by g, for each block of two parts of the folders (by id) the sets that have pairs there."""
    g = np.asarray(t["g"].combine_chunks().dictionary_encode().indices)
    which = np.concatenate([[0], np.cumsum(g[1:] != g[:-1])])
    ids = t["id"].to_numpy()
    part = (ids % parts).astype(np.int32)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    own = []
    for p in range(parts):
        rows = order[ends[p] : ends[p + 1]]
        words, at = np.unique(ids[rows], return_inverse=True)
        own.append((words, at.astype(np.uint16 if len(words) <= 1 << 16 else np.uint32), which[rows], np.bincount(which[rows], minlength=which[-1] + 1).astype(np.int32)))
    out: dict[str, list] = {c: [] for c in _HELD.names[:7]}
    block = 0
    for i in range(parts):
        for j in range(i, parts):
            (words, a, sa, na), (other, b, sb, nb) = own[i], own[j]
            there = (na > 1) if i == j else (na > 0) & (nb > 0)
            if there.any():
                sides = (a[there[sa]], na[there], b[there[sb]], nb[there]) if i != j else (a[there[sa]], na[there], None, None)
                for c, v in zip(_HELD.names, (block, *sides, words, None if i == j else other), strict=False):
                    out[c].append(v.tobytes() if isinstance(v, np.ndarray) else v)
            block += 1
    return pa.table({f.name: pa.array(out[f.name], f.type) if f.name in out else pa.nulls(len(out["block"]), f.type) for f in _HELD}, schema=_HELD)


def _counted_block(t: pa.Table, least: int) -> pa.Table:
    """(a, b, n, once) of a block's pairs; once: no other folders can come to this pair, and pairs that are so in less than ``least`` sets are left out."""
    folders = t.filter(pc.is_valid(t["id"])).sort_by("id")
    ids, last, leaf, alone = (folders[c].to_numpy() for c in ("id", "last", "leaf", "alone"))
    sets = t.filter(pc.is_valid(t["a"]))
    within = sets.num_rows > 0 and not sets["b"][0].is_valid
    sides, sizes, places = [], [], []
    for c, n, w in (("a", "na", "words"), ("b", "nb", "other_words")):
        if c == "b" and within:
            sides += [None, None]
            continue
        held = [(np.frombuffer(x, np.int64), np.frombuffer(n, np.int32), v) for x, n, v in zip(*(sets[k].to_pylist() for k in (w, n, c)), strict=True)]
        word = np.unique(np.concatenate([np.zeros(0, np.int64), *[x for x, _, _ in held]]))
        rows = [np.searchsorted(word, x).astype(np.int32)[np.frombuffer(v, np.uint16 if len(x) <= 1 << 16 else np.uint32)] for x, _, v in held]
        sides += [np.concatenate([np.zeros(0, np.int32), *rows]), np.concatenate([np.zeros(0, np.int64), *[n for _, n, _ in held]]).astype(np.int64)]
        sizes.append(len(word))
        places.append(np.searchsorted(ids, word))
    at = (places * 2)[:2]

    def once(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x, y = at[0][x], at[1][y]
        return ((last[x] != last[y]) & (leaf[x] | leaf[y])) | (alone[x] & alone[y])

    x, y, n = _counted(*sides, (sizes * 2)[:2], lambda x, y, n: (n >= least) | ~once(x, y), least)
    take = lambda i: folders["folder"].take(pa.array(i))
    return pa.table({"a": take(at[0][x]), "b": take(at[1][y]), "n": pa.array(n.astype(np.int64)), "once": pa.array(once(x, y))})


def folder_pairs(rows: DataFrame, group: str, folder: str, least: int, room: int = 1000) -> DataFrame:
    """Pairs of folders that hold copies of each other in ``least`` sets or more.

    Folders are dealt in parts, and a task has the sets of two parts, so it counts all of a pair's sets and only pairs that are in enough
    of them become rows, however many different pairs the sets hold; a set of very many folders is met by all tasks. About 16,000 x
    ``room`` of the rows (group, folder) are a part. Where different folders may come to one pair without their tails, all their pairs are
    rows, and where they do, its sets are counted once more by the sets themselves.
    """
    spark = rows.sparkSession
    named = rows.select(F.col(group).alias("g"), F.col(folder).alias("folder")).where("g is not null and folder is not null")
    total = named.count()
    # more parts than the rows ask for, so that there are enough tasks
    parts = max(8 if total > 100 * room else 1, -(-total // (16_000 * room)))
    blocks = [(i, j) for i in range(parts) for j in range(i, parts)]
    number = {b: k for k, b in enumerate(blocks)}
    words = F.split("folder", "/")
    listed = named.select("folder").distinct()
    stems = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, 1, k), "/"))
    below = listed.select("folder", F.posexplode(stems).alias("k", "stem"))
    below = below.groupBy("stem").agg(F.count(F.lit(1)).alias("of"), F.min("k").alias("k"), F.max("folder").alias("some"))
    # a stem of one folder: its own, or the first one of its way
    one = below.where("of = 1").groupBy(F.col("some").alias("folder")).agg(F.bool_or(F.col("k") == 0).alias("alone"))
    listed = written(listed.join(one, "folder", "left").select("folder", F.element_at(words, -1).alias("tail"), (F.col("alone").isNotNull() & (F.col("folder") != "")).alias("leaf"), F.coalesce("alone", F.lit(False)).alias("alone")), "folders")
    salt = 0
    numbered = lambda: F.xxhash64("folder", F.lit(salt)).bitwiseAND(F.lit((1 << 63) - 1))
    while not listed.groupBy(numbered().alias("id")).count().where("count > 1").isEmpty():
        salt += 1
    number_of = numbered()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 2000 * room:
                continue
            t = pa.Table.from_batches(held)
            n = t.num_rows - pc.sum(pc.equal(t["g"], t["g"][t.num_rows - 1])).as_py()  # the last set may go on
            held = t.slice(n).to_batches()
            if n:
                yield from _dealt(t.slice(0, n), parts).to_batches()
        if held:
            yield from _dealt(pa.Table.from_batches(held), parts).to_batches()

    own = named.distinct()
    sets = own.select("g", number_of.alias("id")).repartition("g").sortWithinPartitions("g").mapInArrow(deal, _BLOCK)
    meets = F.array(*[F.array(*[F.lit(number[min(p, q), max(p, q)]) for q in range(parts)]) for p in range(parts)])
    known = listed.select(number_of.alias("id"), F.xxhash64("tail").alias("last"), "leaf", "alone", "folder")
    known = known.select(F.explode(F.get(meets, F.pmod("id", F.lit(parts)).cast("int"))).alias("block"), *[F.lit(None).cast("binary").alias(c) for c in _HELD.names[1:7]], "id", "last", "leaf", "alone", "folder")
    # as many tasks as asked for: the rows are few bytes, their pairs are the work
    dealt = sets.unionByName(known).repartition(4 * len(blocks), "block")
    raw = written(dealt.groupBy("block").applyInArrow(lambda t: _counted_block(t, least), "a string, b string, n long, once boolean"), "pairs")
    raw = raw.withColumn("pair", names.folder_pair(F.col("a"), F.col("b")))
    once = raw.where("once").select("pair", F.col("n").alias("sets"))
    more = raw.where("not once")
    if more.isEmpty():
        return once
    both = F.struct("a", "b")
    sums = more.groupBy("pair").agg(F.sum("n").alias("sets"), (F.min(both) != F.max(both)).alias("several")).where(F.col("sets") >= least)
    sums = written(sums, "sums")
    once, several = once.unionByName(sums.where("not several").select("pair", "sets")), sums.where("several")
    if several.isEmpty():
        return once
    again = more.select("pair", "a", "b").join(several.select("pair"), "pair", "left_semi")
    met = again.join(own.withColumnRenamed("folder", "a"), "a").join(own.withColumnRenamed("folder", "b"), ["g", "b"])
    return once.unionByName(met.groupBy("pair").agg(F.count_distinct("g").alias("sets")).where(F.col("sets") >= least))


def all_in_any(groups: DataFrame, group: str, item: str, listed: DataFrame, listing: str) -> DataFrame:
    """Groups all of whose items stand in one list at least (relational division)."""
    size = groups.select(group, item).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    met = groups.select(group, item).distinct().join(listed.select(item, listing).distinct(), item).groupBy(group, listing).agg(F.count(F.lit(1)).alias("_met"))
    return met.join(size, group).where("_met = _size").select(group).distinct()
