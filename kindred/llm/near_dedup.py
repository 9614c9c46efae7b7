"""MinHash near-duplicate detection with tensored banding, every link verified on full shingle sets.

Two collections of ``bands`` short keys, of ``rows`` minhashes each, are computed per text. A table key
is a pair of them, one from either collection, so ``2 * bands * rows`` minhashes serve ``bands ** 2``
tables of ``2 * rows`` minhashes. With 8 and 3, a pair of similarity 0.85 shares a table with
probability (1 - (1 - 0.85 ** 3) ** 8) ** 2 = 0.999, and one of 0.9 with 0.99994.

Steps, each a Spark job over written tables, which go as soon as what was made of them is written:
1. one row per text: set size, 128-bit digest of the set, the 16 short keys, a byte of each minhash
   (numpy over Arrow batches);
2. texts with equal sets are one class, which its smallest doc_id stands for;
3. short keys held by one class are dropped, so only table keys of two shared short keys are formed. Each table
   key held by two classes or more has a leader, its smallest id; (member, leader) are candidates. Those whose
   minhashes agree in too few places are left out (``least_agreeing``: a true pair is lost with probability
   1e-6). The texts of all classes with a shared table key are written once, and each class is tested with its
   smallest leader; then components are formed, and the other candidates are tested where they would
   still join two components;
4. the members of a key some of which are in another component than its leader are dealt into cells by set
   size, by whether they are in the leader's component, and by a hash. Cells whose sizes allow a link meet two
   at a time: a task counts in how many minhashes all their pairs agree, without a row for a pair. Only members that
   agree enough with some other go on, with their texts, to a task that counts the common shingles of
   all pairs of two cells at once and returns a forest of links. So every pair that shares a key is tested or in
   one component already. A pair counts in the first key that it shares.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import forget, written
from .components import merged

#: What a cell holds: shingles and members, about.
ROOM, HEADS = 600_000, 2048


def least_agreeing(n: int, percent: int, risk: float = 1e-6) -> int:
    """In how many of ``n`` minhashes a pair agrees at least: one of similarity percent / 100 in fewer with probability ``risk`` at most."""
    s, below = percent / 100, 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * s**k * (1 - s) ** (n - k)
        if below > risk:
            return k
    return n


def _bytes(column: pa.Array) -> np.ndarray:
    """Binary values of one length as a matrix of bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if not len(column):
        return np.zeros((0, 1), np.uint8)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1)


def _agreeing(mins: np.ndarray, left: np.ndarray, right: np.ndarray, least: int) -> np.ndarray:
    """Which rows of ``mins`` (left x right) agree in ``least`` places."""
    if len(left) * len(right) < 4096:
        return (mins[left][:, None] == mins[right][None]).sum(2) >= least
    agree = np.zeros((len(left), len(right)), np.uint8 if mins.shape[1] < 256 else np.uint16)
    for h in range(mins.shape[1]):
        agree += mins[left, h][:, None] == mins[right, h][None]
    return agree >= least


def links(left: list[np.ndarray], right: list[np.ndarray], apart: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets (left x right, where ``apart``) are alike enough, by products of incidence matrices."""
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    values, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    place = place.ravel()
    cut = int(sizes[0].sum())
    rows = [np.repeat(np.arange(len(n)), n) for n in sizes]
    both = np.flatnonzero(np.bincount(place[:cut], minlength=len(values)).astype(bool) & np.bincount(place[cut:], minlength=len(values)).astype(bool))
    column = np.full(len(values), -1)
    column[both] = np.arange(len(both))
    common = np.zeros((len(left), len(right)), np.float32)
    at = [column[place[:cut]], column[place[cut:]]]
    for lo in range(0, len(both), 2048):
        part = []
        for side in range(2):
            own = (at[side] >= lo) & (at[side] < lo + 2048)
            m = np.zeros((len(sizes[side]), min(2048, len(both) - lo)), np.float32)
            m[rows[side][own], at[side][own] - lo] = 1
            part.append(m)
        common += part[0] @ part[1].T
    return apart & (100 * common >= percent * (sizes[0][:, None] + sizes[1][None] - common)) & (common > 0)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Of the edges, those that join two trees."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    kept: tuple[list[int], list[int]] = ([], [])
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if top(x) != top(y):
            up[top(x)] = top(y)
            kept[0].append(x)
            kept[1].append(y)
    return kept


class NearDedup:
    """Near-duplicate classes of a documents table (doc_id, text; other columns are ignored).

    Words are runs of bytes other than space and \\x09-\\x0D, A-Z lower-cased; a set has the distinct
    ``k``-word shingles, with fewer words the whole sequence as one. Null, empty and blank texts have an
    empty set and link with nothing, nor do rows without a doc_id (component_id null, kept true). Rows that
    share a doc_id count as one document for links. An empty table gives an empty result.
    """

    def __init__(self, k: int = 5, percent: int = 85, bands: int = 8, rows: int = 3):
        self.k, self.percent, self.bands, self.rows = k, percent, bands, rows

    def sketches(self, docs: DataFrame) -> DataFrame:
        """doc_id, row_hash (of the text), n_shingles, set digest s0 and s1, short keys a and b, mins (a byte of each minhash)."""
        k, bands, rows = self.k, self.bands, self.rows
        factors = np.random.default_rng(20240517).integers(1 << 62, dtype=np.uint64, size=(2, 2 * bands * rows)) * np.uint64(2) + np.uint64(1)

        def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = ta.flat(batch.column(2))
                sizes, digests, keys, bytes_ = [], [], [], []
                for lo, hi in ta.slices(offsets):
                    sets, first = ta.shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
                    size = np.diff(first)
                    full = np.flatnonzero(size)
                    digest, key, mins = np.zeros((2, hi - lo), np.uint64), np.zeros((2 * bands, hi - lo), np.uint64), np.zeros((hi - lo, 2 * bands * rows), np.uint8)
                    if len(full):
                        ends = np.append(first[:-1][full], len(sets))
                        for i in range(2):
                            digest[i, full] = np.add.reduceat(ta.mix(sets ^ factors[i, 0]), ends[:-1])
                        for j in range(2 * bands):
                            total = np.zeros(len(full), np.uint64)
                            for i in range(j * rows, j * rows + rows):
                                least = ta.segment_min((sets ^ factors[0, i]) * factors[1, i], ends)
                                mins[full, i] = ta.mix(least) >> np.uint64(56)
                                total = ta.mix(total + least)
                            key[j, full] = total
                    sizes.append(size)
                    digests.append(digest)
                    keys.append(key)
                    bytes_.append(mins)
                if not sizes:
                    continue
                digest, key = np.concatenate(digests, 1).view(np.int64), np.concatenate(keys, 1).view(np.int64)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x.T).ravel()), bands).cast(pa.list_(pa.int64())) for x in (key[:bands], key[bands:])]
                mins = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * bands * rows), batch.num_rows, [None, pa.py_buffer(np.concatenate(bytes_).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(np.concatenate(sizes).astype(np.int64)), pa.array(digest[0]), pa.array(digest[1]), *lists, mins],
                    names=["doc_id", "row_hash", "n_shingles", "s0", "s1", "a", "b", "mins"],
                )

        rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("row_hash"), F.col("text").cast("string").alias("text"))
        return rows_in.mapInArrow(sketch, "doc_id long, row_hash long, n_shingles long, s0 long, s1 long, a array<long>, b array<long>, mins binary")

    def _members(self, classes: DataFrame) -> DataFrame:
        """(id, leader, key, slot, holders) of each table key that several classes hold; slot is its number among the tables."""
        bands = self.bands
        short = classes.select("id", F.posexplode(F.concat("a", "b")).alias("slot", "value")).select("id", "slot", F.xxhash64("slot", "value").alias("short"))
        held = short.groupBy("short").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo != hi").select("short")
        mine = short.join(held, "short", "left_semi").groupBy("id").agg(F.collect_list(F.struct("slot", "short")).alias("own"))  # 2 * bands at most
        left, right = F.filter("own", lambda x: x["slot"] < bands), F.filter("own", lambda x: x["slot"] >= bands)
        pairs = F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.struct((x["slot"] * bands + y["slot"] - bands).alias("slot"), F.xxhash64(x["short"], y["short"]).alias("key")))))
        keys = written(mine.select("id", F.explode(pairs).alias("at")).select("id", "at.slot", "at.key"), "keys")
        leaders = keys.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("_last"), F.count(F.lit(1)).alias("n")).where("leader != _last")
        members = written(keys.join(leaders, "key").select("id", "leader", "key", "slot", F.col("n").alias("holders")), "members")
        forget(keys)
        return members

    def _promising(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """The pairs (a, b) whose set sizes and minhashes allow a link."""
        percent, least = self.percent, least_agreeing(2 * self.bands * self.rows, self.percent)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = (_bytes(batch.column(i)) for i in (2, 3))
                keep = pa.array((x == y).sum(1) >= least) if batch.num_rows else pa.array([], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

        x, y = (classes.select(F.col("id").alias(f"_{side}"), F.col("n").alias(f"n_{side}"), F.col("mins").alias(f"mins_{side}")) for side in "ab")
        met = pairs.join(x, F.col("a") == F.col("_a")).join(y, F.col("b") == F.col("_b"))
        met = met.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        return met.select("a", "b", "mins_a", "mins_b").mapInArrow(judge, "a long, b long")

    def verified(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The pairs (a, b) of doc_ids whose full sets are alike enough."""
        k, percent = self.k, self.percent

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sides = [ta.flat(batch.column(2)), ta.flat(batch.column(3))]
                keep = np.zeros(batch.num_rows, bool)
                for lo, hi in ta.slices(sides[0][1] + sides[1][1]):
                    (x, x0), (y, y0) = (ta.shingle_sets(d[o[lo] : o[hi]], o[lo : hi + 1] - o[lo], k) for d, o in sides)
                    for i in range(hi - lo):
                        u, v = x[x0[i] : x0[i + 1]], y[y0[i] : y0[i + 1]]
                        if 100 * min(len(u), len(v)) < percent * max(len(u), len(v)) or not len(u):
                            continue
                        both = np.concatenate([u, v])
                        both.sort()
                        same = int((both[1:] == both[:-1]).sum())
                        keep[lo + i] = 100 * same >= percent * (len(both) - same)
                keep = pa.array(keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

        half = pairs.join(texts.withColumnRenamed("text", "x"), F.col("a") == F.col("_id")).select("a", "b", "x")
        return half.join(texts.withColumnRenamed("text", "y"), F.col("b") == F.col("_id")).select("a", "b", "x", "y").mapInArrow(judge, "a long, b long")

    def _crossing(self, pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """The pairs that are in two components."""
        ra, rb = (roots.select(F.col("id").alias(f"_{x}"), F.col("root").alias(f"_r{x}")) for x in "ab")
        joined = pairs.join(ra, F.col("a") == F.col("_a"), "left").join(rb, F.col("b") == F.col("_b"), "left")
        return joined.where(F.coalesce("_ra", "a") != F.coalesce("_rb", "b")).select(*pairs.columns)

    def _texts(self, ids: DataFrame, docs: DataFrame) -> DataFrame:
        """_id, text of the documents with these ids, equal rows once."""
        texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).where("_id is not null and text is not null")
        return texts.join(ids.select("id"), texts["_id"] == ids["id"], "left_semi").distinct()

    def _settled(self, roots: DataFrame, classes: DataFrame, open_keys: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
        """Step 4: each pair of members of the ``open_keys`` (key, leader) is tested or in one component."""
        k, percent, bands, least = self.k, self.percent, self.bands, least_agreeing(2 * self.bands * self.rows, self.percent)
        to = roots.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
        chiefs = open_keys.join(to, F.col("leader") == F.col("_id"), "left").select(F.col("key").alias("_key"), F.coalesce("_root", "leader").alias("chief"))
        band = F.floor(F.log("n") / float(np.log(100 / percent) * (1 + 1e-9)))
        own = classes.select(F.col("id").alias("_own"), "n", "a", "b", "mins")
        root = F.coalesce("_root", "id")
        members = members.join(chiefs, F.col("key") == F.col("_key")).join(to, F.col("id") == F.col("_id"), "left").join(own, F.col("id") == F.col("_own"))
        members = written(members.select("key", "slot", "id", "n", "a", "b", "mins", root.alias("root"), (2 * band + (root == F.col("chief")).cast("int")).cast("long").alias("sort")), "open-members")
        # the number of cells of each sort (set size and side), a few dozen for a key at most
        cells = F.greatest(F.ceil(F.sum("n") / ROOM), F.ceil(F.count(F.lit(1)) / HEADS))
        sizes = written(members.groupBy("key", "sort").agg(cells.alias("cells"), F.count(F.lit(1)).alias("members")), "open-sizes")
        cells = sizes.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("sort", "cells"))).alias("plan"))
        cell = F.pmod(F.xxhash64("id", F.lit(3)), F.col("plan")[F.col("sort")]) + F.col("sort") * (1 << 32)

        def cells_of(near: int, side: int) -> Column:
            other = (F.floor(F.col("sort") / 2) + near) * 2 + side
            count = F.when((F.lit(side) == 0) | (F.col("sort") % 2 == 0), F.coalesce(F.col("plan")[other], F.lit(0))).otherwise(0)
            every = F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda j: j + other * (1 << 32))
            return F.when(count > 0, every).otherwise(F.array().cast("array<bigint>"))

        met = [cells_of(near, side) for near in (-1, 0, 1) for side in (0, 1)]
        dealt = members.join(cells, "key").withColumn("cell", cell).withColumn("other", F.explode(F.flatten(F.array(*met))))
        dealt = dealt.select("key", F.least("cell", "other").alias("lo"), F.greatest("cell", "other").alias("hi"), "slot", "id", "root", "cell", "n", "a", "b", "mins")

        def sift(rows: pa.Table) -> pa.Table:
            key, low, high, cell, root, n, slot = (np.asarray(rows[c]) for c in ("key", "lo", "hi", "cell", "root", "n", "slot"))
            mins = _bytes(rows["mins"])
            keys = [np.asarray(rows[c].combine_chunks().flatten()).reshape(-1, bands) for c in "ab"]
            order = np.lexsort((high, low, key))
            new = np.flatnonzero(np.append(True, (np.diff(key[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)))
            go = np.zeros(len(cell), bool)
            for group in np.split(order, new[1:]):
                left, right = group[cell[group] == low[group[0]]], group[cell[group] == high[group[0]]]
                for at in range(0, len(left), 512):
                    part = left[at : at + 512]
                    x, y = np.nonzero(_agreeing(mins, part, right, least))
                    x, y = part[x], right[y]
                    ok = (root[x] != root[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
                    x, y = x[ok], y[ok]
                    first = [(side[x] == side[y]).argmax(1) for side in keys]
                    here = first[0] * bands + first[1] == slot[group[0]]
                    go[x[here]] = go[y[here]] = True
            return rows.filter(pa.array(go)).select(["key", "lo", "hi", "id", "root", "cell"])

        # a task takes many small groups at once; a member is dealt to each cell that it meets
        rows = sizes.join(cells, "key").agg(F.sum(F.col("members") * F.size(F.flatten(F.array(*met))))).first()[0] or 0
        bucket = F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(1 + rows // HEADS))
        live = written(dealt.groupBy(bucket.alias("bucket")).applyInArrow(sift, "key long, lo long, hi long, id long, root long, cell long"), "open-live")
        forget(members, sizes)
        if live.isEmpty():
            return roots

        def judge(key: tuple, rows: pa.Table) -> pa.Table:
            cell, ids, root = (np.asarray(rows[c]) for c in ("cell", "id", "root"))
            data, offsets = ta.flat(rows["text"])
            sets: list[np.ndarray] = []
            for lo, hi in ta.slices(offsets):
                found, first = ta.shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
                sets += np.split(found, first[1:-1])
            sides = [np.flatnonzero(cell == key[i].as_py()) for i in (1, 2)]
            left, right = ([sets[i] for i in side] for side in sides)
            if not left or not right:
                return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
            x, y = np.nonzero(links(left, right, root[sides[0]][:, None] != root[sides[1]][None], percent))
            a, b = forest(ids[sides[0]][x], ids[sides[1]][y])
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        found = live.join(texts, F.col("id") == F.col("_id")).select("key", "lo", "hi", "id", "root", "cell", "text")
        found = written(found.groupBy("key", "lo", "hi").applyInArrow(judge, "a long, b long"), "open-links")
        forget(live)
        roots = merged(roots, found)
        forget(found)
        return roots

    def _components(self, docs: DataFrame) -> DataFrame:
        sketches = written(self.sketches(docs), "sketches")
        linked = sketches.where("n_shingles > 0 and doc_id is not null")
        classes = written(linked.groupBy("s0", "s1").agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("a", "b", "mins")], F.first("n_shingles").alias("n")), "classes")
        members = self._members(classes)
        texts = written(self._texts(members.select("id").distinct(), docs), "texts")
        pairs = written(self._promising(members.where("id != leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct(), classes), "candidates")
        first = pairs.groupBy("a").agg(F.min("b").alias("b"))
        found = written(self.verified(first, texts), "verified")
        roots = merged(None, found)
        rest = written(self._crossing(pairs.join(first.withColumnRenamed("b", "_done"), "a").where("b != _done").select("a", "b"), roots), "rest")
        forget(found, pairs)
        if not rest.isEmpty():
            found = written(self.verified(rest, texts), "verified-rest")
            roots = merged(roots, found)
            forget(found)
        forget(rest)
        # a key of two holders has no pair but (member, leader)
        open_keys = written(self._crossing(members.where("id != leader and holders > 2").select(F.col("id").alias("a"), F.col("leader").alias("b"), "key"), roots).groupBy("key").agg(F.min("b").alias("leader")), "open")
        if not open_keys.isEmpty():
            roots = self._settled(roots, classes, open_keys, members, texts)
        forget(open_keys, members, texts)
        to = roots.select(F.col("id").alias("_id"), "root")
        component = written(classes.join(to, F.col("id") == F.col("_id"), "left").select("s0", "s1", F.coalesce("root", "id").alias("component")), "class-components")
        forget(classes, roots)
        own = (sketches["s0"] == component["s0"]) & (sketches["s1"] == component["s1"]) & (sketches["n_shingles"] > 0)
        found_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
        return sketches.join(component, own, "left").select("doc_id", "row_hash", "n_shingles", found_id.alias("component_id"), F.coalesce(found_id == F.col("doc_id"), F.lit(True)).alias("kept"))

    def components(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_shingles, component_id, kept: a row per row of ``docs``."""
        return self._components(docs).drop("row_hash")

    def kept(self, docs: DataFrame) -> DataFrame:
        """The documents less the near duplicates, all columns.

        Rows without a doc_id stay. Rows that share a doc_id but not the text stay or go by their own text's
        component; of rows equal in both one stays.
        """
        out = self._components(docs).where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_row")).agg(F.count(F.lit(1)).alias("_n"))
        out = written(out, "survivors")
        same = (docs["doc_id"].cast("long") == out["_id"]) & (F.xxhash64(docs["text"].cast("string")) == out["_row"])
        repeated = out.where("_n > 1")
        if repeated.isEmpty():
            found = docs.join(out, same, "left_semi")
        else:
            twice = docs.join(repeated, same).dropDuplicates(["_id", "_row"]).select(docs.columns)
            found = docs.join(out.where("_n = 1"), same, "left_semi").unionByName(twice)
        return found.unionByName(docs.where("doc_id is null"))
