"""Which member of a group to keep: criteria in order with near ties, strategies, flags of the best, series."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.kept import written

#: How far apart neighbours of a series and the ends of a burst may be, for numbers and for times in milliseconds.
STEP, SPAN = (5, 60_000), (20, 300_000)


@dataclass(frozen=True)
class Criterion:
    """A column to rank by; values within ``near`` (absolute) or ``share`` (of the best) of the best tie with it."""

    name: str
    value: Column
    ascending: bool = False
    near: float = 0.0
    share: float = 0.0


def keeper(rows: DataFrame, group: str, key: str, criteria: list[Criterion]) -> DataFrame:
    """The rows with ``keep`` and, per group, the ``reason``: the last criterion that narrowed the choice.

    Windows share one partitioning, so the whole ladder takes one shuffle.
    """
    w = Window.partitionBy(group)
    out = rows.withColumns({"_in": F.lit(True), "reason": F.lit(None).cast("string")})
    for i, c in enumerate(criteria):
        v = F.when(F.col("_in"), c.value.cast("double"))
        out = out.withColumn("_best", (F.min(v) if c.ascending else F.max(v)).over(w))
        slack = F.greatest(F.lit(c.near), F.abs("_best") * c.share)
        near = F.coalesce((c.value <= F.col("_best") + slack) if c.ascending else (c.value >= F.col("_best") - slack), F.lit(False))
        out = out.withColumn("_next", F.col("_in") & (near | F.col("_best").isNull()))
        narrowed = F.sum(F.col("_next").cast("int")).over(w) < F.sum(F.col("_in").cast("int")).over(w)
        out = out.withColumn("reason", F.when(narrowed, c.name).otherwise(F.col("reason"))).withColumn("_in", F.col("_next"))
    first = F.min(F.when(F.col("_in"), F.col(key))).over(w)
    return out.withColumn("keep", F.col(key) == first).drop("_in", "_next", "_best")


def strategy(rows: DataFrame, group: str, key: str, order: list[Column]) -> DataFrame:
    """keep: the first row of each group in this order, ties by key."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order, key))
    return rows.withColumn("keep", rank == 1)


def best_flags(rows: DataFrame, group: str, most: list[str], least: list[str]) -> DataFrame:
    """is_best_x for each column: does the row have the group's best value; all that tie have it."""
    w = Window.partitionBy(group)
    flags = {f"is_best_{c}": F.col(c) == F.max(c).over(w) for c in most} | {f"is_best_{c}": F.col(c) == F.min(c).over(w) for c in least}
    return rows.withColumns(flags)


def first_k(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def sessions(rows: DataFrame, partition: str, order: list[str], starts: Column) -> DataFrame:
    """A running number of the session of each row; ``starts`` marks the rows that begin one."""
    w = Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("session", F.sum(starts.cast("int")).over(w))


def burst_neighbours(rows: DataFrame, series: list[str], number: str, gap: Column | float) -> DataFrame:
    """in_series: is a row's number at most ``gap`` from the next smaller or larger one in its series; equal numbers are one shot."""
    w, same = Window.partitionBy(*series).orderBy(number), Window.partitionBy(*series, number)
    gap = gap if isinstance(gap, Column) else F.lit(gap)
    before, after = F.lag(number).over(w), F.lead(number).over(w)
    out = rows.withColumns({"_before": F.when(before != F.col(number), before), "_after": F.when(after != F.col(number), after)})
    near = lambda other: F.coalesce(F.abs(F.col(number) - other) <= gap, F.lit(False))
    out = out.withColumn("in_series", near(F.min("_before").over(same)) | near(F.max("_after").over(same)))
    return out.drop("_before", "_after")


def burst_pairs(rows: DataFrame, key: str, folder: str, series: str, number: str, timed: str) -> DataFrame:
    """(a_key, b_key): shots of one series with different numbers close together, one of which at least is in a series of its folder.

    Neighbours are 5 apart at most and a burst spans 20, or 60 and 300 seconds for names that are times (milliseconds).
    """
    step, span = F.when(F.col(timed), STEP[1]).otherwise(STEP[0]), F.when(F.col("a_timed"), SPAN[1]).otherwise(SPAN[0])
    own = burst_neighbours(rows.where(F.col(number).isNotNull()), [folder, series], number, step)
    cell = F.floor(F.col(number) / F.when(F.col(timed), SPAN[1]).otherwise(SPAN[0]))
    sides = [own.select(*[F.col(c).alias(f"{s}_{n}") for c, n in ((key, "key"), (series, "series"), (number, "number"), (timed, "timed"), ("in_series", "in"))], cell.alias(f"{s}_cell")) for s in "ab"]
    b = sides[1].withColumn("cell", F.explode(F.array(*[F.col("b_cell") + d for d in (-1, 0, 1)])))
    met = sides[0].join(b, (F.col("a_series") == F.col("b_series")) & (F.col("a_timed") == F.col("b_timed")) & (F.col("a_cell") == F.col("cell")))
    gap = F.abs(F.col("a_number") - F.col("b_number"))
    return met.where((F.col("a_key") < F.col("b_key")) & (gap > 0) & (gap <= span) & (F.col("a_in") | F.col("b_in"))).select("a_key", "b_key")


def _later(key: np.ndarray, series: np.ndarray, number: np.ndarray, inside: np.ndarray, span: np.ndarray, block: int = 512) -> np.ndarray:
    """Per row: the rows of larger keys (key: their ranks, ascending) that make a pair of ``burst_pairs`` with it.

    Later blocks are counted by running totals over the places of (series, number); only within a block rows meet each other.
    """
    order = np.lexsort((number, series))
    s, n = series[order], number[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (n[1:] != n[:-1])])
    place = np.empty(len(key), int)
    place[order] = np.cumsum(new) - 1
    s, n, reach = s[new], n[new], span[order][new]
    lo, hi = np.empty(len(s), int), np.empty(len(s), int)
    for at in np.split(np.arange(len(s)), np.flatnonzero(np.diff(s)) + 1):
        lo[at] = at[0] + np.searchsorted(n[at], n[at] - reach[at], "left")
        hi[at] = at[0] + np.searchsorted(n[at], n[at] + reach[at], "right")
    cuts = np.unique(np.concatenate([[0], np.searchsorted(key, key[::block], "left"), [len(key)]]))  # equal keys stay in one block
    totals, out = np.zeros((2, len(s)), np.int64), np.zeros(len(key), np.int64)
    for start, end in zip(cuts[-2::-1], cuts[:0:-1], strict=True):
        own, p = np.arange(start, end), place[start:end]
        before = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(totals, axis=1)], axis=1)
        found = before[:, hi[p]] - before[:, lo[p]] - totals[:, p]
        out[own] = np.where(inside[own], found[0], found[1])
        for i in range(0, len(own), block):
            a = own[i : i + block]
            near = (place[own] >= lo[place[a], None]) & (place[own] < hi[place[a], None]) & (place[own] != place[a, None])
            out[a] += (near & (key[own] > key[a, None]) & (inside[a, None] | inside[own])).sum(1)
        totals[0] += np.bincount(p, minlength=len(s))
        totals[1] += np.bincount(p[inside[own]], minlength=len(s))
    return out


def burst_counts(rows: DataFrame, key: str, folder: str, series: str, number: str, timed: str, room: int = 100_000) -> DataFrame:
    """(folder, pairs): how many of ``burst_pairs`` have their smaller key in a folder, without making the pairs. Numbers are whole.

    Rows are dealt by ranges of the key and counted against the others of their range. Ranges meet as the halves of a
    tree do: at each level rows of the lower half are counted against those of the upper one by (series, number), so the work grows as the rows times the
    logarithm of the ranges. Numbers are cut into stretches, so a series of most rows is dealt over tasks.
    """
    step = F.when(F.col(timed), STEP[1]).otherwise(STEP[0])
    kept = rows.where(F.col(number).isNotNull() & F.col(folder).isNotNull() & F.col(series).isNotNull() & F.col(timed).isNotNull() & F.col(key).isNotNull())
    seen = burst_neighbours(kept.select(folder, series, timed, number).distinct(), [folder, series], number, step)
    own = kept.select(F.col(key).alias("key"), F.col(folder).alias("folder"), F.col(series).alias("series"), F.col(timed).alias("timed"), F.col(number).cast("long").alias("number"))
    seen = seen.select(F.col(folder).alias("folder"), F.col(series).alias("series"), F.col(timed).alias("timed"), F.col(number).cast("long").alias("number"), F.col("in_series").alias("inside"))
    own = written(own.join(seen, ["folder", "series", "timed", "number"]), "shots")
    ranges = max(1, -(-own.count() // room))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by("key").combine_chunks()
        code = lambda c: np.asarray(c.combine_chunks().dictionary_encode().indices) if t.num_rows else np.zeros(0, int)
        timed_ = np.asarray(t["timed"])
        key_ = code(t["key"])  # in the order of the rows, so ascending
        group = code(t["series"]).astype(np.int64) * 2 + timed_
        later = _later(key_, group, np.asarray(t["number"]), np.asarray(t["inside"]), np.where(timed_, SPAN[1], SPAN[0]))
        at = pa.array(np.full(t.num_rows, TaskContext.get().partitionId()), pa.int64())
        yield from t.drop(["key"]).append_column("at", at).append_column("later", pa.array(later)).to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    placed = own.repartitionByRange(ranges, "key").mapInArrow(count, ", ".join(f"{c} {kinds[c]}" for c in ("folder", "series", "timed", "number", "inside")) + ", at long, later long")
    # written once, as the ranges are cut by a sample
    sums = written(placed.groupBy("folder", "series", "timed", "number", "inside", "at").agg(F.count(F.lit(1)).alias("n"), F.sum("later").alias("later")), "ranges")
    out = sums.groupBy("folder").agg(F.sum("later").alias("pairs"))
    if ranges > 1:
        levels = F.sequence(F.lit(0), F.lit((ranges - 1).bit_length() - 1))
        span = F.when(F.col("timed"), SPAN[1]).otherwise(SPAN[0])
        stretch = lambda d: F.floor((F.col("number") + d * span) / (8 * span)).cast("long")
        half = sums.withColumn("level", F.explode(levels)).withColumns({"node": F.floor(F.col("at") / F.pow(F.lit(2.0), F.col("level") + 1)).cast("long"), "upper": F.floor(F.col("at") / F.pow(F.lit(2.0), F.col("level"))).cast("long") % 2 == 1})
        where = ["series", "timed", "level", "node", "stretch"]
        asked = half.where("not upper").groupBy("folder", "series", "timed", "number", "inside", "level", "node").agg(F.sum("n").alias("n")).withColumn("stretch", stretch(0))
        told = half.where("upper").groupBy("series", "timed", "number", "level", "node").agg(F.sum("n").alias("every"), F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("some"))
        told = told.withColumn("stretch", F.explode(F.array_distinct(F.array(stretch(-1), stretch(0), stretch(1)))))
        none = F.lit(0).cast("long")
        places = asked.select(*where, "number", none.alias("every"), none.alias("some")).unionByName(told.select(*where, "number", "every", "some"))
        places = places.groupBy(*where, "number").agg(F.sum("every").alias("every"), F.sum("some").alias("some"))
        w = Window.partitionBy(*where).orderBy("number")
        near = lambda c: F.when(F.col("timed"), F.sum(c).over(w.rangeBetween(-SPAN[1], SPAN[1]))).otherwise(F.sum(c).over(w.rangeBetween(-SPAN[0], SPAN[0]))) - F.col(c)
        met = asked.join(places.select(*where, "number", near("every").alias("all_near"), near("some").alias("some_near")), [*where, "number"])
        crossed = met.groupBy("folder").agg(F.sum(F.col("n") * F.when(F.col("inside"), F.col("all_near")).otherwise(F.col("some_near"))).alias("pairs"))
        out = out.unionByName(crossed).groupBy("folder").agg(F.sum("pairs").alias("pairs"))
    return out.where("pairs > 0")


def fir(rows: DataFrame, partition: str, order: list[str], value: str, taps: list[float]) -> DataFrame:
    """Weighted sum of a row's value and those before it; null until enough rows are there."""
    w = Window.partitionBy(partition).orderBy(*order)
    total = sum((F.lag(value, len(taps) - 1 - i).over(w) * t for i, t in enumerate(taps)), F.lit(0.0))
    return rows.withColumn("filtered", total)
