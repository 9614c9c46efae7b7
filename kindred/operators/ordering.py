"""Places in a global order: every row gets its number, without one task that sorts all and without a limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.kept import written

_INDEX_BITS = 33


def placed(rows: DataFrame, order: list[Column], name: str = "place", parts: int | None = None) -> DataFrame:
    """The rows with ``name``: 1 for the first in the order, and so on. Rows that the order does not tell apart follow each other in any order.

    Rows are dealt by ranges of the order and sorted within each; numbering within a range costs nothing then. The table is written
    once, as the ranges are cut by a sample; then the ranges' sizes, one row for each, say where each of them begins. Columns
    named like the result or with a leading ``_place`` give way. The order's own columns must not be equal for very many
    rows, as these share a range: end it with a column that tells rows apart.
    """
    parts = parts or max(2, rows.sparkSession.sparkContext.defaultParallelism)
    own = rows.select(*[c for c in rows.columns if c != name and not c.startswith("_place")])
    ranged = own.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    held = written(ranged.withColumn("_place_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_place_at", _INDEX_BITS)
    sizes = held.groupBy(part.alias("_place_part")).agg(F.count(F.lit(1)).alias("_place_n"))
    # one row for each range here, so this window is small whatever the table holds
    before = F.sum("_place_n").over(Window.orderBy("_place_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_place_part", F.coalesce(before, F.lit(0)).alias("_place_before"))
    out = held.join(F.broadcast(starts) if parts <= 100_000 else starts, part == F.col("_place_part"))
    place = F.col("_place_before") + F.col("_place_at").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1)) + 1
    return out.select(*own.columns, place.alias(name))


def beside(rows: DataFrame, group: str, order: list[Column], columns: list[str]) -> DataFrame:
    """The rows with ``before_<c>`` of each of ``columns``: the values of the row before them in their group, null for its first.

    Groups stand one after the other in one global order, and a row meets the next place's row, so a group that holds most of
    the rows is dealt over many tasks. ``before_there`` tells a first row from one after a null.
    """
    held = placed(rows, [F.asc(group), *order], "_at")
    last = held.select((F.col("_at") + 1).alias("_next"), F.col(group).alias("_group"), *[F.col(c).alias(f"before_{c}") for c in columns], F.lit(True).alias("before_there"))
    met = held.join(last, (F.col("_at") == F.col("_next")) & F.col(group).eqNullSafe(F.col("_group")), "left")
    return met.select(*rows.columns, *[f"before_{c}" for c in columns], F.coalesce("before_there", F.lit(False)).alias("before_there"))
