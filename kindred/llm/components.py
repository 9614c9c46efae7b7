"""Connected components of verified links, by hooking on the smallest neighbour and pointer jumping.

All state is in written tables, no key is gathered in one task: aggregates are combined before the
shuffle, and each join meets fresh exchanges, which adaptive execution can split on a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _relabel(df: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """``column`` replaced by its root where it has one."""
    to = roots.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
    return df.join(to, df[column] == to["_id"], "left").withColumn(column, F.coalesce("_root", column)).drop("_id", "_root")


def jumped(roots: DataFrame) -> DataFrame:
    """Pointers (id, root) followed to their ends; they go to smaller ids, so there are no cycles."""
    last = None
    while True:
        ends = roots.select(F.col("id").alias("_id"), F.col("root").alias("_next"))
        new = roots.join(ends, roots["root"] == ends["_id"], "left").select("id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        new = written(new, "pointers")
        if last is not None:
            forget(last)
        if new.where("moved").isEmpty():
            return new
        last, roots = new, new.select("id", "root")


def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(id, root) of every id that is not its own root, after the links (a, b) between ids are added.

    ``roots`` has the pointers so far (None: none yet); it is used up, its table goes. The root is the smallest id of a component.
    """
    last = None
    while True:
        if roots is not None:
            links = _relabel(_relabel(links.select("a", "b"), "a", roots), "b", roots)
        links = written(links.where("a != b").select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("to")).distinct(), "links")
        if last is not None:
            forget(last)
        hooks = links.groupBy("id").agg(F.min("to").alias("root"))
        if links.isEmpty():
            return roots if roots is not None else written(hooks, "roots")
        pointers = jumped(hooks)
        fresh, old = pointers.select("id", "root"), roots
        roots = written(fresh if old is None else _relabel(old, "root", fresh).unionByName(fresh), "roots")
        forget(pointers, *([] if old is None else [old]))
        last, links = links, links.select(F.col("id").alias("a"), F.col("to").alias("b"))
