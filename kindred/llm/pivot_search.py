"""Exact top-k inner products through a pivot-distance index.

Pivots are spread over a bounded sample by farthest-first choice. Each vector is keyed by its nearest pivot and its
distance to it, cut into rings: annuli. The directory has, for each annulus, its count, its largest norm and the
least and largest distance of its vectors to every pivot; it has ``pivots * (rings + 1)`` rows at most whatever the
input. As 2 q.v = |q|**2 + |v|**2 - |q - v|**2, and by the triangle inequality |q - v| is at least the gap between the
distance of q to a pivot and the annulus's distances to it, an annulus bounds the inner product of all its vectors from above.

Each query sorts the annuli by their bounds and expands them in rounds: the first ones up to ``first`` vectors, then up to
a share of all, then the rest. A round meets only annuli whose bound reaches the query's k-th best score so far, which
tightens from round to round; the search stops where the bounds fall below it. Annuli are dealt into chunks of about
``chunk`` vectors and queries into batches, so a group in a task is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written
from .textarrays import mix


@dataclass
class Directory:
    pivots: np.ndarray
    near: np.ndarray  # annuli x pivots
    far: np.ndarray
    norm: np.ndarray  # largest, squared
    count: np.ndarray
    chunks: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product of each query with the vectors of each annulus, rounded up."""
        own = (queries**2).sum(1)
        d = distances(queries, self.pivots)
        out = np.empty((len(queries), len(self.count)))
        for i in range(len(queries)):
            gap = np.maximum(d[i] - self.far, self.near - d[i]).max(1)
            gap = np.maximum(gap - 1e-6 * (1 + np.sqrt(self.norm)), 0)
            out[i] = (own[i] + self.norm - gap**2) / 2
        return out * (1 + 1e-9) + 1e-3


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T, 0))


def farthest_first(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the vectors (fewer, if there are fewer different ones), each the farthest from those before."""
    chosen = [0]
    d = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < n and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def integers(rows: DataFrame, is_query: Column) -> DataFrame:
    """row (a number of its own), vec_id, v: floor(256 * x) of each component, asked; rows without an id or with a null or non-finite vector go."""
    x = F.transform("embedding", lambda c: F.floor(F.lit(256.0) * c.cast("double")))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    own = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    return own.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of lists as a matrix, shorter ones filled with 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, int)
    values = np.asarray(column.flatten(), np.int64)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


class PivotSearch:
    """``pivots`` of a bounded ``sample`` (the first vectors by hash) key all vectors; see the module's text.

    Vectors of different lengths count as filled up with zeros, an empty one is all zeros. Rows are told apart by a
    number that they are given once: every query row is asked, also where vec_ids repeat, and every row but the query's own is
    its candidate. Rows whose id or vector is null, or whose vector holds null or non-finite components, take
    no part; equal scores go to the smaller vec_id; a candidate row that comes twice counts twice. A table
    without usable vectors gives no rows; other columns are ignored. After ``search``, ``share`` is the
    part of all pairs of query and vector that was compared.
    """

    def __init__(self, k: int = 5, pivots: int = 64, rings: int = 8, chunk: int = 2048, batch: int = 4096, sample: int = 4096, first: int = 512):
        self.k, self.n_pivots, self.rings, self.chunk, self.batch, self.sample, self.first = k, pivots, rings, chunk, batch, sample, first
        self.share = 0.0

    def build(self, vectors: DataFrame) -> tuple[DataFrame, DataFrame, Directory, int] | None:
        """The keyed vectors as written, the index (row, vec_id, v, annulus, chunk), its directory and the vectors' length."""
        width = vectors.agg(F.max(F.size("v"))).first()[0]
        if width is None:
            return None
        width = max(1, width)
        sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(self.sample).select("v").toArrow()["v"]
        pivots = farthest_first(_matrix(sample, width).astype(float), self.n_pivots)
        within = distances(_matrix(sample, width).astype(float), pivots).min(1)
        # rings are cut at the quantiles of the sample; what is farther falls into the last one
        cuts = np.unique(np.quantile(within, np.linspace(0, 1, self.rings + 1)[1:-1]))
        rings = len(cuts) + 1

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = distances(_matrix(batch.column(2), width).astype(float), pivots)
                nearest = d.argmin(1)
                ring = np.searchsorted(cuts, d[np.arange(len(d)), nearest], "right")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((nearest * rings + ring).astype(np.int32))], names=["row", "vec_id", "v", "asked", "annulus"])

        keyed = written(vectors.mapInArrow(key, "row long, vec_id long, v array<long>, asked boolean, annulus int"), "keyed")

        def extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1), width).astype(float)
                d, norm = distances(x, pivots), (x**2).sum(1)
                annuli, at = np.unique(np.asarray(batch.column(0)), return_inverse=True)
                near, far, most = np.full((len(annuli), len(pivots)), np.inf), np.zeros((len(annuli), len(pivots))), np.zeros(len(annuli))
                np.minimum.at(near, at, d)
                np.maximum.at(far, at, d)
                np.maximum.at(most, at, norm)
                n = len(pivots)
                columns = [np.repeat(annuli, n), np.tile(np.arange(n, dtype=np.int32), len(annuli)), near.ravel(), far.ravel(), np.repeat(most, n), np.repeat(np.bincount(at, minlength=len(annuli)), n)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["annulus", "pivot", "near", "far", "norm", "n"])

        found = keyed.select("annulus", "v").mapInArrow(extent, "annulus int, pivot int, near double, far double, norm double, n long")
        found = found.groupBy("annulus", "pivot").agg(F.min("near").alias("near"), F.max("far").alias("far"), F.max("norm").alias("norm"), F.sum("n").alias("n")).toPandas().sort_values(["annulus", "pivot"])
        n = len(pivots)
        grid = lambda c: found[c].to_numpy().reshape(-1, n)
        annuli, counts = grid("annulus")[:, 0], grid("n")[:, 0].astype(np.int64)
        directory = Directory(pivots, grid("near"), grid("far"), grid("norm")[:, 0], counts, -(-counts // self.chunk))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.searchsorted(annuli, np.asarray(batch.column(3)))
                chunk = mix(np.asarray(batch.column(0)).astype(np.uint64)) % directory.chunks[at].astype(np.uint64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(at.astype(np.int32)), pa.array(chunk.astype(np.int32))], names=["row", "vec_id", "v", "annulus", "chunk"])

        index = keyed.select("row", "vec_id", "v", "annulus").mapInArrow(place, "row long, vec_id long, v array<long>, annulus int, chunk int")
        return keyed, index, directory, width

    def _asked(self, queries: DataFrame, directory: Directory, width: int, lo: int, hi: int | None) -> DataFrame:
        """A row for each query and chunk it has to meet in the round of the annuli from ``lo`` to ``hi`` vectors, in order of their bounds."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    bound = directory.bounds(_matrix(part.column(1), width).astype(float))
                    order = np.argsort(-bound, 1, kind="stable")
                    before = np.cumsum(directory.count[order], 1) - directory.count[order]
                    mine = (before >= lo) & (np.take_along_axis(bound, order, 1) >= np.asarray(part.column(3), float)[:, None])
                    if hi is not None:
                        mine &= before < hi
                    row, position = np.nonzero(mine)
                    annulus = order[row, position]
                    n = directory.chunks[annulus]
                    row, annulus, chunk = np.repeat(row, n), np.repeat(annulus, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    for at in range(0, len(row), 4096):
                        r = pa.array(row[at : at + 4096])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(annulus[at : at + 4096].astype(np.int32)), pa.array(chunk[at : at + 4096].astype(np.int32)), *(part.column(i).take(r) for i in (2, 0, 3))],
                            names=["annulus", "chunk", "batch", "query", "least"],
                        )

        return queries.select("query", "v", "batch", "least").mapInArrow(run, "annulus int, chunk int, batch int, query long, least double")

    def _met(self, asked: DataFrame, index: DataFrame, width: int) -> DataFrame:
        """query, vec_id, score: of each group the best k of each query, at least its ``least``."""
        k = self.k

        def judge(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            q, v = _matrix(left["v"], width), _matrix(right["v"], width)
            query, own, vec, least = (np.asarray(c) for c in (left["query"], right["row"], right["vec_id"], left["least"]))
            rows = []
            if len(q) and len(v):
                exact = float(np.abs(q).max()) * float(np.abs(v).max()) * width < 2**53
                score = (q.astype(float) @ v.astype(float).T).astype(np.int64) if exact else q @ v.T
                score_or_none = np.where(query[:, None] == own[None], np.iinfo(np.int64).min, score)
                order = np.argsort(vec, kind="stable")
                for i in range(len(query)):
                    s = score_or_none[i, order]
                    ok = np.flatnonzero((s > np.iinfo(np.int64).min) & (s >= least[i]))
                    best = ok[np.argsort(-s[ok], kind="stable")[:k]]
                    rows.append((np.full(len(best), query[i]), vec[order][best], s[best]))
            columns = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 3
            return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query", "vec_id", "score"), columns, strict=True)})

        vectors = index.join(asked.select(*[F.col(c).alias(c) for c in ("annulus", "chunk", "batch")]).distinct(), ["annulus", "chunk"])
        keys = ["annulus", "chunk", "batch"]
        return asked.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(judge, "query long, vec_id long, score long")

    def search(self, rows: DataFrame, is_query: Column) -> DataFrame:
        """query_id, rank, vec_id, score for the rows of (vec_id, embedding) where ``is_query`` holds, against all rows."""
        spark = rows.sparkSession
        empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        built = self.build(integers(rows, is_query))
        if not built:
            return empty
        keyed, index, directory, width = built
        own = written(keyed.where("asked").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "v"), "queries")
        n, total = own.count(), int(directory.count.sum())
        queries = own.withColumn("batch", F.pmod(F.xxhash64("query", F.lit(1)), F.lit(max(1, -(-n // self.batch)))).cast("int"))
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
        found, met = None, 0
        edges = [0, self.first, max(self.first, total // 8), None]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            known = queries.withColumn("least", F.lit(float("-inf")))
            if found is not None:
                kth = found.where(F.col("rank") == self.k).select(F.col("query").alias("_q"), F.col("score").cast("double").alias("least"))
                known = queries.join(kth, F.col("query") == F.col("_q"), "left").select("query", "v", "batch", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
            asked = written(self._asked(known, directory, width, lo, hi), "asked")
            counts = asked.groupBy("annulus").agg(F.count(F.lit(1)).alias("n")).collect()
            met += sum(int(directory.count[r["annulus"]] * r["n"] // directory.chunks[r["annulus"]]) for r in counts)
            if counts:
                new = self._met(asked.join(queries.select(F.col("query").alias("_q"), "v"), F.col("query") == F.col("_q")).drop("_q"), index, width)
                every = new if found is None else new.unionByName(found.drop("rank"))
                best = written(every.withColumn("rank", rank.cast("int")).where(F.col("rank") <= self.k), "best")
                forget(asked, *([] if found is None else [found]))
                found = best
        self.share = met / max(1, n * total)
        if found is None:
            return empty
        out = written(found.join(queries.select(F.col("query").alias("_q"), "query_id"), F.col("query") == F.col("_q")).select("query_id", "rank", "vec_id", "score"), "found")
        forget(found, own, keyed)
        return out
