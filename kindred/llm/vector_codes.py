"""Product codes of vectors in exact integers: float32 products screen, int64 distances decide.

Each component x counts as floor(scale * x). Vectors are cut into ``parts`` equal parts; each part position has a
codebook of at most ``entries`` integer entries, moved in ``rounds`` to the floored means of the parts they are nearest
to. The nearest entry e of a part v is the least of |e|**2 - 2 v.e, which one float32 matrix product of (v, 1) with
(-2 e, |e|**2) gives for all entries. Whatever the order of its sums, each value is off by at most
``gamma * (2 |v| |e| + |e|**2)`` with gamma = k u / (1 - k u), u = 2**-24 and k the terms and roundings of one value. Every
entry whose interval reaches the best one's is evaluated again in int64, so the choice is exact, ties to the lower index.

A codebook has a fixed size, so it is sent with the tasks; a round brings the driver one row for each entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components beyond this are refused: squared distances of up to 2048 of them stay below 2**63.
LARGEST = 1 << 25
_U = 2.0**-24


def integers(column: pa.Array | pa.ChunkedArray, scale: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector is there and finite, and their integer vectors, filled up with zeros to ``width``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.where(np.asarray(column.is_valid()), np.asarray(column.value_lengths().fill_null(0)), 0).astype(np.int64)
    flat = column.flatten()
    x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan) if flat.null_count else flat.cast(pa.float64()), float)
    row = np.repeat(np.arange(len(column)), size)
    kept = np.asarray(column.is_valid()).copy()
    kept[row[~np.isfinite(x)]] = False
    place = np.full(len(column), -1)
    place[kept] = np.arange(kept.sum())
    own = kept[row]
    whole = np.floor(scale * x[own])
    if len(whole) and np.abs(whole).max() > LARGEST:
        raise ValueError(f"a component beyond {LARGEST} after scaling: squared distances would leave 64 bits")
    out = np.zeros((int(kept.sum()), width), np.int64)
    out[place[row[own]], (np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size))[own]] = whole
    return np.flatnonzero(kept), out


def screened(v: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Entries (parts x entries, boolean) whose interval of |e|**2 - 2 v.e reaches the interval of the best."""
    norm = (entries**2).sum(1)
    # the last column holds |e|**2; its conversion, those of v and e, and every product and sum round once each
    k = v.shape[1] + 6
    gamma = k * _U / (1 - k * _U)
    left = np.concatenate([v, np.ones((len(v), 1), np.int64)], 1).astype(np.float32)
    right = np.concatenate([-2 * entries, norm[:, None]], 1).astype(np.float32)
    value = left @ right.T
    most = float(norm.max(initial=0))
    length = np.sqrt((v.astype(float) ** 2).sum(1))
    off = gamma * (2 * length * most**0.5 + most) * (1 + 1e-9)
    reach = np.nextafter((value.min(1).astype(float) + 2 * off).astype(np.float32), np.float32(np.inf))
    return value <= np.nextafter(reach, np.float32(np.inf))[:, None]


def nearest(v: np.ndarray, entries: np.ndarray, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """For each integer part the nearest entry, of equally near ones the first, and its exact squared distance."""
    best, error = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
    # of equal entries only the first can be chosen
    first = np.sort(np.unique(entries, axis=0, return_index=True)[1])
    own = entries[first]
    step = max(1, most // max(1, len(own)))
    for lo in range(0, len(v), step):
        part = v[lo : lo + step]
        row, entry = np.nonzero(screened(part, own))
        d = ((part[row] - own[entry]) ** 2).sum(1)
        starts = np.searchsorted(row, np.arange(len(part)))
        least = np.minimum.reduceat(d, starts)
        hit = np.flatnonzero(d == least[row])
        best[lo + row[hit[::-1]]] = first[entry[hit[::-1]]]  # backwards, so the first of them is written last
        error[lo : lo + step] = least
    return best, error


class VectorCodes:
    """Codebooks from all vectors and a code for each; see the module's text.

    Rows whose vector is null or holds null or non-finite components are dropped. Vectors of other lengths than the
    longest, or of a length that ``parts`` does not divide, count as filled up with zeros; an empty vector is all zeros. Rows
    without a vec_id are coded and count in the means, but start no entry; of rows that share a vec_id all count, in order of
    their vectors. With fewer vectors than entries there are fewer entries, without any no rows. Components
    beyond 2**25 after scaling raise ValueError. Equal labels, nulls together, are summed by slices of the
    rows, so one label's rows are dealt over ``slices`` tasks. Columns of the results' names give way to them.
    """

    def __init__(self, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, slices: int = 64):
        if not 1 <= entries <= 256:
            raise ValueError("entries: 1 to 256, as a code has two digits a part")
        self.parts, self.entries, self.rounds, self.scale, self.slices = parts, entries, rounds, scale, slices
        self.codebooks: np.ndarray | None = None

    def _start(self, rows: DataFrame) -> np.ndarray:
        """parts x entries x width of a part."""
        finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
        usable = rows.where(F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
        longest = usable.agg(F.max(F.size("embedding"))).first()[0]
        if longest is None:
            return np.zeros((self.parts, 0, 1), np.int64)
        width = max(1, -(-longest // self.parts)) * self.parts
        first = usable.where("vec_id is not null").orderBy("vec_id", "embedding").limit(self.entries).select("embedding").toArrow()["embedding"]
        v = integers(first, self.scale, width)[1]
        return v.reshape(len(v), self.parts, width // self.parts).transpose(1, 0, 2).copy()

    def fit(self, rows: DataFrame) -> VectorCodes:
        books = self._start(rows)
        parts, n, w = books.shape
        schema = "part int, entry int, n long, " + ", ".join(f"s{i} long" for i in range(w))
        for _ in range(self.rounds if n else 0):

            def sums(batches: Iterator[pa.RecordBatch], books: np.ndarray = books, scale: int = self.scale) -> Iterator[pa.RecordBatch]:
                count, total = np.zeros((parts, n), np.int64), np.zeros((parts, n, w), np.int64)
                for batch in batches:
                    v = integers(batch.column(0), scale, parts * w)[1].reshape(-1, parts, w)
                    for p in range(parts):
                        best = nearest(v[:, p], books[p])[0]
                        count[p] += np.bincount(best, minlength=n)
                        np.add.at(total[p], best, v[:, p])
                p, e = np.nonzero(count)
                columns = [p.astype(np.int32), e.astype(np.int32), count[p, e], *total[p, e].T]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "entry", "n", *(f"s{i}" for i in range(w))])

            found = rows.select("embedding").mapInArrow(sums, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(w)]).toPandas()
            books = books.copy()
            books[found["part"], found["entry"]] = found[[f"s{i}" for i in range(w)]].to_numpy(np.int64) // found["n"].to_numpy(np.int64)[:, None]
        self.codebooks = books
        return self

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()

    def coded(self, rows: DataFrame) -> DataFrame:
        """vec_id, label, code, error of the rows that are not dropped."""
        books, scale = self.codebooks, self.scale
        parts, n, w = books.shape
        if not n:
            return rows.where(F.lit(False)).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, v = integers(batch.column(2), scale, parts * w)
                v = v.reshape(-1, parts, w)
                found = [nearest(v[:, p], books[p]) for p in range(parts)] if len(v) else []
                codes = np.stack([b for b, _ in found], 1).astype(np.uint8) if found else np.zeros((0, parts), np.uint8)
                error = sum((e for _, e in found), np.zeros(len(v), np.int64))
                code = [c.tobytes().hex() for c in codes]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

        kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        return rows.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long")

    def errors(self, coded: DataFrame) -> DataFrame:
        """coded with label_error, the sum of error over the rows of the same label."""
        sliced = coded.withColumn("_slice", F.pmod(F.xxhash64("vec_id", "code"), F.lit(self.slices)).cast("int"))
        by_slice = sliced.groupBy("label", "_slice").agg(F.sum("error").alias("n"))
        total = by_slice.groupBy("label").agg(F.sum("n").alias("label_error"), F.collect_list("_slice").alias("slices"))
        total = total.select(F.col("label").alias("_l"), "label_error", F.explode("slices").alias("_s"))
        return sliced.join(total, sliced["label"].eqNullSafe(total["_l"]) & (sliced["_slice"] == total["_s"])).select(*coded.columns, "label_error")
