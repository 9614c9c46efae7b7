"""Vectors from frames by a supplied model, the check of a model against a reference, and exact principal directions of all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: What colours are normalised by before a model sees them, and how many frames it gets at once.
MEAN, STD, BATCH = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225), 16


def embedder(load: Callable[[], Callable[[np.ndarray], np.ndarray]], channels: int = 3, batch: int = BATCH):
    """A column function: frames (arrays of 0-255, channel by channel) to unit vectors.

    ``load`` makes the model once for each Python worker: normalised frames (n x channels x places) to vectors (n x width). Frames
    come ``batch`` at a time. A vector of zeros stays one. Null frames must be left out before; all frames need one length.
    """
    mean, std = np.array(MEAN[:channels])[None, :, None], np.array(STD[:channels])[None, :, None]

    def make():
        model = load()

        def predict(frames: np.ndarray) -> np.ndarray:
            x = np.asarray(frames, float).reshape(len(frames), channels, -1) / 255.0  # in double precision, so equal sums stay equal
            out = np.asarray(model((x - mean) / std), float).reshape(len(frames), -1)
            size = np.sqrt((out**2).sum(1, keepdims=True))
            return (out / np.where(size > 0, size, 1)).astype(np.float32)

        return predict

    return make


def embedded(frames: DataFrame, frame: str, places: int, load: Callable[[], Callable[[np.ndarray], np.ndarray]], channels: int = 3, batch: int = BATCH) -> DataFrame:
    """The rows with ``vector``: the unit vector of each frame of ``places`` values; rows whose frame is null, short, or holds nulls go."""
    good = F.col(frame).isNotNull() & (F.size(frame) == places) & F.forall(frame, lambda x: x.isNotNull())
    run = predict_batch_udf(embedder(load, channels, batch), return_type=ArrayType(FloatType()), batch_size=batch, input_tensor_shapes=[[places]])
    return frames.where(good).withColumn("vector", run(F.col(frame).cast("array<float>")))


def embedding_check(got: DataFrame, reference: DataFrame, key: str, least: float) -> DataFrame:
    """One row: how many rows of the reference (key, vector) are there (n) and are not (missing), the least cosine with theirs, and whether all is well.

    Vectors need not be of unit length. All is well if none is missing and no cosine is below ``least``.
    """
    both = reference.select(F.col(key).alias("_key"), F.col("vector").alias("_want")).join(got.select(F.col(key), "vector"), F.col(key) == F.col("_key"), "left")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size: Callable[[str], Column] = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    cosine = F.when(size("vector") * size("_want") > 0, dot(F.col("vector"), F.col("_want")) / (size("vector") * size("_want"))).otherwise(0.0)
    out = both.agg(F.count("vector").alias("n"), F.count_if(F.col("vector").isNull()).alias("missing"), F.min(F.when(F.col("vector").isNotNull(), cosine)).alias("least_cosine"))
    return out.withColumn("good", (F.col("missing") == 0) & F.coalesce(F.col("least_cosine") >= least, F.lit(True)))


def moments(vectors: DataFrame, vector: str, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance of all vectors of ``width`` finite numbers; others are left out.

    Each task sums its vectors and their products, a matrix of width x width; rows of these are summed by Spark, so the driver gets
    one matrix whatever the number of rows or tasks. Products are taken around a vector of the data, which keeps their sums exact enough.
    """
    source = vectors.where(F.col(vector).isNotNull() & (F.size(vector) == width)).select(F.col(vector).cast("array<double>").alias("v"))
    first = source.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))).first()
    if first is None:
        return 0, np.zeros(width), np.zeros((width, width))
    around = np.array(first["v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((width + 1, width))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten().fill_null(np.nan), float).reshape(-1, width)
            x = x[np.isfinite(x).all(1)] - around
            n += len(x)
            total[0] += x.sum(0)
            total[1:] += x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(width + 1, n)), pa.array(np.arange(width + 1)), pa.array(list(total))], names=["n", "row", "sums"])

    parts = source.mapInArrow(run, "n long, row long, sums array<double>").select("n", "row", F.posexplode("sums").alias("col", "x"))
    found = parts.groupBy("row", "col").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).toPandas()
    n = int(found["n"].iloc[0])
    total = np.zeros((width + 1, width))
    total[found["row"], found["col"]] = found["x"]
    mean = total[0] / n
    return n, mean + around, total[1:] / n - np.outer(mean, mean)


def principal(vectors: DataFrame, vector: str, width: int, k: int, rounds: int = 200, tolerance: float = 1e-12) -> np.ndarray:
    """The k main directions (k x width, unit length) of all vectors: subspace iteration on their covariance.

    A direction's largest component is positive. Fewer rows than k give directions that nothing lies along; no rows give zeros.
    """
    n, _, covariance = moments(vectors, vector, width)
    if not n:
        return np.zeros((k, width))
    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(width, min(width, k + 8))))[0]
    before = np.zeros(basis.shape[1])
    for _ in range(rounds):
        basis = np.linalg.qr(covariance @ basis + 1e-300)[0]
        values, turn = np.linalg.eigh(basis.T @ covariance @ basis)
        basis, values = basis @ turn[:, ::-1], values[::-1]
        if np.abs(values - before).max() <= tolerance * max(values.max(), 1e-300):
            break
        before = values
    out = basis[:, :k].T
    return out * np.sign(out[np.arange(len(out)), np.abs(out).argmax(1)])[:, None]
