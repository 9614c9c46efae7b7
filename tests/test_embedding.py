"""The embedder plug-in, the check of its vectors, and principal directions, against numpy on all rows."""

import numpy as np
import pytest

from kindred.operators import embedding


def projection():
    weights = np.random.default_rng(7).normal(size=(3 * 16, 5))

    def model(x):
        assert len(x) <= 16
        return x.reshape(len(x), -1) @ weights

    return model


def test_vectors_of_a_supplied_model(spark):
    rng = np.random.default_rng(1)
    frames = [rng.integers(0, 256, 48).tolist() for _ in range(70)]
    rows = [(i, f) for i, f in enumerate(frames)] + [(100, None), (101, [1, 2]), (102, [None] * 48)]
    frame = spark.createDataFrame(rows, "id int, frame array<int>")
    out = embedding.embedded(frame, "frame", 48, projection)
    got = {r.id: np.array(r.vector) for r in out.collect()}
    x = (np.array(frames).reshape(70, 3, 16) / 255 - np.array(embedding.MEAN)[:, None]) / np.array(embedding.STD)[:, None]
    want = x.reshape(70, -1) @ np.random.default_rng(7).normal(size=(48, 5))
    want /= np.linalg.norm(want, axis=1)[:, None]
    assert sorted(got) == list(range(70)) and np.allclose([got[i] for i in range(70)], want, atol=1e-5)
    reference = spark.createDataFrame([(i, (2 * want[i]).tolist()) for i in range(70)], "id int, vector array<double>")
    assert embedding.embedding_check(out, reference, "id", 0.999).first().good
    turned = spark.createDataFrame([(i, (want[i] if i else -want[i]).tolist()) for i in range(69)] + [(999, [1.0] * 5)], "id int, vector array<double>")
    told = embedding.embedding_check(out, turned, "id", 0.999).first()
    assert (told.n, told.missing, told.good) == (69, 1, False) and told.least_cosine == pytest.approx(-1, abs=1e-5)


def test_equal_components_stay_equal(spark):
    """Pairs of places with one sum, whose parts are rounded differently in single precision."""
    rng = np.random.default_rng(5)
    first = rng.integers(0, 120, (400, 8))
    moved = rng.integers(1, 100, (400, 4))
    second = first + np.concatenate([moved, -moved], axis=1)[:, rng.permutation(8)]
    rows = [(i, np.concatenate([a, b, [255] * 16]).tolist()) for i, (a, b) in enumerate(zip(first, second, strict=True)) if b.min() >= 0]

    def sums():
        return lambda x: x.reshape(len(x), 4, 8).sum(2)

    out = embedding.embedded(spark.createDataFrame(rows, "id int, frame array<int>"), "frame", 32, sums, channels=1)
    assert len(rows) > 10 and all(r.vector[0] == r.vector[1] and r.vector[2] == r.vector[3] for r in out.collect())


def test_principal_directions_of_all_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 6)) @ np.diag([9, 5, 3, 1, 0.5, 0.1]) @ np.linalg.qr(rng.normal(size=(6, 6)))[0] + 1e4
    rows = [(v.tolist(),) for v in x] + [(None,), ([1.0],), ([float("nan")] * 6,), ([None] * 6,)]
    frame = spark.createDataFrame(rows, "v array<double>").repartition(5)
    n, mean, covariance = embedding.moments(frame, "v", 6)
    assert n == 900 and np.allclose(mean, x.mean(0)) and np.allclose(covariance, np.cov(x.T, bias=True), rtol=1e-7, atol=1e-7)
    main = np.linalg.svd(x - x.mean(0))[2][:3]
    main *= np.sign(main[np.arange(3), np.abs(main).argmax(1)])[:, None]
    assert np.allclose(embedding.principal(frame, "v", 6, 3), main, atol=1e-5)
    assert (embedding.principal(frame.limit(0), "v", 6, 2) == 0).all()
