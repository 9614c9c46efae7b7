"""Quality classifier: a generalised additive model with pairwise interactions, as lookup tables.

Boosting goes round the features: each step fits a shallow tree (a few cuts of one binned feature) to
the current residuals and adds it to that feature's table. Then the pairs whose trees explain most of what is
left get two-dimensional tables the same way: each step fits a shallow tree that cuts rectangles of two binned
features. A score is a sum of table entries, one fancy index each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import docstats
from .common import crc_fold, labelled
from .trees import binned, edges_of


class Gam:
    def __init__(self, rounds: int = 120, pairs: int = 6, rate: float = 0.15, bins: int = 32, pair_bins: int = 12, cuts: int = 3, ridge: float = 4.0):
        self.rounds, self.pairs, self.rate, self.bins, self.pair_bins, self.cuts, self.ridge = rounds, pairs, rate, bins, pair_bins, cuts, ridge

    def _shallow(self, codes: np.ndarray, g: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
        """Leaf value for each bin of a tree with a few cuts, each the best of those left."""
        gb, hb = np.cumsum(np.bincount(codes, g, width)), np.cumsum(np.bincount(codes, h, width))
        ends = [0, width]
        at = lambda c, k: c[k - 1] if k else 0.0
        for _ in range(self.cuts):
            best, cut = 1e-9, None
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                if hi - lo < 2:
                    continue
                g0, h0 = at(gb, hi) - at(gb, lo), at(hb, hi) - at(hb, lo)
                gl, hl = gb[lo : hi - 1] - at(gb, lo), hb[lo : hi - 1] - at(hb, lo)
                gain = gl**2 / (hl + self.ridge) + (g0 - gl) ** 2 / (h0 - hl + self.ridge) - g0**2 / (h0 + self.ridge)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, cut = gain[k], lo + k + 1
            if cut is None:
                break
            ends = sorted([*ends, cut])
        out = np.zeros(width)
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            out[lo:hi] = -(at(gb, hi) - at(gb, lo)) / (at(hb, hi) - at(hb, lo) + self.ridge)
        return out

    def _shallow_pair(self, cells: np.ndarray, g: np.ndarray, h: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, float]:
        """Leaf value for each cell of a tree over two features, each cut the best of those left on either one; what it gains."""
        size = shape[0] * shape[1]
        gs, hs = (np.bincount(cells, v, size).reshape(shape) for v in (g, h))
        leaves, total = [(slice(0, shape[0]), slice(0, shape[1]))], 0.0
        for _ in range(self.cuts):
            best, found = 1e-9, None
            for n, (rows, columns) in enumerate(leaves):
                own_g, own_h = gs[rows, columns], hs[rows, columns]
                g0, h0 = own_g.sum(), own_h.sum()
                for axis in (0, 1):
                    gl, hl = (np.cumsum(m.sum(1 - axis))[:-1] for m in (own_g, own_h))
                    if not len(gl):
                        continue
                    gain = gl**2 / (hl + self.ridge) + (g0 - gl) ** 2 / (h0 - hl + self.ridge) - g0**2 / (h0 + self.ridge)
                    k = int(np.argmax(gain))
                    if gain[k] > best:
                        best, found = float(gain[k]), (n, axis, k + 1)
            if found is None:
                break
            n, axis, k = found
            rows, columns = leaves.pop(n)
            parts = [(slice(x.start, x.start + k), slice(x.start + k, x.stop)) for x in (rows, columns)]
            leaves += [(part, columns) for part in parts[0]] if axis == 0 else [(rows, part) for part in parts[1]]
            total += best
        out = np.zeros(shape)
        for leaf in leaves:
            out[leaf] = -gs[leaf].sum() / (hs[leaf].sum() + self.ridge)
        return out, total

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        self.edges, self.coarse = edges_of(x, self.bins), edges_of(x, self.pair_bins)
        codes, coarse = binned(x, self.edges), binned(x, self.coarse)
        p0 = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.bias = float(np.log(p0 / (1 - p0)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pair_tables: list[tuple[int, int, np.ndarray]] = []
        score = np.full(len(y), self.bias)
        if not len(y):
            return self
        weight = lambda p: np.maximum(p * (1 - p), 1e-6)
        for _ in range(self.rounds):
            for f, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-score))
                step = self.rate * self._shallow(codes[:, f], p - y, weight(p), len(table))
                table += step
                score += step[codes[:, f]]
        shape = lambda a, b: (len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)
        cells = lambda a, b: coarse[:, a] * shape(a, b)[1] + coarse[:, b]
        p = 1 / (1 + np.exp(-score))
        gains = [(self._shallow_pair(cells(a, b), p - y, weight(p), shape(a, b))[1], a, b) for a, b in combinations(range(x.shape[1]), 2)]
        self.pair_tables = [(a, b, np.zeros(shape(a, b))) for _, a, b in sorted(gains, key=lambda g: (-g[0], g[1:]))[: self.pairs]]
        for _ in range(self.rounds // 4):
            for a, b, table in self.pair_tables:
                p = 1 / (1 + np.exp(-score))
                step = self.rate * self._shallow_pair(cells(a, b), p - y, weight(p), table.shape)[0]
                table += step
                score += step[coarse[:, a], coarse[:, b]]
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        codes, coarse = binned(x, self.edges), binned(x, self.coarse)
        score = np.full(len(x), self.bias)
        for f, table in enumerate(self.tables):
            score += table[codes[:, f]]
        for a, b, table in self.pair_tables:
            score += table[coarse[:, a], coarse[:, b]]
        return 1 / (1 + np.exp(-np.clip(score, -40, 40)))


class QualityClassifier:
    """``fit`` on at most ``most`` labelled rows outside the held-out fold, then ``score`` any documents.

    Only the text is an input of a score. Null, empty and blank texts have all statistics 0 and the score
    the model gives those; with no label to learn from each score is 0.5. Equal texts have equal scores, and rows
    that share a doc_id are scored one by one. Very long texts are read whole. Other columns, whatever their
    names, are ignored; an empty table gives an empty result.
    """

    def __init__(self, cut: float = 0.3, folds: int = 5, held: int = 0, most: int = 8000):
        self.cut, self.folds, self.held, self.most = cut, folds, held, most
        self.model = Gam()

    def fit(self, docs: DataFrame, labels: DataFrame) -> QualityClassifier:
        train = crc_fold("doc_id", self.folds) != self.held
        self.model.fit(*docstats.training_rows(labelled(docs, labels, "quality", train, self.most)))
        return self

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, held_out, score, predicted: a row per row of ``docs``; a null doc_id is not held out."""
        model, cut = self.model, self.cut

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = docstats.batches_of(batch.column(2))[1]
                p = model.probability(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_fold("doc_id", self.folds) == self.held).alias("held_out"), F.col("text").cast("string").alias("text"))
        return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
