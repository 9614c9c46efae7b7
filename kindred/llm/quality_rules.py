"""Quality rules: exact text statistics, hard limits, and gradient-boosted trees over the statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import docstats, trees
from .common import labelled

#: The score may only fall as these statistics rise.
FALLING = ["symbol_per_word", "dup_line_share", "bang_per_word", "pipe_per_word", "caps_word_share"]


class QualityRules:
    """Counts, limits and a verdict for each document; see ``score``.

    ``fit`` learns from at most ``most`` rows of a labels table (quality 1: good), the same on each run.
    Without a label of either kind everything that passes the limits is kept. ``keep`` is the least
    probability of good quality that keeps a document.
    """

    def __init__(self, least_words: int = 50, repeat_percent: int = 50, keep: float = 0.5, most: int = 6000):
        self.least_words, self.repeat_percent, self.keep, self.most = least_words, repeat_percent, keep, most
        self.forest: trees.Forest | None = None

    def fit(self, docs: DataFrame, labels: DataFrame) -> QualityRules:
        x, y = docstats.training_rows(labelled(docs, labels, "quality", None, self.most))
        if len(np.unique(y)) == 2:
            self.forest = trees.fit(x, y, {docstats.FEATURES.index(f): -1 for f in FALLING})
        return self

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, the BASE counts, base_failed, probability, kept: a row per row of ``docs``.

        Null, empty and blank texts have no words and fail the limits; repeated rows are judged one by one, a
        null doc_id stays null. Other columns of ``docs`` are ignored.
        """
        forest, least, repeat, keep = self.forest, self.least_words, self.repeat_percent, self.keep

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                base, x = docstats.batches_of(batch.column(1))
                failed = (base[:, 0] < least) | (100 * base[:, 4] > repeat * base[:, 0])
                p = forest.probability(x) if forest else np.ones(len(x))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c.astype(np.int64)) for c in base.T), pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep))],
                    names=["doc_id", *docstats.BASE, "base_failed", "probability", "kept"],
                )

        schema = "doc_id long, " + ", ".join(f"{c} long" for c in docstats.BASE) + ", base_failed boolean, probability double, kept boolean"
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)

    def filter(self, docs: DataFrame) -> DataFrame:
        """The documents that are kept, with all their columns, in one pass over their rows."""
        return filtered(docs, lambda texts: self._verdict(texts))

    def _verdict(self, texts: pa.Array) -> np.ndarray:
        base, x = docstats.batches_of(texts)
        failed = (base[:, 0] < self.least_words) | (100 * base[:, 4] > self.repeat_percent * base[:, 0])
        return ~failed & ((self.forest.probability(x) if self.forest else np.ones(len(x))) >= self.keep)


def filtered(docs: DataFrame, verdict) -> DataFrame:
    """The rows of ``docs`` for whose texts ``verdict`` is true; all columns pass through Arrow as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(np.asarray(verdict(batch.column(at)), bool)))

    return docs.mapInArrow(run, docs.schema)
