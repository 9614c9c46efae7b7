"""Candidates as a table function in SQL: index rows in, matching pairs out.

    register(spark)
    similarity.cosine_blocks(...).createOrReplaceTempView("index_rows")
    SELECT * FROM similar_pairs(TABLE(index_rows), 'cosine', 0.9)

Index rows are those of ``blocks.dealt``. The function asks for its partitions itself, one for each two chunks that meet, so a call
cannot deal them wrongly; a task holds two chunks, whatever the table holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, Row, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn

from kindred.operators import blocks, similarity

#: By measure: how a vector's bytes are read, and the judge of all pairs of two chunks.
_MEASURES = {"gray": ("<i2", similarity.gray_judge), "cosine": ("i1", similarity.cosine_judge)}
_STEP = 512


class SimilarPairs:
    """(a_key, b_key, value) of the pairs of two chunks that match, a_key below b_key; keys keep their type."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, measure: AnalyzeArgument, limit: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not {"key", "v", "me", "lo", "hi"} <= set(rows.dataType.names):
            raise ValueError("the first argument is a table of index rows: key, v, me, lo, hi")
        if not isinstance(measure.dataType, StringType) or measure.value not in _MEASURES:
            raise ValueError(f"the measure is one of {', '.join(sorted(_MEASURES))}")
        key = rows.dataType["key"].dataType
        schema = StructType().add("a_key", key).add("b_key", key).add("value", DoubleType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("lo"), PartitioningColumn("hi")])

    def __init__(self) -> None:
        self.keys: tuple[list, list] = ([], [])
        self.vectors: tuple[list, list] = ([], [])
        self.alone, self.measure, self.limit = False, "", 0.0

    def eval(self, rows: Row, measure: str, limit: float) -> None:
        self.alone, self.measure, self.limit = rows["lo"] == rows["hi"], measure, float(limit)
        side = int(rows["me"] != rows["lo"])
        self.keys[side].append(rows["key"])
        self.vectors[side].append(bytes(rows["v"]))

    def terminate(self) -> Iterator[tuple]:
        other = 0 if self.alone else 1
        if not self.keys[0] or not self.keys[other]:
            return
        kind, judge = _MEASURES[self.measure]
        x, y = (np.frombuffer(b"".join(self.vectors[s]), kind).reshape(len(self.vectors[s]), -1) for s in (0, other))
        for lo in range(0, len(x), _STEP):
            for i, j, value in zip(*judge(self.limit)(x[lo : lo + _STEP], y), strict=True):
                i = i + lo
                a, b = self.keys[0][i], self.keys[other][j]
                if a != b and (not self.alone or i < j):
                    yield (a, b, float(value)) if a < b else (b, a, float(value))


def register(spark: SparkSession, name: str = "similar_pairs") -> None:
    """Makes the function known to the session's SQL."""
    spark.udtf.register(name, udtf(SimilarPairs))
