"""Lines that many documents share: explode normalised lines, hash, count documents, drop, reassemble by position.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased, held as its 128-bit digest. Only
keys of ``least`` code points or more count. Every document is counted once for a key, however often it
repeats it. All is counted and joined by (digest, slice of the document), so that the documents of one very common
line are dealt over ``slices`` tasks; what is broadcast, if anything, Spark decides by size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta


def digests(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Text, position and digest of the lines whose keys have ``least`` code points or more."""
    n = len(offsets) - 1
    cut = np.flatnonzero(data == 10)
    start, end = np.sort(np.concatenate([offsets[:-1], cut + 1])), np.sort(np.concatenate([offsets[1:], cut]))
    lines = 1 + np.searchsorted(cut, offsets[1:]) - np.searchsorted(cut, offsets[:-1])
    text = np.repeat(np.arange(n), lines)
    position = np.arange(len(text)) - np.repeat(np.cumsum(lines) - lines, lines)
    solid = np.flatnonzero(~((data == 32) | ((data >= 9) & (data <= 13))))
    left, right = np.searchsorted(solid, start), np.searchsorted(solid, end)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    own = np.flatnonzero(right > left)
    a, b = solid[left[own]], solid[right[own] - 1] + 1
    long_ = points[b] - points[a] >= least
    own, a, b = own[long_], a[long_], b[long_]
    lower = (data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)).tobytes()
    return text[own], position[own], [hashlib.blake2b(lower[i:j], digest_size=16).digest() for i, j in zip(a.tolist(), b.tolist(), strict=True)]


def _print() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


class LineDedup:
    """Lines whose key is in ``documents`` documents or more stay in the one of the largest doc_id alone.

    Null and empty texts are one empty line. Rows that share a doc_id are one document when documents are counted,
    and each keeps its own lines. A row without a doc_id is no document in the counts, and never the
    largest: it loses the lines that the others share. Very long texts are handled row by row, in
    time and memory in proportion to their lines. An empty table gives no rows; other columns are ignored.
    """

    def __init__(self, least: int = 40, documents: int = 5, slices: int = 64):
        self.least, self.documents, self.slices = least, documents, slices

    def lines(self, docs: DataFrame) -> DataFrame:
        """(doc_id, print, slice, position, digest) of the lines whose keys count; print tells texts of one doc_id apart."""
        least = self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = ta.flat(batch.column(2))
                for lo, hi in ta.slices(offsets):
                    text, position, found = digests(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], least)
                    at = pa.array(text + lo)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(position.astype(np.int32)), pa.array(found, pa.binary())], names=["doc_id", "print", "position", "digest"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        rows = docs.select("doc_id", _print().alias("print"), "text").mapInArrow(run, f"doc_id {kind}, print long, position int, digest binary")
        return rows.withColumn("slice", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), "print")), F.lit(self.slices)).cast("int"))

    def shared(self, lines: DataFrame) -> DataFrame:
        """(digest, slice, last): keys held by enough documents, for each slice that has them, and the largest doc_id."""
        held = lines.select("digest", "slice", "doc_id").distinct()
        # a doc_id is in one slice, so its documents are counted there; a key has ``slices`` rows at most from here on
        by_slice = held.groupBy("digest", "slice").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("last"))
        keys = by_slice.groupBy("digest").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.collect_list("slice").alias("slices"))
        return keys.where(F.col("n") >= self.documents).select("digest", "last", F.explode("slices").alias("slice"))

    def dropped(self, docs: DataFrame) -> DataFrame:
        """(doc_id, print, positions): of each text the lines that go, in order."""
        lines = self.lines(docs)
        gone = lines.join(self.shared(lines), ["digest", "slice"]).where(~F.col("doc_id").eqNullSafe(F.col("last")))
        return gone.groupBy("doc_id", "print").agg(F.array_sort(F.collect_set("position")).alias("positions"))

    def kept(self, docs: DataFrame) -> DataFrame:
        """docs with kept (the text of the lines that stay), n_lines and n_dropped, in place of columns of these names."""
        own = docs.select(F.struct("*").alias("row"), _print().alias("print"))
        gone = self.dropped(docs).select(F.col("doc_id").alias("_id"), F.col("print").alias("_print"), "positions")
        rows = own.join(gone, own["row.doc_id"].eqNullSafe(gone["_id"]) & (own["print"] == gone["_print"]), "left")
        whole = F.coalesce("row.text", F.lit(""))
        rows = rows.select("row", whole.alias("whole"), F.split(whole, "\n", -1).alias("lines"), F.coalesce(F.size("positions"), F.lit(0)).alias("n"), "positions")
        # the runs of lines between dropped ones: constant work a line, whatever the text's length
        rows = rows.withColumn("ends", F.concat(F.array(F.lit(-1)), F.col("positions"), F.array(F.size("lines"))))
        runs = F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: F.slice("lines", F.get("ends", i) + 2, F.get("ends", i + 1) - F.get("ends", i) - 1))
        kept = F.when(F.col("n") == 0, F.col("whole")).otherwise(F.array_join(F.flatten(runs), "\n"))
        new = {"kept": kept, "n_lines": F.size("lines").cast("long"), "n_dropped": F.col("n").cast("long")}
        return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in new], *[c.alias(n) for n, c in new.items()])
