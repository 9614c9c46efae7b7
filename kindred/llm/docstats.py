"""Statistics of whole texts, computed on the flat arrays of ``textarrays``.

``BASE`` are exact counts. ``FEATURES`` are the inputs of the quality models: ratios and logarithms of
such counts, all finite, 0 for a text without words. None of them reads an id, a source or a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
FEATURES = [
    "log_words", "mean_word", "symbol_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punct_share",
    "bang_per_word", "pipe_per_word", "distinct_share", "log_line_words", "wide_share", "caps_word_share", "stop_end_share", "at_per_word", "brace_per_word", "long_word_share",
]


def _table(chars: bytes) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(chars)] = True
    return flags


_IS_SYMBOL = _table(SYMBOLS)
_IS_UPPER, _IS_DIGIT = _table(bytes(range(65, 91))), _table(bytes(range(48, 58)))
_IS_PUNCT = _table(b".,;:!?-()\"'")
_IS_BRACE = _table(b"{}[]\\/=_;")


def _repeats(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: is there an equal one in its text; is it an extra one."""
    order = np.lexsort((hashes, doc))
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        same[1:] = (hashes[order][1:] == hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    any_ = same.copy()
    any_[:-1] |= same[1:]
    twice, extra = np.zeros(len(order), bool), np.zeros(len(order), bool)
    twice[order], extra[order] = any_, same
    return twice, extra


def stats(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BASE counts (texts x 5) and FEATURES (texts x n) of the texts of one slice."""
    n = len(offsets) - 1
    spans = ta.words(data, offsets)
    hashes = spans.hashes()
    count = np.diff(spans.first)

    total = lambda flags: np.add.reduceat(np.append(flags, False).astype(np.int64), offsets[:-1]) * (np.diff(offsets) > 0) if n else np.zeros(0, np.int64)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    length = points[spans.end] - points[spans.start]
    chars = ta.per_doc(length, spans.first)
    symbols = total(_IS_SYMBOL[data])

    starts, ends, doc = _lines(data, offsets)
    with_word = np.searchsorted(spans.start, ends) > np.searchsorted(spans.start, starts)
    starts, ends, doc = starts[with_word], ends[with_word], doc[with_word]
    lines = ta.Spans(data, starts, ends, doc, np.searchsorted(doc, np.arange(n + 1)))
    dup = ta.per_doc(_repeats(doc, lines.hashes())[1], lines.first)

    found, at = ta.windows(spans, hashes, 3)
    twice = _repeats(spans.doc[at], found)[0]
    covered = np.zeros(len(hashes), bool)
    for i in range(3):
        covered[at[twice] + i] = True
    repeat = ta.per_doc(covered, spans.first)
    base = np.stack([count, chars, symbols, dup, repeat], 1)

    words_, bytes_ = np.maximum(count, 1), np.maximum(np.diff(offsets), 1)
    extra = ta.per_doc(_repeats(spans.doc, hashes)[1], spans.first)
    upper, digit, punct, brace = (total(f[data]) for f in (_IS_UPPER, _IS_DIGIT, _IS_PUNCT, _IS_BRACE))
    bang, pipe, wide, at_ = total(data == 33), total(data == 124), total(data >= 128), total(data == 64)
    ups = np.concatenate([[0], np.cumsum(_IS_UPPER[data])])
    caps = ta.per_doc((ups[spans.end] - ups[spans.start]) >= 2, spans.first)
    stop = ta.per_doc(np.isin(data[spans.end - 1], [46, 33, 63]) if len(spans.end) else np.zeros(0, bool), spans.first)
    long_ = ta.per_doc(length > 20, spans.first)
    n_lines = np.maximum(np.diff(lines.first), 1)
    features = np.stack([
        np.log1p(count), chars / words_, symbols / words_, dup / n_lines, repeat / words_, upper / bytes_, digit / bytes_, punct / bytes_,
        bang / words_, pipe / words_, 1 - extra / words_, np.log1p(count / n_lines), wide / bytes_, caps / words_, stop / words_, at_ / words_, brace / words_, long_ / words_,
    ], 1) * (count > 0)[:, None]
    return base, features


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cut = np.flatnonzero(data == 10)
    doc = np.searchsorted(offsets, cut, "right") - 1
    n = len(offsets) - 1
    starts, ends = np.concatenate([offsets[:-1], cut + 1]), np.concatenate([cut, offsets[1:]])
    start_doc, end_doc = np.concatenate([np.arange(n), doc]), np.concatenate([doc, np.arange(n)])
    a, b = np.lexsort((starts, start_doc)), np.lexsort((ends, end_doc))
    return starts[a], ends[b], start_doc[a]


def batches_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """BASE and FEATURES of all texts of an Arrow column."""
    data, offsets = ta.flat(texts)
    parts = [stats(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in ta.slices(offsets)]
    if not parts:
        return np.zeros((0, len(BASE)), np.int64), np.zeros((0, len(FEATURES)))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def training_rows(marked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """FEATURES and labels of the bounded rows of ``common.labelled``, in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batches_of(batch.column(1))[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c) for c in x.T)], names=["doc_id", "y", *FEATURES])

    rows = marked.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "y").mapInArrow(run, "doc_id long, y int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable")
    return rows[FEATURES].to_numpy(float), rows["y"].to_numpy(float)
