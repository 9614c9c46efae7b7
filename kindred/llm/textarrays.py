"""Texts of an Arrow batch as flat numpy arrays: words, 64-bit word hashes, shingles and minhashes.

A word is a maximal run of bytes other than space and \\x09-\\x0D, so the arrays never touch Python
strings. A hash chains the 8-byte blocks of a word through a full mixer, so no two words have one hash by
their structure; long spans are digested by blake2b. Work goes by slices of about
``SLICE`` bytes, so the arrays stay small whatever the batch holds; only one very long text can
make a larger slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
#: Spans of more bytes are digested one by one.
LONG = 128
_R = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_M = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


@dataclass
class Spans:
    """Byte spans (of words or lines) of several texts, in order; first[d]..first[d + 1] are those of text d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = self.data
        blocks = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        size = self.end - self.start
        out = mix(size.astype(np.uint64) * _R)
        left = np.flatnonzero((size > 0) & (size <= LONG))
        at = 0
        while len(left):
            block = blocks[self.start[left] + at] & _MASKS[np.minimum(size[left] - at, 8)]
            out[left] = mix((out[left] ^ block) * _R + np.uint64(1))
            at += 8
            left = left[size[left] > at]
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.data[self.start[i] : self.end[i]], digest_size=8).digest(), "little")
        return out


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Spans:
    n = len(offsets) - 1
    if lower:
        data = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return Spans(data, start, end, doc, np.searchsorted(doc, np.arange(n + 1)))


def windows(spans: Spans, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k consecutive words of one text, and the position of its first word."""
    if len(hashes) < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(spans.doc[: len(hashes) - k + 1] == spans.doc[k - 1 :])
    total = np.zeros(len(at), np.uint64)
    for i in range(k):
        total = (total ^ hashes[at + i]) * _M[i % len(_M)]
        total ^= total >> np.uint64(29)
    return mix(total), at


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Per text its distinct k-word shingles, sorted; the n + 1 offsets of the texts.

    A text of fewer than k words has its whole sequence as the one shingle, one without words none.
    """
    n = len(offsets) - 1
    spans = words(data, offsets, lower=True)
    hashes = spans.hashes()
    found, at = windows(spans, hashes, k)
    doc, count = spans.doc[at], np.diff(spans.first)
    for short in range(1, k):
        own = np.flatnonzero(count == short)
        if len(own):
            total = np.full(len(own), short, np.uint64)
            for i in range(short):
                total = (total ^ hashes[spans.first[own] + i]) * _M[i % len(_M)]
                total ^= total >> np.uint64(29)
            found, doc = np.concatenate([found, mix(total + np.uint64(short))]), np.concatenate([doc, own])
    if (np.diff(doc) < 0).any():
        order = np.argsort(doc, kind="stable")
        found, doc = found[order], doc[order]
    first = np.searchsorted(doc, np.arange(n + 1))
    for d in range(n):
        found[first[d] : first[d + 1]].sort()
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    return found[new], np.searchsorted(doc[new], np.arange(n + 1))


def segment_min(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minimum of each segment; segments must not be empty."""
    return np.minimum.reduceat(values, first[:-1])


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each segment, empty ones 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
