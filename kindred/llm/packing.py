"""Best-fit packing of token pieces into sequences, improved by a swap-based local search.

Pieces are dealt by a hash into blocks of about ``BLOCK``; each block is packed on its own, so no task
holds more than that, and all blocks but the last sequence of each come out full. In a block, best-fit
decreasing comes first. Then bins that are not full trade: a document moves, or one or two documents of a
bin go against one of a fuller bin, so that the fuller one gains; each trade increases the sum of squared
fills, and it goes on until bins are empty or no trade is left.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import written
from .wordcache import PieceCache

BLOCK = 8192


def best_fit(lengths: list[int], room: int) -> list[list[int]]:
    """Bins of places, by best fit in order of decreasing length."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (room left, bin), sorted
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        k = bisect_left(free, (lengths[i], -1))
        left, b = free.pop(k) if k < len(free) else (room, len(bins))
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
        if left > lengths[i]:
            insort(free, (left - lengths[i], b))
    return bins


def _trade(low: list[int], high: list[int], lengths: list[int], gap: int) -> tuple[list[int], list[int]] | None:
    """What to take from the emptier and the fuller bin so that the fuller one gains most, at most ``gap``."""
    best, found = 0, None
    for i in low:
        if best < lengths[i] <= gap:
            best, found = lengths[i], ([i], [])
    if best == gap:
        return found
    # a bin has few distinct lengths (63 at 2048), so all pairs of these are soon tried, however many documents it holds
    lows, at_low, many = np.unique([lengths[i] for i in low], return_index=True, return_counts=True)
    highs, at_high = np.unique([lengths[j] for j in high], return_index=True)
    gain = lows[:, None] - highs[None]
    gain[gain > gap] = 0
    k = int(gain.argmax())
    if gain.flat[k] > best:
        best, found = int(gain.flat[k]), ([low[at_low[k // len(highs)]]], [high[at_high[k % len(highs)]]])
    if best < gap and len(low) >= 2:
        a, b = np.triu_indices(len(lows))
        two = (a != b) | (many[a] > 1)
        a, b = a[two], b[two]
        gain = (lows[a] + lows[b])[:, None] - highs[None]
        gain[gain > gap] = 0
        k = int(gain.argmax())
        if gain.flat[k] > best:
            p = k // len(highs)
            first = low[at_low[a[p]]]
            second = low[at_low[b[p]]] if a[p] != b[p] else next(i for i in low if i != first and lengths[i] == lows[a[p]])
            best, found = int(gain.flat[k]), ([first, second], [high[at_high[k % len(highs)]]])
    return found


def local_search(bins: list[list[int]], lengths: list[int], room: int) -> list[list[int]]:
    fill = [sum(lengths[i] for i in b) for b in bins]
    least = -(-sum(fill) // room)
    count = len(bins)
    open_ = sorted((k for k in range(len(bins)) if fill[k] < room), key=lambda k: (fill[k], k))
    while count > least and len(open_) > 1:
        low, moved = open_[0], False
        for high in reversed(open_[1:]):
            gap = room - fill[high]
            while gap and bins[low] and (trade := _trade(bins[low], bins[high], lengths, gap)):
                out, back = trade
                bins[low] = [i for i in bins[low] if i not in out] + back
                bins[high] = [j for j in bins[high] if j not in back] + out
                change = sum(lengths[i] for i in out) - sum(lengths[j] for j in back)
                fill[low], fill[high], moved = fill[low] - change, fill[high] + change, True
                gap -= change
            if not bins[low]:
                count -= 1
                break
        open_ = sorted((k for k in open_ if bins[k] and fill[k] < room and (moved or k != low)), key=lambda k: (fill[k], k))
    return [b for b in bins if b]


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space wherever a Latin letter is followed by ASCII punctuation, and in lower case (A-Z).

    The vocabulary's pattern cuts there and its normaliser lower-cases, so the tokens stay the same, and there
    are far fewer distinct words. Texts that hold "<|", which may begin a special token, are left as they are.
    """
    n = len(data)
    if n < 2:
        return data, offsets
    plain = np.ones(len(offsets) - 1, bool)
    plain[np.searchsorted(offsets, np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)), "right") - 1] = False
    plain = np.repeat(plain, np.diff(offsets))
    low = data | 32
    ascii_letter = (low >= 97) & (low <= 122)
    latin = np.zeros(n, bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    punctuation = (data > 32) & (data < 127) & ~ascii_letter & ~((data >= 48) & (data <= 57))
    cut = np.flatnonzero((ascii_letter | latin)[:-1] & punctuation[1:] & plain[:-1]) + 1
    cut = cut[~np.isin(cut, offsets)]
    data = np.where(ascii_letter & plain, low, data)
    return np.insert(data, cut, 32), offsets + np.searchsorted(cut, offsets)


class Packer:
    """Token pieces of documents and their places in sequences of at most ``room`` tokens.

    ``path`` is a vocabulary file of the tokenizers library. Each document is its ids and then ``end``. Null,
    empty and blank texts are the one token ``end``. Repeated rows are packed one by one, a null doc_id stays
    null, other columns are ignored; an empty table gives an empty result.
    """

    def __init__(self, path: str, room: int = 2048, end: int = 0):
        self.path, self.room, self.end = path, room, end

    def _pieces(self, docs: DataFrame, ids: bool) -> DataFrame:
        path, room, end = self.path, self.room, self.end

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()

            def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
                flat, size = [], np.zeros(len(words), np.int64)
                for lo in range(0, len(words), 20_000):
                    for k, e in enumerate(tokenizer.encode_batch_fast([w.decode() for w in words[lo : lo + 20_000]], add_special_tokens=False)):
                        own = e.ids
                        flat += own
                        size[lo + k] = len(own)
                return np.array(flat, np.int32), size

            # neither the vocabulary's pattern nor its normaliser reaches across ASCII white space, so words are encoded one by one
            cache = PieceCache(encode, 700_000)
            for batch in batches:
                data, offsets = ta.flat(batch.column(1))
                number = batch.column(0).to_pylist()
                for lo, hi in ta.slices(offsets):
                    rows = []
                    own_data, own = spaced(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    split = [own_data[own[d] : own[d + 1]].tobytes().split() for d in range(hi - lo)]
                    words = [w for s in split for w in s]
                    tokens, size = cache.ids(words, len(words))
                    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum([len(s) for s in split])])]
                    for d in range(lo, hi):
                        own = np.append(tokens[ends[d - lo] : ends[d - lo + 1]], np.int32(end))
                        for p, start in enumerate(range(0, len(own), room)):
                            part = own[start : start + room]
                            rows.append((number[d], p, start, len(part), part if ids else zlib.crc32(part.astype("<u4").tobytes())))
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()) if ids else pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids" if ids else "ids_crc32"])

        last = "ids array<int>" if ids else "ids_crc32 long"
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, piece int, start long, length long, {last}")

    def pieces(self, docs: DataFrame) -> DataFrame:
        """doc_id, piece, start, length, ids."""
        return self._pieces(docs, True)

    def placed(self, pieces: DataFrame) -> DataFrame:
        """The pieces (written rows with doc_id, piece, length) with sequence_id and offset."""
        room = self.room
        blocks = max(1, -(-pieces.count() // BLOCK))

        def pack(key: tuple, rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
            lengths = rows["length"].to_pylist()
            bins = local_search(best_fit(lengths, room), lengths, room)
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for k, places in enumerate(bins):
                at = 0
                for i in places:
                    sequence[i], offset[i] = key[0].as_py() << 24 | k, at
                    at += lengths[i]
            return rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).drop_columns(["block"])

        # a block of at most a few BLOCK rows of numbers is all that a task ever holds; the number of a row in the
        # written table deals them, so rows of one id, or of none, do not meet in one block
        block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
        return pieces.withColumn("block", block).groupBy("block").applyInArrow(pack, schema)

    def packed(self, docs: DataFrame) -> DataFrame:
        """doc_id, piece, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit), sequence_id, offset."""
        return self.placed(written(self._pieces(docs, False), "pieces"))
