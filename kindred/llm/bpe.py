"""Byte-level BPE: text to token ids and back, with batched numpy merge rounds.

A text is cut into pieces by the tokenizer's pattern; special tokens stand for themselves. The symbols of
many distinct pieces lie in one flat array. A round finds the rank of each adjacent pair by binary search
over the sorted pair keys, takes in each piece the pair of the lowest rank, merges all its occurrences
from the left and closes the gaps; pieces with nothing left to merge leave the array.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordcache import PieceCache

#: Fixed value: the pattern that cuts text into pieces.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {}, 0
    for b in range(256):
        if b in shown:
            letters[b] = chr(b)
        else:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


class ByteBpe:
    """Encoder and decoder of one vocabulary file of the tokenizers library (``path`` is a parameter)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, merges = file["model"]["vocab"], file["model"]["merges"]
        letters = byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self._cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.first = np.array([vocab[c] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        texts = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.token = [texts.get(i, b"") for i in range(max(texts) + 1)]
        self.token_size = np.array([len(t) for t in self.token])
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(self.token), np.uint8)
        self.cache = PieceCache(self._encode_all)

    def _encode_all(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.merge_rounds([p.encode() for p in pieces[i : i + 20_000]]) for i in range(0, len(pieces), 20_000)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def merge_rounds(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in order, and how many each has."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbol = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        word = np.repeat(np.arange(len(pieces)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self.rank)
        while len(symbol):
            key = symbol[:-1] << 32 | symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.full(len(symbol), none)
            rank[:-1] = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.rank[at], none)
            start = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(rank, start)
            length = np.diff(np.append(start, len(word)))
            best_of = np.repeat(best, length)
            ended = best_of == none
            if ended.any():
                done.append((word[ended], symbol[ended]))
                symbol, word, rank, best_of = symbol[~ended], word[~ended], rank[~ended], best_of[~ended]
                if not len(symbol):
                    break
            here = rank == best_of
            # of occurrences that overlap (a a a), every second one of a run
            hit = np.flatnonzero(here)
            run = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
            offset = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            hit = hit[offset % 2 == 0]
            symbol[hit] = self.result[rank[hit]]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            symbol, word = symbol[keep], word[keep]
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(pieces), np.int64)
        word, symbol = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(word, kind="stable")
        return symbol[order].astype(np.int32), np.bincount(word, minlength=len(pieces))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null and empty texts have none."""
        pieces, counts, marks = [], [], []
        for d, text in enumerate(texts):
            before = len(pieces)
            if text:
                last = 0
                for m in self._cut.finditer(text) if self._cut else ():
                    pieces += PATTERN.findall(text, last, m.start())
                    marks.append((len(pieces), d, self.special[m[0]]))
                    last = m.end()
                pieces += PATTERN.findall(text, last) if last else PATTERN.findall(text)
            counts.append(len(pieces) - before)
        ids, size = self.cache.ids(pieces, len(pieces))
        ends = np.concatenate([[0], np.cumsum(size)])
        first = np.concatenate([[0], np.cumsum(counts)])
        out = [ids[ends[a] : ends[b]] for a, b in zip(first[:-1], first[1:], strict=True)]
        for d in {m[1] for m in marks}:
            own = [(ends[p] - ends[first[d]], i) for p, x, i in marks if x == d]
            out[d] = np.insert(out[d], [p for p, _ in own], [i for _, i in own])
        return out

    def decode(self, ids: np.ndarray) -> str:
        size = self.token_size[ids]
        ends = np.cumsum(size)
        place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(self.token_start[ids], size)
        return self.token_bytes[place].tobytes().decode("utf-8", "replace")


def _run(path: str, row, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [row(bpe, ids) for ids in bpe.encode(part.column(1).to_pylist())]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(names) - 1)
                kinds = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), kinds.get(n, pa.string())) for n, c in zip(names[1:], columns, strict=True))], names=names)

    return run


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded: the tokens of each text, and the text they decode to. Null texts are empty."""
    return _documents(docs).mapInArrow(_run(path, lambda b, ids: (ids, b.decode(ids)), ["doc_id", "ids", "decoded"]), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids (little-endian unsigned 32-bit) and of the decoded text, a row per row of ``docs``.

    Null and empty texts have no tokens; repeated rows and null ids are encoded one by one; very long texts are encoded
    whole; other columns are ignored; an empty table gives an empty result.
    """
    row = lambda b, ids: (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(b.decode(ids).encode()).hexdigest())
    return _documents(docs).mapInArrow(_run(path, row, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
