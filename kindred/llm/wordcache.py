"""Token ids of many texts through a cache of their pieces, in flat numpy arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np


class PieceCache(dict):
    """piece -> place of its ids. Looking a piece up that is new notes it; ``encode`` then gets all new ones.

    At most about ``most`` pieces stay; beyond that the cache starts anew, which costs time, not results.
    """

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], most: int = 500_000):
        super().__init__()
        self.encode, self.most = encode, most
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.pending: list = []
        self.flat, self.start, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def __missing__(self, piece) -> int:
        at = len(self)
        self[piece] = at
        self.pending.append(piece)
        return at

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def ids(self, pieces: Iterable, count: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces one after another, and how many each piece has."""
        if len(self) > self.most:
            self._reset()
        at = np.fromiter(map(self.__getitem__, pieces), np.int64, count)
        if self.pending:
            done = len(self) - len(self.pending)
            flat, size = self.encode(self.pending)
            self.flat = self._room(self.flat, self.used + len(flat))
            self.start, self.size = self._room(self.start, len(self)), self._room(self.size, len(self))
            self.flat[self.used : self.used + len(flat)] = flat
            self.size[done : len(self)] = size
            self.start[done : len(self)] = self.used + np.cumsum(size) - size
            self.used += len(flat)
            self.pending = []
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total) - np.repeat(ends - size, size) + np.repeat(self.start[at], size)
        return self.flat[place], size
