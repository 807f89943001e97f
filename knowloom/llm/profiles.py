"""Upper bounds of set intersections from small count profiles."""

from __future__ import annotations

import numpy as np


def set_profile(hashes: np.ndarray) -> bytes:
    """Counts of a set's hashes by their low bits, one byte a cell, in the power of two of cells that its size asks for.

    Two sets share at most the sum over the cells of the smaller count. 255 stands for that or any larger count.
    """
    cells = 1 << max(6, int(len(hashes)).bit_length())
    low = (hashes & hashes.dtype.type(cells - 1)).astype(np.int64)
    return np.minimum(np.bincount(low, minlength=cells), 255).astype(np.uint8).tobytes()


def _folded(profiles: np.ndarray, cells: int) -> np.ndarray:
    """The same profiles with fewer cells."""
    parts = profiles.reshape(len(profiles), -1, cells).astype(np.int64)
    return np.where((parts == 255).any(axis=1), 255, np.minimum(parts.sum(axis=1), 255)).astype(np.uint8)


class Profiles:
    """Profiles of different widths; two are compared at the narrower width."""

    def __init__(self, raw: list[bytes]) -> None:
        rows = [np.frombuffer(x, np.uint8) for x in raw]
        self.width = np.array([len(x) for x in rows], np.int64)
        self.place = np.empty(len(rows), np.int64)
        self.at: dict[tuple[int, int], np.ndarray] = {}
        widths = np.unique(self.width).tolist()
        for w in widths:
            mine = np.flatnonzero(self.width == w)
            self.place[mine] = np.arange(len(mine))
            table = np.stack([rows[i] for i in mine.tolist()])
            for v in widths:
                if v <= w:
                    self.at[w, v] = _folded(table, v) if v < w else table

    def most_shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """Upper bounds of the intersections of set ``i`` with ``others``."""
        out = np.zeros(len(others), np.int64)
        own = int(self.width[i])
        for w in np.unique(self.width[others]).tolist():
            some = np.flatnonzero(self.width[others] == w)
            v = min(w, own)
            least = np.minimum(self.at[own, v][self.place[i]], self.at[w, v][self.place[others[some]]])
            out[some] = least.sum(axis=1, dtype=np.int64) + (least == 255).sum(axis=1) * (1 << 40)
        return out
