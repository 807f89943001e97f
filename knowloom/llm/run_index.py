"""Run-length index of a small text collection: run-compressed BWT with sampled run ends, streamed matching statistics."""

from __future__ import annotations

import numpy as np

_PACK = 7  # symbols of 9 bits in the first sort key


class RunIndex:
    """Index of byte strings, each ended by a terminator of its own.

    Suffixes are sorted by prefix doubling. Of the Burrows-Wheeler transform only its runs are kept, with the text
    position and the common prefix with the neighbour at each run end. Inside a run the neighbours of consecutive text
    positions move along together and their common prefix shrinks by one a step, so the samples are all that a stream
    over the text needs to know the longest match of every position with any other.
    """

    def __init__(self, strings: list[bytes]) -> None:
        sizes = np.array([len(s) + 1 for s in strings], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        text = np.frombuffer(b"\0".join([*strings, b""]), np.uint8).astype(np.int64) + 1
        text[self.ends - 1] = 0
        n = len(text)
        owner = np.repeat(np.arange(len(strings)), sizes)
        left = self.ends[owner] - 1 - np.arange(n)  # symbols before the terminator
        self._levels: list[tuple[int, np.ndarray]] = []
        padded = np.concatenate([text, np.zeros(_PACK, np.int64)])
        key = np.zeros(n, np.int64)
        for j in range(_PACK):
            key = (key << 9) | np.where(left > j, padded[j:j + n], 0)
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        rank = np.unique(rank * (len(strings) + 1) + np.where(left < _PACK, owner + 1, 0), return_inverse=True)[1].astype(np.int64)
        depth = _PACK
        while True:
            self._levels.append((depth, rank))
            if rank.max(initial=-1) == n - 1:
                break
            after = np.concatenate([rank[depth:], np.zeros(min(depth, n), np.int64)])[:n]
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
            depth *= 2
        self._text, self._n = text, n
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        before = text[order - 1]
        before[order == 0] = 0
        head = np.ones(n, bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        tail = np.ones(n, bool)
        tail[:-1] = head[1:]
        self.runs = int(head.sum())
        self.symbols = before[head]
        at = np.flatnonzero(head)
        self.head_position = order[at]
        self.head_match = np.where(at > 0, self._common(order[at], order[at - 1]), 0)
        at = np.flatnonzero(tail)
        self.tail_position = order[at]
        self.tail_match = np.where(at < n - 1, self._common(order[at], order[np.minimum(at + 1, n - 1)]), 0)

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes, by the ranks of the doubling rounds; terminators differ."""
        out = np.zeros(len(a), np.int64)
        last = self._n - 1
        for depth, rank in reversed(self._levels):
            x, y = a + out, b + out
            fits = np.maximum(x, y) <= last
            out += depth * (fits & (rank[np.minimum(x, last)] == rank[np.minimum(y, last)]) & (x != y))
        for _ in range(_PACK - 1):
            x, y = np.minimum(a + out, last), np.minimum(b + out, last)
            out += (self._text[x] == self._text[y]) & (self._text[x] != 0)
        return out

    def _stream(self, position: np.ndarray, match: np.ndarray) -> np.ndarray:
        at = np.full(self._n, -1, np.int64)
        at[position] = position
        value = np.zeros(self._n, np.int64)
        value[position] = match
        last = np.maximum.accumulate(at)
        return np.maximum(0, value[last] - (np.arange(self._n) - last))

    def matching_statistics(self) -> np.ndarray:
        """For each text position the length of its longest match that starts anywhere else, within its string."""
        return np.maximum(self._stream(self.head_position, self.head_match), self._stream(self.tail_position, self.tail_match))
