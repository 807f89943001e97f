"""Adaptive context-mixing range coder for token ids, many independent blocks in lockstep.

Ids of a block are coded by three predictors that start empty in every block. Order 2 remembers the id that last
followed a pair of ids, order 1 the id that last followed one id; a first binary decision says whether the id is the
order-2 guess, a second whether it is the order-1 guess. Their probabilities are mixed, with weights that follow the
better predictor, from adaptive counters of each context's record so far. An id that neither guessed is spelled in
nibbles under adaptive order-0 distributions. All arithmetic is on integers, so encoder and decoder agree everywhere.
"""

from __future__ import annotations

import zlib

import numpy as np

ONE = 1 << 15
_LOW32 = np.uint64((1 << 32) - 1)
_STATE = np.uint64((1 << 48) - 1)
_SLOTS2, _SLOTS1 = 1 << 10, 1 << 9


class _Coder:
    """Carryless range coder with 48 bits of state that moves 16 bits at a time, one state per lane."""

    def __init__(self, lanes: int) -> None:
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, (1 << 48) - 1, np.uint64)

    def _narrow(self, start: np.ndarray, size: np.ndarray) -> None:
        r = self.range >> np.uint64(15)
        self.low = (self.low + r * start.astype(np.uint64)) & _STATE
        self.range = r * size.astype(np.uint64)
        while True:
            high = (self.low + self.range) & _STATE
            same = ((self.low ^ high) >> np.uint64(32)) == 0
            tight = self.range <= _LOW32
            at = np.flatnonzero(same | tight)
            if not len(at):
                return
            low = self.low[at]
            forced = ~same[at]
            wide = self.range[at]
            wide[forced] = (np.uint64(0) - low[forced]) & _LOW32
            self._move(at, low)
            self.low[at] = (low << np.uint64(16)) & _STATE
            self.range[at] = np.minimum(np.maximum(wide, np.uint64(1)) << np.uint64(16), _STATE)


class Encoder(_Coder):
    def __init__(self, lanes: int) -> None:
        super().__init__(lanes)
        self.words: list[tuple[np.ndarray, np.ndarray]] = []

    def _move(self, at: np.ndarray, low: np.ndarray) -> None:
        self.words.append((at.astype(np.int32), (low >> np.uint64(32)).astype(np.uint16)))

    def flag(self, p: np.ndarray, bit: np.ndarray, active: np.ndarray) -> np.ndarray:
        """``p`` of ONE for a set bit; lanes that are not active code nothing."""
        self._narrow(np.where(active & ~bit, p, 0), np.where(active, np.where(bit, p, ONE - p), ONE))
        return bit

    def symbol(self, cdf: np.ndarray, value: np.ndarray, active: np.ndarray) -> np.ndarray:
        lanes = np.arange(len(value))
        start = cdf[lanes, value]
        self._narrow(np.where(active, start, 0), np.where(active, cdf[lanes, value + 1] - start, ONE))
        return value

    def finish(self) -> list[bytes]:
        lanes = len(self.low)
        every = np.arange(lanes)
        for shift in (32, 16, 0):
            self.words.append((every.astype(np.int32), (self.low >> np.uint64(shift)).astype(np.uint16)))
        lane = np.concatenate([a for a, _ in self.words])
        word = np.concatenate([w for _, w in self.words])
        order = np.argsort(lane, kind="stable")
        ends = np.cumsum(np.bincount(lane, minlength=lanes))
        data = word[order].astype("<u2").tobytes()
        return [data[2 * a:2 * b] for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)]


class Decoder(_Coder):
    def __init__(self, blocks: list[bytes]) -> None:
        super().__init__(len(blocks))
        sizes = np.array([len(b) // 2 for b in blocks], np.int64)
        self.next = np.cumsum(sizes) - sizes
        self.stream = np.concatenate([np.frombuffer(b"".join(blocks), "<u2"), np.zeros(8, "<u2")])
        self.code = np.zeros(len(blocks), np.uint64)
        for _ in range(3):
            self.code = (self.code << np.uint64(16)) | self.stream[self.next].astype(np.uint64)
            self.next += 1

    def _move(self, at: np.ndarray, low: np.ndarray) -> None:
        self.code[at] = ((self.code[at] << np.uint64(16)) & _STATE) | self.stream[np.minimum(self.next[at], len(self.stream) - 1)].astype(np.uint64)
        self.next[at] += 1

    def _target(self) -> np.ndarray:
        found = ((self.code - self.low) & _STATE) // (self.range >> np.uint64(15))
        return np.minimum(found, np.uint64(ONE - 1)).astype(np.int64)

    def flag(self, p: np.ndarray, bit: None, active: np.ndarray) -> np.ndarray:
        out = active & (self._target() < p)
        # A set bit lies below p.
        self._narrow(np.where(active & ~out, p, 0), np.where(active, np.where(out, p, ONE - p), ONE))
        return out

    def symbol(self, cdf: np.ndarray, value: None, active: np.ndarray) -> np.ndarray:
        lanes = np.arange(len(cdf))
        out = (cdf[:, 1:16] <= self._target()[:, None]).sum(axis=1)
        start = cdf[lanes, out]
        self._narrow(np.where(active, start, 0), np.where(active, cdf[lanes, out + 1] - start, ONE))
        return out


_STEPS = (ONE * np.arange(17) // 16).astype(np.int32)
#: Where each nibble's distribution moves: room of 16 for every symbol, the rest for the symbol seen.
_GOALS = (16 * np.arange(17)[None, :] + (np.arange(17)[None, :] > np.arange(16)[:, None]) * (ONE - 256)).astype(np.int32)


def _run(coder: Encoder | Decoder, counts: np.ndarray, ids: np.ndarray | None, width: int) -> np.ndarray:
    """The one model loop of both directions: ``ids`` (lanes, longest) or None; returns the ids.

    A table entry is 4 * guess + record, or -1 while it is empty; tables are small enough to stay in a core's cache.
    """
    lanes, longest = len(counts), int(counts.max(initial=0))
    every = np.arange(lanes)
    nibbles = 4 if width == 2 else 8
    out = np.zeros((longest, lanes), np.int64) if ids is None else np.ascontiguousarray(ids.T)
    kind = np.int32 if width == 2 else np.int64
    table2, table1 = np.full(lanes * _SLOTS2, -1, kind), np.full(lanes * _SLOTS1, -1, kind)
    base2, base1, base4 = every * _SLOTS2, every * _SLOTS1, every * 4
    chance2 = np.full(lanes * 4, ONE // 2, np.int64)
    chance1 = np.full(lanes * 4, ONE // 2, np.int64)
    agreed = np.full(lanes * 2, ONE // 2, np.int64)
    weight = np.full(lanes, 128, np.int64)
    spell = [np.tile(_STEPS, (lanes * (16 if i else 1), 1)) for i in range(nibbles)]
    base16 = every * 16
    last = np.zeros(lanes, np.int64)
    before = np.zeros(lanes, np.int64)
    for t in range(longest):
        live = t < counts
        true = None if ids is None else out[t]
        mixed = last * 2654435761
        slot2 = base2 + (((before * 40503 + mixed) >> 7) & (_SLOTS2 - 1))
        slot1 = base1 + ((mixed >> 9) & (_SLOTS1 - 1))
        e2, e1 = table2[slot2].astype(np.int64), table1[slot1].astype(np.int64)
        c2, c1 = e2 >> 2, e1 >> 2
        has2 = e2 >= 0
        at2, at1 = base4 + (e2 & 3), base4 + (e1 & 3)
        # First decision: the order-2 guess, or the order-1 guess where order 2 has none.
        first = np.where(has2, c2, c1)
        asked = live & (first >= 0)
        same = 2 * every + (c1 == first)
        p2, p1 = chance2[at2], chance1[at1]
        own = np.where(has2, p2, p1)
        other = agreed[same]
        p = np.clip((own * weight + other * (256 - weight)) >> 8, 32, ONE - 32)
        hit = coder.flag(p, None if true is None else asked & (true == first), asked)
        goal = hit * ONE
        better = np.abs(goal - own) <= np.abs(goal - other)
        weight = np.where(asked, np.clip(weight + 8 * better - 4, 16, 240), weight)
        chance2[at2] = p2 + ((goal - p2) >> 4) * (asked & has2)
        p1 = p1 + ((goal - p1) >> 4) * (asked & ~has2)
        agreed[same] = other + ((goal - other) >> 5) * asked
        # Second decision: the order-1 guess where it differs.
        again = live & ~hit & has2 & (c1 >= 0) & (c1 != c2)
        hit1 = coder.flag(np.clip(p1, 32, ONE - 32), None if true is None else again & (true == c1), again)
        chance1[at1] = p1 + ((hit1 * ONE - p1) >> 4) * again
        # Else the id is spelled. The order-0 distributions learn every id.
        open_ = live & ~hit & ~hit1
        seen, ctx = [], every
        value = np.zeros(lanes, np.int64)
        for i in range(nibbles):
            cdf = spell[i][ctx]
            s = coder.symbol(cdf, None if true is None else (true >> (4 * (nibbles - 1 - i))) & 15, open_)
            seen.append(cdf)
            value = (value << 4) | s
            ctx = base16 + s
        x = value if true is not None else np.where(hit, first, np.where(hit1, c1, value))
        ctx = every
        for i in range(nibbles):
            s = (x >> (4 * (nibbles - 1 - i))) & 15
            cdf = seen[i] if true is not None or not i else spell[i][ctx]
            spell[i][ctx] = cdf + ((_GOALS[s] - cdf) >> 5)
            ctx = base16 + s
        if true is None:
            out[t] = np.where(live, x, 0)
        table2[slot2] = 4 * x + np.where(x == c2, np.minimum((e2 & 3) + 1, 3), 0)
        table1[slot1] = 4 * x + np.where(x == c1, np.minimum((e1 & 3) + 1, 3), 0)
        before, last = last, x
    return out.T


# Block: magic, id width, 3 spare bytes, ids, bytes of payload, CRC-32 of the ids (little-endian, of the width).
MAGIC = b"KLR1"
_HEAD = np.dtype([("magic", "S4"), ("width", "u1"), ("spare", "u1", 3), ("ids", "<u4"), ("bytes", "<u4"), ("crc", "<u4")])


def encode_blocks(blocks: list[np.ndarray], width: int) -> list[bytes]:
    """Each array of ids -> one self-contained, checksummed block."""
    if not blocks:
        return []
    counts = np.array([len(b) for b in blocks])
    ids = np.zeros((len(blocks), int(counts.max(initial=0))), np.int64)
    for i, b in enumerate(blocks):
        ids[i, :len(b)] = b
    coder = Encoder(len(blocks))
    _run(coder, counts, ids, width)
    out = []
    for b, data in zip(blocks, coder.finish(), strict=True):
        head = np.zeros(1, _HEAD)
        head["magic"], head["width"], head["ids"], head["bytes"] = MAGIC, width, len(b), len(data)
        head["crc"] = zlib.crc32(b.astype(f"<u{width}").tobytes())
        out.append(head.tobytes() + data)
    return out


def decode_blocks(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; a damaged block raises ValueError."""
    if not blocks:
        return []
    heads = [np.frombuffer(b, _HEAD, 1)[0] if len(b) >= _HEAD.itemsize else None for b in blocks]
    for b, h in zip(blocks, heads, strict=True):
        if h is None or h["magic"] != MAGIC or len(b) != _HEAD.itemsize + int(h["bytes"]):
            raise ValueError("damaged block: header")
    widths = {int(h["width"]) for h in heads}
    if len(widths) > 1:
        raise ValueError("blocks of different id width")
    width = widths.pop()
    counts = np.array([int(h["ids"]) for h in heads])
    ids = _run(Decoder([b[_HEAD.itemsize:] for b in blocks]), counts, None, width)
    out = [ids[i, :n] for i, n in enumerate(counts.tolist())]
    for x, h in zip(out, heads, strict=True):
        if zlib.crc32(x.astype(f"<u{width}").tobytes()) != int(h["crc"]):
            raise ValueError("damaged block: checksum")
    return out
