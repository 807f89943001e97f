"""Mixture-controlled packing: deficit round-robin over source queues fills every window to target token shares."""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowloom.functions.skew import is_small, small_side
from knowloom.llm import tokens
from knowloom.llm.shared import materialize

WINDOW = 2048
MAX_QUEUES = 1024
_CELLS = 2_000_000


class MixturePlan:
    """Where each queue's tokens go, in closed form.

    Every window gives each queue its quantum, ``window`` times the queue's weight among those not yet empty; a queue
    sends as many whole tokens as its deficit holds and carries the rest over. After k windows a queue has therefore
    sent floor(min(total, weight * V_k)) tokens, V_k being the service a unit of weight got by then. Any task can
    compute that for any window, so deficits carry over across windows and partitions without a sequential pass.
    Fractions of a token that windows owe each other shift the cuts by fewer tokens than there are queues: the slices
    of all windows, put end to end, are cut every ``window`` tokens, so only the last sequence may be short.
    """

    def __init__(self, totals: list[int], weights: list[float], window: int = WINDOW) -> None:
        self.window = window
        self.totals = np.array(totals, dtype=np.float64)
        self.weights = np.array(weights, dtype=np.float64)
        if len(totals) and (self.weights <= 0).any():
            raise ValueError("weights must be positive")
        ends = self.totals / self.weights
        order = np.argsort(ends, kind="stable")
        self.v = np.concatenate([[0.0], ends[order]])
        rate = np.concatenate([np.cumsum(self.weights[order][::-1])[::-1], [1.0]])
        self.n = np.concatenate([[0.0], np.cumsum(np.diff(self.v) * rate[:-1])])
        self.rate = rate
        self.total = int(sum(totals))
        self.windows = -(-self.total // window)

    def sent(self, k: np.ndarray, queues: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Tokens that queues have sent before window ``k``: (len(k), queues), or elementwise for an index array."""
        x = k.astype(np.float64) * self.window
        i = np.clip(np.searchsorted(self.n, x, side="right") - 1, 0, len(self.n) - 2)
        v = np.clip(self.v[i] + (x - self.n[i]) / self.rate[i], self.v[i], self.v[i + 1])
        if isinstance(queues, slice):
            out = np.floor(np.minimum(self.totals, v[:, None] * self.weights))
            return np.where((k >= self.windows)[:, None], self.totals, out).astype(np.int64)
        out = np.floor(np.minimum(self.totals[queues], v * self.weights[queues]))
        return np.where(k >= self.windows, self.totals[queues], out).astype(np.int64)

    def window_of(self, position: np.ndarray, queues: np.ndarray) -> np.ndarray:
        """Window whose slice of the queue holds the token at ``position``."""
        x = np.interp(position / self.weights[queues], self.v, self.n)
        k = np.clip((x // self.window).astype(np.int64), 0, self.windows - 1)
        while (low := self.sent(k + 1, queues) <= position).any():
            k = k + low
        while (high := self.sent(k, queues) > position).any():
            k = k - high
        return k

    def place(self, k: np.ndarray, queues: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start in the queue, and in the packed stream, of the queue's slice of window ``k``."""
        a, b = np.empty(len(k), np.int64), np.empty(len(k), np.int64)
        step = max(1, _CELLS // max(1, len(self.totals)))
        for i in range(0, len(k), step):
            kk, q = k[i:i + step], queues[i:i + step]
            now, after = self.sent(kk), self.sent(kk + 1)
            ahead = np.cumsum(after - now, axis=1) - (after - now)
            rows = np.arange(len(kk))
            a[i:i + step] = now[rows, q]
            b[i:i + step] = now.sum(axis=1) + ahead[rows, q]
        return a, b

    def pieces(self, position: np.ndarray, length: np.ndarray, queues: np.ndarray) -> tuple[np.ndarray, ...]:
        """Documents at ``position`` of their queues -> (row, start in the document, length, position in the packed stream)."""
        if not len(position):
            return (np.empty(0, np.int64),) * 4
        first, last = self.window_of(position, queues), self.window_of(position + length - 1, queues)
        row = np.repeat(np.arange(len(position)), last - first + 1)
        k = _ramp(last - first + 1) + first[row]
        q = queues[row]
        at, out = self.place(k, q)
        begin = np.maximum(position[row], at)
        end = np.minimum((position + length)[row], self.sent(k + 1, q))
        keep = end > begin
        row, begin, n, out = row[keep], begin[keep], (end - begin)[keep], (out + begin - at)[keep]
        cuts = (out + n - 1) // self.window - out // self.window + 1
        sub = np.repeat(np.arange(len(row)), cuts)
        edge = (out[sub] // self.window + _ramp(cuts)) * self.window
        a = np.maximum(out[sub], edge)
        b = np.minimum(out[sub] + n[sub], edge + self.window)
        return row[sub], begin[sub] + a - out[sub] - position[row[sub]], b - a, a


def _ramp(counts: np.ndarray) -> np.ndarray:
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def token_rows(docs: DataFrame, path: str, end_id: int, spaces: str) -> DataFrame:
    """doc_id, source, part, at (tokens of the same source before it in this part), n, ids (little-endian, ``width`` bytes each).

    Written once: the order within a part, and with it the queues, must not change between passes.
    """
    def run(batches):
        part = TaskContext.get().partitionId()
        done: dict[str | None, int] = {}
        for batch in tokens.slices(batches):
            ids, code = tokens.encode_all(path, batch.column(2).to_pylist(), spaces)
            end = array(code, [end_id]).tobytes()
            width = len(end)
            sources = batch.column(1).to_pylist()
            at, n = [], []
            for s, x in zip(sources, ids, strict=True):
                at.append(done.get(s, 0))
                n.append(len(x) // width + 1)
                done[s] = at[-1] + n[-1]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([part] * len(ids), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()),
                pa.array([width] * len(ids), pa.int32()), pa.array([x + end for x in ids], pa.binary()),
            ], ["doc_id", "source", "part", "at", "n", "width", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, part int, at long, n long, width int, ids binary")


def pack(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, targets: dict[str, float] | None = None,
         spaces: str = tokens.WHOLE, max_queues: int = MAX_QUEUES) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    Each source is a queue; ``targets`` are token shares (a source without one takes its own share of all tokens, the
    default for all, which keeps every window at the corpus mixture to the end). A queue that runs empty leaves its
    share to the others. More sources than ``max_queues`` are hashed onto that many queues, so the plan that tasks get
    stays bounded; sources named in ``targets`` keep a queue of their own. A null text is empty: its only id is ``end_id``. Null ids, null sources and repeated rows are packed
    like any other; an empty table gives no piece. Whole texts are encoded once and written as ids; the second pass
    reads them, places each document by its queue position and cuts it, without a shuffle of ids.
    """
    spark = docs.sparkSession
    rows = materialize(token_rows(docs, path, end_id, spaces), "packing-ids")
    sizes = rows.groupBy("source", "part").agg(F.sum("n").alias("n"))
    many = not is_small(sizes.select("source").distinct(), max_queues)
    queue = F.concat(F.lit("#"), F.pmod(F.xxhash64("source"), F.lit(max_queues))) if many else F.col("source")
    if many and targets:
        queue = F.when(F.col("source").isin(*targets), F.col("source")).otherwise(queue)
    sizes = materialize(sizes.withColumn("queue", queue), "packing-sizes")
    found = sizes.groupBy("queue").agg(F.sum("n").alias("n")).orderBy("queue").collect()  # at most max_queues + 1 rows and one for each target
    names = [r["queue"] for r in found]
    totals = [int(r["n"]) for r in found]
    everything = max(1, sum(totals))
    weights = [float((targets or {}).get(q, n / everything)) for q, n in zip(names, totals, strict=True)]
    plan = MixturePlan(totals, weights, window)
    numbers = spark.createDataFrame([(q, i) for i, q in enumerate(names)], "queue string, q int")
    before = Window.partitionBy("queue").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    bases = bases.join(F.broadcast(numbers), bases["queue"].eqNullSafe(numbers["queue"])).select(
        F.col("source").alias("b_source"), F.col("part").alias("b_part"), "base", "q")
    placed = rows.join(small_side(bases, is_small(bases)), F.col("source").eqNullSafe(F.col("b_source")) & (F.col("part") == F.col("b_part")))
    placed = placed.select("doc_id", "source", F.col("base") + F.col("at"), "n", "q", "width", "ids")

    def cut(batches):
        for batch in batches:
            position, n, q = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3, 4))
            row, start, length, at = plan.pieces(position, n, q)
            sums = np.empty(len(row), np.int64)
            ids, width = batch.column(6), batch.column(5).to_pylist()
            now, view = -1, memoryview(b"")
            for i, (r, a, m) in enumerate(zip(row.tolist(), (4 * start).tolist(), (4 * length).tolist(), strict=True)):
                if r != now:
                    now, view = r, memoryview(np.frombuffer(ids[r].as_buffer(), dtype=f"u{width[r]}").astype("<u4").tobytes())
                sums[i] = zlib.crc32(view[a:a + m])
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(take), pa.array(start), pa.array(length), pa.array(sums), batch.column(3).take(take),
                pa.array(at // window), pa.array(at % window), batch.column(1).take(take),
            ], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    return placed.mapInArrow(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
