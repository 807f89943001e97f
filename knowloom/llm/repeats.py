"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere, by a run-length index."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowloom.functions.skew import hot_join
from knowloom.llm.run_index import RunIndex
from knowloom.llm.shared import materialize

LENGTH, GRAM = 200, 80
MAX_GROUP = 8192
BATCH_BYTES = 1_500_000
_CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_ANCHORS = "a long, b long, key long, ctx long, start int, more array<int>, windows int, head int"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & 0xFFFFFFFFFFFFFFFF))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Anchors:
    """Splits the windows of ``length`` bytes of a text into runs that share their anchor.

    The anchor of a window is its leftmost gram of least hash, so it depends on the window alone: equal windows, wherever
    they start, have equal anchors at the same distance. Every window lies in exactly one run.
    """

    def __init__(self, length: int, gram: int) -> None:
        self.length, self.gram = length, gram
        self.up, self.down = _powers(_BASE, _CHUNK + length), _powers(_INVERSE, _CHUNK + length)
        mixed = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64)
        self.table = mixed * np.uint64(2) + np.uint64(1)

    def runs(self, text: bytes):
        """key, first window, windows, bytes from the first window to the anchor: arrays."""
        found = [self._chunk(text, a) for a in range(0, max(1, len(text) - self.length + 1), _CHUNK)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _chunk(self, text: bytes, first: int):
        data = np.frombuffer(text, np.uint8, min(len(text) - first, _CHUNK + self.length - 1), first)
        if len(data) < self.length:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:len(data)], out=total[1:])
        h = (total[self.gram:] - total[:-self.gram]) * self.down[:len(data) - self.gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        low = np.uint64((1 << 20) - 1)
        packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        w = self.length - self.gram + 1
        least, size = packed, 1
        while 2 * size <= w:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        n = len(packed) - w + 1
        least = np.minimum(least[:n], least[w - size:w - size + n])
        at = (least & low).astype(np.int64)
        begin = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        return h[at[begin]].view(np.int64), first + begin, np.diff(np.concatenate([begin, [n]])), at[begin] - begin


def _keyed(docs: DataFrame) -> DataFrame:
    """a, b (a 128-bit key of id and text; rows that repeat both share it and have the same result), doc_id, text as bytes."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("b"), "doc_id", "text")


def _find_anchors(length: int, gram: int):
    def run(batches):
        finder = Anchors(length, gram)
        names = ["a", "b", "key", "ctx", "start", "more", "windows", "head"]
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[] for _ in names]
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                key, start, windows, head = finder.runs(text)
                if not len(key):
                    continue
                digest = xxhash.xxh3_64_intdigest
                stop = (start + windows + (length - 1)).tolist()
                ctx = np.fromiter((digest(text[s:e]) for s, e in zip(start.tolist(), stop, strict=True)), np.uint64, len(key)).view(np.int64)
                order = np.lexsort((start, ctx, key))
                k, c = key[order], ctx[order]
                new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]))
                counts = np.diff(np.concatenate([new, [len(k)]]))
                first = order[new]
                out[0] += [a[i]] * len(first)
                out[1] += [b[i]] * len(first)
                for column, x in zip(out[2:5], (key, ctx, start), strict=True):
                    column.append(x[first])
                more: list = [None] * len(first)
                for j in np.flatnonzero(counts > 1).tolist():
                    more[j] = start[order[new[j] + 1:new[j] + counts[j]]]
                out[5] += more
                out[6].append(windows[first])
                out[7].append(head[first])
            flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (out[2], out[3], out[4], out[6], out[7])]
            yield pa.RecordBatch.from_arrays([
                pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(flat[0]), pa.array(flat[1]),
                pa.array(flat[2].astype(np.int32)), pa.array(out[5], pa.list_(pa.int32())),
                pa.array(flat[3].astype(np.int32)), pa.array(flat[4].astype(np.int32)),
            ], names)

    return run


def _index(length: int):
    """Batches of whole key groups (rows sorted by key) -> windows of each context that start elsewhere too, as runs."""

    def solve(rows: list[tuple]):
        index = RunIndex([r[4] for r in rows])
        long = index.matching_statistics() >= length
        ranges = []
        for r, a in zip(rows, index.starts.tolist(), strict=True):
            hit = np.ones(r[3], bool) if r[2] > 1 else long[a:a + r[3]]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            ranges.append((edge[::2].tolist(), edge[1::2].tolist()))
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
            pa.array([x for x, _ in ranges], pa.list_(pa.int32())), pa.array([y for _, y in ranges], pa.list_(pa.int32())),
        ], ["key", "ctx", "lo", "hi"])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > BATCH_BYTES and row[0] != rows[-1][0]:
                    yield from solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield from solve(rows)

    return run


def _contexts(length: int):
    """Texts with their wanted runs -> key, ctx, n, windows, bytes."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text = text.as_py()
                for w in wanted:
                    for column, x in zip(out, (w["key"], w["ctx"], w["n"], w["windows"], text[w["start"]:w["start"] + w["windows"] + length - 1]), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)],
                                             ["key", "ctx", "n", "windows", "data"])

    return run


def _cut(docs_columns: list[str]):
    """Texts with the covered byte ranges -> counts and the digest of what is left."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for doc_id, text, ranges in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py()
                pairs = np.array([(r["lo"], r["hi"]) for r in ranges or []], np.int64).reshape(-1, 2)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                digest, at, removed, spans = hashlib.sha256(), 0, 0, 0
                if len(pairs):
                    reach = np.maximum.accumulate(pairs[:, 1])
                    new = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
                    begin = pairs[new, 0]
                    stop = reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(pairs) - 1]])]
                    for x, y in zip(begin.tolist(), stop.tolist(), strict=True):
                        digest.update(text[at:x])
                        at = y
                        removed += y - x
                    spans = len(begin)
                digest.update(text[at:])
                for column, x in zip(out, (doc_id, len(text), removed, spans, digest.hexdigest()), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (*[pa.int64()] * 4, pa.string()), strict=True)], docs_columns)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, max_group: int = MAX_GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text).

    Each byte covered by a string of ``length`` bytes that also starts elsewhere, in the same or another document, is
    removed; strings are judged on the input and never cross documents. Null texts are empty, short ones stay whole,
    repeated rows are copies of each other, null ids are rows like others, an empty table gives none.

    1. Windows of ``length`` bytes are split by anchor into runs (about one for every (length - gram) / 2 bytes), each
       with a hash of the anchor and one of its whole context. Equal windows share the anchor, so an anchor seen once
       proves a stretch unique without comparing it further.
    2. Of repeated anchors the different contexts are counted. Where all contexts of an anchor are equal they are one
       run of copies and need no index. The others fetch one copy of their bytes, and tasks index whole anchor groups:
       matching statistics of ``length`` or more mark the windows that start elsewhere.
    3. An anchor with more than ``max_group`` different contexts (a frequent short line in different surroundings) is
       split by whole windows, which are counted by hash: no group has to fit in one task.
    4. Marked windows go back to the documents that hold their context; a task merges the ranges of a document.
    """
    rows = _keyed(docs)
    anchors = materialize(rows.select("a", "b", "text").mapInArrow(_find_anchors(length, gram), _ANCHORS), "repeats-anchors")
    times = F.lit(1) + F.coalesce(F.when(F.col("more").isNotNull(), F.size("more")), F.lit(0))
    repeated = anchors.select("key", times.alias("n")).groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key")
    near = materialize(hot_join(anchors, repeated, ["key"], "left_semi"), "repeats-candidates")
    seen = near.groupBy("key", "ctx").agg(F.sum(times).alias("n"), F.min(F.struct("a", "b", "start", "windows", "head")).alias("at"))
    seen = materialize(seen.select("key", "ctx", "n", "at.*"), "repeats-contexts")
    groups = seen.groupBy("key").agg(F.count(F.lit(1)).alias("different")).filter("different > 1")
    mixed = hot_join(seen, groups, ["key"])

    wanted = mixed.groupBy("a", "b").agg(F.collect_list(F.struct("key", "ctx", "n", "start", "windows")).alias("wanted"))
    texts = rows.select("a", "b", "text").join(wanted, ["a", "b"]).select("text", "wanted")
    contexts = texts.mapInArrow(_contexts(length), "key long, ctx long, n long, windows int, data binary")
    contexts = materialize(contexts.dropDuplicates(["key", "ctx"]), "repeats-bytes")
    small = hot_join(contexts, groups.filter(F.col("different") <= max_group).select("key"), ["key"], "left_semi")
    marks = small.repartition("key").sortWithinPartitions("key").mapInArrow(_index(length), "key long, ctx long, lo array<int>, hi array<int>")
    large = hot_join(contexts, groups.filter(F.col("different") > max_group).select("key"), ["key"], "left_semi")
    marks = marks.union(_by_window(large, length))
    same = hot_join(seen, groups, ["key"], "left_anti").filter("n > 1").select(
        "key", "ctx", F.array(F.lit(0)).alias("lo"), F.array("windows").alias("hi"))
    marks = marks.filter("size(lo) > 0").union(same)

    starts = F.concat(F.array("start"), F.coalesce("more", F.array().cast("array<int>")))
    hits = hot_join(near.select("key", "ctx", "a", "b", starts.alias("starts")), marks, ["key", "ctx"])
    each = hits.select("a", "b", F.explode("starts").alias("s"), "lo", "hi").select("a", "b", "s", F.explode(F.arrays_zip("lo", "hi")).alias("r"))
    ranges = each.select("a", "b", F.struct((F.col("s") + F.col("r.lo")).alias("lo"), (F.col("s") + F.col("r.hi") + (length - 1)).alias("hi")).alias("r"))
    ranges = ranges.groupBy("a", "b").agg(F.collect_set("r").alias("ranges"))
    joined = rows.join(ranges, ["a", "b"], "left").select("doc_id", "text", "ranges")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return joined.mapInArrow(_cut(names), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _by_window(contexts: DataFrame, length: int) -> DataFrame:
    """The marks of contexts whose group is too large to index: equal windows meet by their 128-bit hash and are counted."""

    def windows(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for key, ctx, n, count, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i in range(count):
                    h = xxhash.xxh3_128_intdigest(data[i:i + length])
                    for column, x in zip(out, (key, ctx, n, i, _long(h >> 64), _long(h & 0xFFFFFFFFFFFFFFFF)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                ["key", "ctx", "n", "i", "h1", "h2"])

    each = contexts.select("key", "ctx", "n", "windows", "data").mapInArrow(windows, "key long, ctx long, n long, i int, h1 long, h2 long")
    twice = each.groupBy("h1", "h2").agg(F.sum("n").alias("_n")).filter("_n > 1").select("h1", "h2")
    found = hot_join(each, twice, ["h1", "h2"], "left_semi")
    return found.groupBy("key", "ctx").agg(F.sort_array(F.collect_set("i")).alias("lo")).select(
        "key", "ctx", "lo", F.transform("lo", lambda i: i + F.lit(1)).alias("hi"))


def _long(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x
