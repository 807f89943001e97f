"""Exact dedup by Grace hashing: partition records to spill files until a bucket fits a table comparing whole contents."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowloom.llm.shared import SPACE, text_or_empty

TABLE_BYTES = 48 << 20
FAN_OUT = 16
_UNITS = "digest binary, content binary, keep_id long, group_size long"


class ContentTable:
    """Open addressing with linear probing; equal hashes still compare the complete content."""

    def __init__(self) -> None:
        self.slots = np.full(1 << 10, -1, dtype=np.int64)
        self.hashes: list[int] = []
        self.digests: list[bytes] = []
        self.contents: list[bytes] = []
        self.keep: list[int | None] = []
        self.sizes: list[int] = []
        self.bytes = 0

    def add(self, digest: bytes, content: bytes, keep: int | None, size: int) -> None:
        h = int.from_bytes(digest[-8:], "little")
        slots, mask = self.slots, len(self.slots) - 1
        i = h & mask
        while (at := int(slots[i])) >= 0:
            if self.hashes[at] == h and self.contents[at] == content:
                self.sizes[at] += size
                if keep is not None and (self.keep[at] is None or keep < self.keep[at]):
                    self.keep[at] = keep
                return
            i = (i + 1) & mask
        slots[i] = len(self.hashes)
        self.hashes.append(h)
        self.digests.append(digest)
        self.contents.append(content)
        self.keep.append(keep)
        self.sizes.append(size)
        self.bytes += len(content) + 200
        if 2 * len(self.hashes) > len(slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, dtype=np.int64)
        mask = len(self.slots) - 1
        for at, h in enumerate(self.hashes):
            i = h & mask
            while self.slots[i] >= 0:
                i = (i + 1) & mask
            self.slots[i] = at

    def rows(self, contents: bool) -> Iterator[pa.RecordBatch]:
        step = 2000
        for a in range(0, len(self.hashes), step):
            s = slice(a, a + step)
            yield pa.RecordBatch.from_arrays([
                pa.array(self.digests[s], pa.binary()),
                pa.array(self.contents[s] if contents else [None] * len(self.digests[s]), pa.binary()),
                pa.array(self.keep[s], pa.int64()), pa.array(self.sizes[s], pa.int64()),
            ], ["digest", "content", "keep_id", "group_size"])


def _records(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _combine(table_bytes: int):
    """Map side: equal contents of a task meet in a table that is emitted when full, so hot contents travel once per task."""

    def run(batches):
        table = ContentTable()
        for digest, content, doc_id, size in _records(batches):
            table.add(digest, content, doc_id, size)
            if table.bytes > table_bytes:
                yield from table.rows(True)
                table = ContentTable()
        yield from table.rows(True)

    return run


def _spill(file, record: tuple) -> None:
    digest, content, keep, size = record
    file.write(b"".join((
        digest, len(content).to_bytes(8, "little"), b"\0" if keep is None else b"\1",
        (keep or 0).to_bytes(8, "little", signed=True), size.to_bytes(8, "little"), content,
    )))


def _unspill(file) -> Iterator[tuple]:
    file.seek(0)
    while head := file.read(57):
        n = int.from_bytes(head[32:40], "little")
        keep = int.from_bytes(head[41:49], "little", signed=True) if head[40] else None
        yield head[:32], file.read(n), keep, int.from_bytes(head[49:57], "little")


def _grace(records: Iterator[tuple], level: int, table_bytes: int) -> Iterator[ContentTable]:
    """One table while it fits; else its entries and all further records go to spill files by the next digest bits.

    The files belong to one task, have no name and vanish with it; a task that is run again writes its own.
    Distinct contents spread over the files, and equal ones cost no room, so the recursion ends for any skew.
    """
    table = ContentTable()
    for record in records:
        table.add(*record)
        if table.bytes > table_bytes and len(table.hashes) > 1 and level < 60:
            break
    else:
        yield table
        return
    files = [tempfile.TemporaryFile() for _ in range(FAN_OUT)]
    try:
        def part(digest: bytes) -> int:
            return (digest[level // 2] >> (4 * (level % 2))) & 15

        for x in zip(table.digests, table.contents, table.keep, table.sizes, strict=True):
            _spill(files[part(x[0])], x)
        del table
        for x in records:
            _spill(files[part(x[0])], x)
        for f in files:
            yield from _grace(_unspill(f), level + 1, table_bytes)
    finally:
        for f in files:
            f.close()


def content_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Distinct contents of ``docs`` (doc_id, digest, content) -> digest, keep_id, group_size."""

    def buckets(batches):
        for table in _grace(_records(batches), 0, table_bytes):
            yield from table.rows(False)

    rows = docs.select("digest", "content", F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).cast("long").alias("n"))
    units = rows.mapInArrow(_combine(table_bytes), _UNITS)
    groups = units.repartition("digest").mapInArrow(buckets, _UNITS)
    return groups.select("digest", "keep_id", "group_size")


def with_content(docs: DataFrame) -> DataFrame:
    """Adds the normalised text (runs of ASCII white space become one space; null counts as empty) and its SHA-256."""
    out = docs.withColumn("_norm", F.regexp_replace(text_or_empty(), SPACE, " "))
    return out.withColumn("_digest", F.unhex(F.sha2("_norm", 256)))


def exact_duplicates(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts are found by whole content; the smallest doc_id of a group stays, and of repeated rows with that id
    every one is marked kept (``drop_duplicates`` keeps one). A group whose ids are all null has keep_id null and kept
    true. The shuffle carries each content once per task; the rows then join their group's digest, and adaptive
    execution splits a digest that holds a large share of them. Other columns are not read.
    """
    base = with_content(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    groups = content_groups(base.select("doc_id", F.col("_digest").alias("digest"), F.col("_norm").cast("binary").alias("content")), table_bytes)
    members = base.select("doc_id", F.col("_digest").alias("digest"))
    return members.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``docs`` with its columns, one row for each content: that of the smallest doc_id.

    Rows that repeat both id and content are the same document; one of them, chosen by a hash of its columns, stays.
    """
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    base = with_content(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row))
    groups = content_groups(base.select("doc_id", F.col("_digest").alias("digest"), F.col("_norm").cast("binary").alias("content")), table_bytes)
    copied = groups.filter("group_size > 1").select(F.col("digest").alias("_d"), "keep_id")
    rows = base.select("doc_id", "_digest", "_row").join(copied, F.col("_digest") == F.col("_d"), "left")
    single = rows.filter("_d is null").select("_row.*")
    kept = rows.filter(F.col("_d").isNotNull() & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    kept = kept.groupBy("_digest").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row.*")
    return single.union(kept)
