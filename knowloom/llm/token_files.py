"""Token-id files: whole texts as ids in document order, in blocks of the context-mixing range coder."""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knowloom.functions.skew import is_small, small_side
from knowloom.llm import range_coder, tokens
from knowloom.llm.shared import work_dir

BLOCK_IDS = 1024
WAVE_BLOCKS = 2048
_FILE = "shard int, block long, doc_no array<long>, doc_id array<long>, at array<long>, length array<long>, begin array<long>, data binary"
_PARTS = "shard int, doc_no long, doc_id long, at long, length long, begin long, crc long"


def _blocks(batches, path: str, end_id: int, spaces: str, block_ids: int) -> Iterator[tuple[list, np.ndarray]]:
    """Blocks of a partition: the document pieces in it (number, id, start in the document, length, start in the shard) and its ids."""
    pieces: list[tuple] = []
    ids: list[np.ndarray] = []
    room, number, begin = block_ids, 0, 0
    for batch in batches:
        names = batch.column(0).to_pylist()
        encoded, code = tokens.encode_all(path, batch.column(1).to_pylist(), spaces)
        end = array(code, [end_id]).tobytes()
        for name, data in zip(names, encoded, strict=True):
            x = np.frombuffer(data + end, dtype=f"u{len(end)}")
            at = 0
            while at < len(x):
                n = min(room, len(x) - at)
                pieces.append((number, name, at, n, begin))
                ids.append(x[at:at + n])
                at += n
                room -= n
                if not room:
                    yield pieces, np.concatenate(ids)
                    pieces, ids, room = [], [], block_ids
            number += 1
            begin += len(x)
    if ids:
        yield pieces, np.concatenate(ids)


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int, spaces: str = tokens.WHOLE, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all documents in ascending doc_id order (null first) to ``folder``.

    A shard is one range of doc_ids; its blocks hold ``block_ids`` ids each, cut regardless of documents, and the pieces
    of documents in them. The container is Parquet, so that any store Spark can write to takes it; a block's ids are in
    its ``data`` alone, self-contained and checksummed. Ranges are cut by (doc_id, text hash), so that neither a hot id
    nor one value decides a task's size. Only full waves of blocks are in memory.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")

    def run(batches):
        shard = TaskContext.get().partitionId()
        first, wave = 0, []

        def coded():
            width = wave[0][1].dtype.itemsize
            data = range_coder.encode_blocks([x for _, x in wave], width)
            for a in range(0, len(wave), 256):
                part = [p for p, _ in wave[a:a + 256]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard] * len(part), pa.int32()), pa.array(range(first + a, first + a + len(part)), pa.int64()),
                    *[pa.array([[piece[i] for piece in p] for p in part], pa.list_(pa.int64())) for i in range(5)],
                    pa.array(data[a:a + 256], pa.binary()),
                ], ["shard", "block", "doc_no", "doc_id", "at", "length", "begin", "data"])

        for block in _blocks(batches, path, end_id, spaces, block_ids):
            wave.append(block)
            if len(wave) == WAVE_BLOCKS:
                yield from coded()
                first, wave = first + len(wave), []
        if wave:
            yield from coded()

    ordered.mapInArrow(run, _FILE).write.parquet(folder)


def read_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The document pieces of all blocks with the CRC-32 of their ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, WAVE_BLOCKS):
                part = batch.slice(a, WAVE_BLOCKS)
                crcs, shards, columns = [], [], [[] for _ in range(5)]
                decoded = range_coder.decode_blocks(part.column(7).to_pylist())
                lists = [part.column(i).to_pylist() for i in range(2, 7)]
                for i, (shard, ids) in enumerate(zip(part.column(0).to_pylist(), decoded, strict=True)):
                    view, at = memoryview(ids.astype("<u4").tobytes()), 0
                    for n in lists[3][i]:
                        crcs.append(zlib.crc32(view[4 * at:4 * (at + n)]))
                        at += n
                    shards += [shard] * len(lists[3][i])
                    for c, x in zip(columns, lists, strict=True):
                        c += x[i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards, pa.int32()), *[pa.array(c, pa.int64()) for c in columns], pa.array(crcs, pa.int64())],
                    ["shard", "doc_no", "doc_id", "at", "length", "begin", "crc"])

    return spark.read.schema(_FILE).parquet(folder).mapInArrow(run, _PARTS)


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC-32 polynomial (reflected)."""
    out = 0
    while b:
        if b & (1 << 31):
            out ^= a
        b = (b << 1) & 0xFFFFFFFF
        a = (a >> 1) ^ (0xEDB88320 if a & 1 else 0)
    return out


_POWERS: list[int] = [1 << 30]


def crc_join(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two byte strings put together, from their own CRC-32 and the length of the second."""
    bits, k, shift = 8 * second_bytes, 0, 1 << 31
    while bits:
        while len(_POWERS) <= k:
            _POWERS.append(_times(_POWERS[-1], _POWERS[-1]))
        if bits & 1:
            shift = _times(_POWERS[k], shift)
        bits >>= 1
        k += 1
    return _times(shift, first) ^ second


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Blocks are decoded where they are read. A document cut by block edges is put together from the checksums of its
    pieces, of which it has as many as blocks. Shard sizes, one row each, give the global starts.
    """
    pieces = read_pieces(spark, folder)
    whole = pieces.groupBy("shard", "doc_no").agg(
        F.first("doc_id").alias("doc_id"), F.min("begin").alias("begin"), F.sum("length").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("at", "length", "crc"))).alias("parts"))

    def joined(batches):
        for batch in batches:
            crcs = []
            for parts in batch.column(4).to_pylist():
                crc = parts[0]["crc"]
                for p in parts[1:]:
                    crc = crc_join(crc, p["crc"], 4 * p["length"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array(crcs, pa.int64())],
                                             ["shard", "doc_id", "begin", "n_tokens", "ids_crc32"])

    rows = whole.select("shard", "doc_id", "begin", "n_tokens", "parts").mapInArrow(joined, "shard int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    lengths = spark.read.schema(_FILE).parquet(folder).select("shard", F.aggregate("length", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    sizes = lengths.groupBy("shard").agg(F.sum("n").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    bases = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(small_side(bases, is_small(bases)), "shard").select(
        "doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def token_round_trip(docs: DataFrame, path: str, end_id: int, spaces: str = tokens.WHOLE, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write the files into the shared folder and report every document from them.

    Null texts are empty and have the end id alone; repeated rows and null ids are documents of their own. An empty
    table writes an empty file set.
    """
    folder = f"{work_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_tokens(docs, path, folder, end_id, spaces, block_ids)
    return read_documents(docs.sparkSession, folder)
