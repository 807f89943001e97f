"""Approximate vector search: random-projection buckets, several probes a question, exact scores inside the buckets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from knowloom.functions.skew import is_small, small_side, top_k
from knowloom.operators.retrieval import CHUNK_BLOCK, QUERY_BLOCK, _block, _local_top, _unit_rows

MAX_BITS = 12
PER_BUCKET = 256
SHARE = 0.3


def planes(bits: int, dimension: int, seed: int) -> np.ndarray:
    """Normal vectors of ``bits`` random hyperplanes, the same in every task and run."""
    return np.random.default_rng([seed, bits, dimension]).standard_normal((bits, dimension))


def _projections(column: pa.Array, rows: int, bits: int, seed: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(rows, -1)
    return _unit_rows(flat) @ planes(bits, flat.shape[1], seed).T


def _with_bucket(rows: DataFrame, column: str, bits: int, probes: int, seed: int) -> DataFrame:
    """Adds ``bucket``: the side of every hyperplane as bits. With ``probes`` > 1 a row is repeated for the nearest buckets.

    A bucket is the nearer the less a vector would have to move across the planes whose bits differ.
    """
    schema = rows.withColumn("bucket", F.lit(0)).schema
    arrow = to_arrow_schema(schema)
    place = rows.columns.index(column)
    flips = ((np.arange(1 << bits)[:, None] >> np.arange(bits)) & 1).astype("float64")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _projections(batch.column(place), batch.num_rows, bits, seed)
            own = ((x >= 0) << np.arange(bits)).sum(axis=1)
            if probes == 1:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], schema=arrow)
                continue
            step = max(1, (1 << 22) >> bits)
            for a in range(0, len(own), step):
                cost = np.abs(x[a:a + step]) @ flips.T
                near = np.argpartition(cost, probes - 1, axis=1)[:, :probes] if probes < 1 << bits else np.tile(np.arange(1 << bits), (len(cost), 1))
                take = pa.array(np.repeat(np.arange(a, a + len(cost)), near.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(take) for c in batch.columns], pa.array((near ^ own[a:a + step, None]).ravel().astype(np.int32))], schema=arrow)

    return rows.mapInArrow(run, schema)


def _numbered(c: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(c), n).cast("int")


def approximate_search(
    chunks: DataFrame, questions: DataFrame, limit: int = 20, bits: int | None = None, share: float = SHARE, seed: int = 7,
    query_block: int = QUERY_BLOCK, chunk_block: int = CHUNK_BLOCK,
) -> DataFrame:
    """Near cosine top-``limit`` per question over the owner's embedded chunks; scores are exact.

    ``chunks(owner_id, chunk_id, embedding)``, ``questions(query_id, owner_id, vector)``. ``bits`` hyperplanes deal unit vectors
    to 2**bits buckets (by default about 256 chunks a bucket, at most 4096 buckets). A question reads the ``share`` of buckets
    that are nearest to it. Every chunk moves once, to its bucket; a question goes to its probed buckets and to no other
    chunk. A bucket of over ``chunk_block`` chunks, such as one of equal vectors, is cut into blocks. Ask ``share=1`` for
    the exact result. Null vectors and those with null components take no part; vectors of other dimensions never meet.
    """
    rows = chunks.filter("embedding is not null").select("owner_id", "chunk_id", "embedding").filter(F.forall("embedding", lambda x: x.isNotNull()))
    asked = questions.filter("vector is not null").select("query_id", "owner_id", "vector").filter(F.forall("vector", lambda x: x.isNotNull()))
    counts = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a dimension in use
    types = {f.name: f.dataType.simpleString() for f in [*rows.schema.fields, *asked.schema.fields]}
    out_schema = f"query_id {types['query_id']}, chunk_id {types['chunk_id']}, score double"
    local = chunks.sparkSession.createDataFrame([], out_schema)
    for dimension, n in sorted(map(tuple, counts)):
        b = min(MAX_BITS, max(1, int(math.log2(max(2, n / PER_BUCKET))))) if bits is None else bits
        probes = max(1, min(1 << b, math.ceil(share * (1 << b))))
        mine = _with_bucket(rows.filter(F.size("embedding") == dimension), "embedding", b, 1, seed)
        theirs = _with_bucket(asked.filter(F.size("vector") == dimension), "vector", b, probes, seed)
        # At most 2**MAX_BITS rows each.
        blocks = mine.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / chunk_block).cast("int").alias("c_blocks"))
        crowds = theirs.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("q_blocks"))
        sizes = F.broadcast(blocks.join(crowds, "bucket"))
        left = mine.join(sizes, "bucket").withColumn("cb", _numbered("chunk_id", F.col("c_blocks"))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
        right = theirs.join(sizes, "bucket").withColumn("qb", _numbered("query_id", F.col("q_blocks"))).withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("c_blocks") - 1)))
        key = ["bucket", "cb", "qb"]
        cells = left.select(*key, "owner_id", "chunk_id", "embedding").groupBy(*key).cogroup(right.select(*key, "query_id", "owner_id", "vector").groupBy(*key))
        local = local.union(cells.applyInPandas(_cell(limit), out_schema))
    best = top_k(local, ["query_id"], [F.desc("score"), F.col("chunk_id")], limit)
    return best.withColumn("match_type", F.lit("semantic"))


def _cell(k: int):
    def cell(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, tuple] = {}
        if len(c) and len(q):
            block = _block(q["query_id"].tolist(), q["owner_id"].tolist(), np.stack(q["vector"].to_list()))
            _local_top(c["chunk_id"].to_numpy(), np.stack(c["embedding"].to_list()).astype("float64"), c["owner_id"].to_numpy(), block, k, held)
        if not held:
            return pd.DataFrame(columns=["query_id", "chunk_id", "score"])
        return pd.concat([pd.DataFrame({"query_id": block["ids"][p], "chunk_id": i, "score": s}) for p, (i, s) in held.items()])

    return cell


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact list that was found, per question."""
    hit = found.select("query_id", "chunk_id", F.lit(1).alias("_hit"))
    met = exact.select("query_id", "chunk_id").join(small_side(hit, is_small(hit)), ["query_id", "chunk_id"], "left")
    return met.groupBy("query_id").agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))
