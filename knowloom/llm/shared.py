"""Helpers of several operators: written intermediate tables and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; only where it is unset, one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{folder.rstrip('/')}/knowloom-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    It cuts the lineage, fixes the rows of steps whose order or row ids a second run could change, and survives the
    loss of executors. The folder carries the application id, so that it can be removed with the application.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what runs inside: both ends hold whole batches of texts or sets beside their own work."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    least = rows if int(before) <= 0 else min(rows, int(before))
    spark.conf.set(name, str(least))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_dir(df.sparkSession))
    return df.checkpoint()


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) long edges -> (node, component), the smallest node reachable; nodes without an edge to another are absent.

    Alternating large-star and small-star steps: every round rewires edges towards smaller neighbours, so that long
    chains shrink in a logarithmic number of rounds. Each round is two grouped minima, whose hot keys combine
    map-side, and joins that adaptive execution splits; the edge table is checkpointed between rounds. Stops when a
    round changes nothing. Empty input gives an empty table.
    """
    def pairs(df: DataFrame) -> DataFrame:
        return df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now = checkpointed(pairs(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))))
    before = None
    for _ in range(max_rounds):
        # Large star: each larger neighbour of a node is linked to the smallest one of its neighbourhood.
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = pairs(large)
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = checkpointed(pairs(small.union(least.select("a", F.col("m").alias("b")))))
        size = new.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if before == tuple(size):
            now = new
            break
        before, now = tuple(size), new
    else:
        raise RuntimeError("components did not converge")
    star = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return star.union(star.select(F.col("component").alias("node"), "component").distinct())
