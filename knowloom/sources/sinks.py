"""Snapshot tables: upsert, insert-if-absent, cascade and writes.

Plain Parquet has no MERGE, so a change is a pure function of (old snapshot, changes) and the result
is written to a new path.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def newest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last by ``order``. ``max_by`` combines map-side, so hot keys do not pile up."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``new`` (unique by ``keys``) replaces rows of ``old``; columns in ``keep`` stay as stored.

    One full outer join: every key is touched once, in both directions.
    """
    o = old.select(F.struct(*[F.col(c) for c in old.columns]).alias("_o"), *[F.col(k) for k in keys])
    n = new.select(F.struct(*[F.col(c) for c in new.columns]).alias("_n"), *[F.col(k) for k in keys])
    joined = o.join(n, keys, "full_outer")
    cols = []
    for c in old.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c in new.columns and c not in keep:
            cols.append(F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}")).alias(c))
        elif c in new.columns:
            cols.append(F.when(F.col("_o").isNotNull(), F.col(f"_o.{c}")).otherwise(F.col(f"_n.{c}")).alias(c))
        else:
            cols.append(F.col(f"_o.{c}").alias(c))
    return joined.select(*cols)


def delete_where_in(table: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(removed.select(*keys).distinct(), keys, "left_anti")


def write_snapshot(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def append_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    w = df.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def work_folder(spark: SparkSession, name: str) -> str:
    """Fresh folder of this application below ``spark.checkpoint.dir``; below the warehouse only where that is unset (tests).

    Remove ``<folder>/knowloom-<application id>`` with the application.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{base.rstrip('/')}/knowloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Folders that :func:`materialize` wrote since the enclosing :func:`work_tables` began.
_SCOPE: ContextVar[list[str] | None] = ContextVar("work_tables", default=None)
#: Folder of each table that :func:`materialize` returned.
_FOLDER: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


@contextmanager
def work_tables(spark: SparkSession) -> Iterator[None]:
    """Tables materialized inside are removed at the end; what outlives it must have been written elsewhere by then."""
    folders: list[str] = []
    outer = _SCOPE.set(folders)
    try:
        yield
    finally:
        _SCOPE.reset(outer)
        for folder in folders:
            _remove(spark, folder)


def _remove(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(*tables: DataFrame) -> None:
    """Materialized tables that nobody reads any more leave before the end of their :func:`work_tables`, and shuffles with them."""
    for table in tables:
        _remove(table.sparkSession, _FOLDER.pop(table))
    drop_shuffles(tables[0].sparkSession)


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished queries leave now, not only when the driver happens to collect its garbage.

    Spark's cleaner removes those that nothing refers to any more, so running stages keep theirs.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into a work folder and read it back: a cut lineage and a table for several readers."""
    path = work_folder(df.sparkSession, name)
    if (folders := _SCOPE.get()) is not None:
        folders.append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDER[out] = path
    return out


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the session names; survives the loss of executors.

    Where ``spark.checkpoint.dir`` is unset and no folder was chosen yet (tests), one in the warehouse is used.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()
