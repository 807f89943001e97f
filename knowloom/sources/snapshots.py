"""Bucketed snapshot tables: an upsert reads the stored side bucket by bucket, without a shuffle."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from knowloom.sources.sinks import upsert


@dataclass(frozen=True)
class Snapshot:
    """One version of a keyed table: Parquet files in ``path``, dealt by ``keys`` into ``buckets`` that are sorted by them."""

    path: str
    schema: StructType
    keys: tuple[str, ...]
    buckets: int

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows. The session catalog learns the layout, so that joins on the keys need no exchange on this side."""
        name = "snapshot_" + re.sub(r"\W", "_", self.path)[-60:] + "_" + uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        keys = ", ".join(f"`{k}`" for k in self.keys)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        return spark.table(name)


def write(rows: DataFrame, path: str, keys: tuple[str, ...], buckets: int = 64) -> Snapshot:
    """Store ``rows`` (unique by ``keys``) as a snapshot. Rows that come dealt by the keys into as many partitions are not moved again."""
    name = "writing_" + uuid.uuid4().hex
    rows.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").option("path", path).saveAsTable(name)
    stored = rows.sparkSession.table(name).schema
    rows.sparkSession.sql(f"DROP TABLE {name}")  # forgets the name; files of a table with a path stay
    return Snapshot(path, stored, tuple(keys), buckets)


def upserted(old: Snapshot, changes: DataFrame, path: str, keep: tuple[str, ...] = ()) -> Snapshot:
    """The next version: ``changes`` (unique by the keys) replace stored rows, columns in ``keep`` stay as stored.

    Only the changes are shuffled, to the buckets of the stored side; the join's partitions are written as buckets as they are.
    """
    spark = changes.sparkSession
    merged = upsert(old.read(spark), changes.repartition(old.buckets, *old.keys), list(old.keys), keep)
    return write(merged, path, old.keys, old.buckets)
