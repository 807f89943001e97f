"""Small plan-shaping helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    The generator keeps the optimizer from inlining a costly expression into every place that uses it.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def spread(table: DataFrame) -> DataFrame:
    """Use all cores for CPU-heavy work on a table with few input splits.

    Only for tables read directly from files. A large table has more splits than cores and is left as it
    is, so no shuffle is added at scale.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
