"""Joins and ranks that hold when one key owns a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

SALTS = 16
BROADCAST_ROWS = 200_000


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Checked size bound of a small side. The count stops at ``rows`` + 1."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, small: bool) -> DataFrame:
    """Broadcast a side whose bound was checked, else leave the choice to the optimizer."""
    return F.broadcast(df) if small else df


def hot_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int = 1) -> DataFrame:
    """Null-safe equi-join whose left side may hold a large share of its rows under one key.

    With ``salts=1`` it is a plain shuffle join: adaptive execution splits the oversized partition of
    ``big`` into several tasks, and neither side is replicated. Pass ``salts`` where ``small`` has few
    rows (sources, owners, question terms): keys of ``big`` then spread over ``salts`` partitions up
    front and ``small`` is replicated once per salt. ``how`` keeps ``big`` on the left, so inner, left,
    left_semi and left_anti are all exact.
    """
    keys = list(on)
    if salts > 1:
        cols = [F.col(f.name) for f in big.schema.fields if _is_atomic(f)]
        big = big.withColumn("_salt", F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int"))
        small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys.append("_salt")
    right = small.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in small.columns])
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys])
    return big.join(right, cond, how).drop("_salt", *[f"_r_{c}" for c in keys])


def _is_atomic(f) -> bool:
    return isinstance(f.dataType, AtomicType)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key.

    The filter on ``row_number`` becomes a WindowGroupLimit that already runs before the shuffle, so
    a hot key sends at most ``k`` rows per input partition.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def attach_rows(parents: DataFrame, rows: DataFrame, key: str, name: str) -> DataFrame:
    """One row per parent and attached row, which becomes the struct ``name``; null for a parent without any.

    The shape is the same at every size and no group is gathered. ``rows`` stands on the splittable side of
    an inner join, so a key with a large share of them does not end in one task. The struct is put together
    behind the join, so fields that nobody reads are not moved.
    """
    items = [c for c in rows.columns if c != key]
    kinds = rows.select(F.struct(*items).alias(name)).schema[name].dataType
    met = hot_join(rows.select(key, *[F.col(c).alias(f"_i_{c}") for c in items]), parents, [key])
    met = met.select(*parents.columns, F.struct(*[F.col(f"_i_{c}").alias(c) for c in items]).alias(name))
    alone = hot_join(parents, rows.select(key).distinct(), [key], "left_anti")
    return met.unionByName(alone.select(*parents.columns, F.lit(None).cast(kinds).alias(name)))
