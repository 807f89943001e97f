"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowloom.functions.skew import hot_join, is_small

TERMS = 80
MAX_PART = 16.0


def uniform(seed: int | Column, *keys: Column) -> Column:
    """Hash-seeded number in [0, 1) with 52 bits, the same on every run and engine."""
    text = F.concat_ws("|", seed if isinstance(seed, Column) else F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_count(u: Column, rate: Column) -> Column:
    """Smallest k with u < P(X <= k) for X ~ Poisson(rate): the inverse of the distribution at ``u``."""
    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("c"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * rate / i.cast("double")
        return F.when(u < s["c"], s).otherwise(F.struct(i.alias("k"), p.alias("p"), (s["c"] + p).alias("c")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["k"])


def poisson_draw(seed: int, rate: Column, *keys: Column) -> Column:
    """Poisson count of any rate: up to ``MAX_PART`` one inversion, above it the sum of inversions of equal parts, each with its own hash seed."""
    parts = F.ceil(rate / F.lit(MAX_PART)).cast("int")

    def add(total: Column, i: Column) -> Column:
        return total + poisson_count(uniform(F.concat(F.lit(f"{seed}."), i.cast("string")), *keys), rate / parts)

    many = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), add)
    return F.when(rate <= MAX_PART, poisson_count(uniform(seed, *keys), rate)).otherwise(many)


def source_rates(docs: DataFrame, temperature: float = 0.7, targets: dict[str, float] | None = None, growth: float = 1.0,
                 max_rate: float | None = None) -> DataFrame:
    """source, amount (characters), rate: the mean repetitions that bring each source to its share.

    Target shares are ``targets`` or, without them, proportional to amount ** temperature; the whole mixture has
    ``growth`` times the characters of the input. Sources without a target or without text keep rate 1 (``targets``) or
    are weighed as one character. Rates are not bounded, so that every source reaches its share; a caller may ask for a
    bound of at most 16 with ``max_rate`` and then misses the targets of sources above it.
    """
    if max_rate is not None and not 0 < max_rate <= MAX_PART:
        raise ValueError("max_rate must lie in (0, 16]")
    amounts = docs.groupBy("source").agg(F.greatest(F.sum(F.length(F.coalesce("text", F.lit("")))), F.lit(1)).cast("double").alias("amount"))
    if targets is None:
        shares = amounts.withColumn("weight", F.pow("amount", F.lit(float(temperature))))
    else:
        known = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]) if targets else F.lit(None).cast("map<string,double>")
        shares = amounts.withColumn("weight", known[F.col("source")].cast("double"))
    total = shares.filter("weight is not null").agg(
        F.coalesce(F.sum("weight"), F.lit(1.0)).alias("w"), F.coalesce(F.sum("amount"), F.lit(1.0)).alias("a")).first()
    rate = F.lit(growth * total["a"] / total["w"]) * F.col("weight") / F.col("amount")
    rate = F.coalesce(rate, F.lit(1.0))
    # Rounded, so that the order in which weights were summed never decides a draw.
    return shares.select("source", "amount", F.round(rate if max_rate is None else F.least(rate, F.lit(max_rate)), 9).alias("rate"))


def poisson_mixture(docs: DataFrame, seed: int = 1, **shares) -> DataFrame:
    """The rows of ``docs`` repeated: row (its columns), copy (1..count), mix_rate, mix_key; count is Poisson with the source's rate.

    The draw depends on seed, doc_id and source alone, so a repeated row is repeated as often as its twin. Rows come
    back in a global random order: range-partitioned and sorted by ``mix_key``, a hash of document and copy, so no key
    of the input decides where rows go. Null sources are a source of their own; an empty table stays empty. The rates
    are broadcast if there are few sources; else rows of a hot source are salted before the join.
    """
    rates = source_rates(docs, **shares).select("source", F.col("rate").alias("mix_rate"))
    rows = docs.select("doc_id", "source", F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    small = is_small(rates, 20_000)
    joined = hot_join(rows, F.broadcast(rates) if small else rates, ["source"], salts=1 if small else 16)
    drawn = joined.withColumn("n", poisson_draw(seed, F.col("mix_rate"), F.col("doc_id"), F.col("source")))
    out = drawn.filter("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string")))
    return out.withColumn("mix_key", key).orderBy("mix_key").select("row", "copy", "mix_rate", "mix_key")


def tail_of(rate: float) -> float:
    """P(X > TERMS) for X ~ Poisson(rate): what the bound on the inverted terms leaves out."""
    term, total = math.exp(-rate), 0.0
    for k in range(TERMS + 1):
        total += term
        term *= rate / (k + 1)
    return max(0.0, 1.0 - total)
