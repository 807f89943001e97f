"""Dense-vector columns (array<double>)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    length = norm(v)
    return F.when(length == 0, v.cast("array<double>")).otherwise(
        F.transform(v, lambda x: x.cast("double") / length)
    )


def hash_embedding(dimension: int):
    """Pseudo-embedding of a text column: chained sha256 digests read as big-endian uint32 in [-1, 1).

    The first digest is made in the JVM, so that digests and not texts move to Python and back.
    """
    import hashlib

    rounds = -(-dimension // 8)

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for digests in batches:
            out = []
            for digest in digests:
                if digest is None:
                    out.append(None)
                    continue
                buf = bytearray(digest)
                for _ in range(rounds - 1):
                    digest = hashlib.sha256(digest).digest()
                    buf += digest
                v = np.frombuffer(bytes(buf), dtype=">u4")[:dimension].astype("float64") / 2**32 * 2 - 1
                length = float(np.sqrt((v * v).sum()))
                out.append(v / length if length else v)
            yield pd.Series(out, index=digests.index)

    return lambda text: embed(F.unhex(F.sha2(text.cast("binary"), 256)))


def hash_embedding_sql(text: Column, dimension: int) -> Column:
    """The same embedding as one JVM expression (no Python worker)."""
    rounds = -(-dimension // 8)
    digests = F.aggregate(
        F.sequence(F.lit(1), F.lit(max(rounds - 1, 1))),
        F.array(F.sha2(text, 256)),
        lambda acc, _: F.array_append(acc, F.sha2(F.unhex(F.element_at(acc, -1)), 256)),
    )

    def word(h: Column, k: Column) -> Column:
        raw = F.conv(F.substring(h, k * 8 + 1, F.lit(8)), 16, 10).cast("double")
        return raw / F.lit(float(2**32)) * 2 - 1

    values = F.flatten(
        F.transform(digests, lambda h: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: word(h, k)))
    )
    return unit(F.slice(values, 1, dimension))
