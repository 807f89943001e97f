"""Chunk embedding with a pluggable embedder and a deterministic fallback."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowloom.functions.vectors import hash_embedding

HASH_MODEL = "hash-embedding-dev"
DIMENSION = 1536


def embed(
    chunks: DataFrame,
    dimension: int = DIMENSION,
    embedder: Callable[[Column], Column] | None = None,
    model: str | None = None,
) -> DataFrame:
    """Adds ``embedding``, ``embedding_model`` and ``embedding_dimension``.

    ``embedder`` is any column function (for example a pandas UDF). Rows where it yields null get the
    hash embedding, and their model name says so. Equal texts are embedded once per row: no shuffle.
    """
    fallback = hash_embedding(dimension)
    if embedder is None:
        return chunks.withColumns(
            {
                "embedding": fallback(F.col("text")),
                "embedding_model": F.lit(HASH_MODEL),
                "embedding_dimension": F.lit(dimension),
            }
        )
    first = chunks.withColumn("_v", embedder(F.col("text")))
    failed = F.col("_v").isNull() | (F.size("_v") != dimension)
    return (
        first.withColumn("_failed", failed)
        .withColumn("_h", fallback(F.when(F.col("_failed"), F.col("text"))))
        .withColumns(
            {
                "embedding": F.when(F.col("_failed"), F.col("_h")).otherwise(F.col("_v")),
                "embedding_model": F.when(F.col("_failed"), HASH_MODEL).otherwise(F.lit(model)),
                "embedding_dimension": F.lit(dimension),
            }
        )
        .drop("_v", "_h", "_failed")
    )


def guarded(call: Callable[[list[str]], list[list[float] | None]], breaker: int = 5, retry_rows: int = 1, pause: float = 0.0):
    """Column function around a model call that may raise: rows it fails on become null, so that :func:`embed` hashes them.

    ``call`` takes a list of texts. A batch that raises is halved until only the rows that fail remain (``retry_rows``: the
    smallest part that is still tried). After ``breaker`` failed single parts in a row the task gives the model up for the rest of its rows, so
    that a service that is down costs each task a bounded number of calls. ``pause`` seconds pass after a failure.
    """
    state = {"failed": 0}

    def part(texts: list[str]) -> list[list[float] | None]:
        if state["failed"] >= breaker:
            return [None] * len(texts)
        try:
            found = call(texts)
            if len(found) != len(texts):
                raise ValueError("one vector per text is expected")
            state["failed"] = 0
            return found
        except Exception:  # noqa: BLE001  whatever the model raises, its rows get the hash embedding
            if pause:
                time.sleep(pause)
            if len(texts) <= retry_rows:
                state["failed"] += 1
                return [None] * len(texts)
            half = len(texts) // 2
            return part(texts[:half]) + part(texts[half:])

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        state["failed"] = 0
        for texts in batches:
            given = [i for i, t in enumerate(texts) if t is not None]
            out: list[list[float] | None] = [None] * len(texts)
            for i, v in zip(given, part([texts.iloc[i] for i in given]) if given else [], strict=True):
                out[i] = v
            yield pd.Series(out, index=texts.index)

    return run
