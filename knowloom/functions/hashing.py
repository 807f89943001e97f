"""Deterministic ids and fingerprints: reruns of any job give the same keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(part: Column | str) -> Column:
    c = F.lit(part) if isinstance(part, str) else part
    return F.coalesce(c.cast("string"), F.lit(""))


def fingerprint(*parts: Column | str) -> Column:
    """sha256 over the ``|``-joined parts; a null part counts as the empty string."""
    return F.sha2(F.concat_ws("|", *[_text(p) for p in parts]), 256)


def stable_id(kind: str, *parts: Column | str) -> Column:
    """Id derived from a natural key; ``kind`` keeps tables apart."""
    return fingerprint(F.lit(kind), *parts)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)
