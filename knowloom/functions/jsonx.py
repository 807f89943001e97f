"""JSON strings used as semi-structured payload columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(payload: Column, name: str) -> Column:
    return F.get_json_object(payload, f"$.{name}")


def has_key(payload: Column, name: str) -> Column:
    """True when the top-level key is present, also when its value is JSON null."""
    return F.coalesce(F.array_contains(F.json_object_keys(payload), name), F.lit(False))


def merge(old: Column, new: Column) -> Column:
    """Top-level JSON object merge, new keys win. Values keep their JSON type."""
    kind = "map<string,variant>"
    left = F.coalesce(F.from_json(old, kind), F.create_map().cast(kind))
    right = F.coalesce(F.from_json(new, kind), F.create_map().cast(kind))
    kept = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))
    return F.to_json(F.map_concat(kept, right))


def string_array(payload: Column, name: str) -> Column:
    raw = F.from_json(field(payload, name), "array<string>")
    return F.coalesce(raw, F.array().cast("array<string>"))
