"""Strict JSON payloads: exact keys and types, and a stable encoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_json(entries: Column) -> Column:
    """A map as compact JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def has_exactly(payload: Column, keys: tuple[str, ...]) -> Column:
    """Whether the payload is a JSON object with these keys and no others."""
    found = F.array_sort(F.json_object_keys(payload))
    return F.coalesce(F.try_parse_json(payload).isNotNull() & (found == F.array(*(F.lit(k) for k in sorted(keys)))), F.lit(False))


def has_types(payload: Column, types: dict[str, tuple[str, ...]]) -> Column:
    """Whether each key's value has one of the given variant types."""
    fine = F.lit(True)
    for name, kinds in types.items():  # names may be paths
        kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(payload), f"$.{name}", "variant"))
        fine = fine & F.coalesce(kind.isin(*kinds), F.lit("VOID" in kinds))
    return fine
