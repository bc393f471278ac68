"""Entity annotations kept as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITY_SCHEMA = "array<struct<entities: array<struct<name: string, type: string>>>>"


def dedupe_keep_last(items: Column) -> Column:
    """Distinct items; of equal ones the last keeps its place."""
    return F.reverse(F.array_distinct(F.reverse(items)))


def parse_entities(json: Column, deduplicate: bool = True, banned: str = "bild") -> Column:
    """``array<struct<text,type>>`` of the first annotation block, without names containing ``banned``.

    Null, malformed or empty JSON gives an empty array.
    """
    blocks = F.from_json(json, ENTITY_SCHEMA)
    found = F.coalesce(F.get(blocks, F.lit(0))["entities"], F.array().cast("array<struct<name:string,type:string>>"))
    kept = F.filter(found, lambda e: e["name"].isNotNull() & ~F.lower(e["name"]).contains(banned))
    named = F.transform(kept, lambda e: F.struct(e["name"].alias("text"), e["type"].alias("type")))
    return dedupe_keep_last(named) if deduplicate else named
