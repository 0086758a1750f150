"""JSON texts that hold an object or an array of objects, by variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def articles(value: Column) -> Column:
    """Array of the elements of a JSON array, or of the one other value; null
    where the text is no JSON."""
    v = F.try_parse_json(value)
    whole = F.schema_of_variant(v).startswith("ARRAY")
    return F.when(whole, F.try_variant_get(v, "$", "array<variant>")).when(v.isNotNull(), F.array(v))


def json_field(v: Column, key: str) -> tuple[Column, Column]:
    """(present, value) of a key: an absent key is not a null one."""
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string, variant>"))
    return F.coalesce(F.array_contains(keys, key), F.lit(False)), F.try_variant_get(v, f"$.{key}", "string")
