"""JSON payload lookups on a VARIANT column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Places searched for a key, in order.
LEVELS = ("$", "$.event", "$.action.value")


def _type_of(payload: Column, path: str) -> Column:
    """Type name of the value at ``path``: null when missing, VOID for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(payload, path, "variant"))


def first_scalar(payload: Column, *keys: str) -> Column:
    """Struct (value, type) of the first scalar found; a JSON null also ends the search."""
    found = None
    for level in LEVELS:
        for key in keys:
            path = f"{level}.{key}"
            kind = _type_of(payload, path)
            hit = kind.isNotNull() & ~kind.rlike("^(OBJECT|ARRAY)")
            value = F.struct(
                F.try_variant_get(payload, path, "string").alias("value"), kind.alias("type")
            )
            found = F.when(hit, value) if found is None else found.when(hit, value)
    return found


def is_filled(scalar: Column) -> Column:
    """True unless the value is missing, null, empty, zero or false."""
    value, kind = scalar["value"], scalar["type"]
    nothing = kind.rlike("^(ARRAY|OBJECT)") & value.isin("[]", "{}")
    zero = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (value.try_cast("double") == 0)
    false = (kind == "BOOLEAN") & (value == "false")
    return F.coalesce(value.isNotNull() & (value != "") & ~zero & ~false & ~nothing, F.lit(False))


def string_map(json_text: Column) -> Column:
    """JSON object as map of strings; other values stay JSON text, a null is the text ``null``."""
    found = F.from_json(json_text, "map<string,string>")
    return F.transform_values(found, lambda _, value: F.coalesce(value, F.lit("null")))
