"""Verdict and notes read from one reply record.

A record is a VARIANT object. Its verdict field may be text, a JSON boolean,
JSON null, another JSON type, or missing:

  text      -> lower(strip(text)) == "true"
  boolean   -> kept
  null      -> null
  missing   -> false
  other     -> null, with the raw JSON kept in ``verdict_raw``
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import named
from .text import strip_text

# The two fields the reviewer is asked to add to every record.
VERDICT_FIELD = "Meets Guidelines"
NOTES_FIELD = "Notes on Compliance"


def _path(field: str) -> str:
    return '$["' + field.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def field_value(record: str | Column, field: str) -> Column:
    """The field as VARIANT (SQL null when the key is missing)."""
    return F.try_variant_get(named(record), _path(field), "variant")


def verdict(record: str | Column, field: str = VERDICT_FIELD) -> Column:
    """Boolean verdict of a record, following the table in the module notes."""
    v = field_value(record, field)
    kind = F.schema_of_variant(v)
    as_text = F.try_variant_get(v, "$", "string")
    return (
        F.when(v.isNull(), F.lit(False))
        .when(kind == "STRING", F.lower(strip_text(as_text)) == F.lit("true"))
        .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .otherwise(F.lit(None).cast("boolean"))
    )


def verdict_raw(record: str | Column, field: str = VERDICT_FIELD) -> Column:
    """Raw JSON of a verdict that is neither text, boolean, null nor missing."""
    v = field_value(record, field)
    kind = F.schema_of_variant(v)
    return F.when(v.isNotNull() & ~kind.isin("STRING", "BOOLEAN", "VOID"), F.to_json(v))


def notes(record: str | Column, field: str = NOTES_FIELD) -> Column:
    """Notes text of a record (non-text JSON given as its JSON text)."""
    v = field_value(record, field)
    kind = F.schema_of_variant(v)
    return (
        F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
        .when(v.isNotNull() & (kind != "VOID"), F.to_json(v))
    )
