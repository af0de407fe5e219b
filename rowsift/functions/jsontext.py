"""JSON found inside free text (R1) and its strict validation.

A reply from a scorer is free text that should hold one JSON value. The rule
to find it: the span from the first ``[`` to the last ``]`` (newlines
included); only when there is no such span, the span from the first ``{`` to
the last ``}``. A span that is not valid JSON gives null; there is no second
try once a span was found. ``prefer="object"`` swaps the two spans (used for
match replies, whose expected shape is an object).

Validity is strict: ``try_parse_json`` alone accepts a first value followed
by junk (``[1] x``), so one wrapper is not enough (``[true]-1]`` reads as
``[true]``). Text ``x`` is accepted only when both ``[x]`` and ``{"v":x}``
parse: after the first value, the array needs ``,`` or ``]`` and the object
``,`` or ``}``; after a ``,`` the array needs a value and the object a key
and ``:``. So both parse only when ``x`` is exactly one value. That value is
field ``v`` of the second parse, so there is no third parse. Duplicate keys
and NaN/Infinity are rejected (Python's ``json`` would accept them).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import named

# The two spans searched for, DOTALL so they cross newlines.
ARRAY_SPAN = r"(?s)\[.*\]"
OBJECT_SPAN = r"(?s)\{.*\}"


def _wrapped(t: Column) -> tuple[Column, Column]:
    return (F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))),
            F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}"))))


def parse_strict(text: str | Column) -> Column:
    """VARIANT of a text that is exactly one JSON value, else null (see the
    module notes: two wrapped parses, the value taken from the second)."""
    as_item, as_field = _wrapped(named(text))
    # null when the second parse fails; a test for that would parse once more
    return F.when(as_item.isNotNull(), F.try_variant_get(as_field, "$.v", "variant"))


def is_strict_json(text: str | Column) -> Column:
    """True when the whole text is exactly one JSON value (surrounding white
    space allowed), false otherwise, null for null."""
    t = named(text)
    as_item, as_field = _wrapped(t)
    return F.when(t.isNull(), F.lit(None)).otherwise(as_item.isNotNull() & as_field.isNotNull())


def strict_json(text: str | Column) -> Column:
    """The text itself when it is strictly one JSON value, else null."""
    t = named(text)
    return F.when(is_strict_json(t), t)


def json_span(text: str | Column, prefer: str = "array") -> Column:
    """The span R1 looks at, not yet validated: first ``[`` to last ``]``;
    only when there is none, first ``{`` to last ``}`` (swapped for
    ``prefer="object"``). Null when neither exists."""
    if prefer not in ("array", "object"):
        raise ValueError("prefer must be 'array' or 'object'")
    t = named(text)
    arr = F.regexp_substr(t, F.lit(ARRAY_SPAN))
    obj = F.regexp_substr(t, F.lit(OBJECT_SPAN))
    first, second = (arr, obj) if prefer == "array" else (obj, arr)
    return F.coalesce(first, second)


def extract_json(text: str | Column, prefer: str = "array") -> Column:
    """The JSON text inside a reply, or null. See the module notes."""
    return strict_json(json_span(text, prefer))


def extract_value(text: str | Column, prefer: str = "array") -> Column:
    """R1 as a VARIANT (the parsed JSON of :func:`extract_json`), or null."""
    return parse_strict(json_span(text, prefer))
