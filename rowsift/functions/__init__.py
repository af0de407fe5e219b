"""Column expressions (no jobs of their own)."""

from .jsontext import (
    extract_json,
    extract_value,
    is_strict_json,
    json_span,
    parse_strict,
    strict_json,
)
from .names import free_name, has_name, named, refuse_clash
from .text import (
    check_pattern,
    clean_term,
    contains_any,
    contains_literal,
    contains_pattern,
    normalize_term,
    strip_text,
    text_value,
)
from .verdict import NOTES_FIELD, VERDICT_FIELD, notes, verdict, verdict_raw

__all__ = [
    "NOTES_FIELD", "VERDICT_FIELD", "check_pattern", "clean_term", "contains_any",
    "contains_literal", "contains_pattern", "extract_json", "extract_value", "free_name",
    "has_name", "is_strict_json",
    "json_span",
    "named", "normalize_term", "notes", "refuse_clash", "parse_strict", "strict_json", "strip_text", "text_value",
    "verdict", "verdict_raw",
]
