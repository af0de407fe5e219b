"""Readers, metadata, document assembly and result writers."""

from .documents import assemble_document
from .tables import (
    DEFAULT_COLUMN,
    DEFAULT_TABLE,
    default_column,
    list_columns,
    list_table_names,
    list_tables,
    read_many,
    read_table,
    require_column,
)
from .writers import (
    add_table,
    append_json,
    append_table,
    json_records_form,
    output_names,
    read_json,
    write_json,
    write_results,
    write_table,
)

__all__ = [
    "DEFAULT_COLUMN", "DEFAULT_TABLE", "add_table", "append_json", "append_table", "assemble_document",
    "json_records_form", "default_column", "list_columns", "list_table_names", "list_tables",
    "output_names", "read_json", "read_many", "read_table", "require_column", "write_json",
    "write_results", "write_table",
]
