"""Options of each file format, the same for every reader and writer, so what
one writes another reads back: headers and column names, nulls, empty text."""

from __future__ import annotations

READ = {
    "csv": {"header": "true", "escape": '"'},
    "json": {},
}
WRITE = {
    "csv": {"header": "true", "escape": '"'},
    "json": {"ignoreNullFields": "false"},
}


def read_options(format: str, schema=None, multi_line: bool = False) -> dict:
    """Options to read ``format``; without a schema CSV types are inferred.

    A CSV file is split among tasks at line ends, so fields must not hold any;
    ``multi_line`` reads such files too, each by one task."""
    options = dict(READ.get(format.lower(), {}))
    if multi_line:
        options["multiLine"] = "true"
    if format.lower() == "csv" and schema is None:
        options["inferSchema"] = "true"
    return options


def write_options(format: str) -> dict:
    return dict(WRITE.get(format.lower(), {}))
