"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsift.session import ship_package, written


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back (see ``session.written``)."""
    return written(df, f"llm/{name}")


def _give_back() -> None:
    """Return freed memory to the system: Python workers live on between
    tasks, and what a batch of long texts took stays with the allocators."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _tidy(fn):
    def run(items):
        try:
            yield from fn(items)
        finally:
            _give_back()

    return run


def map_frames(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInPandas`` after making this package importable on executors."""
    ship_package(df.sparkSession)
    return df.mapInPandas(_tidy(fn), schema)


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` likewise: columns that pass through keep their exact values, nulls too."""
    ship_package(df.sparkSession)
    return df.mapInArrow(_tidy(fn), schema)


def utf8(texts) -> Iterator[bytes]:
    """Texts of a pandas column as UTF-8; null is the empty text."""
    for t in texts:
        yield t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
