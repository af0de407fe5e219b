"""dense 0-based row ids in the order of a key, without funnelling all rows
through one task.

One plan for every size and key type:
  1. rows whose place in the input is not known yet are written once with it
     (partition and place in the partition, in one long), so that ties have
     one order whatever is run again later;
  2. one aggregation measures rows and bytes (skipped when the caller knows
     both); they give the number of range partitions, at most
     ``rows_per_part`` rows and ``PART_BYTES`` each on average. Rows alone make
     no more than ``MAX_PARTS``: each partition sends the driver its sample and
     its task's end, so a count by rows would grow that with the input. Bytes
     still make as many as it takes, which is what bounds a task;
  3. rows are range-partitioned by the key and, last, the place (bounds
     sampled by Spark), sorted, and written once with their partition and
     their place in it. So rows that share a key value, or are equal in all
     columns, spread over partitions and keep their first-seen order;
  4. rows per partition, one small row each, become running offsets, and the
     ids are offset + place, by a join with that small table.

The ids come from the written rows: readers, retries and lost executors all
see the same ids, also where the key is not unique. The input order is the one
Spark reads files in: that of the rows inside a file; of several files the
larger come first.
"""

from __future__ import annotations

import math
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import named, refuse_clash
from ..session import written

ROWS_PER_PART = 1_000_000
PART_BYTES = 128 << 20
MAX_PARTS = 1024
PLACE = "_rs_place"


def _width(f: T.StructField) -> Column:
    """Bytes of a value, as far as they can vary."""
    c = named(f.name)
    if isinstance(f.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.length(F.to_json(F.struct(c))), F.lit(0)) + 16
    return F.lit(16)


def _parts(df: DataFrame, rows_per_part: int, stats: dict | None) -> int:
    width = F.lit(0)
    for f in df.schema.fields:
        if not isinstance(f.dataType, T.VariantType):
            width = width + _width(f)
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("bytes")).first()
    if stats is not None:
        stats["rows"] = int(size["rows"])
    by_rows = min(MAX_PARTS, math.ceil(size["rows"] / max(1, rows_per_part)))
    return max(1, by_rows, math.ceil(size["bytes"] / PART_BYTES))


def with_place(df: DataFrame, name: str = PLACE) -> DataFrame:
    """``df`` with each row's place in its input order; write it before it is used twice."""
    refuse_clash(df.columns, name)
    return df.withColumn(name, F.monotonically_increasing_id())


def with_row_id(df: DataFrame, order_by: str | Sequence[str] | None = None, name: str = "row_id",
                rows_per_part: int = ROWS_PER_PART, stats: dict | None = None, place: str | None = None,
                write: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... in ascending order of ``order_by``, nulls
    first, rows of equal keys in input order; without ``order_by`` all rows in
    input order.

    ``place`` names a column of a written ``df`` that holds the input order
    (``with_place``; it is not returned); without it ``df`` is written once
    more to fix it. ``stats``, when given, receives ``rows`` (the row count,
    F7). A column of the new name in ``df`` is an error, not replaced.
    """
    refuse_clash([c for c in df.columns if c != place], name)
    keys = [order_by] if isinstance(order_by, str) else list(order_by or [])
    if place is None:
        place = PLACE
        df = written(with_place(df), "placed")
    parts = _parts(df, rows_per_part, stats)
    order = [*[named(k) for k in keys], named(place)]
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = write(df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                   .withColumn("_rs_part", F.spark_partition_id()).withColumn("_rs_at", at).drop(place), "row-ids")
    counts = ranged.groupBy("_rs_part").agg(F.count(F.lit(1)).alias("_rs_n"))  # one row per partition
    before = Window.orderBy("_rs_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_rs_part", F.coalesce(F.sum("_rs_n").over(before), F.lit(0)).alias("_rs_offset"))
    return (ranged.join(F.broadcast(offsets), "_rs_part")  # a row per about PART_BYTES of data
            .withColumn(name, F.col("_rs_offset") + F.col("_rs_at"))
            .drop("_rs_part", "_rs_at", "_rs_offset"))
