"""Requests for a scorer: M1 build_match_requests, M2 render_records,
M3 build_requests.

Batches are cut from dense row ids (F6), so a batch never exceeds ``batch``
items whatever the key distribution, and the same rows always land in the
same batch (retries never re-send different content). Each batch is one
small group; ``collect_list`` order is undefined, so items are sorted.

With a byte budget, batches are cut by a prefix sum of the records' bytes over
the row ids. Row ids fall into blocks of ``BLOCK_ROWS``; inside a block a
window adds up bytes, and records whose sum begins in the same half budget are
a batch. A record of more than half the budget is a batch of its own, so a
batch holds less than half a budget and one record of at most that much: none
passes the budget but a single record that does. Blocks are independent, so
the sum is distributed, and window and grouping share one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import named
from ..session import spread
from .rowid import with_row_id

# The wording of the two requests (ours).
MATCH_HEAD = ('Which of these values of column "{column}" mean the same as, or relate to, '
              '"{term}"?\nAnswer with one JSON object: {{"matches": [the related values, '
              'exactly as written], "explanation": "a short reason"}}.\nValues:\n')
REVIEW_HEAD = "Guideline:\n"
REVIEW_MID = ('\n\nRecords where column "{column}" relates to "{term}", '
              "one JSON object per line:\n")
REVIEW_TAIL = ('\n\nReply with a JSON list holding one object per record: all of its fields '
               'unchanged, plus "Meets Guidelines" ("True" if it fully or partially meets '
               'the guideline, else "False") and "Notes on Compliance" (a short reason).')


def _batched(df: DataFrame, row_id: str, item: Column, batch: int) -> DataFrame:
    """(batch_id, row_ids, items) with items in row-id order."""
    if batch < 1:
        raise ValueError("batch must be >= 1")
    grouped = (df.groupBy(F.floor(named(row_id) / F.lit(batch)).cast("long").alias("batch_id"))
               .agg(F.array_sort(F.collect_list(F.struct(named(row_id).alias("i"),
                                                         item.alias("v")))).alias("_items")))
    return grouped.select("batch_id",
                          F.transform("_items", lambda x: x["i"]).alias("row_ids"),
                          F.transform("_items", lambda x: x["v"]).alias("items"))


BLOCK_ROWS = 8192


def _packed(df: DataFrame, row_id: str, item: Column, batch: int, max_bytes: int) -> DataFrame:
    """(batch_id, row_ids, items), at most ``batch`` items and ``max_bytes``
    bytes each (an item counts its UTF-8 bytes and a line end); ``batch_id`` is
    the first row id."""
    if batch < 1 or max_bytes < 1:
        raise ValueError("batch and max_bytes must be >= 1")
    i, half = F.col("i"), max_bytes // 2
    rows = (df.select(named(row_id).cast("long").alias("i"), item.alias("v"))
            .withColumn("size", F.octet_length("v") + 1)
            .withColumn("block", F.floor(i / F.lit(BLOCK_ROWS)).cast("long")))
    own = Window.partitionBy("block").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    large = F.col("size") > half
    # large records take no part in the sum: the small ones beside them stay together
    at = F.sum(F.when(large, F.lit(0)).otherwise(F.col("size"))).over(own) - F.col("size")
    rows = (rows.withColumn("cell", F.when(~large, F.floor(at / F.lit(max(half, 1))).cast("long")))
            .withColumn("alone", F.when(large, i)))
    turn = F.row_number().over(Window.partitionBy("block", "cell", "alone").orderBy("i")) - 1
    grouped = (rows.withColumn("turn", F.floor(turn / F.lit(batch)).cast("long"))
               .groupBy("block", "cell", "alone", "turn").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_items")))
    return grouped.select(F.get(F.col("_items"), F.lit(0))["i"].alias("batch_id"),
                          F.transform("_items", lambda x: x["i"]).alias("row_ids"),
                          F.transform("_items", lambda x: x["v"]).alias("items"))


def build_match_requests(values: DataFrame, term: str, column: str, batch: int = 20,
                         order_by: str = "first_seen", value_col: str = "value") -> DataFrame:
    """M1: candidate values (F4 output, no limit) into match requests of
    ``batch`` values each: ``(batch_id, n_values, prompt)``."""
    ided = with_row_id(values, order_by, name="_rs_vid")
    head = MATCH_HEAD.format(column=column, term=term)
    return (_batched(ided, "_rs_vid", named(value_col), batch)
            .select("batch_id", F.size("items").cast("long").alias("n_values"),
                    F.concat(F.lit(head), F.array_join("items", "\n")).alias("prompt")))


def render_records(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """M2: each row as one JSON object with every column, nulls written:
    ``(row_id, record)``."""
    return df.select(named(row_id),
                     F.to_json(F.struct(*[named(c) for c in df.columns]),
                               {"ignoreNullFields": "false"}).alias("record"))


def guideline_text(guideline: str | DataFrame, text_col: str = "text") -> str:
    """The one guideline text: a string, or a one-row DataFrame (checked).

    It is a single document that every request repeats, so its size is set by
    what a scorer takes, not by the data."""
    if isinstance(guideline, str):
        return guideline
    rows = guideline.select(named(text_col).alias("t")).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected exactly one guideline document, found {len(rows)}+")
    return rows[0]["t"] or ""


def build_requests(records: DataFrame, guideline: str | DataFrame, term: str, column: str,
                   batch: int = 50, row_id: str = "row_id", record_col: str = "record",
                   partitions: int | None = None, max_bytes: int | None = None, whole: bool = True) -> DataFrame:
    """M3: guideline + a batch of records + instructions, one request per
    ``batch`` rows: ``(batch_id, row_ids, n_records, prompt)``.

    ``max_bytes`` bounds the bytes of a request's records too; a single record
    beyond it is a request of its own. Then ``batch_id`` is the first row id.
    ``whole=False`` gives ``head``, ``body`` and ``tail`` in place of
    ``prompt``, which a scorer puts together: what is written between holds the
    guideline once a file.

    Batches of records are dealt round-robin over ``partitions`` tasks, and
    only behind that exchange does the guideline, a constant, join them: what
    moves are records and row ids. Hand the frame to ``score_requests`` as it is.
    """
    head = REVIEW_HEAD + guideline_text(guideline) + REVIEW_MID.format(column=column, term=term)
    item = named(record_col)
    batches = _batched(records, row_id, item, batch) if max_bytes is None else _packed(records, row_id, item, batch, max_bytes)
    body = F.array_join("items", "\n")
    parts = [F.lit(head).alias("head"), body.alias("body"), F.lit(REVIEW_TAIL).alias("tail")]
    return (spread(batches, partitions)
            .select("batch_id", "row_ids", F.size("items").cast("long").alias("n_records"),
                    *([F.concat(F.lit(head), body, F.lit(REVIEW_TAIL)).alias("prompt")] if whole else parts)))
