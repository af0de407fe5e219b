"""Guideline documents assembled from their pages.

One output row per document: the page texts in page order joined by ``sep``;
a null page text counts as an empty page (its separator is kept).

Scale: pages are first joined per (document, page range) so that the pages
of one long document are sorted and concatenated by many tasks; the second
step only moves one partial text per range. ``collect_list`` order is not
defined, so both steps sort by page number explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import named


def _sorted_join(items: Column, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["t"]), sep)


def assemble_document(pages: DataFrame, doc: str = "doc_id", page_no: str = "page_no",
                      text: str = "text", sep: str = "\n",
                      pages_per_part: int | None = 1024) -> DataFrame:
    """Return ``(doc, text)``: each document's pages joined in page order."""
    t = F.coalesce(named(text).cast("string"), F.lit(""))
    p = named(page_no)
    keyed = pages.select(named(doc).alias("_rs_doc"), p.alias("p"), t.alias("t"))
    if pages_per_part:
        keyed = (keyed.groupBy("_rs_doc", F.floor(F.col("p") / pages_per_part).alias("_rs_part"))
                 .agg(F.min("p").alias("p"), _sorted_join(F.collect_list(F.struct("p", "t")), sep).alias("t")))
    return (keyed.groupBy("_rs_doc").agg(_sorted_join(F.collect_list(F.struct("p", "t")), sep).alias("_rs_text"))
            .select(F.col("_rs_doc").alias(doc), F.col("_rs_text").alias(text)))
