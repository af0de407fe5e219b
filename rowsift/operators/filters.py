"""Row filters: E3 keep_columns, F1 filter_contains, F2 filter_any_term,
F3 filter_related, F4 distinct_values, F7 match_count / is_empty.

F1, and F2 and F3 with few values, are one narrow ``Filter`` in the scan stage:
no shuffle, no Python. Larger value sets, from a list or a DataFrame, go
through the exact keyed join of ``containment``, whose work grows with text
length and not with rows times values.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import (
    check_pattern,
    clean_term,
    contains_any,
    contains_literal,
    contains_pattern,
    text_value,
)
from ..functions.names import named
from ..session import written
from ..sources.tables import require_column
from .containment import KeyPlan, rows_containing

# Up to this many terms are tested inline in the scan stage (a balanced OR in
# generated code, each term one more pass over the text); more go through the
# exact keyed join of ``containment``. Both compare the same lower-cased texts
# in the JVM, so the rows are the same.
INLINE_TERMS = 32


def keep_columns(df: DataFrame, *cols: str) -> DataFrame:
    """The chosen source columns, unchanged (all when none are named)."""
    return df.select(*[named(c) for c in cols]) if cols else df


def term_predicate(df: DataFrame, column: str, term: str, literal: bool = False,
                   null_as: str | None = None, lower_term: bool = False) -> Column:
    """F1's predicate after the guards (column exists, term not empty, regex
    compiles). ``lower_term=True`` lower-cases a regex term first, as the
    original tool did (which flips \\D \\S \\W \\B)."""
    require_column(df, column)
    term = clean_term(term, lower=lower_term)
    if literal:
        return contains_literal(column, term, null_as)
    check_pattern(df.sparkSession, term)
    return contains_pattern(column, term, null_as)


def filter_contains(df: DataFrame, column: str, term: str, literal: bool = False,
                    null_as: str | None = None, lower_term: bool = False) -> DataFrame:
    """rows whose text contains ``term`` anywhere, ignoring case; a regex
    unless ``literal``. Null never matches unless ``null_as`` gives it a text."""
    return df.where(term_predicate(df, column, term, literal, null_as, lower_term))


def filter_any_term(df: DataFrame, column: str, terms: Iterable[str] | DataFrame,
                    null_as: str | None = None, value_col: str = "value",
                    max_list_values: int = INLINE_TERMS) -> DataFrame:
    """rows whose lower-cased text contains any lower-cased term (literal).

    Lists and DataFrames follow one rule: up to ``max_list_values`` terms are
    one inline filter, more a join; an empty term keeps every non-null text,
    null terms are ignored, no terms keep nothing.
    """
    require_column(df, column)
    return _semi_by_texts(df, column, terms, value_col, null_as, None, max_list_values)


def filter_related(df: DataFrame, column: str, term: str,
                   matches: Sequence[str] | DataFrame | None = None,
                   literal: bool = False, null_as: str | None = None,
                   value_col: str = "value", lower_term: bool = False,
                   max_list_values: int = INLINE_TERMS) -> DataFrame:
    """F1 or F2. With no matches (None, empty list) it is F1 alone."""
    f1 = term_predicate(df, column, term, literal, null_as, lower_term)
    if matches is None:
        return df.where(f1)
    return _semi_by_texts(df, column, matches, value_col, null_as, f1, max_list_values)


def _semi_by_texts(df: DataFrame, column: str, values: Iterable[str] | DataFrame, value_col: str,
                   null_as: str | None, extra: Column | None, max_list_values: int) -> DataFrame:
    """Rows whose text contains a value of ``values`` (or pass ``extra``).

    A DataFrame of values is evaluated once: its distinct values go to the
    shared folder and everything after reads those. A streaming ``df`` and
    short lists take the inline filter; larger sets go through the blocked
    containment join: candidates are found per text hash and every row is
    tested against its candidates in a left-semi join.
    """
    def inline(terms):
        pred = contains_any(column, terms, null_as)
        return df.where(pred if extra is None else (extra | pred))

    if not isinstance(values, DataFrame):
        terms = [t for t in dict.fromkeys(values) if t is not None]
        if len(terms) <= max_list_values or "" in terms or df.isStreaming:
            return inline(terms)
        spark = df.sparkSession
        values, value_col = spark.createDataFrame([(t,) for t in terms], "value string"), "value"
    vals = written(values.select(named(value_col).cast("string").alias("_rs_value"))
                   .where(F.col("_rs_value").isNotNull()).distinct(), "values")
    plan = KeyPlan(vals, "_rs_value")  # one job: how many, how long, which keys
    if plan.has_empty:
        return inline([""])
    if plan.n_values <= max_list_values:
        return inline([r[0] for r in vals.limit(max_list_values).collect()])
    return rows_containing(df, text_value(column, null_as), vals, "_rs_value", extra, plan)


def distinct_values(df: DataFrame, column: str, order_by: str | None, limit: int | None = 20,
                    null_as: str | None = None) -> DataFrame:
    """distinct texts of a column with the first ``order_by`` value that
    shows each, in first-seen order, at most ``limit`` (None = all, unsorted).
    Without ``order_by`` first seen is the place in the input order.

    Partial aggregation runs before the shuffle; ``limit`` becomes a
    TakeOrderedAndProject (top-k per partition, then merge).
    """
    require_column(df, column)
    seen = F.monotonically_increasing_id() if order_by is None else named(order_by)
    out = (df.select(text_value(column, null_as).alias("value"), seen.alias("_o"))
           .where(F.col("value").isNotNull())
           .groupBy("value").agg(F.min("_o").alias("first_seen")))
    if limit is None:
        return out
    return out.orderBy("first_seen", "value").limit(limit)


def observe_count(df: DataFrame, name: str = "rows_kept") -> tuple[DataFrame, Observation]:
    """F7 (during another action): count rows as they flow past, for free."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


def match_count(df: DataFrame) -> DataFrame:
    """F7 as a query: one row, ``rows_kept``."""
    return df.agg(F.count(F.lit(1)).alias("rows_kept"))


def is_empty(df: DataFrame) -> bool:
    """F7 early exit: reads at most one row."""
    return df.isEmpty()
