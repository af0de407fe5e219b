"""Text expressions: the text form of a value (E1), term clean-up (E2) and the
contains predicates behind the filters (F1, F2).

Everything here returns a ``Column`` built from Spark's own functions, so it
runs inside whole-stage codegen, on batch and on streaming DataFrames alike.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .names import named

# Java regex flags for the contains test. (?i) ignore case,
# (?u) Unicode-aware case folding (so É matches é), (?U) Unicode classes for
# \w \d \s \b (so \w matches é), mirroring Python's `re` on str patterns.
REGEX_FLAGS = "(?iuU)"
# Leading/trailing white space as Python's str.strip() sees it.
STRIP_PATTERN = r"(?U)^\s+|\s+$"


def text_value(col: str | Column, null_as: str | None = None) -> Column:
    """Any column as text (Spark's cast form). Null stays null unless
    ``null_as`` is given (``"nan"``/``"None"`` reproduce pandas' text of a null)."""
    txt = named(col).cast("string")
    return txt if null_as is None else F.coalesce(txt, F.lit(null_as))


def strip_text(col: str | Column) -> Column:
    """Remove leading and trailing white space of any kind (tab, newline, ...)."""
    return F.regexp_replace(named(col), STRIP_PATTERN, "")


def normalize_term(col: str | Column, lower: bool = False) -> Column:
    """A search term column made clean: stripped; lower-cased on request
    (for literal terms; a regex term keeps its case so \\D stays \\D)."""
    out = strip_text(col)
    return F.lower(out) if lower else out


def clean_term(term: str, lower: bool = False) -> str:
    """E2 on the driver for a single parameter value."""
    if term is None:
        raise ValueError("A search term is needed.")
    out = term.strip()
    if not out:
        raise ValueError("A search term is needed.")
    return out.lower() if lower else out


def check_pattern(spark: SparkSession, pattern: str) -> None:
    """Fail early, on the driver, for a regex Java cannot compile.

    A bad pattern inside a job would only fail late inside the tasks; a
    constant ``'' RLIKE pattern`` is folded at planning time instead, so the
    error surfaces here before any data is read.
    """
    try:
        spark.sql("SELECT '' RLIKE :p AS ok", args={"p": REGEX_FLAGS + pattern}).collect()
    except AnalysisException as err:  # INVALID_PARAMETER_VALUE.PATTERN
        raise ValueError(f"Invalid search pattern {pattern!r}: {err}") from None
    except Exception as err:  # pragma: no cover - other JVM-side failures
        if "PATTERN" in str(err) or "PatternSyntax" in str(err):
            raise ValueError(f"Invalid search pattern {pattern!r}: {err}") from None
        raise


def contains_pattern(col: str | Column, pattern: str, null_as: str | None = None) -> Column:
    """F1 predicate: text contains the regex ``pattern`` anywhere, ignoring case."""
    return text_value(col, null_as).rlike(REGEX_FLAGS + pattern)


def contains_literal(col: str | Column, term: str, null_as: str | None = None) -> Column:
    """F1 predicate with ``literal=True``: plain substring, ignoring case."""
    return F.lower(text_value(col, null_as)).contains(F.lower(F.lit(term)))


def _any(tests: list[Column]) -> Column:
    """OR of tests as a balanced tree (depth log2 of their number)."""
    while len(tests) > 1:
        tests = [tests[i] | tests[i + 1] if i + 1 < len(tests) else tests[i] for i in range(0, len(tests), 2)]
    return tests[0]


def contains_any(col: str | Column, terms: Iterable[str], null_as: str | None = None) -> Column:
    """F2 predicate: lower-cased text contains any lower-cased term (literal).

    One balanced OR of ``contains`` tests in generated code. Text and terms are
    lower-cased by the same engine, so a term matches alike in a list and in a
    DataFrame. An empty list keeps nothing; an empty term keeps every non-null
    text.
    """
    txt = text_value(col, null_as)
    wanted = [t for t in dict.fromkeys(terms) if t is not None]
    if not wanted:
        return F.lit(False)
    if "" in wanted:
        return txt.isNotNull()
    low = F.lower(txt)
    return _any([low.contains(F.lower(F.lit(t))) for t in wanted])
