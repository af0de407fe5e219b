"""Column names: quoting, and names that are still free in a table.

Headers are taken as they are, so ``Dose (mg.)`` or ``Dx.name`` are columns
like any other; Spark reads an unquoted dot as a field of a struct.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(c: str | Column) -> Column:
    """The top-level column of exactly this name (a Column passes through)."""
    return F.col("`" + c.replace("`", "``") + "`") if isinstance(c, str) else c


def has_name(name: str, taken: Iterable[str]) -> bool:
    """Is ``name`` among ``taken``, as Spark resolves names (ignoring case)?"""
    return name.lower() in {t.lower() for t in taken}


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, or ``name_1``, ``name_2``, ... : the first that is not taken."""
    names = list(taken)
    out, n = name, 1
    while has_name(out, names):
        out, n = f"{name}_{n}", n + 1
    return out


def refuse_clash(taken: Iterable[str], *new: str) -> None:
    """Added columns never replace a source column: a clash is an error."""
    clash = [n for n in new if has_name(n, taken)]
    if clash:
        raise ValueError(f"the table already has the columns {', '.join(clash)}; choose other names for the added ones")
