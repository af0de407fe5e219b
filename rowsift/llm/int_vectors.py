"""Vectors as integers, and the exact sums that integer clustering needs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_frames

#: Squared distances below this are exact in double precision.
EXACT = 1 << 53


def finite(vector: str) -> Column:
    """The vector is there and all its components are numbers (null: false)."""
    ok = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                  & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(ok, F.lit(False))


def floored(vector: str, scale: int, dims: int) -> Column:
    """floor(scale * x) of every component, as integers.

    A component so large that squared distances over ``dims`` components
    would leave 64 bits fails the job with a message: no figure could be
    returned for it."""
    limit = float(min(1 << 30, int((2 ** 60 / max(1, dims)) ** 0.5)))
    scaled = F.transform(F.col(vector), lambda x: x.cast("double") * float(scale))
    wide = F.exists(scaled, lambda x: F.abs(x) >= limit)
    error = F.raise_error(F.lit(f"a component times {scale} is beyond {limit:.0f}: its distance is no long"))
    return F.when(wide, error.cast("array<int>")).otherwise(F.transform(scaled, lambda x: F.floor(x).cast("int")))


def stacked(column, dims: int) -> np.ndarray:
    return np.stack(list(column)).astype(np.int64) if len(column) else np.empty((0, dims), np.int64)


def squared_distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to a few centres (integers).

    One matrix product where every value in it stays below 2 ** 53, so that
    doubles hold it exactly; else differences in 64-bit integers."""
    if not len(points):
        return np.empty((0, len(centres)), np.int64)
    top = int(max(np.abs(points).max(), np.abs(centres).max(), 1))
    if 4 * top * top * points.shape[1] < EXACT:
        p, c = points.astype(np.float64), centres.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2.0 * (p @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centres], axis=1)


def summed(df: DataFrame, partial, keys: str) -> dict:
    """``{keys: (n, sums)}`` over all rows, by exact integer sums.

    ``partial(frames)`` yields frames of ``(*keys, n, sums)`` with few rows per
    task; Spark adds them up. What comes back is a row per key and component."""
    names = [k.split()[0] for k in keys.split(", ")]
    parts = map_frames(df, partial, f"{keys}, n long, sums array<long>")
    rows = (parts.select(*names, "n", F.posexplode("sums").alias("pos", "x"))
            .groupBy(*names, "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect())
    out: dict = {}
    for r in sorted(rows, key=lambda r: tuple(r)[:len(names) + 1]):
        out.setdefault(tuple(r[k] for k in names), (r["n"], []))[1].append(r["x"])
    return out


def partial_frame(names: list[str], rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[*names, "n", "sums"])


def floor_means(n: int, sums: list[int]) -> list[int]:
    return [s // n for s in sums]
