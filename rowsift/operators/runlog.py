"""K6: the run log, what was done and how many rows.

Counts come from ``Observation`` metrics gathered during the actions the run
performs anyway (no extra pass). The log itself is a handful of rows per run,
turned into a DataFrame and appended to a log folder.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from ..sources.adds import add_files

LOG_SCHEMA = "step string, message string, rows long, ts timestamp"


class RunLog:
    """Collects ``(step, message, rows, ts)`` entries for one run."""

    def __init__(self) -> None:
        self.entries: list[tuple] = []

    def add(self, step: str, message: str, rows: int | None = None) -> None:
        self.entries.append((step, message, None if rows is None else int(rows),
                             dt.datetime.now(dt.timezone.utc)))

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.entries, LOG_SCHEMA)

    def append(self, spark: SparkSession, path: str, add_id: str | None = None) -> None:
        """Add the entries to a log folder; with ``add_id`` once, however often it is called."""
        add_files(self.to_df(spark).coalesce(1), path, "parquet", add_id)

    def messages(self) -> list[str]:
        return [m for _, m, _, _ in self.entries]
