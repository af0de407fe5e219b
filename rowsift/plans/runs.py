"""Steps of a run that can be taken up again.

A run has an id that the caller gives and a folder under it. Each finished
step leaves its table there and then a manifest file with the folder, schema
and number of rows; a step that died leaves no manifest, and its half-written
folder is never looked at. A restart under the same id reads what finished
steps left and goes on behind them. The parameters of the run are noted first:
the same id with others is refused.

Without an id the steps are plain intermediate tables that go with the run.
"""

from __future__ import annotations

import json
import re
import uuid
from typing import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..files import create_new, delete, listing, read_text, write_text
from ..session import checkpoint_base, written


class Run:
    """One run: ``table`` for steps that make rows, ``value`` for steps with effects."""

    def __init__(self, spark: SparkSession, run_id: str | None = None, folder: str | None = None, **parameters):
        self.spark, self.id = spark, run_id
        self.rows: dict[str, int] = {}
        if run_id is None:
            return
        if not re.fullmatch(r"[A-Za-z0-9._-]+", run_id):
            raise ValueError(f"a run id has letters, digits, dot, dash and underscore, not {run_id!r}")
        self.folder = f"{(folder or checkpoint_base(spark) + '/rowsift/runs').rstrip('/')}/{run_id}"
        mine = json.dumps(parameters, sort_keys=True, default=str)
        if not create_new(spark, f"{self.folder}/run.json", mine):
            if read_text(spark, f"{self.folder}/run.json") != mine:
                raise ValueError(f"run {run_id!r} was started with other parameters")

    def _manifest(self, step: str) -> str:
        return f"{self.folder}/{step}.step.json"

    def done(self, step: str) -> dict | None:
        """The manifest of a finished step."""
        text = read_text(self.spark, self._manifest(step)) if self.id else None
        return json.loads(text) if text else None

    def table(self, step: str, make: Callable[[], DataFrame], *counts) -> DataFrame:
        """The rows of a step, from its table when the step is finished.

        ``self.rows[step]`` is their number, counted as they are written;
        ``counts`` are further (name, aggregate) pairs, as ``step.name``."""
        done = self.done(step)
        if done is None:
            seen = Observation(f"{step}-{uuid.uuid4().hex}")
            df = make().observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counts])
            if self.id is None:
                out = written(df, step)
                got = seen.get
            else:
                path = f"{self.folder}/{step}-{uuid.uuid4().hex}"
                df.write.parquet(path)
                got = seen.get
                write_text(self.spark, self._manifest(step), json.dumps(
                    {"step": step, "folder": path, "schema": df.schema.jsonValue(), "counts": got}))
                out = self.spark.read.schema(df.schema).parquet(path)
        else:
            got = done["counts"]
            out = self.spark.read.schema(T.StructType.fromJson(done["schema"])).parquet(done["folder"])
        self.rows.update({step if n == "rows" else f"{step}.{n}": int(x) for n, x in got.items()})
        return out

    def value(self, step: str, make: Callable[[], dict]) -> dict:
        """What a step returned (plain JSON); done once."""
        done = self.done(step)
        if done is not None:
            return done["value"]
        out = make()
        if self.id is not None:
            write_text(self.spark, self._manifest(step), json.dumps({"step": step, "value": out}))
        return out

    def release(self, *keep: str) -> None:
        """Delete the tables of all steps but ``keep``; the manifests stay and tell what was done."""
        if self.id is None:
            return
        for name, _ in listing(self.spark, self.folder):
            if not name.endswith(".json") and not any(name.startswith(f"{k}-") for k in keep):
                delete(self.spark, f"{self.folder}/{name}")
