"""Replies by content: what a paid callable has answered is never asked again.

A store is a folder of Parquet tables ``(key, response, error, asked_at)``, one
per wave, in storage that every executor and every later session can reach.
``key`` is the SHA-256 of the scorer's name and the whole request, so the same
request finds its reply whoever asks, in whatever batch, run or session.

A run joins its keys to the store and asks only what has no reply yet, each
different request once. It does so in waves of bounded size: the replies of a
wave are on disk before the next one starts. When a scorer, a task or the
driver dies, what has been answered stays; only the open wave is asked again.
A request that failed is no reply: it is kept with its error and asked again
by the next run.

The open requests get dense ids and are written once in their order, so a job
reads its own and no others. Up to ``ROUNDS`` waves are a job each. More waves
share ``ROUNDS`` jobs: there a task takes a wave's share of one of the tasks
that run at once, and its replies are on disk when it ends (a committer that
moves a task's files with the task). So the requests open at a time are a wave
still, or one for each running task where a wave has fewer; the number of jobs
does not grow with the requests. With ``partitions``, which bounds the calls at
once, every wave is a job, as many as there are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import delete, listing, make_dirs
from ..session import ship_package, written
from .rowid import PLACE, with_place, with_row_id

SCHEMA = "key string, response string, error string, asked_at timestamp"
#: Requests of a wave: what a crash can make a run ask twice.
WAVE = 10_000
#: Jobs of a ``fill`` at most, when ``partitions`` does not bound the calls at once.
ROUNDS = 16


def request_key(name: str, text: Column) -> Column:
    """SHA-256 of the scorer's name and the request."""
    return F.sha2(F.concat(F.lit(name), F.lit("\n"), text).cast("binary"), 256)


class ReplyStore:
    """The replies in one folder; made when it does not exist."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        make_dirs(spark, self.path)

    def rows(self) -> DataFrame:
        """Everything asked so far, failures included."""
        if not listing(self.spark, self.path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/wave-*")

    def answers(self, keys: DataFrame) -> DataFrame:
        """``key, response, error`` for those of ``keys(key)`` that were ever
        asked: the first reply, or without one the last error."""
        reply = F.col("response").isNotNull()
        mine = self.rows().join(keys.select("key"), "key", "left_semi")
        got = mine.groupBy("key").agg(
            F.min_by(F.when(reply, F.col("response")), F.when(reply, F.struct("asked_at", "response"))).alias("response"),
            F.max_by(F.when(~reply, F.col("error")), F.when(~reply, F.struct("asked_at", "error"))).alias("error"))
        return got.select("key", "response", F.when(F.col("response").isNull(), F.col("error")).alias("error"))

    def fill(self, requests: DataFrame, ask: Callable[[Iterable[pd.DataFrame]], Iterable[pd.DataFrame]], *,
             wave: int = WAVE, partitions: int | None = None, shape: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Ask every request of ``requests(key, ...)`` that has no reply; the number asked.

        ``requests`` should read files (it is read for its keys, then for the
        open requests). ``ask`` maps frames of its rows, behind the last
        exchange brought into the form it wants by ``shape``, to frames of
        ``key, response, error`` in a ``mapInPandas``, at most ``partitions``
        tasks a wave."""
        if wave < 1:
            raise ValueError("a wave has at least one request")
        replied = self.rows().where(F.col("response").isNotNull()).select("key")
        keys = requests.select("key").where(F.col("key").isNotNull()).distinct()
        todo = written(with_place(keys.join(replied, "key", "left_anti")), "open-keys")
        stats: dict = {}
        ids = with_row_id(todo, name="_rs_open", place=PLACE, stats=stats)
        n = stats["rows"]
        if not n:
            return 0
        at = F.col("_rs_open")
        files = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        laid = written(requests.join(ids, "key").dropDuplicates(["key"])
                       .repartitionById(files, F.floor(at * files / n).cast("int")).sortWithinPartitions("_rs_open"), "open-requests")
        if partitions:
            size, share = wave, -(-wave // partitions)
        else:
            size, share = max(wave, -(-n // ROUNDS)), max(1, wave // self.spark.sparkContext.defaultParallelism)
        ship_package(self.spark)
        for i, low in enumerate(range(0, n, size)):
            high = min(low + size, n)
            own = laid.where((at >= low) & (at < high))
            batch = own.repartitionById(-(-(high - low) // share), F.floor((at - low) / share).cast("int")).drop("_rs_open")
            replies = (shape(batch) if shape else batch).mapInPandas(ask, "key string, response string, error string")
            (replies.withColumn("asked_at", F.current_timestamp())
             .write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")  # a task's replies stay when another dies
             .parquet(f"{self.path}/wave-{i:06d}-{uuid.uuid4().hex}"))
        return n

    def compact(self) -> None:
        """Put the waves so far into one table with a row per key, the first
        reply or else the last error. The old waves go when it is written; a
        crash in between leaves replies twice, which reads the same. No run
        should use the store meanwhile: its lazy reads name the old waves."""
        old = [name for name, _ in listing(self.spark, self.path) if name.startswith("wave-")]
        rank = F.struct(F.col("response").isNull().alias("open"),
                        F.when(F.col("response").isNull(), -F.unix_micros("asked_at")).otherwise(F.unix_micros("asked_at")).alias("at"),
                        F.coalesce("response", "error").alias("text"))
        best = self.rows().groupBy("key").agg(F.min_by(F.struct("response", "error", "asked_at"), rank).alias("b"))
        best.select("key", "b.*").write.parquet(f"{self.path}/wave-all-{uuid.uuid4().hex}")
        for name in old:
            delete(self.spark, f"{self.path}/{name}")
