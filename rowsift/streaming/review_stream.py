"""The filter and the rules review on a stream.

F1/F3 (with a literal match list), E1/E2 and M5 are stateless column
expressions, so the same plan runs unchanged on a streaming DataFrame:
``readStream`` over a folder of files -> filter -> rules verdict ->
``writeStream`` to files, with the query's progress in a checkpoint folder
under the shared ``spark.checkpoint.dir`` (exactly-once file sink, restart
safe). No state is kept, so no watermark is needed.

``review_stream_append`` adds every micro-batch to a JSON set (K2), a table
(K4's source) and the run log (K6) instead. Spark may hand out a micro-batch
again after a crash, with the same number and rows; each of the three adds is
named by stream and number in the target's own ledger, so what was added before
the crash is not added again, and what was not is.
"""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import filter_related
from ..operators.runlog import RunLog
from ..operators.scoring import evaluate_rules
from ..session import shared_dir
from ..sources.writers import append_json, append_table


def review_stream_frame(stream: DataFrame, column: str, term: str,
                        rules: Sequence[tuple], matches: Sequence[str] | None = None,
                        literal: bool = False) -> DataFrame:
    """The streaming plan: kept rows with ``verdict`` and ``notes``.

    ``rules`` must be a list here (a rules DataFrame would need a batch read
    inside the stream definition).
    """
    kept = filter_related(stream, column, term, list(matches) if matches else None,
                          literal=literal)
    return evaluate_rules(kept, rules)


def _source(spark: SparkSession, path: str, format: str, max_files_per_trigger: int | None,
            file_glob: str | None) -> DataFrame:
    """The files of a folder as a stream, with the schema of those already there (streams need one)."""
    batch_reader = spark.read.format(format)
    reader = spark.readStream.format(format)
    if file_glob:
        batch_reader = batch_reader.option("pathGlobFilter", file_glob)
        reader = reader.option("pathGlobFilter", file_glob)
    reader = reader.schema(batch_reader.load(path).schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path)


def _timed(writer, available_now: bool):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")


def review_stream(spark: SparkSession, path: str, column: str, term: str,
                  rules: Sequence[tuple], sink: str, format: str = "parquet",
                  checkpoint: str | None = None, available_now: bool = True,
                  matches: Sequence[str] | None = None,
                  max_files_per_trigger: int | None = None,
                  file_glob: str | None = None) -> StreamingQuery:
    """Start the streaming review of the files under the folder ``path``.

    ``file_glob`` keeps only matching file names. ``available_now`` processes
    what exists in bounded micro-batches and stops.
    """
    stream = _source(spark, path, format, max_files_per_trigger, file_glob)
    out = review_stream_frame(stream, column, term, rules, matches)
    writer = (out.writeStream.format("parquet")
              .option("checkpointLocation", checkpoint or shared_dir(spark, "stream"))
              .outputMode("append"))
    return _timed(writer, available_now).start(sink)


def append_batch(rows: DataFrame, name: str, number: int, json_target: str, source: str, table: str,
                 log_path: str | None = None, format: str = "parquet") -> None:
    """The effects of one micro-batch of the stream ``name``, each taken once."""
    spark, add_id = rows.sparkSession, f"{name}-{number}"
    seen = Observation(f"batch-{uuid.uuid4().hex}")
    src = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        append_json(src, json_target, add_id=add_id)
        append_table(src, source, table, format, add_id)
        if log_path:
            src.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
            log = RunLog()
            n = seen.get["rows"]
            log.add(f"batch {number}", f"{n} rows of {name} added", n)
            log.append(spark, log_path, add_id)
    finally:
        src.unpersist()


def review_stream_append(spark: SparkSession, path: str, column: str, term: str, rules: Sequence[tuple], name: str,
                         json_target: str, source: str, table: str, log_path: str | None = None,
                         format: str = "parquet", checkpoint: str | None = None, available_now: bool = True,
                         matches: Sequence[str] | None = None, max_files_per_trigger: int | None = None,
                         file_glob: str | None = None) -> StreamingQuery:
    """Start the streaming review that adds to a JSON set, a table and the log.

    ``name`` is the stream's identity in the ledgers of its targets: a stream
    that is started again, with its checkpoint or with a new one over the same
    files, keeps its name and adds no micro-batch twice. ``matches`` and
    ``rules`` are lists, as for ``review_stream``."""
    stream = _source(spark, path, format, max_files_per_trigger, file_glob)
    kept = review_stream_frame(stream, column, term, rules, matches)

    def take(rows: DataFrame, number: int) -> None:
        append_batch(rows, name, number, json_target, source, table, log_path)

    writer = (kept.writeStream.foreachBatch(take)
              .option("checkpointLocation", checkpoint or shared_dir(spark, "stream")))
    return _timed(writer, available_now).start()
