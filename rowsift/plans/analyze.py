"""The whole review as one Spark job graph.

  S1 read -> (F4 -> F5 match set) -> F3 filter + F7 count (checkpointed)
  -> F6 row ids
  -> S5 guideline -> scorer:
       rules table:  M5 (one expression over the kept rows)
       callable:     M2 -> M3 -> M4 (checkpointed: paid calls run once)
                     -> R5 quarantine -> R3 explode -> R4 standardise -> R7 merge
  -> K5 both outputs, K6 run log

The source is read once by the filter, and once before for its distinct values
when a matcher is given (value sets too large to inline add the reads of the
keyed join). The kept rows are written to the shared folder, counted on the
way; row ids, requests and the merge read only those. The scorer's replies are
written before they are used, so an executor lost later never causes a second
paid call. With a run id every step leaves a manifest, and a restart under the
same id goes on behind the last finished one (``runs``); replies are then kept
by content (``replystore``), so a run that died while scoring asks for no reply
twice but those of its open wave. At the end the intermediate tables go: what
stays are the results, the rejected replies, the reply store and the manifests.
Output rows carry the original fields unchanged (joined by row id,
never echoed by the scorer); further fields of the replies become columns.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import free_name, named
from ..functions.text import clean_term
from ..functions.verdict import NOTES_FIELD, VERDICT_FIELD
from ..operators.filters import distinct_values, filter_related
from ..operators.matching import match_values
from ..operators.replies import (
    explode_records,
    merge_verdicts,
    parse_replies,
    quarantine,
    record_fields,
    standardize,
)
from ..operators.requests import build_requests, guideline_text, render_records
from ..operators.rowid import PLACE, with_place, with_row_id
from ..operators.runlog import RunLog
from ..operators.scoring import evaluate_rules, score_requests
from ..session import Scratch, shared_dir
from ..sources.documents import assemble_document
from ..sources.formats import read_options
from ..sources.tables import default_column, read_table, require_column
from ..sources.writers import write_results
from .runs import Run


@dataclass
class Review:
    """What a review run produced."""
    result: DataFrame | None
    errors: DataFrame | None
    outputs: dict = field(default_factory=dict)
    log: RunLog = field(default_factory=RunLog)
    rows_kept: int = 0


def _is_rules(scorer) -> bool:
    return isinstance(scorer, DataFrame) or (isinstance(scorer, (list, tuple))
                                             and not callable(scorer))


def _reserve(name: str, taken: list[str]) -> str:
    """The first free form of ``name``, which then is taken too."""
    out = free_name(name, taken)
    taken.append(out)
    return out


def analyze(spark: SparkSession, source: str, table: str, column: str | None, term: str,
            order_by: str | Sequence[str] | None, scorer: DataFrame | Sequence[tuple] | Callable[[str], str],
            out_dir: str, pages: DataFrame | None = None, guideline_doc=None,
            doc_col: str = "doc_id", page_col: str = "page_no", text_col: str = "text",
            option: str = "new_file", matcher=None, literal: bool = False,
            batch: int = 50, input_name: str | None = None, format: str = "parquet",
            output_names: tuple[str, str] = (VERDICT_FIELD, NOTES_FIELD),
            log_path: str | None = None, schema=None, out_format: str | None = None,
            null_as: str | None = None, lower_term: bool = False,
            json_target: str | None = None, table_source: str | None = None,
            max_bytes: int | None = None, run_id: str | None = None, run_folder: str | None = None,
            reply_store: str | None = None, scorer_name: str = "", matcher_name: str = "") -> Review:
    """Run the review; see the module notes. ``log_path`` appends the run log.

    ``format`` (and ``schema``) read the source, ``out_format`` writes the
    result table (default: the same); without ``column`` the default column is
    used; rows are numbered in the order of ``order_by``, ties and without it
    all rows in the order of the source. All source columns come out unchanged;
    an added column whose name is taken gets the suffix ``_1``, ``_2``, ...

    ``run_id`` makes the run one that can be taken up again after it died;
    ``run_folder`` holds such runs (default: under the shared folder).
    ``reply_store`` is the folder of replies by content (default with a run id:
    one in the run's folder); ``scorer_name`` and ``matcher_name`` tell replies
    of different models apart there. ``max_bytes`` bounds a request's records.
    """
    run = Run(spark, run_id, run_folder, source=source, table=table, column=column, term=term, order_by=order_by,
              guideline=guideline_doc, option=option, literal=literal, batch=batch, format=format, out_dir=out_dir,
              scorer_name=scorer_name, matcher_name=matcher_name, max_bytes=max_bytes, null_as=null_as)
    if run.done("finished"):
        return _restored(spark, run)
    if reply_store is None and run_id is not None:
        reply_store = f"{run.folder}/replies"
    with Scratch(spark):
        review = _review(spark, run, source, table, column, term, order_by, scorer, out_dir, pages, guideline_doc, doc_col,
                         page_col, text_col, option, matcher, literal, batch, input_name, format, output_names, schema,
                         out_format or format, null_as, lower_term, json_target, table_source, max_bytes, reply_store,
                         scorer_name, matcher_name)
    if log_path:
        review.log.append(spark, log_path, add_id=run_id)
    if run_id is not None:
        run.value("finished", lambda: {
            "rows": review.rows_kept, "outputs": review.outputs, "format": out_format or format,
            "schema": review.result.schema.jsonValue() if review.result is not None else None,
            "log": [[step, message, n, at.isoformat()] for step, message, n, at in review.log.entries]})
        run.release("replies", "errors")
    return review


def _restored(spark: SparkSession, run: Run) -> Review:
    """The review of a run that is finished, from its manifests."""
    kept = run.done("finished")["value"]
    log = RunLog()
    log.entries = [(step, message, n, dt.datetime.fromisoformat(at)) for step, message, n, at in kept["log"]]
    if kept["schema"] is None:
        return Review(None, None, {}, log, kept["rows"])
    errors = run.table("errors", lambda: None) if run.done("errors") else None
    result = _read_result(spark, kept["format"], T.StructType.fromJson(kept["schema"]), kept["outputs"]["table_path"])
    return Review(result, errors, kept["outputs"], log, kept["rows"])


def _read_result(spark: SparkSession, format: str, schema: T.StructType, path: str) -> DataFrame:
    options = read_options(format, schema, multi_line=format == "csv")  # notes may hold line ends
    return spark.read.format(format).options(**options).schema(schema).load(path)


def _review(spark, run, source, table, column, term, order_by, scorer, out_dir, pages, guideline_doc, doc_col, page_col,
            text_col, option, matcher, literal, batch, input_name, format, output_names, schema, out_format, null_as,
            lower_term, json_target, table_source, max_bytes, reply_store, scorer_name, matcher_name) -> Review:
    """The steps of ``analyze``."""
    log = RunLog()
    term = clean_term(term)
    # Guards first: nothing is filtered, and nobody is paid, before they pass.
    df = read_table(spark, source, table, format=format, schema=schema)
    column = require_column(df, column or default_column(df))
    for key in [order_by] if isinstance(order_by, str) else order_by or ():
        require_column(df, key)
    by_rules = _is_rules(scorer)
    text = None
    if not by_rules:
        if pages is None:
            raise ValueError("The scorer needs the pages of a guideline.")
        docs = assemble_document(pages, doc_col, page_col, text_col)
        chosen = docs.where(named(doc_col) == F.lit(guideline_doc)) if guideline_doc is not None else docs
        text = guideline_text(chosen.select(named(text_col)), text_col)
    log.add("start", f"Review of {table}: {column} against '{term}'")

    taken = list(df.columns)
    rid, vname, nname, raw = [_reserve(n, taken) for n in ("row_id", *output_names, "verdict_raw")]

    matches = None
    if matcher is not None:
        # Filtered by name only: the values are read once, the matches written once.
        def related():
            values = distinct_values(df, column, order_by=None, limit=None, null_as=null_as)
            paid = reply_store if not isinstance(matcher, DataFrame) else None
            return match_values(values, term, matcher, store=paid and f"{paid}/matches", matcher_name=matcher_name)

        matches = run.table("matches", related)
        log.add("match", f"Values related to '{term}' looked up")

    # The filter scans the source; the kept rows go to the shared folder with
    # their place in it, counted on the way (F7). Row ids, requests and the
    # merge then read that snapshot only, and an empty result ends the run
    # before any other job.
    place = free_name(PLACE, df.columns)
    def filtered():
        rows = df if matches is None else with_place(df, place)  # a join may shuffle: the place is that before it
        rows = filter_related(rows, column, term, matches, literal=literal, null_as=null_as, lower_term=lower_term)
        return with_place(rows, place) if matches is None else rows

    kept = run.table("kept", filtered)
    n = run.rows["kept"]
    if n == 0:
        log.add("filter", f"No data found: no {column} relates to '{term}'", 0)
        return Review(None, None, {}, log, 0)
    log.add("filter", f"{n} rows relate to '{term}'", n)
    numbered = with_row_id(kept, order_by, name=rid, place=place,  # written: requests and merge see the same ids
                           write=lambda rows, name: run.table(name, lambda: rows))

    errors = None
    if by_rules:
        judged = evaluate_rules(numbered, scorer, vname, nname).withColumn(raw, F.lit(None).cast("string"))
    else:
        # Paid calls run once: M4 writes the replies, the parsed ones are a step
        # of their own, the rejected ones counted on the way.
        def answered():
            requests = build_requests(render_records(numbered, rid), text, term, column, batch, row_id=rid,
                                      max_bytes=max_bytes, whole=False)
            return parse_replies(score_requests(requests, scorer, store=reply_store and f"{reply_store}/reviews",
                                                scorer_name=scorer_name))

        replies = run.table("parsed", answered, ("rejected", F.count(F.col("reason"))))
        good, bad = quarantine(replies)
        records = standardize(explode_records(good), id_field=rid)
        strays = records.where(F.col("reason").isNotNull()).select("batch_id", "reason", F.to_json("record").alias("response"))
        errors = _kept(run, bad.unionByName(strays, allowMissingColumns=True))
        # Whatever else the reply says beside the echoed fields becomes columns.
        fields, more = record_fields(records, without=[*taken, *output_names])
        extra = [*fields, *([] if more is None else [more])]
        pool = [*taken, *records.columns]
        shown = [_reserve(c, pool) for c in records.select(*extra).columns]
        verdicts = records.select("*", *[c.alias(name) for c, name in zip(extra, shown)])
        judged = merge_verdicts(numbered, verdicts, key=rid, names=(vname, nname, raw), extra=shown)
        bad_n = run.rows["parsed.rejected"]
        log.add("score", f"{bad_n} of {run.rows['parsed']} replies set aside", bad_n)

    outputs = run.value("write", lambda: write_results(
        judged, out_dir, input_name or table, table, column, option, out_format, json_target=json_target,
        table_source=table_source, add_id=run.id))
    log.add("write", f"Results in {outputs['json_path']} and {outputs['table_path']}", n)
    result = _read_result(spark, out_format, judged.schema, outputs["table_path"])
    return Review(result, errors, outputs, log, n)


def _kept(run: Run, errors: DataFrame) -> DataFrame:
    """The rejected replies as a table that stays when the intermediate ones go."""
    if run.id is not None:
        return run.table("errors", lambda: errors)
    path = shared_dir(errors.sparkSession, "rejected")
    errors.write.parquet(path)
    return errors.sparkSession.read.schema(errors.schema).parquet(path)
