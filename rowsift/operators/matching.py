"""which distinct values of a column are related to a search term.

Two matchers, both applied to the *distinct* values (F4 with no limit), never
per source row:

* a ``related(term, value[, explanation])`` DataFrame: an equi-join on the
  lower-cased value, after the related table is cut down to the term;
* a callable ``matcher(term, values) -> iterable of (value, explanation)``
  run by ``mapInPandas`` on Arrow batches of values spread over the cluster
  (for user-supplied scorers such as a hosted model); its answers are written
  to the shared folder, so each batch is asked about once. With a reply store
  (``replystore``) a value that this matcher was ever asked about for the term
  is not asked about again, related or not.

Output: ``(term, value, explanation)``.
"""

from __future__ import annotations

import json
from typing import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import named
from ..session import ship_package, spread, written
from .replystore import WAVE, ReplyStore, request_key

MATCH_SCHEMA = "term string, value string, explanation string"


def match_values(values: DataFrame, term: str,
                 matcher: DataFrame | Callable[[str, list[str]], Iterable],
                 value_col: str = "value", batch_size: int = 20,
                 partitions: int | None = None, store: str | None = None, matcher_name: str = "",
                 wave: int = WAVE) -> DataFrame:
    vals = values.select(named(value_col).cast("string").alias("value")) \
        .where(F.col("value").isNotNull())
    if isinstance(matcher, DataFrame):
        rel = matcher
        expl = F.col("explanation") if "explanation" in rel.columns else F.lit(None).cast("string")
        rel = (rel.where(F.lower(F.col("term")) == F.lit(term.lower()))
               .select(F.lower(F.col("value")).alias("_low"), expl.alias("explanation")))
        return (vals.join(rel, F.lower(F.col("value")) == F.col("_low"), "inner")
                .select(F.lit(term).alias("term"), "value", "explanation"))

    fn = matcher

    def hits(chunk: list[str]) -> list[tuple]:
        return [(hit, None) if isinstance(hit, str) else (hit[0], hit[1]) for hit in fn(term, chunk) or ()]

    if store is not None:
        return _stored(vals, term, hits, batch_size, partitions, ReplyStore(values.sparkSession, store), matcher_name, wave)

    def run(batches):
        for pdf in batches:
            items = pdf["value"].tolist()
            out = []
            for start in range(0, len(items), batch_size):
                out += [(term, v, why) for v, why in hits(items[start:start + batch_size])]
            yield pd.DataFrame(out, columns=["term", "value", "explanation"])

    ship_package(values.sparkSession)
    return written(spread(vals, partitions).mapInPandas(run, MATCH_SCHEMA), "matches")


def _stored(vals: DataFrame, term: str, hits: Callable, batch_size: int, partitions: int | None,
            store: ReplyStore, name: str, wave: int) -> DataFrame:
    """Ask about the values that the store does not know, then read all answers from it.

    A value's answer is the list of its hits as JSON (empty: not related); a
    hit that names none of the values asked about goes to the first of them.
    A matcher that raises leaves its values unanswered, with the error."""
    def ask(batches):
        for pdf in batches:
            out = []
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size]
                keys, items = part["key"].tolist(), part["value"].tolist()
                found: dict = {k: [] for k in keys}
                try:
                    owner = dict(zip(items, keys))
                    for v, why in hits(items):
                        found[owner.get(v, keys[0])].append({"value": v, "explanation": why})
                    out += [(k, json.dumps(h), None) for k, h in found.items()]
                except Exception as exc:  # noqa: BLE001 - kept with the values
                    out += [(k, None, f"{type(exc).__name__}: {exc}") for k in keys]
            yield pd.DataFrame(out, columns=["key", "response", "error"])

    asked = written(vals.distinct().withColumn("key", request_key(f"{name}\n{term}", F.col("value"))), "match-values")
    store.fill(asked, ask, wave=wave, partitions=partitions)
    answers = written(store.answers(asked.select("key")), "match-answers")
    failed = answers.where(F.col("response").isNull()).agg(F.count(F.lit(1)).alias("n"), F.first("error").alias("error")).first()
    if failed["n"]:
        raise RuntimeError(f"the matcher failed on {failed['n']} values, the others are stored: {failed['error']}")
    found = F.explode(F.from_json("response", "array<struct<value: string, explanation: string>>")).alias("h")
    return answers.select(found).select(F.lit(term).alias("term"), "h.value", "h.explanation")
