"""Scorers: M4 score_requests (a user callable) and M5 evaluate_rules (an
offline rules table).

M4 runs the callable in Python workers through ``mapInPandas``, one task per
partition of the requests (``build_requests`` deals them out; ``partitions``
deals out others), and creates it once per task by ``make_scorer``. A failing
or empty reply becomes an error row, never a lost job. The replies are written
to the shared folder and read back, so a paid call is never repeated however
many readers there are; with a reply store not by a later run either.

M5 compiles a rules table into two Column expressions: no join, no Python.
"""

from __future__ import annotations

import json
from typing import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import named, refuse_clash
from ..functions.text import contains_pattern
from ..session import ship_package, spread, written
from .replystore import WAVE, ReplyStore, request_key


def request_text(requests: DataFrame) -> Column:
    """The whole request: its ``prompt``, or its ``head``, ``body`` and ``tail`` put together."""
    if "prompt" in requests.columns:
        return F.col("prompt")
    return F.concat(*[F.coalesce(F.col(c), F.lit("")) for c in ("head", "body", "tail")])


def _call(fn: Callable[[str], str], prompt: str, retries: int) -> tuple[str | None, str | None]:
    """(reply, error) of one request; failures and empty replies are errors."""
    reply, err = None, None
    for _ in range(retries + 1):
        try:
            reply, err = fn(prompt), None
            break
        except Exception as exc:  # noqa: BLE001 - reported per request
            reply, err = None, f"{type(exc).__name__}: {exc}"
    if err is None and (reply is None or not str(reply).strip()):
        reply, err = None, "empty reply"
    return None if reply is None else str(reply), err


def score_requests(requests: DataFrame, scorer: Callable[[str], str] | None = None,
                   make_scorer: Callable[[], Callable[[str], str]] | None = None,
                   retries: int = 1, partitions: int | None = None,
                   keep: Sequence[str] = ("row_ids", "n_records"),
                   store: str | None = None, scorer_name: str = "", wave: int = WAVE) -> DataFrame:
    """M4: ``(batch_id, *keep, response, error)`` for every request.

    Runs now: every request is sent once, the replies are on disk after it.
    ``partitions`` deals the requests round-robin over so many tasks first;
    requests of ``build_requests`` are dealt out already.

    ``store`` names a folder of replies by content (``replystore``) that
    outlives the run: a request that this ``scorer_name`` has answered before
    is not sent again, equal requests are sent once, and the others go out in
    waves of ``wave`` requests, each on disk before the next, so a run that
    dies loses one wave at most (of more waves than ``replystore.ROUNDS``, and
    without ``partitions``: a wave's number of requests, or one for each task
    that runs at once where that is more)."""
    if (scorer is None) == (make_scorer is None):
        raise ValueError("give exactly one of scorer / make_scorer")
    kept = [c for c in keep if c in requests.columns]
    carried = ["batch_id", *kept] if store is None else ["key"]
    source = requests.withColumn("_rs_text", request_text(requests))

    def run(batches: Iterable[pd.DataFrame]):
        fn = make_scorer() if make_scorer is not None else scorer
        for pdf in batches:
            got = [_call(fn, prompt, retries) for prompt in pdf["_rs_text"]]
            out = pdf[carried].copy()
            out["response"] = [r for r, _ in got]
            out["error"] = [e for _, e in got]
            yield out

    if store is None:
        fields = [requests.schema[c] for c in carried]
        schema = T.StructType(fields + [T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])
        ship_package(requests.sparkSession)
        rows = source.select(*carried, "_rs_text")
        return written((spread(rows, partitions) if partitions else rows).mapInPandas(run, schema), "replies")

    # The parts of a request are written as they are (a guideline that all share
    # is one dictionary entry a file) and put together in the task that asks.
    parts = [c for c in ("prompt", "head", "body", "tail") if c in requests.columns]
    keyed = written(source.withColumn("key", request_key(scorer_name, F.col("_rs_text")))
                    .select("key", "batch_id", *kept, *parts), "requests")
    replies = ReplyStore(requests.sparkSession, store)
    replies.fill(keyed.select("key", *parts), run, wave=wave, partitions=partitions,
                 shape=lambda rows: rows.select("key", request_text(rows).alias("_rs_text")))
    slim = keyed.select("key", "batch_id", *kept)
    return written(slim.join(replies.answers(slim.select("key").distinct()), "key", "left")
                   .select("batch_id", *kept, "response", "error"), "replies")


# Rule operators, by name and by symbol.
_OPS = {
    "eq": "eq", "=": "eq", "==": "eq",
    "ne": "ne", "!=": "ne", "<>": "ne",
    "lt": "lt", "<": "lt",
    "le": "le", "<=": "le",
    "gt": "gt", ">": "gt",
    "ge": "ge", ">=": "ge",
    "contains": "contains",
    "matches": "matches",
}


def _rule_kind(op: str | None) -> str:
    kind = _OPS.get((op or "").strip().lower())
    if kind is None:
        raise ValueError(f"unknown rule operator {op!r}")
    return kind


def _test(c: Column, kind: str, target: Column) -> Column:
    return {"eq": c == target, "ne": c != target, "lt": c < target,
            "le": c <= target, "gt": c > target, "ge": c >= target,
            "contains": F.lower(c.cast("string")).contains(target)}[kind]


# Rules of one column and operator up to this many are single tests in generated
# code; more are one expression over the array of their values.
SINGLE_TESTS = 16


def _passes(df: DataFrame, rules: list[tuple]) -> tuple[Column, list[int]]:
    """One array of booleans for all rules, and each rule's place in it.

    Rules of one column and operator are one expression over the constant
    array of their values, so the plan grows with the columns used and not
    with the number of rules. Regex rules stay single: their pattern is
    compiled once."""
    types = {f.name.lower(): f.dataType for f in df.schema.fields}
    groups: dict[tuple, list[int]] = {}
    for i, (_, column, op, value, _) in enumerate(rules):
        if column is None or column.lower() not in types:
            raise ValueError(f"Column '{column}' not found in the table.")
        kind = _rule_kind(op)
        groups.setdefault((column.lower(), kind, i if kind == "matches" else None), []).append(i)
    parts, place = [], [0] * len(rules)
    for (column, kind, _), members in groups.items():
        c, values = named(rules[members[0]][1]), [rules[i][3] for i in members]
        if kind == "matches":
            part = F.array(F.coalesce(contains_pattern(c, values[0] or ""), F.lit(False)))
        else:
            kinds = types[column]  # of constants, cast once when the plan is made
            targets = [F.lower(F.lit(v or "")) if kind == "contains" else F.lit(v).try_cast(kinds) for v in values]
            if len(targets) <= SINGLE_TESTS:
                part = F.array(*[F.coalesce(_test(c, kind, t), F.lit(False)) for t in targets])
            else:
                part = F.transform(F.array(*targets), lambda v: F.coalesce(_test(c, kind, v), F.lit(False)))
        start = sum(len(m) for m in list(groups.values())[:len(parts)])
        for k, i in enumerate(members):
            place[i] = start + k
        parts.append(part)
    return F.concat(*parts), place


def _rule_rows(rules: DataFrame | Sequence[tuple]) -> list[tuple]:
    """The rules in rule_id order; they become part of the plan, whatever their number."""
    if isinstance(rules, DataFrame):
        return [tuple(r) for r in rules.select("rule_id", "column", "op", "value", "note").orderBy("rule_id").collect()]
    return sorted((tuple(r) for r in rules), key=lambda r: r[0])


def evaluate_rules(df: DataFrame, rules: DataFrame | Sequence[tuple],
                   verdict_col: str = "verdict", notes_col: str = "notes",
                   sep: str = "; ") -> DataFrame:
    """M5: verdict = at least one rule passes; notes = the notes of the failed
    rules in rule_id order joined by ``sep`` ('' when none failed). A null
    field, or a rule value that does not convert to the column type, fails.

    Each rule is tested once, into one array of booleans; verdict and notes
    read that array, and rules of one column and operator share an expression,
    so thousands of rules make neither a deep nor a wide plan. A column of
    ``df`` with one of the two names is an error: name the outputs differently."""
    refuse_clash(df.columns, verdict_col, notes_col)
    rows = _rule_rows(rules)
    if not rows:
        return df.withColumn(verdict_col, F.lit(False)).withColumn(notes_col, F.lit(""))
    passes, place = _passes(df, rows)
    note = F.from_json(F.lit(json.dumps([{"k": k, "t": t or ""} for k, (*_, t) in zip(place, rows)])),
                       "array<struct<k: int, t: string>>")  # folded to a constant, in rule order
    failed = F.transform(F.filter(note, lambda n: ~F.get(F.col("_rs_pass"), n["k"])), lambda n: n["t"])
    return (df.withColumn("_rs_pass", passes)
            .withColumn(verdict_col, F.array_contains("_rs_pass", True))
            .withColumn(notes_col, F.array_join(failed, sep)).drop("_rs_pass"))
