"""Reply handling: R2 parse_matches, R3 explode_records, R4 standardize,
R5 quarantine, R6 records_to_table, R7 merge_verdicts.

All columnar (VARIANT functions, higher-order functions); no Python.
A reply is invalid *as a whole* when it is empty, holds no valid JSON, is not
a list, is an empty list, or holds an element that is not an object; R5 must
run before R3/R4 because a non-object element reads like a missing key.
"""

from __future__ import annotations

from collections import Counter
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import extract_value, json_span, parse_strict
from ..functions.names import named, refuse_clash
from ..functions.text import strip_text
from ..functions.verdict import notes, verdict, verdict_raw

# Keys of replies that become columns; further ones go into a map.
MAX_COLUMNS = 10_000
# Reasons a reply is set aside.
EMPTY = "empty reply"
NO_JSON = "no valid json"
NOT_LIST = "not a list"
EMPTY_LIST = "empty list"
NON_OBJECT = "non-object element"


def reply_array(text: str | Column) -> Column:
    """The reply's JSON list as ``array<variant>`` (null if not a list)."""
    return F.try_variant_get(extract_value(text), "$", "array<variant>")


def parse_matches(df: DataFrame, col: str = "response") -> DataFrame:
    """R2: ``matches`` (array<string>) and ``explanation`` from a match reply.
    The object form is looked for first; ``matches`` that is not a list gives
    null, which means: fall back to the plain filter."""
    # Staged like parse_replies: the reply is searched and parsed once.
    staged = (df.withColumn("_rs_v", extract_value(col, prefer="object"))
              .withColumn("_rs_obj", F.schema_of_variant("_rs_v").startswith("OBJECT")))
    v, is_obj = F.col("_rs_v"), F.col("_rs_obj")
    return (staged.withColumn("matches", F.when(is_obj, F.try_variant_get(v, "$.matches", "array<string>")))
            .withColumn("explanation", F.when(is_obj, F.try_variant_get(v, "$.explanation", "string")))
            .drop("_rs_v", "_rs_obj"))


def parse_replies(df: DataFrame, col: str = "response",
                  error_col: str | None = "error") -> DataFrame:
    """R1 + R5 in stages: adds ``json_text`` (the JSON found in the reply),
    ``items`` (the list as array<variant>, null if not a list) and ``reason``
    (null when usable). Each step is its own projection, so a reply is
    searched and parsed once, not once per test."""
    err = error_col if error_col and error_col in df.columns else None
    staged = (df.withColumn("_rs_span", json_span(col))
              .withColumn("_rs_v", parse_strict("_rs_span"))
              .withColumn("json_text", F.when(F.col("_rs_v").isNotNull(), F.col("_rs_span")))
              .withColumn("items", F.try_variant_get("_rs_v", "$", "array<variant>")))
    t = named(col)
    reason = (F.when(t.isNull() | (strip_text(t) == ""), F.lit(EMPTY))
              .when(F.col("json_text").isNull(), F.lit(NO_JSON))
              .when(F.col("items").isNull(), F.lit(NOT_LIST))
              .when(F.size("items") == 0, F.lit(EMPTY_LIST))
              # only an object casts to a map; its schema would be text built for each element
              .when(F.exists("items", lambda e: F.try_variant_get(e, "$", "map<string,variant>").isNull()),
                    F.lit(NON_OBJECT)))
    if err is not None:
        reason = F.coalesce(F.col(err), reason)
    return staged.withColumn("reason", reason).drop("_rs_span", "_rs_v")


def quarantine(df: DataFrame, col: str = "response",
               error_col: str | None = "error") -> tuple[DataFrame, DataFrame]:
    """(good replies, rejected replies with ``reason``). Materialise the
    input first (write/checkpoint) when it comes from a paid scorer; a frame
    from :func:`parse_replies` is split without parsing again."""
    tagged = df if "reason" in df.columns and "items" in df.columns else \
        parse_replies(df, col, error_col)
    return (tagged.where(F.col("reason").isNull()).drop("reason"),
            tagged.where(F.col("reason").isNotNull()))


def explode_records(df: DataFrame, col: str = "response",
                    keep: Sequence[str] = ("batch_id", "row_ids")) -> DataFrame:
    """One row per element of the reply list:
    ``(*keep, n_items, pos, record)`` where ``n_items`` is the list length.
    Uses the parsed ``items`` column when present."""
    arr = F.col("items") if "items" in df.columns else reply_array(col)
    kept = [c for c in keep if c in df.columns]
    return df.select(*kept, F.size(arr).alias("n_items"), F.posexplode(arr).alias("pos", "record"))


STRAY_ID = "row id of another request"


def standardize(records: DataFrame, record_col: str = "record",
                id_field: str = "row_id") -> DataFrame:
    """Verdict (boolean), verdict_raw, notes, and the row id of each record.

    The row id is the record's ``id_field`` when present, else the id at the
    same position of the request's ``row_ids`` when the reply has exactly one
    record per request row. A stated id that is not among the request's
    ``row_ids`` judges nothing: its row id is null and ``reason`` says so.
    """
    rec = named(record_col)
    stated = F.try_variant_get(rec, _path(id_field), "bigint")
    rid, reason = stated, F.lit(None).cast("string")
    if "row_ids" in records.columns:
        known = F.array_contains("row_ids", stated)
        rid = F.when(known, stated)
        reason = F.when(stated.isNotNull() & ~known, F.lit(STRAY_ID))
        if "n_items" in records.columns:
            by_pos = F.when(F.col("n_items") == F.size("row_ids"),
                            F.element_at("row_ids", F.col("pos") + 1))
            rid = F.when(stated.isNotNull(), rid).otherwise(by_pos)
    return (records.withColumn("row_id", rid)
            .withColumn("verdict", verdict(rec))
            .withColumn("verdict_raw", verdict_raw(rec))
            .withColumn("notes", notes(rec))
            .withColumn("reason", reason))


_SCALARS = {"BIGINT": "bigint", "INT": "int", "SMALLINT": "smallint", "TINYINT": "tinyint",
            "DOUBLE": "double", "FLOAT": "float", "STRING": "string", "BOOLEAN": "boolean",
            "DATE": "date", "TIMESTAMP": "timestamp", "TIMESTAMP_NTZ": "timestamp_ntz"}


def _path(key: str) -> str:
    return '$["' + key.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def _bare(v: Column) -> Column:
    """Text of any JSON value: strings without quotes, JSON null as null, the rest as JSON."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind != "VOID", F.to_json(v))


def _field_column(rec: Column, key: str, kind: str) -> Column:
    if kind in _SCALARS:
        return F.try_variant_get(rec, _path(key), _SCALARS[kind])
    if kind.startswith("DECIMAL"):
        digits = int(kind[8:].split(",")[0])
        # a double gives back every decimal of up to 15 digits; longer ones stay decimals
        return F.try_variant_get(rec, _path(key), "double" if digits <= 15 else kind.lower())
    if kind == "VOID":
        return F.lit(None).cast("string")
    return _bare(F.try_variant_get(rec, _path(key), "variant"))


def record_fields(df: DataFrame, record_col: str = "record", without: Sequence[str] = (),
                  max_columns: int = MAX_COLUMNS) -> tuple[list[Column], Column | None]:
    """The union of the records' keys as columns (sorted by name), and the map
    ``more_fields`` of the keys beyond ``max_columns`` (None when all fit).

    One aggregation finds the keys and their merged types; keys named in
    ``without`` (ignoring case) are left out. A key whose values are of mixed
    kinds gives text: strings bare, other values as JSON. Of keys that differ
    only in case the first (by name) has its own name as column, the next ones
    get the suffix ``_1``, ``_2``, ... (``free_name``), since a table's column
    names ignore case."""
    rec = named(record_col)
    as_map = F.try_variant_get(rec, "$", "map<string,variant>")
    skip = {w.lower() for w in without}
    kinds = (df.select(F.explode(as_map).alias("key", "value"))
             .where(~F.lower("key").isin(*skip) if skip else F.lit(True))
             .groupBy("key").agg(F.schema_of_variant_agg("value").alias("kind"))
             .orderBy("key").limit(max_columns + 1).collect())
    shown = kinds[:max_columns]
    cols = [_field_column(rec, r["key"], r["kind"]).alias(name)
            for r, name in zip(shown, _column_names([r["key"] for r in shown]))]
    if len(kinds) <= max_columns:
        return cols, None
    known = F.array(*[F.lit(r["key"]) for r in shown]) if shown else F.array().cast("array<string>")
    rest = F.map_filter(as_map, lambda k, v: ~F.array_contains(known, k))
    if skip:
        rest = F.map_filter(rest, lambda k, v: ~F.lower(k).isin(*skip))
    return cols, F.transform_values(rest, lambda k, v: _bare(v)).alias("more_fields")


def _column_names(keys: list[str]) -> list[str]:
    """A column name for each key, differing also when case is ignored; keys
    that stand alone keep theirs."""
    seen = Counter(k.lower() for k in keys)
    taken = {k.lower() for k in keys}
    first, out = set(), []
    for k in keys:
        low = k.lower()
        if seen[low] == 1 or low not in first:
            first.add(low)
            out.append(k)
            continue
        n = 1
        while f"{low}_{n}" in taken:
            n += 1
        taken.add(f"{low}_{n}")
        out.append(f"{k}_{n}")
    return out


def records_to_table(df: DataFrame, record_col: str = "record",
                     keep: Sequence[str] = (), max_columns: int = MAX_COLUMNS) -> DataFrame:
    """Flat records to columns: the union of all keys (sorted by name),
    absent keys null; see ``record_fields`` for types and surplus keys."""
    cols, more = record_fields(df, record_col, max_columns=max_columns)
    return df.select(*[named(c) for c in keep], *cols, *([] if more is None else [more]))


def merge_verdicts(rows: DataFrame, verdicts: DataFrame, key: str = "row_id",
                   names: Sequence[str] = ("verdict", "notes", "verdict_raw"),
                   verdict_key: str = "row_id", extra: Sequence[str] = ()) -> DataFrame:
    """Original rows with ``verdict`` (false when none came back),
    ``notes`` and ``verdict_raw`` (null when none) under ``names``, and the
    columns ``extra`` of the verdicts. When a row was judged twice, the first
    judgement (lowest batch, position) wins; without those columns the
    smallest by content.

    The verdicts are reduced per key and then left-joined; both sides are
    hash-partitioned on the key once, the reduce reuses that partitioning.
    All columns of ``rows`` stay; an added name that is taken is an error.
    """
    refuse_clash(rows.columns, *names, *extra)
    order = [c for c in ("batch_id", "pos") if c in verdicts.columns]
    payload = F.struct(F.col("verdict"), F.col("notes"),
                       (F.col("verdict_raw") if "verdict_raw" in verdicts.columns
                        else F.lit(None).cast("string")).alias("verdict_raw"),
                       *[named(c).alias(f"_rs_x{i}") for i, c in enumerate(extra)])
    rank = F.struct(*[F.col(c) for c in order or ("verdict", "notes")])
    one = (verdicts.where(named(verdict_key).isNotNull())
           .groupBy(named(verdict_key).alias("_rs_key")).agg(F.min_by(payload, rank).alias("_rs_v")))
    out = rows.join(one, named(key) == F.col("_rs_key"), "left")
    v, n, raw = names
    return out.select(
        *[named(c) for c in rows.columns],
        F.when(F.col("_rs_v").isNull(), F.lit(False)).otherwise(F.col("_rs_v.verdict")).alias(v),
        F.col("_rs_v.notes").alias(n), F.col("_rs_v.verdict_raw").alias(raw),
        *[F.col(f"_rs_v._rs_x{i}").alias(c) for i, c in enumerate(extra)])
