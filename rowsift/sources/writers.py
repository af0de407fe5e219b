"""Sinks: K1 write_json, K2 append_json, K3 write_table, K4 add_table,
K5 write_results.

JSON results are JSON Lines folders (one record per line, nulls written as
``null``), written by the executors in parallel. Folders we write carry a
hidden ``_rowsift_records`` marker, so appending to them needs no validation
scan; any other target is scanned and refused unless every line is a JSON
object or every file a list of them.

Any number of sessions may add to the same JSON set (K2) or the same source
(K4) at once. An add is staged in a folder of its own and moved in file by
file under a ledger entry (``adds``); a new table is staged and renamed as a
whole under a name reserved before; a target that must be rewritten first (a
single file, or lists) is rewritten by one session while the others wait, and
the old file gives way by two renames that a later add completes if the
session dies between them. An add or table that its caller names (``add_id``)
is made once, however often it is asked for.
"""

from __future__ import annotations

import itertools
import json
import os
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import create_new, delete, exists, is_file, listing, read_text, rename
from ..functions.jsontext import parse_strict
from .adds import add_files, added, json_types, note_types, only_one, reserved_name, set_types
from .formats import write_options

MARKER = "_rowsift_records"
OWNER = "_rowsift_add"
# Output name pattern and refusal messages.
NAME_SUFFIX = "_Analyzed"
NOT_A_LIST = "the target holds something else than JSON records; nothing was added"


def _mark(spark: SparkSession, path: str) -> None:
    """Leave the hidden marker file in a folder of JSON records we wrote
    (one small file written by the driver; readers skip ``_`` names)."""
    create_new(spark, f"{path.rstrip('/')}/{MARKER}", "json lines of records\n")


def _beside(path: str, name: str) -> str:
    """A path in the folder that ``path`` lies in."""
    return path[:path.rfind("/") + 1] + name


def _lock(path: str) -> str:
    return _beside(path, f"_rowsift_lock-{os.path.basename(path)}")


def write_json(df: DataFrame, path: str, mode: str = "new", add_id: str | None = None) -> str:
    """K1: a new JSON result set (``mode="new"`` refuses an existing target;
    ``"overwrite"`` replaces it). It is staged beside the target and renamed,
    so a target is there whole or not at all. With ``add_id`` a target that
    this very write made before is left as it is."""
    spark, path = df.sparkSession, path.rstrip("/")
    if mode not in ("new", "overwrite"):
        raise ValueError("mode must be 'new' or 'overwrite'")
    if add_id and exists(spark, path) and added(spark, path, add_id):
        return path
    if mode == "new" and exists(spark, path):
        raise FileExistsError(f"{path} exists")
    fresh = _beside(path, f"_rowsift_new-{uuid.uuid4().hex}")
    add_files(df, fresh, "json", add_id, types=True)
    _mark(spark, fresh)
    if mode == "overwrite" and exists(spark, path):
        delete(spark, path)
    if not rename(spark, fresh, path):
        delete(spark, fresh)
        raise FileExistsError(f"{path} exists")
    return path


def json_records_form(spark: SparkSession, path: str) -> str:
    """How a target holds JSON records: ``"lines"`` (one object per line) or
    ``"lists"`` (each file one list of objects, on any number of lines).
    Anything else is refused."""
    if exists(spark, f"{path.rstrip('/')}/{MARKER}"):
        return "lines"
    lines = spark.read.format("text").load(path)
    blank = F.trim(F.col("value")) == ""
    v = parse_strict("value")
    bad = lines.where(~blank & (v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT")))
    if bad.isEmpty():
        return "lines"
    whole = spark.read.format("text").option("wholetext", "true").load(path).withColumn("_rs_v", parse_strict("value"))
    items = F.try_variant_get("_rs_v", "$", "array<variant>")
    odd = (items.isNull() | ~F.schema_of_variant("_rs_v").startswith("ARRAY")
           | F.exists(items, lambda e: ~F.schema_of_variant(e).startswith("OBJECT")))
    if not whole.where(F.coalesce(odd, F.lit(True))).isEmpty():
        raise ValueError(NOT_A_LIST)
    return "lists"


def _settle_rewrite(spark: SparkSession, path: str) -> None:
    """Complete a rewrite that died between its two renames."""
    fresh, old = f"{path}_rs_new", f"{path}_rs_old"
    if exists(spark, old) and not exists(spark, path) and not rename(spark, fresh, path):
        rename(spark, old, path)
    if exists(spark, path):
        delete(spark, old)
        delete(spark, fresh)


def _as_lines(spark: SparkSession, path: str) -> None:
    """Make a target a folder of JSON lines that adds can go to, once."""
    marker = f"{path}/{MARKER}"
    if exists(spark, marker):
        return
    with only_one(spark, _lock(path)):
        _settle_rewrite(spark, path)
        if exists(spark, marker):
            return
        form = json_records_form(spark, path)
        if form == "lines" and not is_file(spark, path):
            note_types(spark, path, json_types(spark, path, spark.read.json(path).schema))
            _mark(spark, path)
            return
        old = read_json(spark, path, multi_line=form == "lists")
        fresh = f"{path}_rs_new"
        write_json(old, fresh, mode="overwrite")
        if not rename(spark, path, f"{path}_rs_old"):
            raise RuntimeError(f"{path} could not be moved aside")
        _settle_rewrite(spark, path)


def append_json(df: DataFrame, path: str, create_missing: bool = True, add_id: str | None = None) -> str:
    """K2: add records to an existing set (old rows kept, keys may differ).

    A missing target is created (``create_missing``) or refused; a target that
    is not JSON records is refused and left unchanged. A target of indented
    lists (one per file), or one single file of lines, becomes a folder of JSON
    lines first. With ``add_id`` the records are added once, however often this
    is called.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    if not exists(spark, path):
        if exists(spark, f"{path}_rs_old"):
            with only_one(spark, _lock(path)):
                _settle_rewrite(spark, path)
        elif not create_missing:
            raise FileNotFoundError(path)
        else:
            try:
                return write_json(df, path, add_id=add_id)
            except FileExistsError:  # created meanwhile: add to it
                pass
    _as_lines(spark, path)
    add_files(df, path, "json", add_id, types=True)
    return path


def read_json(spark: SparkSession, path: str, schema=None, multi_line: bool = False) -> DataFrame:
    """Read a JSON result set back (union of keys across appends).

    The types of a set that we wrote come from its ledger, without a pass over
    its records. ``multi_line=True`` reads files that each hold one (indented)
    JSON array of records, the form the original tool wrote."""
    r = spark.read
    if schema is None and not multi_line:
        schema = set_types(spark, path)
    if schema is not None:
        r = r.schema(schema)
    if multi_line:
        r = r.option("multiLine", "true")
    return r.json(path)


def write_table(df: DataFrame, source: str, table: str, format: str = "parquet") -> str:
    """K3: a new result table in a source; refuses an existing table."""
    path = f"{source.rstrip('/')}/{table}"
    df.write.mode("errorifexists").format(format).options(**write_options(format)).save(path)
    return path


def add_table(df: DataFrame, source: str, table: str, format: str = "parquet", add_id: str | None = None) -> str:
    """K4: add a table to a source; when the name is taken, the first free of
    ``name_1``, ``name_2``, ... is used. Returns the name used. A name is taken
    when its folder exists (a JSON result folder ``name.json`` does not take it)
    or another session is about to use it. With ``add_id`` the table that this
    very add made before is found and its name returned."""
    spark = df.sparkSession
    base = source.rstrip("/")
    if add_id:
        for name, _ in listing(spark, base):
            if (name == table or name.startswith(f"{table}_")) and read_text(spark, f"{base}/{name}/{OWNER}") == json.dumps(add_id):
                return name
    staged = f"{base}/_rowsift_new-{uuid.uuid4().hex}"
    write_table(df, base, os.path.basename(staged), format)
    if add_id:
        create_new(spark, f"{staged}/{OWNER}", json.dumps(add_id))
    names = itertools.chain([table], (f"{table}_{n}" for n in itertools.count(1)))
    while True:
        with reserved_name(spark, base, names) as name:
            if rename(spark, staged, f"{base}/{name}"):
                return name


def append_table(df: DataFrame, source: str, table: str, format: str = "parquet", add_id: str | None = None) -> str:
    """Add rows to a table of a source that grows by adds (a stream's results);
    each named add once. The table is made by its first add."""
    add_files(df, f"{source.rstrip('/')}/{table}", format, add_id)
    return table


def output_names(input_name: str, sheet: str, column: str) -> tuple[str, str]:
    """Names of the two outputs: ``{base}_by_{column}_Analyzed`` (JSON, base =
    input file name without extension) and ``{sheet}_by_{column}_Analyzed``."""
    base = os.path.splitext(os.path.basename(input_name.rstrip("/")))[0]
    return f"{base}_by_{column}{NAME_SUFFIX}", f"{sheet}_by_{column}{NAME_SUFFIX}"


def write_results(df: DataFrame, out_dir: str, input_name: str, sheet: str, column: str,
                  option: str = "new_file", format: str = "parquet",
                  persist: bool = True, json_target: str | None = None,
                  table_source: str | None = None, add_id: str | None = None) -> dict:
    """K5: both outputs of one result. ``new_file`` = K1 + K3, ``same_file`` =
    K2 + K4. JSON goes first; a failed JSON write raises and skips the table.
    ``json_target`` is the JSON set to write or add to and ``table_source`` the
    folder that gets the table; by default both lie in ``out_dir`` under the
    derived names. ``add_id`` names the write, so that one which died between
    the two can be repeated: what is there already is not written again.

    The result is persisted (memory and disk) for the two writes; lost blocks
    are recomputed from lineage, which callers keep deterministic.
    """
    if option not in ("new_file", "same_file"):
        raise ValueError("option must be 'new_file' or 'same_file'")
    json_name, table_name = output_names(input_name, sheet, column)
    out_dir = out_dir.rstrip("/")
    src = df.persist(StorageLevel.MEMORY_AND_DISK) if persist else df
    try:
        json_path = json_target or f"{out_dir}/{json_name}.json"
        home = (table_source or out_dir).rstrip("/")
        if option == "new_file":
            write_json(src, json_path, add_id=add_id)
            used = table_name
            if not add_id or read_text(df.sparkSession, f"{home}/{used}/{OWNER}") != json.dumps(add_id):
                _new_table(src, home, used, format, add_id)
        else:
            append_json(src, json_path, add_id=add_id)
            used = add_table(src, home, table_name, format, add_id)
    finally:
        if persist:
            src.unpersist()
    return {"json_path": json_path, "table_name": used,
            "table_path": f"{home}/{used}"}


def _new_table(df: DataFrame, home: str, table: str, format: str, add_id: str | None) -> None:
    """K3, staged and renamed when the write has a name, so a repeat finds it whole or not at all."""
    if add_id is None:
        write_table(df, home, table, format)
        return
    spark, staged = df.sparkSession, f"_rowsift_new-{uuid.uuid4().hex}"
    write_table(df, home, staged, format)
    create_new(spark, f"{home}/{staged}/{OWNER}", json.dumps(add_id))
    if not rename(spark, f"{home}/{staged}", f"{home}/{table}"):
        delete(spark, f"{home}/{staged}")
        raise FileExistsError(f"{home}/{table} exists")
