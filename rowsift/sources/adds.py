"""Adds to a result folder that happen once, whole, and next to other adds.

A folder of results keeps a ledger, ``_rowsift_adds``, with one small file per
add. Its parts are written to a hidden folder of their own, so jobs that add at
the same time share no temporary files; then the entry is created (by one
caller only) with the list of files to move, the files are renamed into the
folder, and a second small file says that it is done. Whoever comes next finishes a move that
was cut short, file by file, so a kill at any point loses nothing and adds
nothing twice. A caller that names its add (a run, a micro-batch of a stream)
can repeat it: the entry is found and nothing is added.

Entries of JSON sets also hold the types of their records, as Spark's reader
would infer them, so a set of many adds is read without looking at its records
first.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..files import create_new, delete, exists, listing, make_dirs, read_text, rename
from .formats import write_options

LEDGER = "_rowsift_adds"
STAGED = "_rowsift_staged"
DONE = ".done"
#: A lock or a reserved name that was not given back is taken over after this time.
STALE_SECONDS = 6 * 3600


def _entry(path: str, add_id: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9._-]+", add_id):
        raise ValueError(f"an add is named by letters, digits, dot, dash and underscore, not {add_id!r}")
    return f"{path.rstrip('/')}/{LEDGER}/{add_id}.json"


def _state(spark: SparkSession, entry: str) -> dict:
    return json.loads(read_text(spark, entry))


def _finish(spark: SparkSession, path: str, entry: str) -> None:
    """Move what an entry lists and is not moved yet; only then is it done."""
    state = _state(spark, entry)
    for name in state["files"]:
        old, new = f"{state['staged']}/{name}", f"{path}/{name}"
        if not rename(spark, old, new) and not exists(spark, new):
            raise RuntimeError(f"{old} could not be moved to {new}")
    create_new(spark, f"{entry}{DONE}")
    delete(spark, state["staged"])


def settle(spark: SparkSession, path: str) -> None:
    """Finish the adds to ``path`` that were cut short while moving."""
    names = {n for n, _ in listing(spark, f"{path}/{LEDGER}")}
    for name in sorted(n for n in names if n.endswith(".json") and n + DONE not in names):
        _finish(spark, path, f"{path}/{LEDGER}/{name}")


def added(spark: SparkSession, path: str, add_id: str) -> bool:
    """Was this add done (or can it be finished now)?"""
    entry = _entry(path, add_id)
    if not exists(spark, entry):
        return False
    if not exists(spark, entry + DONE):
        _finish(spark, path.rstrip("/"), entry)
    return True


def add_files(df: DataFrame, path: str, format: str, add_id: str | None = None, types: bool = False) -> bool:
    """Add the rows of ``df`` to the folder ``path`` (made when absent) as
    files of ``format``. False, and nothing added, when the add of this name is
    there already. ``types`` notes the records' JSON types in the entry."""
    spark, path = df.sparkSession, path.rstrip("/")
    add_id = add_id or uuid.uuid4().hex
    entry = _entry(path, add_id)
    if added(spark, path, add_id):
        return False
    settle(spark, path)
    staged = f"{path}/{STAGED}/{add_id}-{uuid.uuid4().hex}"
    df.write.format(format).options(**write_options(format)).save(staged)
    names = [n for n, _ in listing(spark, staged) if not n.startswith(("_", "."))]
    state = {"staged": staged, "files": names}
    if types:
        state["schema"] = json_types(spark, staged, df.schema).jsonValue()
    make_dirs(spark, path)
    if not create_new(spark, entry, json.dumps(state)):  # the same add, by someone else
        delete(spark, staged)
        added(spark, path, add_id)
        return False
    _finish(spark, path, entry)
    return True


# ---------------------------------------------------------------- locks and names

@contextmanager
def only_one(spark: SparkSession, path: str, wait_seconds: float = 600.0):
    """Hold the lock file ``path`` meanwhile; others wait for it."""
    end = time.monotonic() + wait_seconds
    while not create_new(spark, path, json.dumps({"since": time.time()})):
        if not _take_over(spark, path):
            if time.monotonic() > end:
                raise TimeoutError(f"{path} is held by another session")
            time.sleep(0.2)
    try:
        yield
    finally:
        delete(spark, path)


def _take_over(spark: SparkSession, path: str) -> bool:
    """Remove a lock or reservation that its owner left behind long ago."""
    text = read_text(spark, path)
    if text and time.time() - json.loads(text)["since"] > STALE_SECONDS:
        return rename(spark, path, f"{path}.{uuid.uuid4().hex}")
    return False


@contextmanager
def reserved_name(spark: SparkSession, base: str, names):
    """The first of ``names`` that no table of ``base`` has and nobody else is
    about to take; reserved by a file created if absent."""
    for name in names:
        if exists(spark, f"{base}/{name}"):
            continue
        mark = f"{base}/_rowsift_names/{name}"
        if not create_new(spark, mark, json.dumps({"since": time.time()})) and not (
                _take_over(spark, mark) and create_new(spark, mark, json.dumps({"since": time.time()}))):
            continue
        try:
            if exists(spark, f"{base}/{name}"):  # finished between the look and the mark
                continue
            yield name
            return
        finally:
            delete(spark, mark)


# ---------------------------------------------------------------- types of JSON records

def json_types(spark: SparkSession, path: str, written: T.StructType) -> T.StructType:
    """The types of the JSON lines below ``path``; a field without any value has type void.

    One scan, or a second one where a field of ``written`` has no value at all."""
    try:
        slim = spark.read.option("dropFieldIfAllNull", "true").json(path).schema
    except AnalysisException:  # no files, no records
        return T.StructType([])
    if _names(written) <= _names(slim):
        return slim
    return _with_voids(spark.read.json(path).schema, slim)


def _names(kind: T.DataType, at: str = "") -> set[str]:
    """Paths of all fields of a type; what lies below a map cannot be known."""
    if isinstance(kind, T.StructType):
        return {p for f in kind.fields for p in {f"{at}.{f.name}", *_names(f.dataType, f"{at}.{f.name}")}}
    if isinstance(kind, T.ArrayType):
        return _names(kind.elementType, f"{at}[]")
    return {f"{at}{{}}"} if isinstance(kind, T.MapType) else set()


def _with_voids(full: T.DataType, slim: T.DataType | None) -> T.DataType:
    """``full``, with type void for what ``slim``, which leaves out fields without a value, does not have."""
    if isinstance(full, T.StructType):
        have = {f.name: f.dataType for f in slim.fields} if isinstance(slim, T.StructType) else {}
        return T.StructType([T.StructField(f.name, _with_voids(f.dataType, have.get(f.name))) for f in full.fields])
    if isinstance(full, T.ArrayType):
        return T.ArrayType(_with_voids(full.elementType, slim.elementType if isinstance(slim, T.ArrayType) else None))
    return T.NullType() if slim is None else full


def _decimal(kind: T.DataType) -> T.DecimalType | None:
    if isinstance(kind, T.DecimalType):
        return kind
    return T.DecimalType(20, 0) if isinstance(kind, T.LongType) else None


def widened(a: T.DataType, b: T.DataType) -> T.DataType:
    """The one type that values of both are read as, by the rules of Spark's JSON reader."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        kinds = {f.name: f.dataType for f in a.fields}
        for f in b.fields:
            kinds[f.name] = widened(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
        return T.StructType([T.StructField(n, kinds[n]) for n in sorted(kinds)])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(widened(a.elementType, b.elementType))
    numbers = (T.LongType, T.DoubleType, T.DecimalType)
    if isinstance(a, numbers) and isinstance(b, numbers):
        if isinstance(a, T.DoubleType) or isinstance(b, T.DoubleType):
            return T.DoubleType()
        p, q = _decimal(a), _decimal(b)
        scale, whole = max(p.scale, q.scale), max(p.precision - p.scale, q.precision - q.scale)
        return T.DoubleType() if scale + whole > 38 else T.DecimalType(scale + whole, scale)
    return T.StringType()


def _settled(kind: T.DataType) -> T.DataType:
    """Fields that never had a value read as text; all else stays."""
    if isinstance(kind, T.NullType):
        return T.StringType()
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _settled(f.dataType)) for f in kind.fields])
    return T.ArrayType(_settled(kind.elementType)) if isinstance(kind, T.ArrayType) else kind


def set_types(spark: SparkSession, path: str) -> T.StructType | None:
    """The type of a set's records from its ledger; None when an entry does not say."""
    merged: T.DataType = T.StructType([])
    seen = False
    for name, _ in listing(spark, f"{path.rstrip('/')}/{LEDGER}"):
        if not name.endswith(".json"):
            continue
        state = _state(spark, f"{path.rstrip('/')}/{LEDGER}/{name}")
        if "schema" not in state:
            return None
        merged, seen = widened(merged, T.StructType.fromJson(state["schema"])), True
    return _settled(merged) if seen else None


def note_types(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Note the types of records that were in the folder before its first add."""
    entry = _entry(path, "before")
    create_new(spark, entry + DONE)
    create_new(spark, entry, json.dumps({"staged": f"{path}/{STAGED}/before", "files": [], "schema": schema.jsonValue()}))
