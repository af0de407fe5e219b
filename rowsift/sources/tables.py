"""Sources and metadata: S1 read_table, S2 list_tables, S3 list_columns,
S4 read_many, and the source guards.

A *source* is a folder (local, HDFS, object store) holding one dataset per
table, either ``<source>/<table>.<format>`` (a file or folder) or
``<source>/<table>``; or ``catalog:<database>`` for tables in the session
catalog. All reads are lazy; only S2 runs a (listing) job.
"""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException
from py4j.protocol import Py4JJavaError

from ..functions.names import has_name, refuse_clash
from .formats import read_options

CATALOG_PREFIX = "catalog:"
KNOWN_FORMATS = ("parquet", "orc", "csv", "json", "text")
# The preferred filter column and the default table name.
DEFAULT_COLUMN = "DiseaseName"
DEFAULT_TABLE = "Sheet1"


def _reader(spark: SparkSession, fmt: str, schema: T.StructType | str | None, multi_line: bool = False):
    r = spark.read.format(fmt).options(**read_options(fmt, schema, multi_line))
    return r.schema(schema) if schema is not None else r


def read_table(spark: SparkSession, source: str, table: str | None = None,
               format: str = "parquet", schema: T.StructType | str | None = None,
               multi_line: bool = False) -> DataFrame:
    """Scan one named table of a source (lazy).

    Files are split among tasks; ``multi_line`` is for CSV fields with line
    ends in them and JSON records over several lines, and reads a file by one
    task. An absent table raises ``ValueError("Table 'x' not found. Available tables: a, b")``.
    """
    table = (table or "").strip() or DEFAULT_TABLE
    if source.startswith(CATALOG_PREFIX):
        db = source[len(CATALOG_PREFIX):]
        name = f"{db}.{table}" if db else table
        if not spark.catalog.tableExists(name):
            raise ValueError(_missing(table, list_table_names(spark, source)))
        return spark.table(name)
    base = source.rstrip("/")
    last_error: Exception | None = None
    for path in (f"{base}/{table}.{format}", f"{base}/{table}"):
        try:
            df = _reader(spark, format, schema, multi_line).load(path)
            df.schema  # noqa: B018 - resolves the path (and infers the schema) now
            return df
        except AnalysisException as err:
            last_error = err
            if "PATH_NOT_FOUND" not in str(err) and "Path does not exist" not in str(err):
                raise
    raise ValueError(_missing(table, list_table_names(spark, source))) from last_error


def _missing(table: str, available: Sequence[str]) -> str:
    return f"Table '{table}' not found. Available tables: {', '.join(available)}"


_TABLES_SCHEMA = T.StructType([T.StructField("table_name", T.StringType(), False)])


def list_table_names(spark: SparkSession, source: str) -> list[str]:
    """Names of the tables in a source, sorted; none when unreadable.

    A folder is listed one level deep by the file system itself, whatever lies
    below; nothing is opened. Hidden entries (``_x``, ``.x``) are skipped as
    Spark's readers skip them."""
    if source.startswith(CATALOG_PREFIX):
        try:
            return sorted(t.name for t in spark.catalog.listTables(source[len(CATALOG_PREFIX):] or None))
        except AnalysisException:
            return []
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
        entries = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    except Py4JJavaError:  # absent, or not readable
        return []
    names = {e.getPath().getName() for e in entries}
    tables = {re.sub(rf"\.({'|'.join(KNOWN_FORMATS)})$", "", n) for n in names}
    return sorted(t for t in tables if t and not t.startswith(("_", ".")))


def list_tables(spark: SparkSession, source: str) -> DataFrame:
    """Names of the tables in a source, sorted (see ``list_table_names``)."""
    return spark.createDataFrame([(n,) for n in list_table_names(spark, source)], _TABLES_SCHEMA)


def list_columns(df: DataFrame) -> DataFrame:
    """S3: (ordinal, name, type) of a table, from its schema only (no data read)."""
    spark = df.sparkSession
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    schema = "ordinal int, name string, type string"
    return spark.createDataFrame(rows, schema)


def default_column(df: DataFrame) -> str | None:
    """Guard: the preferred filter column if present, else the first; None if no columns."""
    cols = df.columns
    if not cols:
        return None
    return DEFAULT_COLUMN if DEFAULT_COLUMN in cols else cols[0]


def require_column(df: DataFrame, column: str | None) -> str:
    """Guard: a column must be given and exist."""
    if not column:
        raise ValueError("A filter column is needed.")
    if not has_name(column, df.columns):
        raise ValueError(f"Column '{column}' not found; the table has: {', '.join(df.columns)}")
    return column


def read_many(spark: SparkSession, paths: str | Sequence[str], format: str = "parquet",
              schema: T.StructType | str | None = None,
              file_column: str = "source_file", multi_line: bool = False) -> DataFrame:
    """The same table read from many files (a glob or a list), with the
    path of the file each row came from. Spark lists and splits the files;
    the path comes from the hidden ``_metadata`` column at no extra cost."""
    if isinstance(paths, str):
        paths = [paths]
    df = _reader(spark, format, schema, multi_line).load(list(paths))
    refuse_clash(df.columns, file_column)
    return df.withColumn(file_column, F.col("_metadata.file_path"))
