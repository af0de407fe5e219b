"""Small file system steps on any storage the session reads (Hadoop FileSystem):
existence, rename, delete, create-if-absent, small text files.

``create_new`` and ``rename`` are the two steps that writers build on: a file
is created by one caller only, and a folder moves as a whole. HDFS and local
disks do both in one step; an object store does as far as its connector does.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def fs_path(spark: SparkSession, path: str):
    """(Hadoop FileSystem, Path), configured like the session's readers."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Does a file or folder exist? One metadata call, no listing job."""
    fs, p = fs_path(spark, path)
    return bool(fs.exists(p))


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = fs_path(spark, path)
    return bool(fs.exists(p)) and bool(fs.getFileStatus(p).isFile())


def make_dirs(spark: SparkSession, path: str) -> None:
    fs, p = fs_path(spark, path)
    fs.mkdirs(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = fs_path(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Move a file or folder to a name that is not there; False when it did not move."""
    fs, p = fs_path(spark, old)
    q = fs_path(spark, new)[1]
    try:
        return not fs.exists(q) and bool(fs.rename(p, q))
    except Py4JJavaError:  # gone already, or taken meanwhile
        return False


def listing(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, time of last change in milliseconds) of a folder's entries; none when it is absent."""
    fs, p = fs_path(spark, path)
    if not fs.exists(p):
        return []
    return sorted((s.getPath().getName(), int(s.getModificationTime())) for s in fs.listStatus(p))


def _put(stream, text: str) -> None:
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def create_new(spark: SparkSession, path: str, text: str = "") -> bool:
    """Create a file unless it is there; of several callers at once one gets True."""
    fs, p = fs_path(spark, path)
    fs.mkdirs(p.getParent())
    if fs.getUri().getScheme() == "file":  # its create() looks first and writes then
        local = spark.sparkContext._jvm.java.io.File(p.toUri().getPath())
        if not local.createNewFile():
            return False
        _put(fs.create(p, True), text)
        return True
    try:
        _put(fs.create(p, False), text)
        return True
    except Py4JJavaError:
        if fs.exists(p):
            return False
        raise


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, replaced as a whole: written beside it, then moved over."""
    fs, p = fs_path(spark, path)
    fs.mkdirs(p.getParent())
    fresh = fs_path(spark, f"{path}.{uuid.uuid4().hex}")[1]
    _put(fs.create(fresh, True), text)
    if fs.exists(p):
        fs.delete(p, False)
    fs.rename(fresh, p)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None when it is absent."""
    fs, p = fs_path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        jvm = spark.sparkContext._jvm
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
