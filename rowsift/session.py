"""Session helpers: a tuned local session for tests/bench and the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from .files import delete


def get_session(master: str | None = None, app: str = "rowsift",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session or build one with settings suited to this library.

    On a cluster the session normally exists already (spark-submit); then it is
    returned untouched. The settings below are the ones the library relies on:
    AQE for runtime coalescing / skew splits, UTC for stable timestamps.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    return builder.getOrCreate()


def checkpoint_base(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    ``spark.checkpoint.dir`` as the session reports it (or the folder already
    registered with the SparkContext). Only a local session (tests, a laptop)
    without one gets a private temporary folder: on a cluster a machine-local
    folder would leave each executor's files where no other machine can read
    them, so the setting is required there.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can "
                               "reach (HDFS, object store, shared mount).")
        base = tempfile.mkdtemp(prefix="rowsift-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh folder under the shared checkpoint folder (see checkpoint_base)."""
    return "/".join([checkpoint_base(spark), "rowsift", *parts, uuid.uuid4().hex])


class Scratch:
    """The intermediate tables of one piece of work, so that they can go when it is done.

    ``with Scratch(spark):`` notes every table that ``written`` makes inside
    and deletes them at the end; what is still to be read must be written
    elsewhere before. Outside of any such block tables stay in the shared
    folder, since a lazy result may read them at any time.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []
        self._token = None

    def __enter__(self) -> "Scratch":
        self._token = _SCRATCH.set(self)
        return self

    def __exit__(self, *_) -> None:
        _SCRATCH.reset(self._token)
        self.release()

    def release(self) -> None:
        """Delete the tables noted so far."""
        while self.paths:
            delete(self.spark, self.paths.pop())


_SCRATCH: ContextVar[Scratch | None] = ContextVar("rowsift_scratch", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    What follows reads the files: a paid call, an expensive plan or an order
    with ties is evaluated once, however many readers there are, and a lost
    executor costs a re-read. A surrounding ``Scratch`` deletes it at its end.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    scratch = _SCRATCH.get()
    if scratch is not None:
        scratch.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """``df`` dealt round-robin over ``partitions`` tasks (default: the
    session's shuffle partitions) for a callable whose cost is per row, not
    per byte (a remote call per request).

    Not ``repartition(n, key)``: on a frame already grouped by that key
    Spark drops it as redundant, and AQE then packs the whole (small in
    bytes) input into one task, so every call would run in sequence. A
    shuffle with an explicit partition count is neither dropped nor
    coalesced; Spark sorts rows before dealing them, so a retried task gets
    the same rows."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint()`` usable, keeping a configured folder."""
    checkpoint_base(spark)


_SHIPPED: set = set()


def ship_package(spark: SparkSession | None = None) -> None:
    """Make ``rowsift`` importable in the executors' Python workers.

    Functions handed to ``mapInPandas`` / pandas UDFs are pickled by
    reference to their module, so executors must be able to import the
    package. This is what ``--py-files rowsift.zip`` does at submit time; here
    the driver zips its copy of the package once per application and adds it
    with ``SparkContext.addPyFile`` (Spark distributes it to every executor).
    """
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile

    import rowsift

    root = os.path.dirname(os.path.abspath(rowsift.__file__))
    parent = os.path.dirname(root)
    folder = tempfile.mkdtemp(prefix="rowsift-py-")
    path = os.path.join(folder, "rowsift.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    z.write(full, os.path.relpath(full, parent))
    sc.addPyFile(path)
    _SHIPPED.add(key)
