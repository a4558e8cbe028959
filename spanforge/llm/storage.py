"""Places that driver and executors share: tables that cut lineage, and archive files."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1000
_own: dict[str, str] = {}
_paths: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, else the context's checkpoint folder.

    Without either, a temporary folder serves a local master alone; on a cluster that is an error,
    as no machine would see what another has written.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = own.get() if own.isDefined() else None
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="shared-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A new place; what is left of it goes when the driver ends."""
    path = f"{shared_dir(spark)}/spanforge-{name}-{uuid.uuid4().hex}"
    if not _paths:
        atexit.register(remove_all)
    _paths.add(path)
    return path


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_ROWS rows while a table is written, where the session has no size of its own.

    Texts are long: the default of 10,000 rows is meant for short ones. The setting is taken back.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if name in spark.conf.getAll:
        yield
        return
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.unset(name)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Removes tables that written() made and nothing reads any longer."""
    for df in frames:
        for path in {p for p in _paths if any(p.rsplit("/", 1)[-1] in f for f in df.inputFiles())}:
            _remove(path)


def remove_all() -> None:
    """Removes every table and archive folder of this driver; results not yet written are lost."""
    for path in list(_paths):
        _remove(path)


def _remove(path: str) -> None:
    _paths.discard(path)
    with contextlib.suppress(OSError, ValueError):  # gone already, or a store that Arrow can't reach: left to its owner
        store, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        store.delete_dir(place)
