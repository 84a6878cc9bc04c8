"""Tables in the folder that the driver and all executors share.

Intermediate results that several jobs read are written as Parquet below
``spark.checkpoint.dir``.  A lost executor then costs the running job only, and
lineage ends at the files.  Only where that setting is absent and Spark runs on this
machine alone (tests, a laptop) is a folder of this machine taken instead; on a cluster
its absence is an error.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_own: dict[str, str] = {}
_written: dict[str, SparkSession] = {}
_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or one of this process if unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[(\*|[0-9]+)(, *[0-9]+)?\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors share (master {master})")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="quillon-")
    return _own["dir"]


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Set a session option for the length of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand documents to Python workers by ``rows`` at a time, unless the session says otherwise.

    The default of 10,000 texts of some kilobytes is copied several times in each task.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(rows))


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed with the scratch block it is made in or when this process ends."""
    path = f"{shared_dir(spark)}/quillon/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    if scopes := getattr(_scopes, "open", None):
        scopes[-1].append(path)
    return path


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Remove the tables written in a block at its end."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    made: list[str] = []
    _scopes.open.append(made)
    try:
        yield
    finally:
        _scopes.open.pop()
        for path in made:
            with contextlib.suppress(Exception):
                delete(_written.pop(path), path)


def settled(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Store what a function returns and remove all other tables that it wrote."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(f)
        def run(*args, **kwargs) -> DataFrame:
            with scratch():
                out = f(*args, **kwargs)
                inside = _scopes.open.pop()  # the result outlives the block
                try:
                    result = stored(out, name)
                finally:
                    _scopes.open.append(inside)
            return result

        return run

    return wrap


def release(spark: SparkSession, path: str) -> None:
    """Remove a stored table that nothing reads any more."""
    _written.pop(path, None)
    with contextlib.suppress(Exception):
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path through Spark's own file system layer."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def write(df: DataFrame, name: str, codec: str = "zstd") -> str:
    """Write ``df`` to the shared folder; where it is.

    The shuffle files of the writing job are dropped with it: whatever reads the
    result needs the table alone.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with setting(spark, _CLEANUP, "true"):
        df.write.option("compression", codec).parquet(path)
    return path


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read from there."""
    return df.sparkSession.read.schema(df.schema).parquet(write(df, name, codec))


def _clean() -> None:
    for path, spark in _written.items():
        with contextlib.suppress(Exception):
            delete(spark, path)
    if "dir" in _own:
        import shutil

        shutil.rmtree(_own["dir"].removeprefix("file://"), ignore_errors=True)


atexit.register(_clean)
