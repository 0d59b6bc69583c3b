"""Writing intermediate results where every executor can read them again."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
#: Each application's folder below the shared one; tables of the innermost scopes.
_runs: dict[str, str] = {}
_scopes: list[list[DataFrame]] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, or else the one set on the context.

    A folder of our own takes its place only on a local master, where all tasks see the driver's disk; on a
    cluster without a shared folder this refuses.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    on_context = context.getCheckpointDir()
    if on_context:
        return on_context
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="siftline-")
    return _own_dirs[context.applicationId]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before the interpreter does
        pass


def run_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one, named by when it began; it goes as a whole when the interpreter ends."""
    name = spark.sparkContext.applicationId
    if name not in _runs:
        _runs[name] = f"{checkpoint_dir(spark).rstrip('/')}/siftline/run-{int(time.time())}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _runs[name])
    return _runs[name]


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet below the shared folder and read back.

    It cuts the lineage: a lost executor costs a read of files and no recomputation. Files go by ``unstage``, with the
    ``scratch`` around the call, or when the interpreter ends.
    """
    path = f"{run_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def unstage(df: DataFrame) -> None:
    """Removes the files of a table from ``staged`` that nothing will read again, such as a round of an iteration."""
    _remove(df.sparkSession, df._staged_at)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Removes what was staged inside when it ends: for applications that run long. Results must be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for df in _scopes.pop():
            unstage(df)


@contextlib.contextmanager
def keeping(into: list[DataFrame]) -> Iterator[None]:
    """Names what is staged inside to ``into``, whose owner removes it."""
    _scopes.append([])
    try:
        yield
    finally:
        into.extend(_scopes[-1])
        own = _scopes.pop()
        if _scopes:
            _scopes[-1].extend(own)


def staged_files(spark: SparkSession) -> list[str]:
    """Tables of this application that are still there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []


def sweep(spark: SparkSession, days: float = 7) -> int:
    """Removes the folders of applications that began more than ``days`` ago, such as of drivers that died; gives their number."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/siftline")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath() for f in files.listStatus(where)] if files.exists(where) else []
    old = [p for p in found if (name := p.getName()).startswith("run-") and int(name.split("-")[1]) < time.time() - 86400 * days and p.toString() != _runs.get(spark.sparkContext.applicationId)]
    for p in old:
        files.delete(p, True)
    return len(old)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
