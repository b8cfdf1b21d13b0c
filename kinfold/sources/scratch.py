"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid
import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    ``spark.checkpoint.dir`` names it on a cluster. Only where that is unset
    (tests, ``local[n]``) is a temporary folder made and set for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        current = context._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="kinfold-checkpoint-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder (small tables)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SCRATCH: list[tuple[SparkSession, str]] = []
_SCOPE: contextvars.ContextVar[Scope | None] = contextvars.ContextVar("kinfold_scope", default=None)


class Scope:
    """The scratch tables that one piece of work has made and has not kept."""

    def __init__(self, outer: Scope | None):
        self.outer, self.tables = outer, []

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, stored so that it outlives this scope."""
        out, table = _write(df)
        if self.outer:
            self.outer.tables.append(table)
        return out


def _write(df: DataFrame) -> tuple[DataFrame, tuple[SparkSession, str]]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinfold-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _SCRATCH.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), _SCRATCH[-1]


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again (larger
    tables: columnar, compressed, column-pruned). It is deleted at the end of the
    ``temporary`` scope that it is made in, else when the process ends."""
    out, table = _write(df)
    if scope := _SCOPE.get():
        scope.tables.append(table)
    return out


@contextlib.contextmanager
def temporary() -> Iterator[Scope]:
    """Deletes the scratch tables that are made inside, at the end or on an error,
    but for those that went through ``keep``. What leaves the scope may read kept
    tables only."""
    scope = Scope(_SCOPE.get())
    token = _SCOPE.set(scope)
    try:
        yield scope
    finally:
        _SCOPE.reset(token)
        release(scope.tables)


@atexit.register
def release(tables: list[tuple[SparkSession, str]] | None = None) -> None:
    """Delete scratch tables: those given, or all of this process."""
    for found in list(_SCRATCH if tables is None else tables):
        spark, path = found
        if found in _SCRATCH:
            _SCRATCH.remove(found)
        if spark.sparkContext._jsc is None:  # the session has ended already
            continue
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception as e:  # what can't be deleted now is left to the folder's owner
            warnings.warn(f"scratch table {path} was not deleted: {e}", stacklevel=2)
