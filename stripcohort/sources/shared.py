"""The folder that driver and executors share: tables that cut lineage, and files that tasks write for each other."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One of our own only in local mode, where all run on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="stripcohort-"))
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named or context.getCheckpointDir()


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)
_left: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the tables and files that were made inside. Write out what is to last before that.

    Outside of it they stay until Python ends, since a result that hasn't been read yet may need them.
    """
    made: list[str] = []
    token = _scratch.set(made)
    try:
        yield
    finally:
        _scratch.reset(token)
        remove(spark, *made)


def fresh(spark: SparkSession) -> str:
    """A path in the shared folder for one table or set of files, which is removed as scratch() says."""
    path = f"{shared_dir(spark).rstrip('/')}/stripcohort-{uuid.uuid4().hex}"
    made = _scratch.get()
    (_left if made is None else made).append(path)
    return path


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """The path and its file system, as Hadoop's objects."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(context._jsc.hadoopConfiguration())


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at, system = hadoop_path(spark, path)
        system.delete(at, True)


@atexit.register
def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _left:
        try:
            remove(spark, *_left)
        except Exception as e:  # the session may be gone with the cluster
            print(f"left in the shared folder: {e}")


def durable(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cuts the lineage: the rows are a table in the shared folder, so a lost executor costs no recomputation."""
    path = path or fresh(df.sparkSession)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.durable_path = path
    return kept


def forget(*tables: DataFrame) -> None:
    """Removes tables made by durable() that no later step reads."""
    for kept in tables:
        remove(kept.sparkSession, kept.durable_path)
