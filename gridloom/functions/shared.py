"""Cutting lineage through the folder every executor can reach."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="gridloom-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a fresh temporary one only for local masters."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder(spark.sparkContext.applicationId)


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/gridloom/{spark.sparkContext.applicationId}"


_scope: ContextVar[str] = ContextVar("gridloom-storage", default="")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_application_folder(spark)}{_scope.get()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once as parquet and read back, so that several consumers share one evaluation.

    Parquet keeps column pruning and predicate pushdown for the consumers, and the files
    outlive any executor.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_storage(spark: SparkSession) -> Iterator[None]:
    """Whatever is stored inside is deleted on the way out, also after an error."""
    token = _scope.set(f"{_scope.get()}/scope-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        _delete(spark, f"{_application_folder(spark)}{_scope.get()}")
        _scope.reset(token)


def discard_stored(spark: SparkSession) -> None:
    """Delete what this application has stored, once nothing reads it any more."""
    _delete(spark, _application_folder(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
