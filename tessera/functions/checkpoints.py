"""Tables that cut a plan, written to the folder that the cluster shares."""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder, as in tests.
DEFAULT_DIR = "/tmp/checkpoints"

#: Paths that the scope around the running code will delete, if there is one.
_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)


def folder(spark: SparkSession) -> str:
    """The folder of this application below ``spark.checkpoint.dir``."""
    root = (spark.conf.get("spark.checkpoint.dir", None) or DEFAULT_DIR).rstrip("/")
    return f"{root}/tessera/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in that folder; it goes with the scope that it was asked for in."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    paths = _scope.get()
    if paths is not None:
        paths.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir`` and read back; it survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what was cut inside; results have to be fetched or written before."""
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in paths:
            _delete(spark, path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all that this application has cut."""
    _delete(spark, folder(spark))
