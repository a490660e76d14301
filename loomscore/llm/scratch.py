"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


#: Folders that open scopes have made, innermost scope last.
SCOPES: list[list[str]] = []


def folder(spark: SparkSession) -> str:
    """A fresh path below ``spark.checkpoint.dir``.

    The setting is read from the session.  Only where none is set and the
    master is a local one, as in tests, a temporary folder is made and set;
    on a cluster executors couldn't read it, so there a missing setting is an
    error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomscore-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/loomscore-{uuid.uuid4().hex}"
    if SCOPES:
        SCOPES[-1].append(path)
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete ``path`` through Spark's file system layer, if the session still runs."""
    if spark.sparkContext._jsc is None:
        return
    with contextlib.suppress(Py4JError, OSError):  # the JVM may end first
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Folders made inside are deleted at its end; what is to stay is written to a folder made outside."""
    SCOPES.append([])
    try:
        yield
    finally:
        for path in SCOPES.pop():
            remove(spark, path)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts the lineage: a later stage, or one run again after an executor was
    lost, reads the files and doesn't repeat the work.
    """
    path = folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` returned and that nothing reads any more."""
    remove(df.sparkSession, df._scratch)
