"""What a session needs: the package on its executors, and a folder that all of them see."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per session's context; the driver serves the archive."""
    context = spark.sparkContext
    if getattr(context, "_stratafold_shipped", False):
        return
    context._stratafold_shipped = True
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="stratafold-"), "stratafold.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(here)))
    context.addPyFile(archive)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below `spark.checkpoint.dir`, which all executors see; it goes when the JVM ends.

    Only a local session may leave that setting out, as tests do: a folder of this machine then serves all its threads.
    """
    context = spark.sparkContext
    found = getattr(context, "_stratafold_dir", None)
    if found is None:
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
            top = "file://" + tempfile.mkdtemp(prefix="stratafold-")
        found = context._stratafold_dir = f"{top}/stratafold-{uuid.uuid4().hex}"
        path = context._jvm.org.apache.hadoop.fs.Path(found)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return found


def saved(df: DataFrame, folder: str | None = None) -> DataFrame:
    """`df` written once as a table in the shared folder and read back: it is not computed again and survives lost executors."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stratafold_path = path
    return out


def _delete(spark: SparkSession, name: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def dropped(df: DataFrame) -> None:
    """Delete a `saved` table whose readers have been written."""
    _delete(df.sparkSession, df._stratafold_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables `saved` inside go at the end; the function given saves one that stays."""
    outer = shared_dir(spark)
    inner = spark.sparkContext._stratafold_dir = f"{outer}/{uuid.uuid4().hex}"
    try:
        yield lambda df: saved(df, outer)
    finally:
        spark.sparkContext._stratafold_dir = outer
        _delete(spark, inner)
