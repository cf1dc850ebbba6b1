"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and staged tables, as the session names it.

    A temporary folder stands in only in local mode, where driver and executors are one machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="packloom-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


# Paths given out in this process, for ``release``.
_paths: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    """An unused path in the shared folder."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _paths.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the tables staged by this process so far, and say how many. Frames made from them are gone."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_paths.pop())
        gone += path.getFileSystem(hadoop).delete(path, True)
    return gone


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back: cuts lineage, keeps columns prunable."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: each job's are deleted when it ends, not when the driver's garbage is."""
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


def stage_texts(df: DataFrame, label: str) -> DataFrame:
    """As ``stage``, for rows of long texts: compressed over a whole page, and the shuffles they came from are deleted."""
    path = new_path(df.sparkSession, label)
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers that do not have it installed.

    The archive lies with the driver, which serves it to the executors.
    """
    context = spark.sparkContext
    if any(os.path.basename(path) == "packloom.zip" for path in context.listFiles):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="packloom-ship-"), "packloom")
    context.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(package), "packloom"))
