"""A sink for micro-batches in which each counts once, however often it is run.

The folder is its own ledger: a batch is written aside and becomes part of the table by one rename to its number.
A batch whose number is there is not written again; what a crash left aside is not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from packloom.sources.state_log import _files, rename_once

_BATCH = "batch="


def write_batch(rows: DataFrame, path: str) -> str:
    """First half of a batch: its rows under a name no reader looks at; that name."""
    name = f"_writing-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path.rstrip('/')}/{name}")
    return name


def once(path: str, writer: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that adds each batch of the query ``writer`` to the table at ``path`` once.

    Batches are numbered by the query's checkpoint. A query over another checkpoint needs a name of its own, or its
    batches pass for those already there.
    """
    folder = f"{path.rstrip('/')}/writer={writer}"

    def sink(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        system, place = _files(spark, folder)
        if system.exists(place(f"{_BATCH}{number}")):
            return
        name = write_batch(rows, folder)
        if not rename_once(spark, folder, name, f"{_BATCH}{number}"):
            # The same batch was committed by another run meanwhile.
            system.delete(place(name), True)

    return sink


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches committed so far, with ``writer`` and ``batch``; no rows if there is none yet."""
    full = T.StructType([*schema.fields, T.StructField("writer", T.StringType()), T.StructField("batch", T.LongType())])
    system, place = _files(spark, path)
    return spark.read.schema(full).parquet(path) if system.exists(place(".")) else spark.createDataFrame([], full)
