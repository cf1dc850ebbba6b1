"""Continuous reading of triplet files; the checkpoint keeps the position."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from packloom.sources.jsonl import DATA_FILE_GLOB, not_blank, parse_triplets


def stream_triplets(
    spark: SparkSession,
    folder: str,
    max_files_per_trigger: int | None = None,
    num_negatives: int = 1,
    extras: T.StructType | None = None,
    delete_read: bool = False,
) -> DataFrame:
    """Triplets of all data files in a folder, also of files that arrive later.

    ``delete_read`` deletes a file when a later micro-batch begins than the one that read it: for feeds nobody else reads.
    """
    reader = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", DATA_FILE_GLOB)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if delete_read:
        reader = reader.option("cleanSource", "delete")
    lines = reader.text(folder).where(not_blank())
    return parse_triplets(lines, num_negatives=num_negatives, extras=extras)


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of long arrays that cross to or from a packer's worker at once.
SMALL_BATCH = 256


@contextmanager
def small_batches(spark: SparkSession):
    """Queries started inside give their Python workers few rows at a time; their results are gathered to as many, too."""
    before = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, str(min(SMALL_BATCH, int(before)) if int(before) > 0 else SMALL_BATCH))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)


def run_available(
    stream: DataFrame,
    checkpoint: str,
    sink: str | Callable[[DataFrame, int], None],
    output_mode: str = "append",
) -> StreamingQuery:
    """Process everything that has arrived since the last run, then stop.

    ``sink`` is a folder for Parquet (in zstd, as texts are long) or a function of (rows, batch id). The next run with the same
    checkpoint goes on after the last finished micro-batch.
    """
    writer = stream.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
    if callable(sink):
        writer = writer.foreachBatch(sink)
    else:
        writer = writer.format("parquet").option("compression", "zstd").option("path", sink)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
