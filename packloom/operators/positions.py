"""Row numbers over a whole table without a single-task window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.workspace import stage

# monotonically_increasing_id keeps the row ordinal of a task in its low 33 bits.
_ROW_BITS = (1 << 33) - 1


def _offsets(counts: DataFrame, bucket: str, name: str) -> DataFrame:
    """Running total of the rows in all earlier buckets. One row per bucket, never per data row."""
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(bucket, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(name))


def dense_positions(
    df: DataFrame,
    *order: Column | str,
    name: str = "pos",
    then: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """Number rows 0..n-1 in ``order``, which must be a total order.

    One range shuffle, then the sorted table is staged: range bounds come from a sample, so the
    partitions must not be computed a second time. Offsets have one row per partition.

    ``then`` adds columns to the sorted rows before they are stored. Costly ones belong here: what
    comes before the shuffle runs for the sample as well, and is shuffled.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.withColumn("__part", F.spark_partition_id()).withColumn(
        "__idx", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))
    )
    staged = stage(then(numbered), "positions")
    # Stored as well, or every later read of the rows would count them again.
    offsets = stage(_offsets(staged.groupBy("__part").count(), "__part", "__offset"), "offsets")
    return (
        staged.join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__offset") + F.col("__idx"))
        .drop("__part", "__idx", "__offset")
    )


def number_rows(df: DataFrame, bucket: str, *order: Column | str, name: str) -> DataFrame:
    """Number rows 0..n-1 by ``(bucket, order)`` when ``bucket`` already rises with the order.

    ``df`` is read twice (counts, then rows) and must give the same rows both times. The number of
    buckets is the caller's bound on what is broadcast, the rows per bucket what one window sorts.
    """
    offsets = _offsets(df.groupBy(bucket).count(), bucket, "__offset")
    inside = Window.partitionBy(bucket).orderBy(*order)
    return (
        df.withColumn("__rank", F.row_number().over(inside))
        .join(F.broadcast(offsets), bucket)
        .withColumn(name, F.col("__offset") + F.col("__rank") - 1)
        .drop("__offset", "__rank")
    )
