"""Sets of whole-number ids as bitmaps: two sets are compared in one pass with one shuffle of bitmaps.

Ids are dealt to buckets of 2^15 consecutive numbers. Each task ORs its ids into one bitmap a bucket and side, so what
crosses the network is at most 4 KB a bucket, side and task instead of an id a row. For ids that lie densely; far apart,
an id costs a whole bitmap, and ``quality.id_differences`` is the one to use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: ids of one bitmap, as Spark's bitmap functions deal them.
BITS = 32_768


def _both(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row per bucket: the bitmaps ``l`` and ``r`` of the two sides. Null ids take no part."""
    number = F.col(key).cast("long").alias("id")
    ids = left.select(number, F.lit(True).alias("first")).unionAll(right.select(number, F.lit(False).alias("first")))
    ids = ids.where(F.col("id").isNotNull())
    bit = F.bitmap_bit_position("id")
    maps = ids.groupBy(F.bitmap_bucket_number("id").alias("bucket"), "first").agg(F.bitmap_construct_agg(bit).alias("bits"))
    # One shuffle by bucket serves both steps: the sides meet where they were merged.
    own = {side: F.max(F.when(F.col("first") == side, F.col("bits"))) for side in (True, False)}
    return maps.groupBy("bucket").agg(own[True].alias("l"), own[False].alias("r"))


def _ids(bucket: int, places: np.ndarray) -> np.ndarray:
    """Ids of the bits that are set in a bucket: upwards from 1 in the buckets above zero, downwards from 0 in the others."""
    return (bucket - 1) * BITS + places + 1 if bucket > 0 else bucket * BITS - places


def _places(bits: bytes | None) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits or bytes(BITS // 8), np.uint8), bitorder="little").astype(bool)


def id_differences(expected: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Ids on one side only: ``key, problem`` with ``missing`` or ``unexpected``, as of ``quality.id_differences``."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, left, right in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                left, right = _places(left), _places(right)
                for problem, places in (("missing", left & ~right), ("unexpected", right & ~left)):
                    found = _ids(bucket, np.flatnonzero(places))
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([problem] * len(found), pa.string())], ["id", "problem"])

    apart = _both(expected, seen, key).where(~F.equal_null("l", "r"))
    kind = expected.schema[key].dataType
    return apart.mapInArrow(expand, "id long, problem string").select(F.col("id").cast(kind).alias(key), "problem")


def common_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids on both sides, each once."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, one, other in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(_ids(bucket, np.flatnonzero(_places(one) & _places(other))))], ["id"])

    both = _both(left, right, key).where(F.col("l").isNotNull() & F.col("r").isNotNull())
    return both.mapInArrow(expand, "id long").select(F.col("id").cast(left.schema[key].dataType).alias(key))
