"""Pack and vector tables stored in buckets of a key, so that what groups by it needs no shuffle.

The rows of a key are in one bucket file, sorted. Batching and sample bounds of a batch read such a table as it lies,
and so do the block products of the in-batch loss: only their sums per anchor are shuffled, no vector is. Blocks of one
batch are then compared in its bucket's task: meant for batches of a bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def save_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int, *sort: str) -> DataFrame:
    """Write ``df`` to ``path`` in ``buckets`` of ``key``, sorted by it and ``sort``, as the catalog's ``table``.

    One shuffle; one file a bucket. Choose the number of buckets by the size of the table (some 128 MB each).
    """
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key, *sort)
    writer.option("path", path).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def open_bucketed(
    spark: SparkSession, table: str, path: str, schema: T.StructType, key: str, buckets: int, *sort: str
) -> DataFrame:
    """Enter a table that another session wrote with ``save_bucketed`` into this one's catalog."""
    fields = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema.fields)
    order = ", ".join(f"`{name}`" for name in (key, *sort))
    spark.sql(
        f"CREATE TABLE {table} ({fields}) USING parquet CLUSTERED BY (`{key}`) SORTED BY ({order}) "
        f"INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    return spark.table(table)
