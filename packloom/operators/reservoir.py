"""The reservoir shuffle of a stream of packs, as a table operation.

A reservoir of ``size`` places is filled with the first packs. Every further pack draws a place, puts the pack
that is there out and takes it; at the end what is left comes out in a seeded order. A pack may stay for
long, so it can leave far from where it came in.

The draw of the pack at position t depends on the seed and t alone. So a pack's exit is known without running the
stream: it sits in a place since it came in, and leaves at the next position that draws this place. That is a
grouping by place: positions of one place, in order, each putting out the one before. Only positions are
sorted and shuffled. The packs of one place are n / size on average; a place is also cut into runs of positions, so
that no task holds all of them, and the last position of a run is handed on to the next run that has any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packloom.functions.numbers import floor_div
from packloom.operators.batches import shuffle_key
from packloom.operators.positions import number_rows
from packloom.workspace import stage

# Positions per place and run, about.
RUN_ROUNDS = 4096
# Buckets of the order of what is left at the end.
_HASH_DIGITS = 4


def drawn_place(seed: int | None, position: Column, size: int) -> Column:
    """The place that the pack at a position takes: its own among the first ``size``, then a seeded draw."""
    digits = F.conv(F.substring(shuffle_key(seed, F.concat(F.lit("place:"), position.cast("string"))), 1, 15), 16, 10).cast("long")
    return F.when(position < size, position).otherwise(F.pmod(digits, F.lit(size)))


def exits(spark: SparkSession, n_packs: int, size: int, seed: int | None = None) -> DataFrame:
    """``pack_id, leaves``: the position whose draw puts a pack out, null for those left at the end."""
    ids = spark.range(n_packs).select(F.col("id").alias("pack_id"))
    ids = ids.withColumn("place", drawn_place(seed, F.col("pack_id"), size))
    ids = ids.withColumn("run", floor_div("pack_id", size * RUN_ROUNDS))
    following = Window.partitionBy("place", "run").orderBy("pack_id")
    inside = ids.withColumn("next", F.lead("pack_id").over(following))
    if n_packs <= size * RUN_ROUNDS:
        return inside.select("pack_id", F.col("next").alias("leaves"))
    # One row per place and run: what the last pack of a run meets next is the first of a later run.
    heads = ids.groupBy("place", "run").agg(F.min("pack_id").alias("head"))
    later = Window.partitionBy("place").orderBy("run")
    heads = heads.select("place", "run", F.lead("head").over(later).alias("handed"))
    joined = inside.join(heads, ["place", "run"])
    return joined.select("pack_id", F.coalesce("next", "handed").alias("leaves"))


def reservoir_order(spark: SparkSession, n_packs: int, size: int, seed: int | None = None) -> DataFrame:
    """``pack_id, pack_seq``: the order in which packs leave a reservoir of ``size`` places."""
    if size < 1:
        raise ValueError("a reservoir needs a place")
    found = stage(exits(spark, n_packs, size, seed), "exits")
    # The pack put out by position t is number t - size, as every later position puts out one.
    moved = found.where("leaves IS NOT NULL").select("pack_id", (F.col("leaves") - size).alias("pack_seq"))
    left = found.where("leaves IS NULL").select("pack_id")
    left = left.withColumn("key", shuffle_key(seed, F.concat(F.lit("rest:"), F.col("pack_id").cast("string"))))
    left = left.withColumn("bucket", F.conv(F.substring("key", 1, _HASH_DIGITS), 16, 10).cast("int"))
    rest = number_rows(left, "bucket", "key", "pack_id", name="nth")
    return moved.unionByName(rest.select("pack_id", (F.col("nth") + max(n_packs - size, 0)).alias("pack_seq")))
