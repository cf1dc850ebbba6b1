"""Sharding by extendible hashing: a directory over hash prefixes, grown only where a shard is too large.

Only DataFrame functions. Keys hash to 60 bits. A bucket is a hash prefix; one that holds more than the
byte limit is split on the next bit, all others stay as they are, so shards differ in depth and moving
from one limit to half of it splits shards without reshuffling the others.

Defined cases: a null text has 0 bytes, a null id is hashed as an empty string. A single row above the
limit is a shard of its own. Rows of one id cannot be told apart by any bit: if they exceed the limit
together they are dealt to numbered parts of their bucket, by several tasks if they are many. An empty
table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.llm.common import joinable, stage

BITS = 60
# Bits beyond the expected depth that one round looks at.
AHEAD = 4
# Limits' worth of bytes of one bucket that are dealt to parts by one window; more are salted.
RUN_LIMITS = 64


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def _prefix(bits: Column, depth: Column | int) -> Column:
    return F.call_function("shiftright", bits, (F.lit(BITS) - depth).cast("int"))


def directory(keyed: DataFrame, limit: int) -> DataFrame:
    """Buckets ``depth, prefix, shard_bytes`` of rows with ``bits`` and ``n_bytes``: none above ``limit`` that a bit can split.

    Sums per prefix are rolled up from the finest cells, so a round reads the rows once; only cells still
    too large go into another round.
    """
    total = keyed.agg(F.sum("n_bytes")).first()[0] or 0
    low = 0
    high = min(BITS, max(0, math.ceil(math.log2(max(total, 1) / limit))) + AHEAD)
    leaves = None
    rows = keyed.select("bits", "n_bytes")
    while True:
        cells = rows.groupBy(_prefix(F.col("bits"), high).alias("cell")).agg(
            F.sum("n_bytes").alias("bytes"), F.min("bits").alias("first"), F.max("bits").alias("last")
        )
        depths = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
        levels = (
            cells.select("*", depths)
            .groupBy("depth", F.call_function("shiftright", "cell", (F.lit(high) - F.col("depth")).cast("int")).alias("prefix"))
            .agg(F.sum("bytes").alias("bytes"), F.min("first").alias("first"), F.max("last").alias("last"))
        )
        settled = (F.col("bytes") <= limit) | (F.col("first") == F.col("last"))
        levels = stage(levels.withColumn("settled", settled), "levels")
        above = levels.where(~F.col("settled")).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        below = levels.withColumn("up", F.call_function("shiftright", "prefix", F.lit(1)))
        found = below.where("settled").join(above, ["depth", "up"], "left_semi")
        if low == 0:
            found = found.unionByName(below.where("settled and depth = 0"))
        found = found.select("depth", "prefix", F.col("bytes").alias("shard_bytes"))
        leaves = found if leaves is None else leaves.unionByName(found)
        large = levels.where((F.col("depth") == high) & ~F.col("settled")).select("prefix")
        if high == BITS or large.isEmpty():
            return stage(leaves, "directory")
        rows = rows.withColumn("prefix", _prefix(F.col("bits"), high)).join(joinable(large), "prefix", "left_semi").drop("prefix")
        low, high = high, min(BITS, high + 2 * AHEAD)


def shard(
    docs: DataFrame, limit: int, *, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Rows ``doc_id, n_bytes, shard, depth, part, shard_bytes``, and the columns ``keep`` of each row in a struct ``row``.

    ``shard`` spells the bucket's bits; ``part`` is above 0 only where rows of one id exceed the limit.
    """
    row = [F.struct(*(F.col(c) for c in keep)).alias("row")] if keep else []
    keyed = stage(
        docs.select(
            F.col(id_column).alias("doc_id"),
            F.coalesce(F.octet_length(F.col(text_column).cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
            hash_bits(F.col(id_column)).alias("bits"),
            F.monotonically_increasing_id().alias("place"),
            *row,
        ),
        "keyed",
    )
    carried = ["row"] if keep else []
    leaves = directory(keyed, limit)
    depths = [r["depth"] for r in leaves.select("depth").distinct().collect()]  # at most 61
    # A row belongs to the one bucket that is a prefix of its bits.
    tried = keyed.withColumn("depth", F.explode(F.array(*map(F.lit, sorted(depths))))) if depths else keyed.withColumn("depth", F.lit(0))
    tried = tried.withColumn("prefix", _prefix(F.col("bits"), F.col("depth")))
    placed = tried.join(joinable(leaves), ["depth", "prefix"])
    name = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), F.lit("0")))
    columns = ["doc_id", "n_bytes", name.alias("shard"), F.col("depth").cast("int").alias("depth")]
    # Rows of one id may be any share of the table: beyond RUN_LIMITS limits they are dealt by several windows.
    runs = F.ceil(F.col("shard_bytes") / (RUN_LIMITS * limit))
    placed = placed.withColumn("runs", runs).withColumn("run", F.pmod(F.xxhash64("place"), F.col("runs")))
    fitting = placed.where(F.col("shard_bytes") <= limit).select(*columns, F.lit(0).alias("part"), "shard_bytes", *carried)
    # Parts of half the limit by running size hold whole rows of at most half; larger rows stand alone.
    alone = F.col("n_bytes") > limit // 2
    inside = Window.partitionBy("depth", "prefix", "run", alone).orderBy("doc_id", "n_bytes", "place")
    running = F.sum("n_bytes").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_bytes")
    part = F.when(alone, 2 * F.row_number().over(inside) - 2).otherwise(2 * F.floor(running / (limit - limit // 2)) + 1)
    part = F.col("run") + F.col("runs") * part
    large = placed.where(F.col("shard_bytes") > limit).select(*columns, part.cast("int").alias("part"), *carried)
    sizes = large.groupBy("shard", "depth", "part").agg(F.sum("n_bytes").alias("shard_bytes"))
    large = large.join(sizes, ["shard", "depth", "part"]).select(*fitting.columns)
    return fitting.unionByName(large)


def write_shards(docs: DataFrame, path: str, limit: int, *, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Write ``docs`` as Parquet, one folder for each shard and part."""
    placed = shard(docs, limit, id_column=id_column, text_column=text_column, keep=tuple(docs.columns))
    rows = placed.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in ("shard", "part")), "shard", "part")
    rows.repartition("shard", "part").write.partitionBy("shard", "part").parquet(path)
