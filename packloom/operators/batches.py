"""Order packs, group them into batches and collate the batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.config import PackConfig
from packloom.functions.numbers import floor_div
from packloom.operators.assembly import fill
from packloom.operators.positions import number_rows

# The fields that run along the sequence.
SEQUENCE_FIELDS = ("input_ids", "attention_mask", "segment_ids", "position_ids")

# Buckets of the hash order: bounds the offset table of the row numbers.
_HASH_DIGITS = 4
# Packs per bucket when the shuffle works on neighbouring packs only.
_BUFFERS_PER_BUCKET = 16


def shuffle_key(seed: int | None, pack_id: Column) -> Column:
    """Pseudo-random sort key that depends on nothing but the seed and the pack."""
    return F.md5(F.concat_ws(":", F.lit(0 if seed is None else seed).cast("string"), pack_id.cast("string")))


def shuffled_order(
    spark: SparkSession, n_packs: int, seed: int | None, buffer: int | None = None
) -> DataFrame:
    """``pack_id, pack_seq``: a seeded permutation of the packs, the same on every run.

    The whole table is permuted; with ``buffer`` only packs of the same run of ``buffer`` packs
    change places. Works on ids alone, so no packed row is moved to find its place.
    """
    ids = spark.range(n_packs).select(F.col("id").alias("pack_id"))
    ids = ids.withColumn("key", shuffle_key(seed, F.col("pack_id")))
    if buffer is None:
        bucket = F.conv(F.substring("key", 1, _HASH_DIGITS), 16, 10).cast("int")
        order = ("key", "pack_id")
    else:
        run = floor_div("pack_id", buffer)
        per_bucket = max(_BUFFERS_PER_BUCKET, -(-n_packs // (buffer * 16**_HASH_DIGITS)))
        bucket = floor_div(run, per_bucket)
        order = (run, "key", "pack_id")
    return number_rows(ids.withColumn("bucket", bucket), "bucket", *order, name="pack_seq").select(
        "pack_id", "pack_seq"
    )


def order_packs(packs: DataFrame, n_packs: int, config: PackConfig) -> DataFrame:
    """Add ``pack_seq``: finishing order, or the seeded shuffle within runs of ``config.shuffle_buffer`` packs.

    Without a ``shuffle_buffer_factor`` the whole table is shuffled. Give it packs before they are
    padded: they move once.
    """
    if not config.shuffle:
        return packs.withColumn("pack_seq", F.col("pack_id"))
    order = shuffled_order(packs.sparkSession, n_packs, config.seed, config.shuffle_buffer)
    return packs.join(order, "pack_id")


def assign_batches(
    packs: DataFrame, n_packs: int, batch_size: int, drop_last: bool = True
) -> DataFrame:
    """Add ``batch_id`` by ``pack_seq``; a short last batch is left out with ``drop_last``."""
    batched = packs.withColumn("batch_id", floor_div("pack_seq", batch_size))
    if drop_last:
        batched = batched.where(F.col("batch_id") < n_packs // batch_size)
    return batched


def collate_field(
    values: Column | str, length: int, truncation_mode: str = "keep_end", pad: int = 0
) -> Column:
    """Cut a sequence to ``length`` entries from its end or its start, or pad it."""
    if truncation_mode not in ("keep_end", "keep_start"):
        raise ValueError(f"unknown truncation_mode {truncation_mode!r}")
    values = F.col(values) if isinstance(values, str) else values
    first = F.greatest(F.size(values) - length, F.lit(0)) + 1 if truncation_mode == "keep_end" else F.lit(1)
    return fill(F.slice(values, first, F.lit(length)), length, pad)


def collate(
    batched: DataFrame,
    length: int,
    truncation_mode: str = "keep_end",
    pad_zero: bool = False,
) -> DataFrame:
    """One row per batch: each field as the list of its rows' values in pack order.

    Padding entries are 0. Segment ids are padded with -1, since 0 is the first sample's anchor;
    ``pad_zero`` uses 0 there as well.
    """
    fields = [c for c in batched.columns if c not in ("batch_id", "pack_seq")]
    values = [
        collate_field(c, length, truncation_mode, -1 if c == "segment_ids" and not pad_zero else 0).alias(c)
        if c in SEQUENCE_FIELDS
        else F.col(c)
        for c in fields
    ]
    # A batch has batch_size rows, so its list is bounded.
    rows = F.sort_array(F.collect_list(F.struct("pack_seq", F.struct(*values).alias("row"))))
    grouped = batched.groupBy("batch_id").agg(rows.alias("rows"))
    return grouped.select(
        "batch_id",
        F.size("rows").alias("n_rows"),
        *[F.col("rows.row").getField(c).alias(c) for c in fields],
    )


def collate_packs(
    batched: DataFrame, config: PackConfig, length: int, truncation_mode: str = "keep_end", pad_zero: bool = False
) -> DataFrame:
    """As ``collate`` over padded packs, for packs without padding: they are padded in their batch.

    Only the tokens there are cross the shuffle to the batch; the attention mask is made from their number.
    """
    kept = [c for c in batched.columns if c not in ("batch_id", "pack_seq", "first_pos", "n_tokens")]
    entry = F.struct("pack_seq", F.struct(*kept).alias("row"))
    # A batch has batch_size rows, so its list is bounded.
    grouped = batched.groupBy("batch_id").agg(F.sort_array(F.collect_list(entry)).alias("rows"))
    pads = {"input_ids": config.pad_token_id, "segment_ids": -1, "position_ids": 0}

    def padded(field: str):
        def values(packed: Column) -> Column:
            if field == "attention_mask":
                own, pad = F.array_repeat(F.lit(1), F.size(packed["row"]["input_ids"])), 0
            else:
                own, pad = packed["row"][field], pads.get(field)
            if pad is None:
                return own
            # What the padded row would have after it is cut and padded again.
            last = -1 if field == "segment_ids" and not pad_zero else 0
            return collate_field(fill(own, config.seq_length, pad), length, truncation_mode, last)

        return values

    fields = []
    for name in kept:
        fields.append(name)
        if name == "input_ids":
            fields.append("attention_mask")
    return grouped.select(
        "batch_id",
        F.size("rows").alias("n_rows"),
        *[F.transform("rows", padded(f)).alias(f) for f in fields],
    )
