"""Packed rows back to samples. Everything happens inside the row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.functions.arrays import each_element
from packloom.functions.numbers import floor_div


def _check_slots(num_slots: int) -> None:
    if num_slots <= 0:
        raise ValueError(f"a sample has at least one slot, not {num_slots}")


def sample_of(segment: Column, num_slots: int) -> Column:
    """Sample id of a segment id, -1 for padding."""
    return F.when(segment >= 0, floor_div(segment, num_slots).cast("int")).otherwise(F.lit(-1))


def slot_of(segment: Column, num_slots: int) -> Column:
    """Slot (0 anchor, 1 positive, 2+ negatives) of a segment id, -1 for padding."""
    return F.when(segment >= 0, F.pmod(segment, F.lit(num_slots))).otherwise(F.lit(-1))


def decode_segments(packs: DataFrame, num_slots: int) -> DataFrame:
    """One row per token: ``pack_id, pos, segment_id, sample_id, slot``."""
    _check_slots(num_slots)
    tokens = each_element(packs, "segment_ids", "pack_id", value="segment_id")
    segment = F.col("segment_id")
    return tokens.withColumns(
        {"sample_id": sample_of(segment, num_slots), "slot": slot_of(segment, num_slots)}
    )


def attended_length(mask: Column) -> Column:
    """Index after the last attended position, 0 if there is none."""
    from_end = F.array_position(F.reverse(mask), 1).cast("int")
    return F.when(from_end > 0, F.size(mask) - from_end + 1).otherwise(F.lit(0))


def with_sample_bounds(packs: DataFrame, num_slots: int, use_mask: bool = True) -> DataFrame:
    """Add ``sample_starts`` and ``sample_lengths`` to every pack.

    A sample begins where a valid sample id differs from the one before. Everything after the last
    attended position is left out. Without the mask, padding counts towards the last sample. A pack
    that begins with padding has no samples.
    """
    _check_slots(num_slots)
    if "segment_ids" not in packs.columns:
        raise ValueError("segment_ids is needed to find samples")
    segments = F.col("segment_ids")
    if use_mask:
        mask = F.col("attention_mask")
        same = F.assert_true(
            F.size(segments) == F.size(mask), "segment_ids and attention_mask differ in length"
        )
        # assert_true gives null when it holds.
        valid = F.when(same.isNull(), attended_length(mask))
    else:
        valid = F.size(segments)
    samples = F.transform(F.slice(segments, 1, F.col("__valid")), lambda s: sample_of(s, num_slots))
    before = F.concat(F.array(F.lit(-1)), F.col("__samples"))
    changes = F.zip_with(
        F.col("__samples"), before, lambda now, then: F.coalesce((now >= 0) & (now != then), F.lit(False))
    )
    marked = F.filter(
        F.transform(changes, lambda change, i: F.when(change, i)), lambda start: start.isNotNull()
    )
    opens = F.coalesce(F.try_element_at(F.col("__samples"), F.lit(1)), F.lit(-1)) >= 0
    ends = F.concat(
        F.slice("sample_starts", F.lit(2), F.greatest(F.size("sample_starts") - 1, F.lit(0))),
        F.array("__valid"),
    )
    lengths = F.zip_with("sample_starts", ends, lambda start, end: end - start)
    none = F.array().cast("array<int>")
    return (
        packs.withColumn("__valid", valid)
        .withColumn("__samples", samples)
        .withColumn("sample_starts", F.when(opens, marked).otherwise(none))
        .withColumn("sample_lengths", F.when(F.size("sample_starts") > 0, lengths).otherwise(none))
        .drop("__valid", "__samples")
    )


def sample_info(packs: DataFrame, num_negatives: int = 1, by: str = "pack_id", use_mask: bool = True) -> DataFrame:
    """``by, num_samples, sample_starts, sample_lengths``; a batch joins the lists of its packs."""
    bounds = with_sample_bounds(packs, 2 + num_negatives, use_mask)
    if by == "pack_id":
        return bounds.select(
            "pack_id", F.size("sample_starts").alias("num_samples"), "sample_starts", "sample_lengths"
        )
    # The packs of one batch: batch_size rows.
    entry = F.struct("pack_seq", "sample_starts", "sample_lengths")
    grouped = bounds.groupBy(by).agg(F.sort_array(F.collect_list(entry)).alias("rows"))
    return grouped.select(
        by,
        F.size(F.flatten("rows.sample_starts")).alias("num_samples"),
        F.flatten("rows.sample_starts").alias("sample_starts"),
        F.flatten("rows.sample_lengths").alias("sample_lengths"),
    )


def split_samples(packs: DataFrame, num_negatives: int = 1, use_mask: bool = False) -> DataFrame:
    """One row per sample: ``pack_id, sample_ord, start, length, input_ids, segment_ids``.

    Samples reaching past the end of ``input_ids`` are skipped.
    """
    bounds = with_sample_bounds(packs, 2 + num_negatives, use_mask)
    # Cut inside the row: what is exploded is a sample's own tokens, not the whole pack once per sample.
    bound = F.arrays_zip(F.col("sample_starts").alias("start"), F.col("sample_lengths").alias("length"))

    def cut(b: Column) -> Column:
        slices = [F.slice(c, b["start"] + 1, b["length"]).alias(c) for c in ("input_ids", "segment_ids")]
        inside = b["start"] + b["length"] <= F.size("input_ids")
        return F.when(inside, F.struct(b["start"].alias("start"), b["length"].alias("length"), *slices))

    each = each_element(bounds, F.transform(bound, cut), "pack_id", position="sample_ord", value="sample")
    return each.where(F.col("sample").isNotNull()).select("pack_id", "sample_ord", "sample.*")
