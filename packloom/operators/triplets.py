"""Triplets (anchor, positive, negatives) to tokenized, labelled, length-checked samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.config import PackConfig
from packloom.functions.text import Tokenizer

EMPTY_FIELD = "empty_field"
NEGATIVE_COUNT = "negative_count"
NULL_NEGATIVE = "null_negative"
CORRUPT_LINE = "corrupt_line"
TOO_LONG = "too_long"
NO_TOKENS = "no_tokens"


def select_fields(
    df: DataFrame,
    anchor: str = "anchor",
    positive: str = "positive",
    negative: str = "negative",
    num_negatives: int = 1,
) -> DataFrame:
    """Map the named fields to ``anchor, positive, negatives``; every other column is kept.

    A single string negative becomes a list of one. A frame without the negative column takes
    ``num_negatives`` empty texts.
    """
    if negative not in df.columns:
        negatives = F.array_repeat(F.lit(""), num_negatives)
    elif df.schema[negative].dataType.typeName() == "array":
        negatives = F.col(negative)
    else:
        negatives = F.when(F.coalesce(F.col(negative), F.lit("")) != "", F.array(F.col(negative)))
    fields = {anchor, positive, negative}
    return df.select(
        F.col(anchor).alias("anchor"),
        F.col(positive).alias("positive"),
        negatives.alias("negatives"),
        *[c for c in df.columns if c not in fields],
    )


def reject_reason(num_negatives: int) -> Column:
    """Why a triplet cannot be used: an empty field, not exactly ``num_negatives`` negatives, a null among them."""
    empty = (
        (F.coalesce(F.col("anchor"), F.lit("")) == "")
        | (F.coalesce(F.col("positive"), F.lit("")) == "")
        | (F.coalesce(F.size("negatives"), F.lit(0)) <= 0)
    )
    return (
        F.when(empty, F.lit(EMPTY_FIELD))
        .when(F.size("negatives") != num_negatives, F.lit(NEGATIVE_COUNT))
        .when(F.exists("negatives", lambda text: text.isNull()), F.lit(NULL_NEGATIVE))
    )


def usable(triplets: DataFrame, num_negatives: int = 1) -> DataFrame:
    return triplets.where(reject_reason(num_negatives).isNull())


def rejected(triplets: DataFrame, num_negatives: int = 1) -> DataFrame:
    """The triplets left out of training, with the reason."""
    return triplets.withColumn("reject_reason", reject_reason(num_negatives)).where(
        F.col("reject_reason").isNotNull()
    )


def tokenize_slots(triplets: DataFrame, tokenizer: Tokenizer, config: PackConfig) -> DataFrame:
    """Add ``slots``: the token arrays of anchor, positive and each negative, EOS at each end, and
    ``slot_sizes``.

    The slot code (0 anchor, 1 positive, 2+ negatives) is the array index, so tokens and labels
    cannot get out of step.
    """
    texts = [F.col("anchor"), F.col("positive")]
    texts += [F.col("negatives")[i] for i in range(config.num_negatives)]
    tokenized = triplets.withColumn("slots", token_slots(texts, tokenizer, config)).withColumn(
        "slot_sizes", sizes_of("slots")
    )
    return tokenized.drop("anchor", "positive", "negatives")


def token_slots(texts: Sequence[Column], tokenizer: Tokenizer, config: PackConfig) -> Column:
    """Token arrays of the texts of one sample, EOS at each end."""
    slots = [tokenizer(t).cast("array<int>") for t in texts]
    if config.add_special_tokens:
        eos = F.array(F.lit(config.eos_token_id))
        slots = [F.concat(s, eos) for s in slots]
    return F.array(*slots)


def sizes_of(slots: Column | str) -> Column:
    return F.transform(slots, F.size)


def cut_slots(slots: Column, limit: int, num_slots: int) -> Column:
    """Cut the joined sample at ``limit`` tokens; later slots may end up empty, none is removed."""
    kept, before = [], F.lit(0)
    for k in range(num_slots):
        slot = slots[k]
        room = F.greatest(F.lit(0), F.lit(limit) - before)
        kept.append(F.slice(slot, 1, F.least(F.size(slot), room)))
        before = before + F.size(slot)
    return F.array(*kept)


def length_reason(config: PackConfig) -> Column:
    """Why a tokenized sample is dropped, from ``slot_sizes``: no token, or no room for a negative."""
    sizes = F.col("slot_sizes")
    total = F.aggregate(sizes, F.lit(0), lambda so_far, size: so_far + size)
    reason = F.when(total <= 0, F.lit(NO_TOKENS))
    if config.max_sample_length is None:
        return reason
    return reason.when(sizes[0] + sizes[1] >= config.max_sample_length, F.lit(TOO_LONG))


def limit_length(samples: DataFrame, config: PackConfig) -> DataFrame:
    """Drop samples whose anchor and positive leave no room for a negative, cut the rest.

    Adds ``n_tokens`` and leaves out samples without any token. Only ``slot_sizes`` decides, so over
    a staged table the lengths can be read without the tokens.
    """
    sizes, slots = F.col("slot_sizes"), F.col("slots")
    total = F.aggregate(sizes, F.lit(0), lambda so_far, size: so_far + size)
    limit = config.max_sample_length
    kept = samples.where(length_reason(config).isNull())
    if limit is None:
        return kept.withColumn("n_tokens", total).drop("slot_sizes")
    cut = F.when(total > limit, cut_slots(slots, limit, config.num_slots)).otherwise(slots)
    return kept.withColumns({"n_tokens": F.least(total, F.lit(limit)), "slots": cut}).drop("slot_sizes")


def needed_tokens(samples: DataFrame, config: PackConfig) -> DataFrame:
    """Without the tokens that ``limit_length`` leaves out: those behind the limit, and all of a row that is no sample.

    ``slot_sizes`` still counts them, so ``limit_length`` decides the same from it; what is stored in between is bounded.
    """
    slots, limit = F.col("slots"), config.max_sample_length
    if limit is not None:
        slots = cut_slots(slots, limit, config.num_slots)
    used = length_reason(config).isNull()
    if "reject_reason" in samples.columns:
        used &= F.col("reject_reason").isNull()
    return samples.withColumn("slots", F.when(used, slots))


def outcome(config: PackConfig) -> Column:
    """What becomes of a tokenized row with ``reject_reason``: the reason it is left out, or ``sample``."""
    return F.coalesce("reject_reason", length_reason(config), F.lit("sample"))


def slot_labels(slots: Column | str = "slots") -> Column:
    """One slot code per token, as long as the flattened tokens."""
    return F.flatten(F.transform(slots, lambda slot, k: F.array_repeat(k, F.size(slot))))


def build_samples(triplets: DataFrame, tokenizer: Tokenizer, config: PackConfig) -> DataFrame:
    """Usable triplets, tokenized and length-checked: ``slots, n_tokens`` and the other columns."""
    kept = usable(triplets, config.num_negatives)
    return limit_length(tokenize_slots(kept, tokenizer, config), config)
