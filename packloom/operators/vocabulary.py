"""Vocabularies as tables ``(token, token_id)`` and their vectors ``(token_id, vec)``."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.functions.arrays import each_element
from packloom.functions.vectors import zeros
from packloom.operators.pooling import mean_vectors
from packloom.operators.positions import dense_positions

# Initialisation of new vectors.
INIT_STRATEGIES = ("average", "random", "zeros")
RANDOM_SCALE = 0.02

# A vocabulary up to this size is looked up in every task, a larger one is joined.
MAX_LOOKUP_TOKENS = 1_000_000
# Parts one token of a corpus is spread over in the join.
JOIN_SALTS = 32


def build_vocabulary(texts: DataFrame, words: str = "words", first_id: int = 0) -> DataFrame:
    """``token, n, token_id`` of a corpus: most frequent first, ties by the token.

    ``words`` is an array column. Counts are summed before the shuffle, so a word that makes up
    much of the corpus costs a task one row. Ids come from a range sort, not from one task.
    """
    counts = each_element(texts, words, value="token").groupBy("token").agg(F.count("*").alias("n"))
    ranked = dense_positions(counts, F.desc("n"), F.asc("token"), name="token_id")
    return ranked.withColumn("token_id", (F.col("token_id") + first_id).cast("int"))


def encode_slots(
    df: DataFrame,
    word_slots: str,
    vocabulary: DataFrame,
    unknown_id: int,
    key: str,
    max_lookup: int = MAX_LOOKUP_TOKENS,
) -> DataFrame:
    """Replace ``word_slots`` (array of word arrays) by ``slots`` of token ids.

    A vocabulary of checked size goes to every task and is looked up in Arrow batches without a
    shuffle. A larger one is joined word by word, salted against frequent words; ``key`` identifies
    the row.
    """
    n_tokens = vocabulary.limit(max_lookup + 1).count()
    if n_tokens <= max_lookup:
        return _encode_by_lookup(df, word_slots, vocabulary, unknown_id)
    return _encode_by_join(df, word_slots, vocabulary, unknown_id, key)


def _encode_by_lookup(df: DataFrame, word_slots: str, vocabulary: DataFrame, unknown_id: int) -> DataFrame:
    table = vocabulary.select("token", "token_id").toPandas()
    index = pd.Index(table["token"])
    ids = np.append(table["token_id"].to_numpy(dtype=np.int32), np.int32(unknown_id))
    shared = df.sparkSession.sparkContext.broadcast((index, ids))

    @F.arrow_udf("array<array<int>>")
    def encode(slots: pa.Array) -> pa.Array:
        tokens, token_ids = shared.value
        inner = slots.flatten()
        words = inner.flatten()
        found = _ids_of(words, tokens, token_ids)
        encoded = pa.ListArray.from_arrays(_compact(inner), pa.array(found, type=pa.int32()))
        return pa.ListArray.from_arrays(_compact(slots), encoded)

    return df.withColumn("slots", encode(F.col(word_slots))).drop(word_slots)


def _ids_of(words: pa.Array, tokens: pd.Index, token_ids: np.ndarray) -> np.ndarray:
    """Id of every word; ``token_ids`` ends with that of unknown ones. Only distinct words become Python texts."""
    coded = words.dictionary_encode()
    # A miss has position -1, the entry after the last token.
    of_word = token_ids[tokens.get_indexer(coded.dictionary.to_numpy(zero_copy_only=False))]
    of_word = np.append(of_word, token_ids[-1])
    return of_word[pc.fill_null(coded.indices, len(of_word) - 1).to_numpy(zero_copy_only=False)]


def _compact(lists: pa.ListArray) -> pa.Array:
    """List offsets that start at 0, for use with the flattened values."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def _encode_by_join(
    df: DataFrame, word_slots: str, vocabulary: DataFrame, unknown_id: int, key: str
) -> DataFrame:
    each_slot = each_element(df, word_slots, key, position="slot", value="words")
    salt = F.pmod(F.xxhash64(key, "slot", "i"), F.lit(JOIN_SALTS)).cast("int")
    each_word = each_element(each_slot, "words", key, "slot", position="i", value="token")
    spread = vocabulary.select(
        "token", "token_id", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))).alias("salt")
    )
    found = each_word.withColumn("salt", salt).join(spread, ["token", "salt"], "left")
    entry = F.struct("i", F.coalesce("token_id", F.lit(unknown_id)).alias("id"))
    ids = found.groupBy(key, "slot").agg(F.sort_array(F.collect_list(entry)).getField("id").alias("ids"))
    # Slots without a word come back as empty arrays.
    slots = each_slot.select(key, "slot").join(ids, [key, "slot"], "left")
    encoded = slots.groupBy(key).agg(
        F.sort_array(
            F.collect_list(F.struct("slot", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")))
        ).getField("ids").alias("slots")
    )
    # Rows without a slot have nothing to join.
    nothing = F.array().cast("array<array<int>>")
    return df.drop(word_slots).join(encoded, key, "left").withColumn("slots", F.coalesce("slots", nothing))


def append_eos(slots: Column | str, eos_token_id: int) -> Column:
    return F.transform(slots, lambda slot: F.concat(slot, F.array(F.lit(eos_token_id))))


def extend_vocabulary(vocabulary: DataFrame, new_tokens: DataFrame | Sequence[str]) -> DataFrame:
    """Add tokens that are not known yet; their ids follow on in the order given.

    A frame of tokens ``(token[, ord])`` without ``ord`` is taken in token order.
    """
    if not isinstance(new_tokens, DataFrame):
        if not new_tokens:
            raise ValueError("no new tokens given")
        rows = [(t, i) for i, t in enumerate(new_tokens)]
        new_tokens = vocabulary.sparkSession.createDataFrame(rows, "token string, ord long")
    if "ord" not in new_tokens.columns:
        new_tokens = new_tokens.select("token", F.lit(0).alias("ord"))
    first_seen = new_tokens.groupBy("token").agg(F.min("ord").alias("ord"))
    added = first_seen.join(vocabulary.select("token"), "token", "left_anti")
    size = vocabulary.count()
    numbered = dense_positions(added, "ord", "token", name="token_id")
    added_rows = numbered.select("token", (F.col("token_id") + size).cast("int").alias("token_id"))
    return vocabulary.select("token", "token_id").unionByName(added_rows)


def average_vector(vectors: DataFrame) -> DataFrame:
    """One row ``vec``: the mean over all rows, one partial sum per batch of rows."""
    return mean_vectors(vectors.withColumn("__all", F.lit(0)), "__all").select("vec")


def new_vectors(
    vectors: DataFrame, new_ids: DataFrame, strategy: str = "average", seed: int | None = None
) -> DataFrame:
    """``token_id, vec`` for ``new_ids(token_id)``: the average vector, small random ones, or zeros."""
    if strategy not in INIT_STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}, expected one of {INIT_STRATEGIES}")
    if strategy == "average":
        # One row, sent to every task.
        mean = average_vector(vectors).select(F.lit(0).alias("__all"), "vec")
        return new_ids.withColumn("__all", F.lit(0)).join(F.broadcast(mean), "__all").select("token_id", "vec")
    width = F.size("vec")
    size = vectors.select(width.alias("size")).first()["size"]
    if strategy == "zeros":
        return new_ids.select("token_id", zeros(size).alias("vec"))
    if seed is None:
        raise ValueError("random vectors need a seed")
    # Two uniform numbers from the hash of (seed, id, dimension) give a normal one: the same vectors
    # however the rows are partitioned, and on every retry of a task.

    def uniform(dim: Column, stream: int) -> Column:
        text = F.concat_ws(":", F.lit(seed), F.col("token_id"), dim, F.lit(stream))
        bits = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")
        return (bits + F.lit(0.5)) / F.lit(float(1 << 48))

    def normal(dim: Column) -> Column:
        radius = F.sqrt(F.lit(-2.0) * F.ln(uniform(dim, 0)))
        return radius * F.cos(F.lit(2.0 * np.pi) * uniform(dim, 1)) * F.lit(RANDOM_SCALE)

    dims = F.sequence(F.lit(0), F.lit(size - 1))
    return new_ids.select("token_id", F.transform(dims, normal).alias("vec"))


def extend_vectors(
    vectors: DataFrame, new_count: int, strategy: str = "average", seed: int | None = None
) -> tuple[DataFrame, int, int]:
    """Vectors for ``new_count`` more ids, and the sizes before and after."""
    if new_count <= 0:
        raise ValueError("new_count must be positive")
    shape = vectors.agg(
        F.count("*").alias("rows"), F.min(F.size("vec")).alias("low"), F.max(F.size("vec")).alias("high")
    ).first()
    if not shape["rows"] or shape["low"] != shape["high"]:
        raise ValueError("vectors must be a non-empty table of equally long rows")
    before = shape["rows"]
    ids = vectors.sparkSession.range(before, before + new_count)
    added = new_vectors(vectors, ids.select(F.col("id").cast("int").alias("token_id")), strategy, seed)
    current = vectors.select("token_id", F.col("vec").cast("array<double>").alias("vec"))
    return current.unionByName(added), before, before + new_count


def extend_both(
    vocabulary: DataFrame,
    vectors: DataFrame,
    new_tokens: DataFrame | Sequence[str],
    strategy: str = "average",
    seed: int | None = None,
) -> tuple[DataFrame, DataFrame, int, int]:
    """Extend a vocabulary and its vectors together: both tables, old and new vocabulary size.

    With nothing new, both stay as they are. A vocabulary and vectors of different size are
    reported and extended by the same number.
    """
    extended = extend_vocabulary(vocabulary, new_tokens)
    before, after = vocabulary.count(), extended.count()
    if after == before:
        warnings.warn("no token was added, all are known already", stacklevel=2)
        return vocabulary, vectors, before, before
    more, rows, _ = extend_vectors(vectors, after - before, strategy, seed)
    if rows != before:
        warnings.warn(f"{rows} vectors for {before} tokens before the extension", stacklevel=2)
    return extended, more, before, after
