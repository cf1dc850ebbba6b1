"""Greedy packing of an unbounded feed, one open pack per lane."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from packloom.config import PackConfig
from packloom.functions.memory import give_back
from packloom.operators.assembly import fill, segment_labels, slot_positions

_PACK = (
    "lane string, pack_no long, sample_keys array<long>, input_ids array<int>, "
    "slot_sizes array<array<int>>, sources array<string>"
)
_STATE = _PACK.removeprefix("lane string, ")


#: Packs given on at once by a lane's task.
PACKS_AT_ONCE = 64

#: Rows of a lane that are sorted at once, if lanes follow the size of the input.
LANE_ROWS = 10_000
MIN_LANES = 32


def lanes_for(n_rows: int) -> int:
    """Lanes for an input of so many rows: they grow with it, what one lane holds does not."""
    return max(MIN_LANES, -(-n_rows // LANE_ROWS))


def lane_of(group: Column, key: Column, lanes: int) -> Column:
    """A group's samples over ``lanes`` independent open packs, so a hot group is not one task."""
    digits = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")
    return F.concat_ws("/", group.cast("string"), F.pmod(digits, F.lit(lanes)).cast("string"))


def _cut(sizes: list[int], limit: int) -> list[int]:
    """Slot sizes of a sample cut at ``limit`` tokens."""
    ends = np.minimum(np.cumsum(sizes), limit)
    return np.diff(ends, prepend=0).tolist()


def in_key_order(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[np.ndarray], str]]:
    """Samples of a lane's share of a micro-batch by key. Each batch is reduced to flat arrays as it comes."""
    keys, lengths, tokens, sources = [], [], [], []
    for rows in batches:
        for key, slots, source in zip(rows["sample_key"].tolist(), rows["slots"], rows["source_id"], strict=True):
            keys.append(key)
            lengths.append(np.fromiter((len(slot) for slot in slots), np.int32, len(slots)))
            tokens.append(np.concatenate(list(slots)).astype(np.int32))
            sources.append(source)
    for i in np.argsort(np.asarray(keys, dtype=np.int64), kind="stable"):
        slots = np.split(tokens[i], np.cumsum(lengths[i])[:-1])
        tokens[i] = None  # its pack holds it from here on
        yield keys[i], slots, sources[i]


def _packer(seq_length: int, cap: int, flush_after_ms: int | None):
    """Close packs as the samples of one lane arrive. State: number and content of the open pack,
    at most ``seq_length`` tokens."""

    def step(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        number, keys, tokens, sizes, sources = state.get if state.exists else (0, [], [], [], [])
        keys, sizes, sources = list(keys), [list(s) for s in sizes], list(sources)
        # Token arrays of the open pack's samples, joined only when it is closed or stored.
        parts, used = [np.array(tokens, dtype=np.int32)], len(tokens)
        finished = []
        columns = [field.split(" ")[0] for field in _PACK.split(", ")]

        def close(pack_keys: list, pack_parts: list, pack_sizes: list, pack_sources: list) -> None:
            nonlocal number
            joined = np.concatenate(pack_parts)[:seq_length]
            finished.append((key[0], number, pack_keys, joined, pack_sizes, pack_sources))
            number += 1

        if state.hasTimedOut:
            if keys:
                close(keys, parts, sizes, sources)
            keys, parts, sizes, sources = [], [], [], []
        else:
            for sample, slots, source in in_key_order(batches):
                if len(finished) >= PACKS_AT_ONCE:
                    yield pd.DataFrame(finished, columns=columns)
                    finished.clear()
                lengths = [len(slot) for slot in slots]
                new = sum(lengths)
                if new > seq_length:
                    close([sample], list(slots), [_cut(lengths, seq_length)], [source])
                    continue
                if keys and (used + new > seq_length or len(keys) >= cap):
                    close(keys, parts, sizes, sources)
                    keys, parts, sizes, sources, used = [], [], [], [], 0
                keys.append(sample)
                parts.extend(slots)
                sizes.append(lengths)
                sources.append(source)
                used += new
        left = np.concatenate(parts).astype(int).tolist() if parts else []
        state.update((number, keys, left, sizes, sources))
        if flush_after_ms is not None and keys:
            state.setTimeoutDuration(flush_after_ms)
        yield pd.DataFrame(finished, columns=columns)
        give_back()

    return step


def pack_stream(
    samples: DataFrame, config: PackConfig, flush_after_ms: int | None = None
) -> DataFrame:
    """Finished packs of a streaming ``samples(lane, sample_key, slots)``, as padded rows.

    Samples of a lane are taken in key order within a micro-batch and in arrival order across them.
    The open pack of a lane stays in the state store until later samples close it, until the lane has
    been idle for ``flush_after_ms``, or until ``open_packs`` gives it out at the end of the input.
    What a task holds is a lane's share of one micro-batch, as flat arrays: bound that by the source's
    ``maxFilesPerTrigger``, and take ``lanes_for`` the input. Start the query inside of ``small_batches``.

    An optional ``source_id`` names where a sample comes from.
    """
    step = _packer(config.seq_length, max(1, config.sample_cap), flush_after_ms)
    timeout = GroupStateTimeout.NoTimeout if flush_after_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    source = F.col("source_id") if "source_id" in samples.columns else F.lit(None)
    packs = (
        samples.where(F.size(F.flatten("slots")) > 0)
        .select("lane", "sample_key", "slots", F.coalesce(source.cast("string"), F.lit("")).alias("source_id"))
        .groupBy("lane")
        .applyInPandasWithState(step, _PACK, _STATE, "append", timeout)
    )
    return _padded(packs, config)


def open_packs(spark: SparkSession, checkpoint: str, config: PackConfig) -> DataFrame:
    """The packs still open in a stopped ``pack_stream`` query, as its rows: the rest when the input has ended.

    Read from the state the query left in its checkpoint. A query that goes on from there closes them
    itself, so give them out only at the end.
    """
    state = spark.read.format("statestore").load(checkpoint).select("key.lane", "value.groupState.*")
    names = [field.split(" ")[0] for field in _PACK.split(", ")]
    return _padded(state.where(F.size("sample_keys") > 0).select(*names), config)


def _padded(packs: DataFrame, config: PackConfig) -> DataFrame:
    sizes, length = F.col("slot_sizes"), config.seq_length
    attended = F.array_repeat(F.lit(1), F.size("input_ids"))
    named = F.filter("sources", lambda source: source != "")
    return packs.select(
        "lane",
        "pack_no",
        "sample_keys",
        fill("input_ids", length, config.pad_token_id).alias("input_ids"),
        fill(attended, length, 0).alias("attention_mask"),
        fill(segment_labels(sizes, config.num_slots), length, -1).alias("segment_ids"),
        fill(slot_positions(sizes), length, 0).alias("position_ids"),
        F.when(F.size(named) > 0, named).alias("source_ids"),
        F.size("sample_keys").alias("num_segments"),
    )
