"""Greedy sequential packing of one global sample order, computed in parallel and exactly.

The rule: samples are taken in order; a pack is closed when the next whole sample would exceed
``seq_length`` tokens or ``max_samples`` samples. Where a pack starts depends on everything before
it, so the order is cut into chunks of rows and each chunk is summarised as a function from the
open pack it receives (tokens used, samples held) to the open pack it leaves. Such functions compose,
so a tree of small jobs finds the open pack at every chunk boundary. After that all chunks are
packed independently, and the sample payload is shuffled once.

A sample longer than ``seq_length`` is cut and forms a pack of its own without touching the open
pack. Packs are numbered in the order they are finished: an oversize one at its own row, a normal
one at the row that no longer fits, the last at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.config import PackConfig
from packloom.functions.numbers import floor_div
from packloom.workspace import stage

# At most this many chunks, whatever the input size: bounds the broadcast chunk table (a few
# dozen bytes a row).
MAX_CHUNKS = 1 << 18
# Chunks of a small input: a few for every core, but not so short that starting them dominates.
CHUNKS_PER_CORE = 4
CHUNK_ROWS = (256, 65536)
# Tokens of a chunk, about: its samples are sorted and packed by one task. Chunks of fewer rows than the least are
# made for this only down to a sixteenth of it.
CHUNK_TOKENS = 1 << 23
# Chunks that one partition of the routed samples holds at most, about.
CHUNKS_PER_TASK = 4
# Summaries composed by one task, per level of the tree.
FAN_IN = 256

# One row per possible first pack start of a chunk (or run of chunks): if the open pack takes
# `rows` more samples of `tokens` tokens before that start, the unit leaves a pack with `used`
# tokens and `held` samples, started in chunk `home`, after `starts` new packs. `whole` marks the
# case where every sample fits the open pack. `over` counts the unit's oversize samples.
_SUMMARY = (
    "unit long, rows long, tokens long, entry_pos long, entry_over long, whole boolean, "
    "used long, held long, starts long, home long, over long"
)
# The open pack that reaches a unit, and what was packed before it.
_ENTRY = "unit long, used long, held long, packs_before long, over_before long, home long"
_CHUNKS = (
    "chunk long, entry_pos long, entry_over long, carry_home long, packs_before long, "
    "over_before long, starts long, over long"
)


def next_starts(total: np.ndarray, seq_length: int, cap: int) -> np.ndarray:
    """For a pack starting at each row, the first row that no longer fits it.

    ``total`` holds the running token count, one entry more than there are rows.
    """
    rows = len(total) - 1
    by_tokens = np.searchsorted(total, total[:-1] + seq_length, side="right") - 1
    return np.minimum(by_tokens, np.arange(rows) + cap)


def running_total(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def summarise_chunk(chunk: pd.DataFrame, seq_length: int, cap: int) -> pd.DataFrame:
    """Every first pack start the chunk can have, and what each of them leaves behind."""
    chunk = chunk.sort_values("pos")
    unit = int(chunk["chunk"].iloc[0])
    pos, size = chunk["pos"].to_numpy(), chunk["n_tokens"].to_numpy()
    oversize = size > seq_length
    over_pos, pos, size = pos[oversize], pos[~oversize], size[~oversize]
    n, total = len(size), running_total(size)
    follow = next_starts(total, seq_length, cap)
    # Pointer doubling: the last pack start reached from each row, and the hops to it.
    last = np.where(follow < n, follow, np.arange(n))
    hops = (follow < n).astype(np.int64)
    while not np.array_equal(last[last], last):
        hops = hops + hops[last]
        last = last[last]
    entry = np.arange(min(n, cap - 1) + 1)
    entry = entry[total[entry] <= seq_length - 1]
    whole = entry == n
    last, hops, pos = np.append(last, n), np.append(hops, -1), np.append(pos, -1)
    return pd.DataFrame(
        {
            "unit": unit,
            "rows": entry,
            "tokens": total[entry],
            "entry_pos": pos[entry],
            "entry_over": np.searchsorted(over_pos, pos[entry]),
            "whole": whole,
            "used": total[n] - total[last[entry]],
            "held": n - last[entry],
            "starts": hops[entry] + 1,
            "home": np.where(whole, -1, unit),
            "over": len(over_pos),
        }
    )


def _choose(step: pd.DataFrame, used, held, seq_length: int, cap: int) -> np.ndarray:
    """The row of a summary that applies to an open pack: the furthest start it can reach."""
    by_tokens = np.searchsorted(step["tokens"].to_numpy(), seq_length - used, side="right")
    by_rows = np.searchsorted(step["rows"].to_numpy(), cap - held, side="right")
    return np.minimum(by_tokens, by_rows) - 1


def _units(summaries: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    ordered = summaries.sort_values(["unit", "rows"])
    for unit, step in ordered.groupby("unit", sort=True):
        yield int(unit), step.reset_index(drop=True)


def _then(first: pd.DataFrame, step: pd.DataFrame, seq_length: int, cap: int) -> pd.DataFrame:
    """Summary of one unit followed by the next."""
    closed = first[~first["whole"]].reset_index(drop=True)
    pick = step.iloc[_choose(step, closed["used"], closed["held"], seq_length, cap)]
    pick = pick.reset_index(drop=True)
    joined = closed.assign(
        used=pick["used"].where(~pick["whole"], closed["used"] + pick["tokens"]),
        held=pick["held"].where(~pick["whole"], closed["held"] + pick["rows"]),
        starts=closed["starts"] + pick["starts"],
        home=pick["home"].where(~pick["whole"], closed["home"]),
    )
    for _, passed in first[first["whole"]].iterrows():
        later = step.assign(
            rows=step["rows"] + passed["rows"], tokens=step["tokens"] + passed["tokens"]
        )
        later = later[(later["tokens"] < seq_length) & (later["rows"] < cap)]
        joined = pd.concat([joined, later], ignore_index=True)
    # Neighbouring starts that leave the same open pack behind are one case.
    shape = joined[["whole", "used", "held", "starts", "home"]]
    joined = joined[(shape != shape.shift()).any(axis=1)]
    return joined.assign(over=first["over"].iloc[0] + step["over"].iloc[0])


def compose_units(
    summaries: pd.DataFrame, seq_length: int, cap: int, fan_in: int
) -> pd.DataFrame:
    """Summaries of consecutive units to one summary of the whole run."""
    result = None
    for _, step in _units(summaries):
        result = step if result is None else _then(result, step, seq_length, cap)
    unit = int(summaries["unit"].iloc[0]) // fan_in
    return result.assign(unit=unit, entry_pos=-1, entry_over=-1)


def walk_units(
    summaries: pd.DataFrame, entry: dict[str, int], seq_length: int, cap: int
) -> Iterator[tuple[dict[str, int], pd.Series]]:
    """Follow the open pack through consecutive units: state on entry, summary row that applied."""
    state = dict(entry)
    for unit, step in _units(summaries):
        pick = step.iloc[int(_choose(step, state["used"], state["held"], seq_length, cap))]
        yield dict(state, unit=unit), pick
        if pick["whole"]:
            state["used"] += int(pick["tokens"])
            state["held"] += int(pick["rows"])
        else:
            state.update(used=int(pick["used"]), held=int(pick["held"]), home=int(pick["home"]))
        state["packs_before"] += int(pick["starts"])
        state["over_before"] += int(pick["over"])


def _chunk_row(state: dict[str, int], pick: pd.Series) -> dict[str, int | None]:
    entered = not pick["whole"]
    return {
        "chunk": state["unit"],
        "entry_pos": int(pick["entry_pos"]) if entered else None,
        "entry_over": state["over_before"] + int(pick["entry_over"]) if entered else None,
        "carry_home": state["home"],
        "packs_before": state["packs_before"],
        "over_before": state["over_before"],
        "starts": int(pick["starts"]),
        "over": int(pick["over"]),
    }


def _descend(seq_length: int, cap: int, to_chunks: bool) -> Callable:
    """Hand the open pack known for a run of units down to each unit of the run."""

    def step(entry: pd.DataFrame, units: pd.DataFrame) -> pd.DataFrame:
        if entry.empty or units.empty:
            return pd.DataFrame()
        first = entry.drop(columns="unit").iloc[0].astype(int).to_dict()
        steps = walk_units(units, first, seq_length, cap)
        if not to_chunks:
            return pd.DataFrame([state for state, _ in steps])
        rows = [_chunk_row(state, pick) for state, pick in steps]
        # Nullable from the start: by way of floats, large positions would lose digits.
        return pd.DataFrame({c: pd.array([r[c] for r in rows], dtype="Int64") for c in rows[0]})

    return step


@dataclass(frozen=True)
class PackPlan:
    """Where every chunk's packs begin.

    ``chunks`` (at most ``MAX_CHUNKS`` rows): ``entry_pos`` first pack start in the chunk, null if
    there is none; ``carry_home`` chunk in which the pack open at the chunk's beginning started;
    ``packs_before`` and ``over_before`` normal and oversize packs started before the chunk;
    ``close_over`` oversize packs finished before the chunk's last pack.
    """

    chunks: DataFrame
    first_pos: int
    chunk_rows: int
    n_packs: int
    config: PackConfig
    n_chunks: int = 1

    def chunk_of(self, pos: Column) -> Column:
        return floor_div(pos - F.lit(self.first_pos), self.chunk_rows)


def rows_per_chunk(span: int, cores: int, tokens: int = 0) -> int:
    """Positions of a chunk, where ``span`` positions have so many tokens."""
    least, most = CHUNK_ROWS
    wanted = min(max(-(-span // (CHUNKS_PER_CORE * cores)), least), most)
    if tokens > CHUNK_TOKENS:
        wanted = min(wanted, max(span * CHUNK_TOKENS // tokens, least // 16))
    return max(wanted, -(-span // MAX_CHUNKS))


def plan_packs(
    samples: DataFrame, config: PackConfig, chunk_rows: int | None = None, fan_in: int = FAN_IN
) -> PackPlan:
    """Find the pack boundaries of ``samples(pos, n_tokens, ...)``; only those two columns are read.

    ``pos`` is a unique LONG that rises in packing order and may have gaps. Keys that are sparse
    and clustered should first go through ``dense_positions``. The samples are read again when they
    are packed, so they must be a stored table or a deterministic expression over one.
    """
    length, cap = config.seq_length, max(1, config.sample_cap)
    narrow = samples.select("pos", F.col("n_tokens").cast("long").alias("n_tokens"))
    kept = F.sum(F.least("n_tokens", F.lit(length))).alias("tokens")
    bounds = narrow.agg(F.min("pos").alias("low"), F.max("pos").alias("high"), kept).first()
    low, high = bounds["low"] or 0, bounds["high"] or 0
    if chunk_rows is None:
        cores = samples.sparkSession.sparkContext.defaultParallelism
        chunk_rows = rows_per_chunk(high - low + 1, cores, bounds["tokens"] or 0)
    plan = PackPlan(None, low, chunk_rows, 0, config)

    def summarise(chunk: pd.DataFrame) -> pd.DataFrame:
        return summarise_chunk(chunk, length, cap)

    def compose(units: pd.DataFrame) -> pd.DataFrame:
        return compose_units(units, length, cap, fan_in)

    run = floor_div("unit", fan_in).alias("run")
    chunked = narrow.withColumn("chunk", plan.chunk_of(F.col("pos")))
    levels = [chunked.groupBy("chunk").applyInPandas(summarise, _SUMMARY)]
    n_units = n_chunks = (high - low) // chunk_rows + 1
    while n_units > fan_in:
        # Needed on the way up and on the way down.
        levels[-1] = stage(levels[-1], "pack-summary")
        levels.append(levels[-1].groupBy(run).applyInPandas(compose, _SUMMARY))
        n_units = (n_units - 1) // fan_in + 1

    # A full pack before the first sample makes that sample start a new one.
    start = [(0, length, cap, 0, 0, -1)]
    known = samples.sparkSession.createDataFrame(start, _ENTRY)
    for depth in reversed(range(len(levels))):
        known = (
            known.groupBy("unit")
            .cogroup(levels[depth].groupBy(run))
            .applyInPandas(
                _descend(length, cap, depth == 0), _CHUNKS if depth == 0 else _ENTRY
            )
        )
    chunks = stage(known, "pack-chunks")
    totals = chunks.agg(F.sum("starts").alias("packs"), F.sum("over").alias("over")).first()
    n_over = totals["over"] or 0
    closing = chunks.where(F.col("entry_pos").isNotNull()).select(
        F.col("carry_home").alias("chunk"), F.col("entry_over").alias("close_over")
    )
    chunks = chunks.drop("entry_over", "starts", "over").join(
        F.broadcast(closing), "chunk", "left"
    ).fillna({"close_over": n_over})
    return PackPlan(chunks, low, chunk_rows, (totals["packs"] or 0) + n_over, config, n_chunks)


def with_homes(samples: DataFrame, plan: PackPlan) -> DataFrame:
    """Add ``home``, the chunk in which each sample's pack started (an oversize sample has its own), and what was packed
    before it."""
    pos = F.col("pos")
    oversize = F.col("n_tokens") > plan.config.seq_length
    stays = oversize | F.coalesce(pos >= F.col("entry_pos"), F.lit(False))
    return (
        samples.withColumn("chunk", plan.chunk_of(pos))
        .join(F.broadcast(plan.chunks), "chunk")
        .withColumn("home", F.when(stays, F.col("chunk")).otherwise(F.col("carry_home")))
        .drop("chunk", "entry_pos", "carry_home")
    )


def to_homes(rows: DataFrame, plan: PackPlan) -> DataFrame:
    """Shuffle rows with ``home`` to it. A destination holds one chunk and the rest of its last pack, so no key can grow hot."""
    # The default number of partitions does not follow the input.
    default = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = -(-plan.n_chunks // CHUNKS_PER_TASK)
    return rows.repartition(*((parts, "home") if parts > default else ("home",)))


def route(samples: DataFrame, plan: PackPlan) -> DataFrame:
    """Bring each pack's samples together: one shuffle of the samples by the chunk their pack
    started in (an oversize sample by its own), sorted by position within it."""
    return to_homes(with_homes(samples, plan), plan).sortWithinPartitions("home", "pos")
