"""Packing that a batch run begins and a stream goes on with, one open pack per lane.

The batch half packs a backlog in parallel and leaves each lane's last pack open. The stream takes these
packs as its initial state, so both together give what one run over everything would.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from packloom.config import PackConfig
from packloom.functions.memory import give_back
from packloom.operators.assembly import assign_packs
from packloom.operators.packing import plan_packs
from packloom.operators.positions import dense_positions
from packloom.streaming.packer import _PACK, PACKS_AT_ONCE, _cut, _padded, in_key_order
from packloom.workspace import stage

_COLUMNS = [field.split(" ")[0] for field in _PACK.split(", ")]
_PLACE = "pack_no long, used long, held int"
_HELD = "ord int, sample_key long, slots array<array<int>>, source_id string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which list state and timers need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _usable(samples: DataFrame) -> DataFrame:
    source = F.col("source_id") if "source_id" in samples.columns else F.lit(None)
    return samples.where(F.size(F.flatten("slots")) > 0).select(
        "lane", "sample_key", "slots", F.coalesce(source.cast("string"), F.lit("")).alias("source_id")
    )


def pack_lanes(samples: DataFrame, config: PackConfig) -> DataFrame:
    """``samples(lane, sample_key, slots)`` packed lane by lane in key order: ``lane, pack_no, ord, sample_key,
    slots, source_id, open``, where ``open`` marks the samples of a lane's last pack.

    All lanes are one order to the parallel packer. A sample of full length stands at the head of each lane and
    closes the pack before it, so that no pack crosses a border; it is left out of the result. Lanes may be of
    any size.
    """
    length = config.seq_length
    rows = _usable(samples).withColumn("n_tokens", F.size(F.flatten("slots")))
    heads = rows.select("lane").distinct().select(
        "lane",
        F.lit(None).cast(rows.schema["sample_key"].dataType).alias("sample_key"),
        F.array().cast("array<array<int>>").alias("slots"),
        F.lit("").alias("source_id"),
        F.lit(length).alias("n_tokens"),
        F.lit(0).alias("kind"),
    )
    # Heads come first whatever the keys are.
    ordered = dense_positions(heads.unionByName(rows.withColumn("kind", F.lit(1))), "lane", "kind", "sample_key")
    placed = stage(assign_packs(ordered, plan_packs(ordered, config)), "lane-packs")
    own, closed_late = F.col("kind") == 1, F.col("n_tokens") <= length
    lanes = placed.groupBy("lane").agg(
        F.max(F.when(~own, F.col("pack_id"))).alias("head"),
        F.min(F.when(own, F.col("pack_id"))).alias("first"),
        F.max(F.when(own & closed_late, F.col("pack_id"))).alias("last"),
    )
    # Oversize samples right behind the head are finished before it.
    number = F.col("pack_id") - F.least("head", "first") - (F.col("pack_id") > F.col("head")).cast("long")
    return placed.where(own).join(lanes, "lane").select(
        "lane",
        number.alias("pack_no"),
        F.col("sample_ord").alias("ord"),
        "sample_key",
        "slots",
        "source_id",
        F.coalesce(F.col("pack_id") == F.col("last"), F.lit(False)).alias("open"),
    )


def closed_packs(packed: DataFrame, config: PackConfig) -> DataFrame:
    """The finished packs of ``pack_lanes`` as padded rows."""
    return _rows(packed.where(~F.col("open")), config)


def carried(packed: DataFrame) -> DataFrame:
    """What the stream begins with, one row per sample of an open pack: ``lane, pack_no, ord, sample_key, slots, source_id``.

    A lane without an open pack has one row without a sample, with the number of its next pack.
    """
    held = packed.where("open").drop("open")
    used_up = packed.groupBy("lane").agg(F.bool_or("open").alias("open"), (F.max("pack_no") + 1).alias("pack_no"))
    return held.unionByName(used_up.where(~F.col("open")).drop("open"), allowMissingColumns=True)


def _rows(samples: DataFrame, config: PackConfig) -> DataFrame:
    """``lane, pack_no, ord, sample_key, slots, source_id`` to padded rows. A pack has at most ``seq_length`` tokens,
    or is one oversize sample, which is cut."""
    sizes = F.transform("slots", F.size)
    ends = F.transform(
        sizes, lambda _, i: F.aggregate(F.slice(sizes, F.lit(1), i + 1), F.lit(0), lambda total, size: total + size)
    )
    cut = F.transform(ends, lambda end: F.least(end, F.lit(config.seq_length)))
    before = F.slice(F.concat(F.array(F.lit(0)), cut), F.lit(1), F.size(cut))
    entry = F.struct(
        "ord",
        "sample_key",
        F.slice(F.flatten("slots"), 1, config.seq_length).alias("tokens"),
        F.zip_with(cut, before, lambda end, start: end - start).alias("sizes"),
        "source_id",
    )
    packs = samples.groupBy("lane", "pack_no").agg(F.sort_array(F.collect_list(entry)).alias("held"))
    return _padded(
        packs.select(
            "lane",
            "pack_no",
            F.col("held.sample_key").alias("sample_keys"),
            F.flatten("held.tokens").alias("input_ids"),
            F.col("held.sizes").alias("slot_sizes"),
            F.col("held.source_id").alias("sources"),
        ),
        config,
    )


class LanePacker(StatefulProcessor):
    """Closes packs as samples of a lane arrive.

    ``place`` is the number and size of the open pack, ``held`` the list of its samples. The list only grows
    until its pack is closed, and is read only then.
    """

    def __init__(self, seq_length: int, cap: int, flush_after_ms: int | None):
        self.seq_length, self.cap, self.flush_after_ms = seq_length, cap, flush_after_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", _PLACE)
        self.held = handle.getListState("held", _HELD)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        number, used, held = self.place.get() if self.place.exists() else (0, 0, 0)
        for row in initialState.itertuples(index=False):
            number = int(row.pack_no)
            if row.sample_key is None or pd.isna(row.sample_key):
                continue
            slots = [[int(token) for token in slot] for slot in row.slots]
            self.held.appendValue((int(row.ord), int(row.sample_key), slots, row.source_id))
            used, held = used + sum(map(len, slots)), held + 1
        self.place.update((number, used, held))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number, used, held = self.place.get() if self.place.exists() else (0, 0, 0)
        new: list[tuple] = []  # samples of the open pack that are not stored yet
        finished: list[tuple] = []

        def close() -> None:
            finished.append(self._pack(key[0], number, self._stored(held - len(new)) + new))
            new.clear()

        for sample, slots, source in in_key_order(rows):
            if len(finished) >= PACKS_AT_ONCE:
                yield pd.DataFrame(finished, columns=_COLUMNS)
                finished.clear()
            size = sum(map(len, slots))
            entry = (held, sample, [slot.tolist() for slot in slots], source)
            if size > self.seq_length:
                finished.append(self._pack(key[0], number, [entry]))
                number += 1
                continue
            if held and (used + size > self.seq_length or held >= self.cap):
                close()
                number, used, held = number + 1, 0, 0
            new.append((held, *entry[1:]))
            used, held = used + size, held + 1
        if new:
            self.held.appendList(new)
        self.place.update((number, used, held))
        if self.flush_after_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if held:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.flush_after_ms)
        yield pd.DataFrame(finished, columns=_COLUMNS)
        give_back()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number, _, held = self.place.get()
        packs = [self._pack(key[0], number, self._stored(held))] if held else []
        self.place.update((number + len(packs), 0, 0))
        yield pd.DataFrame(packs, columns=_COLUMNS)

    def close(self) -> None:
        pass

    def _stored(self, count: int) -> list[tuple]:
        """Take the stored samples of the open pack out of the state."""
        stored = [tuple(row) for row in self.held.get()] if count else []
        if count:
            self.held.clear()
        return sorted(stored, key=lambda row: row[0])

    def _pack(self, lane: str, number: int, entries: list[tuple]) -> tuple:
        tokens = np.concatenate([np.asarray(slot, np.int32) for entry in entries for slot in entry[2]])
        sizes = [_cut([len(slot) for slot in entry[2]], self.seq_length) for entry in entries]
        return lane, number, [e[1] for e in entries], tokens[: self.seq_length], sizes, [e[3] for e in entries]


def continue_lanes(
    samples: DataFrame, config: PackConfig, carried: DataFrame | None = None, flush_after_ms: int | None = None
) -> DataFrame:
    """Finished packs of a streaming ``samples(lane, sample_key, slots)``, begun with the open packs in ``carried``.

    The initial state counts for a new query only. Samples of a lane are taken in key order within a micro-batch
    and in arrival order across them. With ``flush_after_ms`` a lane's open pack is given out when the lane was
    idle for that long. Start the query inside of ``rocksdb_state`` and ``small_batches``.
    """
    processor = LanePacker(config.seq_length, max(1, config.sample_cap), flush_after_ms)
    packs = _usable(samples).groupBy("lane").transformWithStateInPandas(
        processor,
        outputStructType=_PACK,
        outputMode="append",
        timeMode="none" if flush_after_ms is None else "processingTime",
        initialState=None if carried is None else carried.groupBy("lane"),
    )
    return _padded(packs, config)


def left_open(spark: SparkSession, checkpoint: str, config: PackConfig) -> DataFrame:
    """The packs still open in a stopped query, as its rows: the rest when the input has ended."""
    state = spark.read.format("statestore")
    place = state.option("stateVarName", "place").load(checkpoint).select("key.lane", "value.pack_no")
    held = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint)
    return _rows(held.select("key.lane", "list_element.*").join(place, "lane"), config)
