"""Packing strategies next to the sequential one: first fit, and a pool of open packs.

Both look back at many open packs, so a run over the whole order cannot be cut anywhere. They work
on windows of neighbouring samples: windows are packed independently, and every sample is packed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.config import PackConfig
from packloom.functions.numbers import floor_div
from packloom.operators.assembly import assign_packs
from packloom.operators.packing import plan_packs
from packloom.operators.positions import dense_positions

WINDOW_ROWS = 4096
# Fixed value: open packs in the pool.
POOL_PACKS = 4

_ASSIGNED = "pos long, window long, bin int, sample_ord int"


def _fit(first_fit: bool, seq_length: int, cap: int, pool: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(window: pd.DataFrame) -> pd.DataFrame:
        window = window.sort_values("pos")
        sizes = np.minimum(window["n_tokens"].to_numpy(), seq_length)
        # One bin per sample is the most that can be needed.
        room = np.full(len(sizes), seq_length, dtype=np.int64)
        held = np.zeros(len(sizes), dtype=np.int64)
        opened, active, bins, ordinals = 0, [], [], []
        for size in sizes:
            if first_fit:
                fits = np.flatnonzero((room[:opened] >= size) & (held[:opened] < cap))
                chosen = int(fits[0]) if len(fits) else -1
            else:
                # The fullest of the pool's packs that still takes the sample.
                fitting = [b for b in active if room[b] >= size and held[b] < cap]
                chosen = min(fitting, key=lambda b: room[b]) if fitting else -1
            if chosen < 0:
                chosen, opened = opened, opened + 1
                if len(active) == pool:
                    active.remove(min(active, key=lambda b: room[b]))
                active.append(chosen)
            bins.append(chosen)
            ordinals.append(int(held[chosen]))
            room[chosen] -= size
            held[chosen] += 1
        return window[["pos", "window"]].assign(bin=bins, sample_ord=ordinals)

    return pack


def assign_by_strategy(
    samples: DataFrame, config: PackConfig, window_rows: int = WINDOW_ROWS, pool: int = POOL_PACKS
) -> DataFrame:
    """``pos, pack_id, sample_ord`` under ``config.strategy``; reads ``pos`` and ``n_tokens`` only.

    A window is ``window_rows`` samples that follow each other, whatever gaps their positions have.
    Pack ids of ``first_fit`` and ``pool`` rise with the window and may have gaps. A sample longer
    than ``seq_length`` fills a pack alone.
    """
    narrow = samples.select("pos", F.col("n_tokens").cast("long").alias("n_tokens"))
    if config.strategy == "greedy":
        return assign_packs(narrow, plan_packs(narrow, config)).drop("n_tokens")
    narrow = dense_positions(narrow, "pos", name="number")
    window = floor_div("number", window_rows)
    fit = _fit(config.strategy == "first_fit", config.seq_length, max(1, config.sample_cap), pool)
    placed = narrow.withColumn("window", window).drop("number").groupBy("window").applyInPandas(fit, _ASSIGNED)
    return placed.select(
        "pos", (F.col("window") * F.lit(window_rows) + F.col("bin")).alias("pack_id"), "sample_ord"
    )
