"""First-fit packing in levels: windows of samples, then what their open packs hold, until little is left open.

First fit looks back at all packs that are still open. A window is packed by a tree of largest gaps, so that a
sample finds its pack in a logarithm of steps. Packs that are nearly full stay as they are; the samples of the
others are numbered anew in the order of their positions and packed again, in windows of each other's, level by
level. A seam between windows thus costs a pack that is not quite full, not one that is half empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.config import PackConfig
from packloom.functions.numbers import floor_div
from packloom.operators.positions import dense_positions
from packloom.workspace import stage

WINDOW_ROWS = 4096
# Samples of a window at most; lengths alone are held, about a hundred bytes each.
MOST_ROWS = 1 << 18
#: A pack with at least this share of its tokens used is not opened again.
FULL = 0.99

_PLACED = "pos long, n_tokens long, window long, bin int, sample_ord int, used long, held int"


def first_fit(sizes: np.ndarray, seq_length: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Pack of each size, the first that has room for it and fewer than ``cap`` others, and its place in there.

    Sizes above ``seq_length`` count as that. Packs not yet begun are gaps of the whole length at the end of the tree.
    """
    n = len(sizes)
    width = 1 << max(n - 1, 0).bit_length()
    gaps = [seq_length] * (2 * width)
    held = [0] * n
    bins, ordinals = np.zeros(n, np.int32), np.zeros(n, np.int32)
    for i, size in enumerate(np.minimum(sizes, seq_length).tolist()):
        node = 1
        while node < width:
            node *= 2
            if gaps[node] < size:
                node += 1
        found = node - width
        bins[i], ordinals[i] = found, held[found]
        held[found] += 1
        gaps[node] = gaps[node] - size if held[found] < cap else -1
        while node > 1:
            node //= 2
            gap = max(gaps[2 * node], gaps[2 * node + 1])
            if gap == gaps[node]:
                break
            gaps[node] = gap
    return bins, ordinals


def assign_first_fit(samples: DataFrame, config: PackConfig, window_rows: int = WINDOW_ROWS, full: float = FULL) -> DataFrame:
    """``pos, pack_id, sample_ord``: first fit over the whole order, in levels; reads ``pos`` and ``n_tokens`` only.

    A level packs windows of ``window_rows`` samples, four times as many where more than half of them stay open. The
    last level is one window, or one in which next to nothing closes. Pack ids have gaps.
    """
    length, cap = config.seq_length, max(1, config.sample_cap)

    def fit(window: pd.DataFrame) -> pd.DataFrame:
        window = window.sort_values("pos")
        sizes = np.minimum(window["n_tokens"].to_numpy(), length)
        bins, ordinals = first_fit(sizes, length, cap)
        used, held = np.bincount(bins, sizes).astype(np.int64), np.bincount(bins)
        return window[["pos", "n_tokens", "window"]].assign(bin=bins, sample_ord=ordinals, used=used[bins], held=held[bins])

    rest = dense_positions(samples.select("pos", F.col("n_tokens").cast("long").alias("n_tokens")), "pos", name="number")
    n = rest.count()
    begun, found = 0, []
    while True:
        windowed = rest.withColumn("window", floor_div("number", window_rows)).drop("number")
        placed = stage(windowed.groupBy("window").applyInPandas(fit, _PLACED), "level")
        still_open = (F.col("used") < int(full * length)) & (F.col("held") < cap)
        left = 0 if n <= window_rows else placed.where(still_open).count()
        last = left == 0 or (left > 0.95 * n and window_rows >= MOST_ROWS)
        kept = placed if last else placed.where(~still_open)
        pack = F.lit(begun) + F.col("window") * window_rows + F.col("bin")
        found.append(kept.select("pos", pack.alias("pack_id"), "sample_ord"))
        if last:
            break
        begun += -(-n // window_rows) * window_rows
        rest = dense_positions(placed.where(still_open).select("pos", "n_tokens"), "pos", name="number")
        if left > n // 2:
            window_rows = min(4 * window_rows, max(window_rows, MOST_ROWS))
        n = left
    result = found[0]
    for level in found[1:]:
        result = result.unionByName(level)
    return result
