"""First fit in levels against one sequential run."""

import numpy as np
import pytest
from packloom.config import PackConfig
from packloom.operators import levels
from packloom.operators.levels import assign_first_fit, first_fit

LENGTH = 1000


def plain(sizes, length, cap):
    room, held, bins = [], [], []
    for size in sizes:
        size = min(size, length)
        chosen = next((b for b in range(len(room)) if room[b] >= size and held[b] < cap), None)
        if chosen is None:
            chosen = len(room)
            room.append(length)
            held.append(0)
        bins.append((chosen, held[chosen]))
        room[chosen] -= size
        held[chosen] += 1
    return bins


@pytest.mark.parametrize(("n", "most", "cap"), [(0, 5, 3), (1, 5, 3), (300, 400, 100), (500, 90, 4), (200, 1500, 2), (64, 0, 7)])
def test_tree_equals_a_scan(n, most, cap):
    sizes = np.random.default_rng(n + cap).integers(0, most + 1, n)
    bins, ordinals = first_fit(sizes, LENGTH, cap)
    assert list(zip(bins.tolist(), ordinals.tolist(), strict=True)) == plain(sizes.tolist(), LENGTH, cap)


@pytest.mark.parametrize("window", [32, 4096])
@pytest.mark.parametrize("most", [120, 400])
def test_levels_are_near_one_run(spark, window, most):
    n = 12_000
    sizes = np.random.default_rng(most).integers(1, most + 1, n)
    rows = [(3 * i, int(s)) for i, s in enumerate(sizes)]
    config = PackConfig(eos_token_id=1, seq_length=LENGTH, max_samples=500, max_sample_length=None)
    got = assign_first_fit(spark.createDataFrame(rows, "pos long, n_tokens long").repartition(3), config, window).collect()
    assert sorted(r["pos"] for r in got) == [p for p, _ in rows]
    packs, length_of = {}, dict(rows)
    for r in got:
        packs.setdefault(r["pack_id"], []).append((r["sample_ord"], r["pos"]))
    for members in packs.values():
        members.sort()
        assert [o for o, _ in members] == list(range(len(members))) and members == sorted(members, key=lambda m: m[1])
        assert sum(length_of[p] for _, p in members) <= LENGTH
    assert len(packs) <= 1.02 * len(set(first_fit(sizes, LENGTH, 500)[0].tolist()))


def test_what_never_closes_ends(spark, monkeypatch):
    """Samples of which no two fit, more than the largest window holds."""
    monkeypatch.setattr(levels, "MOST_ROWS", 64)
    rows = [(i, 600) for i in range(500)]
    config = PackConfig(eos_token_id=1, seq_length=LENGTH, max_sample_length=None)
    got = assign_first_fit(spark.createDataFrame(rows, "pos long, n_tokens long"), config, 16).collect()
    assert len({r["pack_id"] for r in got}) == 500


def test_empty_and_oversize(spark):
    config = PackConfig(eos_token_id=1, seq_length=LENGTH, max_sample_length=None)
    assert assign_first_fit(spark.createDataFrame([], "pos long, n_tokens long"), config).count() == 0
    got = assign_first_fit(spark.createDataFrame([(0, 5), (1, 9999), (2, 5)], "pos long, n_tokens long"), config).collect()
    assert len({r["pack_id"] for r in got}) == 2
