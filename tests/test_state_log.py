"""Saved states that only add up, and the order of a reservoir."""

import random

import pytest
from packloom.operators.batches import shuffle_key
from packloom.operators.reservoir import drawn_place, reservoir_order
from packloom.sources import state_log
from packloom.sources.state import ResumeState, initial_state
from pyspark.sql import functions as F


def test_every_save_is_kept(spark, tmp_path):
    path = f"{tmp_path}/log"
    assert state_log.latest(spark, path) is None and state_log.history(spark, path).count() == 0
    states = [ResumeState(1, 10, 100), initial_state(["a", "b"]).stamped(200, 1), ResumeState(2, 0, 200)]
    assert [state_log.append(spark, s, path) for s in states] == [0, 1, 2]
    assert state_log.latest(spark, path) == states[2]
    assert state_log.latest(spark, path, step=100) == states[0] and state_log.latest(spark, path, step=200) == states[2]
    assert state_log.latest(spark, path, step=7) is None
    rows = state_log.history(spark, path).orderBy("entry").collect()
    assert [(r["entry"], r["step"]) for r in rows] == [(0, 100), (1, 200), (2, 200)]
    assert set(rows[1]["dataset_states"]) == {"a", "b"}


def test_a_crash_between_write_and_commit_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/log"
    state_log.append(spark, ResumeState(step=1), path)
    name = state_log.write_aside(spark, ResumeState(step=2), path)  # and then the process is gone
    assert state_log.latest(spark, path) == ResumeState(step=1)
    assert state_log.append(spark, ResumeState(step=3), path) == 1
    assert state_log.history(spark, path).count() == 2
    assert state_log.clear_aside(spark, path) == 1
    with pytest.raises(FileNotFoundError):
        state_log.commit(spark, name, path)
    assert state_log.latest(spark, path) == ResumeState(step=3)


def sequential(spark, n, size, seed):
    """A reservoir run pack by pack, with the same draws."""
    ids = spark.range(n).select("id", drawn_place(seed, F.col("id"), size).alias("place"), shuffle_key(seed, F.concat(F.lit("rest:"), F.col("id").cast("string"))).alias("key"))
    rows = ids.orderBy("id").collect()
    held, out = {}, []
    for r in rows:
        if r["place"] in held:
            out.append(held[r["place"]])
        held[r["place"]] = r["id"]
    keys = {r["id"]: r["key"] for r in rows}
    return out + sorted(held.values(), key=lambda i: (keys[i], i))


@pytest.mark.parametrize(("n", "size"), [(0, 5), (3, 5), (5, 5), (500, 1), (900, 16), (300, 1000)])
@pytest.mark.parametrize("rounds", [4096, 3])
def test_order_equals_a_sequential_reservoir(spark, monkeypatch, n, size, rounds):
    monkeypatch.setattr("packloom.operators.reservoir.RUN_ROUNDS", rounds)
    got = [r["pack_id"] for r in reservoir_order(spark, n, size, 7).orderBy("pack_seq").collect()]
    assert got == sequential(spark, n, size, 7) and sorted(got) == list(range(n))


def test_packs_travel_far(spark):
    rows = reservoir_order(spark, 4000, 50, 1).collect()
    assert max(r["pack_seq"] - r["pack_id"] for r in rows) > 200
    assert min(r["pack_seq"] - r["pack_id"] for r in rows) >= -50
