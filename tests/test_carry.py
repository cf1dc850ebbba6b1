"""Batch half and stream half against one sequential run of each lane."""

import time

import numpy as np
import pytest
from packloom.config import PackConfig
from packloom.streaming.carry import carried, closed_packs, continue_lanes, left_open, pack_lanes, rocksdb_state
from packloom.streaming.ingest import run_available
from packloom.streaming.packer import lanes_for
from reference_model import greedy, packed_row

CONFIG = PackConfig(eos_token_id=1, seq_length=40, max_samples=4, max_sample_length=None)
SCHEMA = "lane string, sample_key long, slots array<array<int>>"


@pytest.fixture(scope="module")
def samples():
    rng = np.random.default_rng(7)
    made = {k: [[int(t) for t in rng.integers(2, 90, rng.integers(1, 9))] for _ in range(3)] for k in range(90)}
    for key in (0, 1, 33, 71):  # oversize: at the head of a lane, twice in a row, and in either half
        made[key][2] = list(range(2, 60))
    return made


def lane(key: int) -> str:
    return "only batch" if key % 9 == 4 and key < 45 else "only stream" if key % 9 == 4 else f"lane {key % 2}"


def numbered(samples: dict, name: str) -> list[list[int]]:
    """Keys of the packs of a lane, in the order they are finished."""
    keys = [k for k in samples if lane(k) == name]
    return [[keys[i] for i in pack] for pack in greedy([sum(map(len, samples[k])) for k in keys], 40, 4)]


def feed(spark, path, samples, keys):
    rows = [(lane(k), k, samples[k]) for k in keys]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_batch_alone_packs_each_lane(spark, samples):
    rows = spark.createDataFrame([(lane(k), k, samples[k]) for k in samples], SCHEMA).repartition(5)
    packed = pack_lanes(rows, CONFIG).collect()
    for name in {lane(k) for k in samples}:
        got = {}
        for r in sorted((r for r in packed if r["lane"] == name), key=lambda r: (r["pack_no"], r["ord"])):
            got.setdefault(r["pack_no"], []).append(r["sample_key"])
        assert list(got) == list(range(len(got)))
        assert list(got.values()) == numbered(samples, name)
        assert len({r["pack_no"] for r in packed if r["lane"] == name and r["open"]}) == 1


def test_stream_goes_on_with_the_open_packs(spark, samples, tmp_path):
    path, checkpoint, sink = (str(tmp_path / name) for name in ("in", "checkpoint", "out"))
    packed = pack_lanes(spark.createDataFrame([(lane(k), k, samples[k]) for k in range(45)], SCHEMA), CONFIG)
    for part in (range(45, 60), range(60, 90)):
        feed(spark, path, samples, part)
        stream = continue_lanes(spark.readStream.schema(SCHEMA).parquet(path), CONFIG, carried(packed))
        with rocksdb_state(spark):
            run_available(stream, checkpoint, sink)
    got = closed_packs(packed, CONFIG).unionByName(spark.read.parquet(sink)).unionByName(left_open(spark, checkpoint, CONFIG)).collect()
    for name in {lane(k) for k in samples}:
        packs = sorted((r for r in got if r["lane"] == name), key=lambda r: r["pack_no"])
        assert [r["pack_no"] for r in packs] == list(range(len(packs)))
        assert [list(r["sample_keys"]) for r in packs] == numbered(samples, name)
        for r in packs:
            want = packed_row(samples, r["sample_keys"], 40, 3, 0)
            assert {k: r[k] for k in want} == want


def test_lane_of_oversize_samples_carries_its_number(spark, samples):
    rows = spark.createDataFrame([("x", k, samples[k]) for k in (0, 1)], SCHEMA)
    state = carried(pack_lanes(rows, CONFIG)).collect()
    assert [(r["lane"], r["pack_no"], r["sample_key"]) for r in state] == [("x", 2, None)]


def test_no_samples(spark):
    packed = pack_lanes(spark.createDataFrame([("x", 1, [[], []])], SCHEMA), CONFIG)
    assert packed.count() == 0 and carried(packed).count() == 0 and closed_packs(packed, CONFIG).count() == 0


def test_idle_lane_is_given_out(spark, samples, tmp_path):
    path, checkpoint, sink = (str(tmp_path / name) for name in ("in", "checkpoint", "out"))
    feed(spark, path, samples, [3, 5])
    stream = continue_lanes(spark.readStream.schema(SCHEMA).parquet(path), CONFIG, flush_after_ms=500)
    writer = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    with rocksdb_state(spark):
        query = writer.trigger(processingTime="1 second").start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline and not (query.lastProgress and spark.read.schema(stream.schema).parquet(sink).count()):
            time.sleep(1)
    finally:
        query.stop()
    got = spark.read.parquet(sink).collect()
    assert [(r["lane"], r["pack_no"], list(r["sample_keys"])) for r in got] == [("lane 1", 0, [3, 5])]
    assert left_open(spark, checkpoint, CONFIG).count() == 0


def test_lanes_grow_with_the_input():
    assert [lanes_for(n) for n in (0, 10_000, 3_200_001)] == [32, 32, 321]
