import numpy as np
import pandas as pd
import pytest
from packloom.config import PackConfig
from packloom.operators import batches, quality, unpack
from packloom.operators.strategies import assign_by_strategy
from packloom.streaming.ingest import run_available
from packloom.streaming.packer import _packer, lane_of, open_packs, pack_stream
from pyspark.sql import functions as F
from reference_model import greedy, packed_row

ROW = "pack_id long, pack_seq long, segment_ids array<int>, attention_mask array<int>, input_ids array<int>"


def bounds_by_loop(segments, mask, slots):
    """Starts and lengths by walking over the tokens."""
    end = len(segments)
    if mask is not None:
        end = max((i + 1 for i, m in enumerate(mask) if m), default=0)
    ids = [s // slots if s >= 0 else -1 for s in segments[:end]]
    if not ids or ids[0] < 0:
        return [], []
    starts = [i for i in range(end) if ids[i] >= 0 and (i == 0 or ids[i] != ids[i - 1])]
    return starts, [b - a for a, b in zip(starts, starts[1:] + [end])]


CASES = [
    ([0, 0, 1, 2, 3, 4, 5, 5, -1, -1], [1] * 8 + [0] * 2),
    ([0, 0, 0, 1, 1, 2, -1, -1], [1] * 6 + [0] * 2),
    ([-1, 0, 1, 2], [1, 1, 1, 1]),
    ([0, 1, 2, 3], [0, 0, 0, 0]),
    ([0, 1, -1, 3, 4, 0, 1], [1, 1, 1, 1, 1, 1, 0]),
    ([], []),
]


@pytest.mark.parametrize("use_mask", [True, False])
@pytest.mark.parametrize("slots", [1, 3])
def test_sample_bounds(spark, use_mask, slots):
    rows = [(i, i, s, m, list(range(100, 100 + len(s)))) for i, (s, m) in enumerate(CASES)]
    packs = spark.createDataFrame(rows, ROW)
    got = {r["pack_id"]: (r["sample_starts"], r["sample_lengths"]) for r in unpack.with_sample_bounds(packs, slots, use_mask).collect()}
    assert got == {i: bounds_by_loop(s, m if use_mask else None, slots) for i, (s, m) in enumerate(CASES)}
    split = unpack.split_samples(packs, num_negatives=1, use_mask=use_mask).collect() if slots == 3 else []
    for r in split:
        starts, lengths = got[r["pack_id"]]
        a, n = starts[r["sample_ord"]], lengths[r["sample_ord"]]
        assert r["input_ids"] == list(range(100 + a, 100 + a + n))
    by_batch = unpack.sample_info(packs.withColumn("batch_id", F.lit(0)), slots - 2, by="batch_id", use_mask=use_mask).first()
    assert by_batch["num_samples"] == sum(len(s) for s, _ in got.values())
    assert by_batch["sample_starts"] == [x for i in range(len(CASES)) for x in got[i][0]]


def test_toy_segments_and_argument_checks(spark):
    packs = spark.createDataFrame([(0, 0, [0, 0, 0, 1, 1, 1, 2, 2, 2], [1] * 9, [5] * 9)], ROW)
    assert unpack.sample_info(packs, num_negatives=-1).first()["num_samples"] == 3
    with pytest.raises(ValueError):
        unpack.with_sample_bounds(packs, 0)
    with pytest.raises(ValueError):
        unpack.with_sample_bounds(packs.drop("segment_ids"), 3)
    uneven = spark.createDataFrame([(0, 0, [0, 0, 0], [1], [5] * 3)], ROW)
    with pytest.raises(Exception, match="differ in length"):
        unpack.with_sample_bounds(uneven, 3).collect()
    # Samples past the end of the ids are skipped.
    short = spark.createDataFrame([(0, 0, [0, 0, 3, 3], [1] * 4, [5, 6, 7])], ROW)
    assert [r["input_ids"] for r in unpack.split_samples(short).collect()] == [[5, 6]]


def position_errors_by_loop(segments, positions, mask):
    seen, wrong = {}, set()
    for i, (segment, position, attended) in enumerate(zip(segments, positions, mask)):
        if not attended:
            if position != 0:
                wrong.add(i)
        elif segment >= 0:
            if position != seen.get(segment, 0):
                wrong.add(i)
            seen[segment] = seen.get(segment, 0) + 1
    return wrong


def test_position_errors_on_random_packs(spark):
    rng = np.random.default_rng(8)
    rows = []
    for pack in range(300):
        n = int(rng.integers(0, 9))
        segments = np.sort(rng.integers(-1, 4, n)) if pack % 3 else rng.integers(-1, 3, n)
        mask = np.arange(n) < rng.integers(0, n + 1) if pack % 2 else rng.integers(0, 2, n) > 0
        count, positions = {}, []
        for s, m in zip(segments, mask):
            positions.append(count.get(s, 0) if m and s >= 0 else 0)
            if m:
                count[s] = count.get(s, 0) + 1
        if n and pack % 5 == 0:
            positions[int(rng.integers(0, n))] += 1
        rows.append((pack, [int(s) for s in segments], [int(p) for p in positions], [int(m) for m in mask]))
    packs = spark.createDataFrame(rows, "pack_id long, segment_ids array<int>, position_ids array<int>, attention_mask array<int>")
    got = {(r["pack_id"], r["pos"]) for r in quality.position_errors(packs).collect()}
    want = {(r[0], i) for r in rows for i in position_errors_by_loop(*r[1:])}
    assert got == want and want


def test_checks_find_faulty_packs(spark):
    schema = "pack_id long, segment_ids array<int>, position_ids array<int>, attention_mask array<int>, num_segments int"
    rows = [
        (0, [0, 0, 1, 2, 3, 4, 5, -1], [0, 1, 0, 0, 0, 0, 0, 0], [1] * 7 + [0], 2),
        (1, [0, 0, 1, 2, 3, 4, 5, -1], [0, 1, 2, 0, 0, 0, 0, 4], [1] * 7 + [0], 3),
        (2, [0, 2, 1, 3, 3, 5, -1, -1], [0, 0, 0, 0, 1, 0, 0, 0], [1] * 6 + [0, 0], 2),
        (3, [0, 1, 0, 2, -1, -1, -1, -1], [0, 0, 1, 0, 0, 0, 0, 0], [1] * 4 + [0] * 4, 1),
    ]
    packs = spark.createDataFrame(rows, schema)
    wrong = {(r["pack_id"], r["pos"]) for r in quality.position_errors(packs).collect()}
    assert wrong == {(1, 2), (1, 7)}
    slots = {(r["pack_id"], r["sample_id"]): tuple(r)[2:] for r in quality.slot_order_errors(packs, 3).collect()}
    assert slots[(0, 0)] == slots[(0, 1)] == (0, 0, 0, 0)
    assert slots[(2, 0)][2] == 1 and slots[(2, 1)][:2] == (1, 1)
    assert slots[(3, 0)][2:] == (1, 1)
    ids = {r["pack_id"]: tuple(r)[1:] for r in quality.sample_id_errors(packs, 3).collect()}
    assert ids[0] == (2, 0, 0)
    agree = {r["pack_id"]: (r["overlaps"], r["counts_agree"]) for r in quality.overlap_errors(packs, 3).collect()}
    assert agree == {0: (0, True), 1: (0, False), 2: (0, True), 3: (0, True)}


@pytest.mark.parametrize("buffer", [None, 100])
def test_shuffle_is_a_seeded_permutation(spark, buffer):
    def order(seed):
        rows = batches.shuffled_order(spark, 1000, seed, buffer).collect()
        return {r["pack_id"]: r["pack_seq"] for r in rows}

    first = order(42)
    assert first == order(42) != order(43)
    assert sorted(first) == sorted(first.values()) == list(range(1000))
    assert any(k != v for k, v in first.items())
    if buffer:
        assert all(k // buffer == v // buffer for k, v in first.items())


def test_batches_and_collate(spark):
    rows = [(i, list(range(1, i + 2)), [0] * (i + 1), ["s"] if i else None) for i in range(5)]
    packs = spark.createDataFrame(rows, "pack_id long, input_ids array<int>, segment_ids array<int>, source_ids array<string>")
    config = PackConfig(eos_token_id=1, shuffle=False, batch_size=2)
    ordered = batches.order_packs(packs, 5, config)
    assert batches.assign_batches(ordered, 5, 2).count() == 4
    assert batches.assign_batches(ordered, 1, 2).count() == 0
    batched = batches.assign_batches(ordered, 5, 2, drop_last=False)
    end = {r["batch_id"]: r for r in batches.collate(batched, 3).collect()}
    assert end[1]["input_ids"] == [[1, 2, 3], [2, 3, 4]]
    assert end[0]["input_ids"] == [[1, 0, 0], [1, 2, 0]]
    assert end[0]["segment_ids"] == [[0, -1, -1], [0, 0, -1]]
    assert end[0]["source_ids"] == [None, ["s"]] and end[2]["n_rows"] == 1
    start = {r["batch_id"]: r for r in batches.collate(batched, 3, "keep_start", pad_zero=True).collect()}
    assert start[1]["input_ids"] == [[1, 2, 3], [1, 2, 3]]
    assert start[0]["segment_ids"] == [[0, 0, 0], [0, 0, 0]]
    assert batches.collate(batched.where("false"), 3).collect() == []
    with pytest.raises(ValueError):
        batches.collate_field("input_ids", 3, "middle")


def first_fit(sizes, length, cap):
    packs = []
    for i, size in enumerate(sizes):
        home = next((p for p in packs if sum(sizes[j] for j in p) + size <= length and len(p) < cap), None)
        if home is None:
            packs.append(home := [])
        home.append(i)
    return packs


@pytest.mark.parametrize("strategy", ["first_fit", "pool"])
def test_other_strategies(spark, strategy):
    sizes = np.random.default_rng(1).integers(1, 60, 300)
    samples = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "pos long, n_tokens int")
    config = PackConfig(eos_token_id=1, seq_length=100, max_samples=4, strategy=strategy, max_sample_length=None)
    rows = assign_by_strategy(samples, config, window_rows=100).collect()
    assert sorted(r["pos"] for r in rows) == list(range(300))
    packs = {}
    for r in sorted(rows, key=lambda r: r["sample_ord"]):
        packs.setdefault(r["pack_id"], []).append(r["pos"])
    assert all(sum(sizes[i] for i in p) <= 100 and len(p) <= 4 for p in packs.values())
    assert all(p == sorted(p) for p in packs.values())
    if strategy == "first_fit":
        expected = [[w + i for i in p] for w in (0, 100, 200) for p in first_fit(sizes[w : w + 100], 100, 4)]
        assert sorted(packs.values()) == sorted(expected)


class Lane:
    """Stands in for the state of one lane."""

    exists, hasTimedOut, timeout, get = False, False, None, None

    def update(self, value):
        self.exists, self.get = True, value

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_idle_lane_gives_out_its_open_pack():
    step, lane = _packer(10, 5, 1000), Lane()
    rows = pd.DataFrame({"sample_key": [2, 1], "source_id": ["s", ""], "slots": [[np.array([5, 6]), np.array([7])], [np.array([8]), np.array([9])]]})
    assert [len(out) for out in step(("l",), iter([rows]), lane)] == [0]
    assert lane.get == (0, [1, 2], [8, 9, 5, 6, 7], [[1, 1], [2, 1]], ["", "s"]) and lane.timeout == 1000
    lane.hasTimedOut = True
    out = next(step(("l",), iter([]), lane)).iloc[0]
    assert (out["pack_no"], out["sample_keys"], list(out["input_ids"])) == (0, [1, 2], [8, 9, 5, 6, 7])
    assert lane.get == (1, [], [], [], [])


def test_stream_packs_equal_the_loop(spark, tmp_path):
    rng = np.random.default_rng(3)
    samples = [[[int(t) for t in rng.integers(2, 90, rng.integers(1, 9))] for _ in range(3)] for _ in range(60)]
    samples[20][2] = list(range(2, 60))
    schema = "sample_key long, slots array<array<int>>"
    for part in range(3):
        rows = [(i, samples[i]) for i in range(part * 20, part * 20 + 20)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    lanes = feed.withColumn("lane", lane_of(F.lit("g"), F.col("sample_key"), 2))
    config = PackConfig(eos_token_id=1, seq_length=40, max_samples=4, max_sample_length=None)
    sink = str(tmp_path / "out")
    run_available(pack_stream(lanes, config), str(tmp_path / "checkpoint"), sink)
    rows = spark.createDataFrame([(i,) for i in range(60)], "sample_key long")
    lane = {r["sample_key"]: r["lane"] for r in rows.withColumn("lane", lane_of(F.lit("g"), F.col("sample_key"), 2)).collect()}
    got = spark.read.parquet(sink).unionByName(open_packs(spark, str(tmp_path / "checkpoint"), config)).collect()
    arrival = [k for r in sorted(got, key=lambda r: r["pack_no"]) for k in r["sample_keys"]]
    assert sorted(arrival) == list(range(60))
    for name in set(lane.values()):
        keys = [k for k in range(60) if lane[k] == name]
        packs = sorted((r for r in got if r["lane"] == name), key=lambda r: r["pack_no"])
        assert [r["pack_no"] for r in packs] == list(range(len(packs)))
        # Files arrive in the order they were written.
        expected = [[keys[i] for i in p] for p in greedy([sum(map(len, samples[k])) for k in keys], 40, 4)]
        assert [list(r["sample_keys"]) for r in packs] == expected
        for r in packs:
            want = packed_row(samples, r["sample_keys"], 40, 3, 0)
            assert {k: r[k] for k in want} == want


@pytest.mark.parametrize("strategy", ["first_fit", "pool"])
def test_gaps_between_positions_change_nothing(spark, strategy):
    config = PackConfig(eos_token_id=1, seq_length=50, max_samples=4, strategy=strategy)
    got = []
    for step in (1, 4096):
        rows = [(i * step, 3 + i * 7 % 40) for i in range(200)]
        samples = spark.createDataFrame(rows, "pos long, n_tokens int").repartition(3)
        assigned = assign_by_strategy(samples, config, window_rows=64).collect()
        got.append(sorted((r["pos"] // step, r["pack_id"], r["sample_ord"]) for r in assigned))
    assert got[0] == got[1]
