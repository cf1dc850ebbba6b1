import hashlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from packloom.config import PackConfig
from packloom.operators.assembly import SLICE_TOKENS, _build_rows, _cut_stream, _place_stream, assemble_packs, assign_packs, pack_samples, pad_packs
from packloom.operators.packing import CHUNK_TOKENS, compose_units, plan_packs, route, rows_per_chunk, summarise_chunk, walk_units
from packloom.plans.flows import document_samples, joined
from packloom.workspace import stage
from reference_model import greedy, packed_row


def starts_by_plan(sizes, length, cap, chunk_rows, fan_in):
    """Pack starts found through the chunk summaries alone, without Spark."""
    frame = pd.DataFrame({"pos": range(len(sizes)), "n_tokens": sizes})
    frame["chunk"] = frame["pos"] // chunk_rows
    leaf = pd.concat([summarise_chunk(c, length, cap) for _, c in frame.groupby("chunk")])
    parents = pd.concat([compose_units(u, length, cap, fan_in) for _, u in leaf.groupby(leaf["unit"] // fan_in)])
    entry = {"used": length, "held": cap, "packs_before": 0, "over_before": 0, "home": -1}
    direct = {s["unit"]: (s["used"], s["held"], s["packs_before"], s["over_before"], s["home"])
              for s, _ in walk_units(leaf, entry, length, cap)}
    by_tree = {}
    for state, _ in walk_units(parents, entry, length, cap):
        unit = state.pop("unit")
        below = leaf[leaf["unit"] // fan_in == unit]
        for s, _ in walk_units(below, state, length, cap):
            by_tree[s["unit"]] = (s["used"], s["held"], s["packs_before"], s["over_before"], s["home"])
    assert direct == by_tree
    return direct


@pytest.mark.parametrize("seed", range(60))
def test_chunk_summaries_follow_the_sequential_rule(seed):
    rng = random.Random(seed)
    length, cap = rng.randint(4, 60), rng.choice([1, 2, 5, 9, 10**6])
    chunk_rows, fan_in = rng.choice([1, 3, 7, 16]), rng.choice([2, 3, 5])
    sizes = [rng.randint(1, rng.choice([3, length, length + 5])) for _ in range(rng.randint(1, 200))]
    states = starts_by_plan(sizes, length, cap, chunk_rows, fan_in)
    for chunk, (used, held, packs, over, home) in states.items():
        before = sizes[: chunk * chunk_rows]
        normal = [s for s in before if s <= length]
        packs_now = greedy(normal, length, cap)
        assert packs == len(packs_now)
        assert over == len(before) - len(normal)
        if packs_now:
            assert (used, held) == (sum(normal[i] for i in packs_now[-1]), len(packs_now[-1]))


CASES = [(0, 40, 5, 3, 2), (1, 25, 10**6, 4, 2), (2, 10, 1, 8, 64), (3, 60, 9, 2, 3), (4, 16, None, 1, 4)]


@pytest.mark.parametrize("seed,length,cap,chunk_rows,fan_in", CASES)
def test_packs_equal_the_sequential_rule(spark, seed, length, cap, chunk_rows, fan_in):
    rng = random.Random(seed)
    data = []
    for i in range(120):
        slots = [[rng.randint(1, 99) for _ in range(rng.randint(0 if k else 1, max(1, length // 4)))] for k in range(3)]
        if rng.random() < 0.08:
            slots[1] = list(range(1, length + rng.randint(1, 9)))
        data.append((1000 + i * rng.choice([1, 1]) , slots, rng.choice(["a", "b", "", None])))
    rows = [(p, sum(map(len, s)), s, src) for p, s, src in data]
    schema = "pos long, n_tokens int, slots array<array<int>>, source_id string"
    samples = stage(spark.createDataFrame(rows, schema), "samples")
    config = PackConfig(eos_token_id=1, seq_length=length, max_samples=cap, max_sample_length=None)
    plan = plan_packs(samples, config, chunk_rows=chunk_rows, fan_in=fan_in)
    expected = greedy([r[1] for r in rows], length, cap or 10**6)
    assert plan.n_packs == len(expected)

    assigned = {r["pos"]: (r["pack_id"], r["sample_ord"]) for r in assign_packs(samples, plan).collect()}
    assert assigned == {rows[i][0]: (p, o) for p, members in enumerate(expected) for o, i in enumerate(members)}

    packs = {r["pack_id"]: r.asDict() for r in pad_packs(assemble_packs(samples, plan), config).collect()}
    assert sorted(packs) == list(range(len(expected)))
    for pack_id, members in enumerate(expected):
        want = packed_row([r[2] for r in rows], members, length, 3, 0)
        got = packs[pack_id]
        assert {k: got[k] for k in want} == want
        assert got["source_ids"] == ([rows[i][3] for i in members if rows[i][3]] or None)


def test_small_arrow_batches_and_few_partitions(spark):
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 30, 3000)
    sizes[rng.random(3000) < 0.02] = 900
    rows = [(int(i), int(n), [[7] * int(n), [], []]) for i, n in enumerate(sizes)]
    samples = stage(spark.createDataFrame(rows, "pos long, n_tokens int, slots array<array<int>>"), "samples")
    config = PackConfig(eos_token_id=1, seq_length=256, max_samples=20, max_sample_length=None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        plan = plan_packs(samples, config, chunk_rows=500)
        got = assign_packs(samples.drop("slots"), plan).collect()
        packs = assemble_packs(samples, plan).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = greedy(sizes.tolist(), 256, 20)
    want = {i: (p, o) for p, members in enumerate(expected) for o, i in enumerate(members)}
    assert {r["pos"]: (r["pack_id"], r["sample_ord"]) for r in got} == want
    assert {r["pack_id"]: r["num_segments"] for r in packs} == {p: len(m) for p, m in enumerate(expected)}


def test_packs_across_many_chunks_and_long_oversize_runs(spark):
    sizes = [1] * 400 + [999] * 300 + [1] * 5 + [500] + [3] * 200
    rows = list(enumerate(sizes))
    samples = stage(spark.createDataFrame(rows, "pos long, n_tokens int"), "samples")
    config = PackConfig(eos_token_id=1, seq_length=256, max_samples=None, max_sample_length=None)
    plan = plan_packs(samples, config, chunk_rows=5, fan_in=6)
    expected = greedy(sizes, 256, 10**6)
    got = {r["pos"]: (r["pack_id"], r["sample_ord"]) for r in assign_packs(samples, plan).collect()}
    assert got == {i: (p, o) for p, members in enumerate(expected) for o, i in enumerate(members)}
    # No destination holds more than a chunk and the rest of its last pack.
    largest = route(samples, plan).groupBy("home").count().agg({"count": "max"}).first()[0]
    assert largest <= 5 + 256


def test_gaps_and_large_positions(spark):
    base = (1 << 60) + 12345
    sizes = [7, 9, 30, 2, 2, 2, 50, 1, 8, 8, 8]
    rows = [(base + i * i * 1000, n) for i, n in enumerate(sizes)]
    samples = stage(spark.createDataFrame(rows, "pos long, n_tokens int"), "samples")
    config = PackConfig(eos_token_id=1, seq_length=40, max_samples=3, max_sample_length=None)
    got = {r["pos"]: r["pack_id"] for r in assign_packs(samples, plan_packs(samples, config)).collect()}
    assert got == {rows[i][0]: p for p, members in enumerate(greedy(sizes, 40, 3)) for i in members}


def test_empty_input(spark):
    samples = spark.createDataFrame([], "pos long, n_tokens int, slots array<array<int>>")
    assert pack_samples(samples, PackConfig(eos_token_id=1, seq_length=8)).collect() == []


def test_chunk_count_is_bounded():
    for span in (1, 10**4, 10**8, 10**12, 1 << 62):
        for cores in (1, 8, 10_000):
            assert -(-span // rows_per_chunk(span, cores)) <= 1 << 18


def test_what_a_worker_holds_does_not_grow_with_its_batch():
    n, size = 3000, 900
    slots = pa.array([[[5] * size, [6], []]] * n, pa.list_(pa.list_(pa.int32())))
    columns = {"pos": range(n), "n_tokens": [size + 1] * n, "home": [0] * n, "packs_before": [0] * n, "over_before": [0] * n, "close_over": [0] * n}
    batch = pa.RecordBatch.from_arrays(
        [*map(pa.array, map(list, columns.values())), slots, pa.nulls(n, pa.string())], names=[*columns, "slots", "source_id"]
    )
    given = list(_cut_stream(_build_rows(3), 4096, 8)(iter([batch])))
    assert max(len(out.column("input_ids").flatten()) for out in given) <= SLICE_TOKENS + 4096
    assert sum(len(out.column("input_ids").flatten()) for out in given) == n * (size + 1)
    assert [k for out in given for k in out.column("pack_id").to_pylist()] == list(range(n // 4))


def test_chunks_and_partitions_follow_the_tokens(spark):
    assert rows_per_chunk(1 << 20, 4, (1 << 20) * 8192) * 8192 <= CHUNK_TOKENS
    rows = [(i, 1 << 17) for i in range(1500)]
    samples = stage(spark.createDataFrame(rows, "pos long, n_tokens int"), "samples")
    config = PackConfig(eos_token_id=1, seq_length=1 << 17, max_samples=None, max_sample_length=None)
    routed = route(samples, plan_packs(samples, config))
    assert routed.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert routed.groupBy("home").count().agg({"count": "max"}).first()[0] * (1 << 17) <= 2 * CHUNK_TOKENS


def test_digests_leave_out_null_entries(spark):
    values = [[3, None, -1], [], None, [None], [7], [1, 2, 30]]
    rows = spark.createDataFrame([(v,) for v in values], "v array<int>")
    got = [r["d"] for r in rows.select(joined("v").alias("d")).collect()]
    texts = [None if v is None else ",".join(str(x) for x in v if x is not None) for v in values]
    assert got == [None if t is None else hashlib.md5(t.encode()).hexdigest() for t in texts]


@pytest.mark.parametrize("seed", range(20))
def test_places_do_not_depend_on_how_numbers_are_cut_into_batches(seed):
    random = np.random.default_rng(seed)
    n, length, cap = 400, 20, int(random.integers(1, 6))
    home, size = np.sort(random.integers(0, 4, n)), random.integers(1, 26, n)
    size[np.searchsorted(home, range(4))] = 1  # a home's first pack ends the one before
    n_over = [int((size[home == h] > length).sum()) for h in range(4)]
    numbers = [home, home * 1000, np.cumsum([0, *n_over])[home], np.cumsum(n_over)[home], size]
    cuts = [0, *np.sort(random.integers(0, n, 9)), n]
    batches = [tuple(pa.array(c[a:b]) for c in numbers) for a, b in zip(cuts[:-1], cuts[1:])]
    got = [(r["pack_id"], r["sample_ord"]) for out in _place_stream(length, cap)(iter(batches)) for r in out.to_pylist()]

    want = [None] * n
    for h in range(4):
        packs, over, open_rows, used = h * 1000, sum(n_over[:h]), [], 0
        for i in [*np.flatnonzero(home == h), None]:
            if i is not None and size[i] > length:
                want[i], over = (packs + over, 0), over + 1
                continue
            if i is None or not open_rows or used + size[i] > length or len(open_rows) == cap:
                for k, row in enumerate(open_rows):
                    want[row] = (packs + over, k)
                packs, open_rows, used = packs + bool(open_rows), [], 0
            if i is not None:
                open_rows, used = [*open_rows, i], used + size[i]
    assert got == want


def test_no_tokens_go_to_workers_and_samples_move_once(spark):
    rows = [(i, 3, [[5], [6], [7]]) for i in range(100)]
    samples = stage(spark.createDataFrame(rows, "pos long, n_tokens int, slots array<array<int>>"), "samples")
    config = PackConfig(eos_token_id=1, seq_length=8, max_sample_length=None)
    packs = assemble_packs(samples, plan_packs(samples, config))
    plan = packs._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
    sent = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert len(sent) == 1 and "slots" not in sent[0]
    assert plan.count("Exchange hashpartitioning") == 2  # the numbers, and the samples
    assert "slots" in plan.split("Exchange hashpartitioning")[1]
    assert packs.count() == 50


def test_documents_are_stored_as_texts_with_the_sizes_of_their_tokens(spark, tmp_path):
    texts = ["plain words", "é \U0001f469‍\U0001f52c", "\n\t \x00end", "x" * 10_000, "مرحبا", "last"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(3 * i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    samples = document_samples(spark, str(tmp_path))
    got = {r["doc_id"]: r for r in samples.collect()}
    assert sorted(got) == [0, 3, 6, 9]
    for i in range(4):
        assert got[3 * i]["slots"] == [[*map(ord, t), 1] for t in texts[i : i + 3]]
        assert got[3 * i]["n_tokens"] == sum(len(t) + 1 for t in texts[i : i + 3])
    # A reader's batch of nested arrays of whole texts does not fit an executor; lengths are read without the texts.
    stored = spark.read.parquet(*samples.inputFiles())
    assert not any("array<array" in kind for _, kind in stored.dtypes)
    lengths = samples.select("pos", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "anchor" not in lengths.split("ReadSchema")[1]
