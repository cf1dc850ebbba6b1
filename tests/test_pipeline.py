import json

import pytest
from packloom.config import PackConfig
from packloom.functions.text import codepoints
from packloom.operators import quality
from packloom.operators.unpack import split_samples
from packloom.plans.pipeline import load_datasets, load_packed, read_rows, resume_packed
from packloom.sources.state import ResumeState
from reference_model import greedy, packed_row


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """5 files x 40 triplets in three length classes."""
    path = tmp_path_factory.mktemp("data")
    for file in range(5):
        with open(path / f"test_data_{file:03d}.jsonl", "w", encoding="utf-8") as f:
            for row in range(40):
                i = file * 40 + row
                n = (3, 17, 60)[i % 3]
                line = {"anchor": "a" * n, "positive": f"{i:04d}", "negative": "n" * (n // 2 + 1), "__source__": f"s{file}"}
                f.write(json.dumps(line) + "\n")
    return str(path)


def slots(i):
    n = (3, 17, 60)[i % 3]
    return [[97] * n + [1], [ord(c) for c in f"{i:04d}"] + [1], [110] * (n // 2 + 1) + [1]]


@pytest.mark.parametrize("resume,first", [(None, 0), (ResumeState(1, 5), 45), (ResumeState(1, 40), 80), (ResumeState(5, 0), 200)])
def test_files_to_packs(spark, folder, resume, first):
    config = PackConfig(eos_token_id=1, seq_length=256, max_samples=6, max_sample_length=200, shuffle=False)
    data = load_packed(spark, folder + "/*.jsonl", codepoints, config, resume)
    samples = [slots(i) for i in range(first, 200)]
    expected = greedy([sum(map(len, s)) for s in samples], 256, 6)
    rows = {r["pack_seq"]: r for r in data.packs.collect()}
    assert data.n_packs == len(rows) == len(expected)
    for number, members in enumerate(expected):
        want = packed_row(samples, members, 256, 3, 0)
        assert {k: rows[number][k] for k in want} == want
        assert rows[number]["source_ids"] == [f"s{(first + m) // 40}" for m in members]
    batches = data.batches(length=100, truncation_mode="keep_start").orderBy("batch_id").collect()
    assert len(batches) == len(expected) // 8
    if batches:
        assert batches[0]["input_ids"] == [rows[i]["input_ids"][:100] for i in range(8)]


@pytest.mark.parametrize("strategy", ["greedy", "first_fit", "pool"])
def test_every_strategy_gives_sound_packs(spark, folder, strategy):
    config = PackConfig(eos_token_id=1, seq_length=256, max_samples=6, max_sample_length=None, seed=42, strategy=strategy)
    data = load_packed(spark, folder, codepoints, config, recursive=True)
    packs = data.packs
    assert sorted(r["pack_seq"] for r in packs.select("pack_seq").collect()) == list(range(data.n_packs))
    assert quality.position_errors(packs).count() == 0
    order = quality.slot_order_errors(packs, 3)
    assert order.where("skipped_steps + missing_slots + overlapping_slots + broken_slots > 0").count() == 0
    assert quality.overlap_errors(packs, 3).where("overlaps > 0 OR NOT counts_agree").count() == 0
    assert quality.over_cap(packs, 6).count() == 0
    totals = quality.pack_totals(packs).first()
    assert totals["n_samples"] == 200
    assert totals["n_tokens"] == sum(len(s) for i in range(200) for s in slots(i))
    got = sorted(tuple(r["input_ids"]) for r in split_samples(packs, use_mask=True).collect())
    assert got == sorted(tuple(t for s in slots(i) for t in s) for i in range(200))


@pytest.mark.parametrize("shuffle", [True, False])
def test_resume_loses_and_repeats_nothing(spark, folder, tmp_path, shuffle):
    config = PackConfig(eos_token_id=1, seq_length=128, max_samples=6, max_sample_length=None, shuffle=shuffle, seed=7, batch_size=2)
    start = ResumeState(1, 5, epoch=3)
    data = load_packed(spark, folder + "/*.jsonl", codepoints, config, start)
    done = data.n_packs // 4
    state = data.state_after(done)
    assert (state.shard_index, state.row_index, state.step, state.epoch) == (1, 5, done, 3)
    again, skip = resume_packed(spark, folder + "/*.jsonl", codepoints, config, state)
    first = data.batches(drop_last=False).where(f"batch_id < {done}").collect()
    rest = again.batches(drop_last=False, skip=skip).collect()
    rows = [row for batch in first + rest for row in zip(batch["input_ids"], batch["segment_ids"], strict=True)]
    # A text's number is the second slot of its sample.
    numbers = []
    for ids, segments in rows:
        for s in sorted({x // 3 for x in segments if x >= 0}):
            numbers.append(int("".join(chr(t) for t, x in zip(ids, segments, strict=True) if x == 3 * s + 1 and t != 1)))
    assert sorted(numbers) == list(range(45, 200)) and len(first) == done


def test_shards_are_chosen_before_they_are_read(spark, folder):
    config = PackConfig(eos_token_id=1, seq_length=256, max_sample_length=None, shuffle=False)
    rows = read_rows(spark, folder, codepoints, config, recursive=True, shards=[3, 1, 9])
    places = sorted((r["shard_index"], r["row_index"]) for r in rows.select("shard_index", "row_index").collect())
    assert places == [(s, i) for s in (1, 3) for i in range(40)]


def test_every_line_has_an_outcome(spark, tmp_path):
    lines = [
        '{"anchor": "a", "positive": "p", "negative": "n"}',
        '{"anchor": "a", "positive": "p", "negative": ["n"]}',
        '{"anchor": "a", "positive": "p", "negative": [null]}',
        '{"anchor": "a", "positive": "p", "negative": ["n", "m"]}',
        '{"anchor": "a", "positive": "p"}',
        '{"anchor": "", "positive": "p", "negative": "n"}',
        '{"anchor": "a", "positive": "p", "nega',
        '{"anchor": "aaaaaaaaaaaa", "positive": "p", "negative": "n"}',
    ]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    config = PackConfig(eos_token_id=1, seq_length=64, max_sample_length=12, shuffle=False)
    data = load_packed(spark, str(tmp_path), codepoints, config)
    got = {r["outcome"]: r["n_rows"] for r in data.rejects.collect()}
    assert got == {"sample": 3, "null_negative": 1, "negative_count": 1, "empty_field": 1, "corrupt_line": 1, "too_long": 1}
    assert data.samples.count() == 3


def test_several_datasets(spark, folder):
    config = PackConfig(eos_token_id=1, seq_length=256, max_sample_length=None, shuffle=False)
    state = ResumeState(dataset_states={"b": {"shard_index": 0, "row_index": 30, "step": 0, "epoch": 0}})
    files = {"a": folder + "/test_data_000.jsonl", "b": folder + "/test_data_001.jsonl"}
    data = load_datasets(spark, files, codepoints, config, state)
    assert {name: d.samples.count() for name, d in data.items()} == {"a": 40, "b": 10}
