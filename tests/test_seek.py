"""Opening files at a row: what is read, and streams and batches that share a position."""

import io
import json

import pytest
from packloom.sources import jsonl, seek
from packloom.sources.seek import build_index, lines_from, open_at, stream_from, stream_state
from packloom.sources.state import ResumeState
from packloom.streaming.ingest import run_available


class Counted(io.BytesIO):
    """A file that knows which bytes were read."""

    def __init__(self, data):
        super().__init__(data)
        self.first, self.total = None, 0

    def read(self, n=-1):
        at = self.tell()
        data = super().read(n)
        if data:
            self.first = at if self.first is None else min(self.first, at)
        self.total += len(data)
        return data


@pytest.fixture
def folder(tmp_path):
    """Three files: ordinary, with blank lines and carriage returns and no last line feed, and empty."""
    data = tmp_path / "data"
    data.mkdir()
    (data / "a.jsonl").write_text("".join(json.dumps({"anchor": f"a{i}", "fill": "x" * (i % 50)}) + "\n" for i in range(300)))
    lines = [json.dumps({"anchor": f"é{i}"}) + ("\r\n" if i % 3 else "\n\n  \n") for i in range(200)]
    (data / "b.jsonl").write_text("".join(lines).rstrip("\n"), newline="")
    (data / "c.jsonl").write_text("")
    return f"{data}"


@pytest.mark.parametrize("chunk", [1, 7, 4096])
@pytest.mark.parametrize("text", [b"", b"\n", b"one", b"one\ntwo\r\n\nthree", b"\n\nx\n"])
def test_ranges_share_out_the_lines(text, chunk):
    whole = [line for line in lines_from(io.BytesIO(text), 0, chunk=chunk)]
    assert [line for _, line in whole] == [x.removesuffix(b"\r") for x in text.split(b"\n")[: text.count(b"\n") + (not text.endswith(b"\n") and bool(text))]]
    for cut in range(len(text) + 1):
        parts = [*lines_from(io.BytesIO(text), 0, cut, chunk), *lines_from(io.BytesIO(text), cut, len(text), chunk)]
        assert parts == whole or cut == 0


def everything(spark, folder):
    lines = jsonl.with_positions(jsonl.read_lines(spark, folder, recursive=True))
    return sorted((r["shard_index"], r["row_index"], r["value"]) for r in lines.collect())


def found(frame):
    return sorted((r["shard_index"], r["row_index"], r["value"]) for r in frame.collect())


@pytest.mark.parametrize("block", [64, 1000, 1 << 20])
def test_open_at_equals_a_filtered_scan(spark, monkeypatch, folder, block):
    monkeypatch.setattr(seek, "TASK_BYTES", 20 * block)
    every = everything(spark, folder)
    index = build_index(spark, folder, recursive=True, block=block)
    assert found(open_at(spark, index)) == every
    for start, end in [((0, 250), None), ((1, 0), None), ((1, 77), None), ((2, 0), None), ((0, 10), (0, 11)), ((0, 290), (1, 5)), ((9, 0), None)]:
        want = [r for r in every if r[:2] >= start and (end is None or r[:2] < end)]
        assert found(open_at(spark, index, ResumeState(*start), end)) == want


def test_nothing_before_the_seek_is_read(spark, folder):
    import pyarrow.dataset as ds

    index = ds.dataset(build_index(spark, folder, recursive=True, block=500).removeprefix("file:"), format="parquet").to_table()
    parts = seek.ranges(index, (0, 250), (1, 0))
    assert [(p.shard_index, p.from_row, p.to_row) for p in parts] == [(0, 250, 300)]
    with open(f"{folder}/a.jsonl", "rb") as file:
        data = file.read()
    rows, total = [], 0
    for part in parts:
        counted = Counted(data)
        rows += [r[2] for r in seek.read_range(part, counted)]
        assert counted.first >= part.first_byte - 1
        total += counted.total
    assert rows == list(range(250, 300))
    starts = [i for i in range(len(data)) if i == 0 or data[i - 1 : i] == b"\n"]
    assert min(p.first_byte for p in parts) > starts[250] - 600


def test_stream_stops_inside_of_a_file_and_a_batch_goes_on(spark, folder, tmp_path):
    every = everything(spark, folder)
    index = build_index(spark, folder, recursive=True, block=300)
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    run_available(stream_from(spark, index, end=(0, 120)), checkpoint, out)
    assert stream_state(spark, checkpoint) == ResumeState(0, 120)
    run_available(stream_from(spark, index, end=(1, 33)), checkpoint, out)
    state = stream_state(spark, checkpoint)
    assert state == ResumeState(1, 33)
    streamed = found(spark.read.parquet(out))
    assert streamed == [r for r in every if r[:2] < (1, 33)]
    assert sorted(streamed + found(open_at(spark, index, state))) == every
    run_available(stream_from(spark, index), checkpoint, out)
    run_available(stream_from(spark, index), checkpoint, out)
    assert found(spark.read.parquet(out)) == every
