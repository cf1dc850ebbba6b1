import json
import os

import pytest
from packloom.operators import quality, resume
from packloom.sources import jsonl, state
from packloom.sources.state import ResumeState
from packloom.sources.tables import save
from packloom.streaming.ingest import run_available, stream_triplets
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

EXTRAS = StructType([StructField("sample_id", LongType())])


def write(path, lines):
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


@pytest.fixture
def folder(tmp_path):
    """3 files x 10 samples, numbered over the files, with blank lines in between."""
    for file in range(3):
        lines = []
        for row in range(10):
            i = file * 10 + row
            lines.append(json.dumps({"anchor": f"a{i}", "positive": f"p{i}", "negative": f"n{i}", "sample_id": i}))
            if row % 4 == 1:
                lines.append("   ")
        write(tmp_path / f"data_{file:03d}.jsonl", lines)
    return str(tmp_path)


def read(spark, folder):
    lines = jsonl.with_positions(jsonl.read_lines(spark, folder + "/*.jsonl"))
    return jsonl.parse_triplets(lines, extras=EXTRAS)


def test_positions_shards_and_resume(spark, folder):
    rows = read(spark, folder)
    places = {r["sample_id"]: (r["shard_index"], r["row_index"], r["pos"]) for r in rows.collect()}
    assert places == {i: (i // 10, i % 10, i) for i in range(30)}
    lines = jsonl.read_lines(spark, folder + "/*.jsonl")
    names, index = jsonl.shard_names(lines), jsonl.index_splits(lines)
    assert len(names) == 3
    shards = jsonl.list_shards(index, names)
    assert [r["n_rows"] for r in shards.orderBy("shard_index").collect()] == [10, 10, 10]

    def ids(df):
        return sorted(r["sample_id"] for r in df.collect())

    assert ids(jsonl.select_shards(rows, [0, 2])) == [*range(10), *range(20, 30)]
    assert ids(resume.resume_from(rows, ResumeState(1, 5))) == list(range(15, 30))
    assert ids(resume.resume_from(rows, ResumeState(1, 5), 2, 3)) == list(range(23, 30))
    assert ids(resume.resume_from(rows, ResumeState(0, 10))) == list(range(10, 30))
    assert [r["shard_index"] for r in resume.shards_to_read(shards, ResumeState(0, 10)).collect()] == [1, 2]
    last = resume.emitted_progress(resume.resume_from(rows, ResumeState(1, 5))).first()
    assert (last["shard_index"], last["row_index"]) == (2, 10)


def test_positions_over_many_splits(spark, tmp_path):
    for file in range(3):
        write(tmp_path / f"f{file}.jsonl", [json.dumps({"anchor": "x" * (i % 37), "sample_id": file * 400 + i}) for i in range(400)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        lines = jsonl.read_lines(spark, str(tmp_path))
        assert lines.select("__block").distinct().count() > 5
        rows = jsonl.with_positions(lines).select("pos", F.get_json_object("value", "$.sample_id").cast("long").alias("i"))
        got = rows.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == 1200 and all(r["pos"] == r["i"] for r in got)


def test_empty_files_and_odd_names_count_as_shards(spark, tmp_path):
    for i, name in enumerate(["a 1.jsonl", "b[2]%20.jsonl", "c.jsonl", "d{x}*.jsonl"]):
        write(tmp_path / name, [json.dumps({"sample_id": i})] if i != 2 else [])
    lines = jsonl.read_lines(spark, str(tmp_path))
    names = jsonl.shard_names(lines)
    shards = jsonl.list_shards(jsonl.index_splits(lines), names).orderBy("shard_index").collect()
    assert [r["n_rows"] for r in shards] == [1, 1, 0, 1] and [r["shard_name"] for r in shards] == names
    rest = jsonl.with_positions(jsonl.read_lines(spark, jsonl.unread_files(names, 1)), first_shard=1)
    assert sorted((r["shard_index"], r["value"]) for r in rest.collect()) == [(1, '{"sample_id": 1}'), (3, '{"sample_id": 3}')]


def test_directory_search(spark, tmp_path):
    os.makedirs(tmp_path / "deep" / "er")
    write(tmp_path / "a.json", ['{"anchor": "1"}'])
    write(tmp_path / "deep" / "er" / "b.jsonl", ['{"anchor": "2"}'])
    write(tmp_path / "deep" / "c.txt", ['{"anchor": "3"}'])
    found = jsonl.read_lines(spark, str(tmp_path), recursive=True)
    assert sorted(r["value"] for r in found.collect()) == ['{"anchor": "1"}', '{"anchor": "2"}']


def test_negative_shapes(spark, tmp_path):
    lines = [
        {"anchor": "a", "positive": "p", "negative": "[not a list"},
        {"anchor": "a", "positive": "p", "negative": ["n1"]},
        {"anchor": "a", "positive": "p"},
        {"anchor": "a", "positive": "p", "negative": None},
        {"anchor": "a", "positive": "p", "negative": ""},
        {"anchor": "a", "positive": "p", "negative": ["x", "y"]},
    ]
    write(tmp_path / "x.jsonl", [json.dumps(line) for line in lines])
    positioned = jsonl.with_positions(jsonl.read_lines(spark, str(tmp_path)))
    got = [r["negatives"] for r in jsonl.parse_triplets(positioned).orderBy("pos").collect()]
    assert got == [["[not a list"], ["n1"], [""], None, None, ["x", "y"]]


def test_states(spark, tmp_path):
    start = state.initial_state(["train", "extra"])
    assert start.of_dataset() == ResumeState()
    assert start.of_dataset("other") is None
    moved = start.moved(2, 5, step=100)
    assert (moved.shard_index, moved.row_index, moved.step, moved.epoch) == (2, 5, 100, 0)
    assert moved.moved(3, 1).step == 100
    assert moved.stamped(7, 1).row_index == 5
    assert moved.rewound() == start
    path = str(tmp_path / "state")
    assert state.load_state(spark, path) is None
    state.save_state(spark, moved, path)
    state.save_state(spark, moved.stamped(101, 1), path)
    assert state.load_state(spark, path) == moved.stamped(101, 1)


def test_latest_checkpoint(spark, tmp_path):
    folder = str(tmp_path / "model")
    assert state.load_latest_checkpoint_state(spark, folder) is None
    for name, row in (("step-90", 1), ("step-100", 2), ("final", 3), ("run-9-of-200", 4)):
        state.save_checkpoint_state(spark, ResumeState(row_index=row), f"{folder}/{name}")
    assert state.load_latest_checkpoint_state(spark, folder).row_index == 2


def test_save_modes(spark, tmp_path):
    path = str(tmp_path / "table")
    save(spark.range(3), path)
    with pytest.raises(AnalysisException):
        save(spark.range(4), path)
    save(spark.range(4), path, overwrite=True)
    assert spark.read.parquet(path).count() == 4


def test_progress_loses_and_repeats_nothing(spark):
    # Pack 1 is an oversize sample that overtook pack 2, which began before it.
    rows = [(0, 0, 0), (0, 1, 0), (0, 2, 2), (0, 3, 1), (1, 0, 2), (1, 1, 3)]
    assigned = spark.createDataFrame(rows, "shard_index int, row_index long, pack_id long")
    assert tuple(resume.progress(assigned, 1).first()) == (0, 2, 0)
    assert tuple(resume.progress(assigned, 2).first()) == (0, 2, 1)
    assert tuple(resume.progress(assigned, 3).first()) == (1, 1, 0)
    assert tuple(resume.progress(assigned, 4).first()) == (None, None, 0)


def test_stream_goes_on_after_a_restart(spark, folder, tmp_path):
    sink, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    feed = str(tmp_path / "feed")
    os.makedirs(feed)

    def arrive(file):
        with open(f"{folder}/data_{file:03d}.jsonl") as f:
            write(f"{feed}/data_{file:03d}.jsonl", f.read().splitlines())

    arrive(0)
    run_available(stream_triplets(spark, feed, 1, extras=EXTRAS), checkpoint, sink)
    assert spark.read.parquet(sink).count() == 10
    arrive(1)
    arrive(2)
    sizes = []
    run_available(stream_triplets(spark, feed, 1, extras=EXTRAS), checkpoint, lambda rows, batch: sizes.append(rows.count()))
    assert sum(sizes) == 20 and len([n for n in sizes if n]) == 2


def test_quality_helpers(spark, folder):
    rows = read(spark, folder)
    expected = spark.range(1, 31).withColumnRenamed("id", "sample_id")
    problems = {r["sample_id"]: r["problem"] for r in quality.id_differences(expected, rows, "sample_id").collect()}
    assert problems == {30: "missing", 0: "unexpected"}
    seen = rows.agg(F.count("*").alias("n_seen"))
    assert quality.coverage(seen, 31).first()["accepted"]
    assert not quality.coverage(seen, 32).first()["accepted"]
    assert not quality.coverage(seen, 25, *quality.MULTI_FILE_COVERAGE).first()["accepted"]
    assert quality.shards_per_dataset(rows.withColumn("name", F.lit("train")), "name").first()["n_shards"] == 3


def test_places_do_not_depend_on_how_files_are_cut(spark, tmp_path):
    """Splits change between building the rows and reading them, as when executors come or go."""
    for file in range(2):
        write(tmp_path / f"f{file}.jsonl", [json.dumps({"anchor": "x" * (i % 37), "sample_id": file * 3000 + i}) for i in range(3000)])
    lines = jsonl.read_lines(spark, str(tmp_path))
    rows = jsonl.with_positions(lines).select("pos", F.get_json_object("value", "$.sample_id").cast("long").alias("i"))
    before = lines.select("__block").distinct().count()
    spark.conf.set("spark.sql.files.minPartitionNum", "40")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        assert jsonl.read_lines(spark, str(tmp_path)).select("__block").distinct().count() > before
        got = rows.collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == 6000 and all(r["pos"] == r["i"] for r in got)


def test_lines_of_any_white_space_are_no_rows(spark, tmp_path):
    write(tmp_path / "a.jsonl", ['{"sample_id": 0}', "\t \t", "　", "", '{"sample_id": 1}'])
    assert jsonl.read_lines(spark, str(tmp_path)).count() == 2


def test_a_line_is_parsed_once(spark, folder):
    parsed = read(spark, folder).where("anchor <> ''")
    lines = jsonl.read_lines(spark, folder + "/*.jsonl")
    plan = jsonl.parse_triplets(lines, extras=EXTRAS).where("anchor <> ''")._jdf.queryExecution().optimizedPlan().toString()
    assert parsed.count() == 30 and plan.count("from_json") <= 4


def test_newest_checkpoint_without_state(spark, tmp_path):
    folder = str(tmp_path / "model")
    state.save_checkpoint_state(spark, ResumeState(row_index=1), f"{folder}/step-5")
    os.makedirs(f"{folder}/step-7")
    write(f"{folder}/step-7/weights.bin", ["x"])
    assert state.load_latest_checkpoint_state(spark, folder) is None
    write(tmp_path / "broken", ["x"])
    assert state.load_state(spark, str(tmp_path / "nothing")) is None
