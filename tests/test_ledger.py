"""Micro-batches count once: replays, crashes between the halves, two runs of one batch."""

from packloom.streaming import ledger
from packloom.streaming.ingest import run_available


def rows_of(spark, numbers):
    return spark.createDataFrame([(n,) for n in numbers], "n long")


def test_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    sink = ledger.once(path, "a")
    assert ledger.read(spark, path, rows_of(spark, []).schema).count() == 0
    sink(rows_of(spark, [1, 2]), 0)
    sink(rows_of(spark, [3]), 1)
    sink(rows_of(spark, [1, 2]), 0)
    ledger.once(path, "b")(rows_of(spark, [4]), 0)
    got = sorted(tuple(r) for r in ledger.read(spark, path, rows_of(spark, []).schema).collect())
    assert got == [(1, "a", 0), (2, "a", 0), (3, "a", 1), (4, "b", 0)]


def test_crash_between_write_and_rename(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sink = ledger.once(path, "a")

    def crash(*_):
        raise RuntimeError("gone")

    with monkeypatch.context() as broken:
        broken.setattr(ledger, "rename_once", crash)
        try:
            sink(rows_of(spark, [1]), 0)
        except RuntimeError:
            pass
    assert ledger.read(spark, path, rows_of(spark, []).schema).count() == 0
    sink(rows_of(spark, [1]), 0)
    assert [r["n"] for r in ledger.read(spark, path, rows_of(spark, []).schema).collect()] == [1]


def test_same_batch_by_two_runs(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sink, write = ledger.once(path, "a"), ledger.write_batch

    def late(rows, folder):
        name = write(rows, folder)
        monkeypatch.setattr(ledger, "write_batch", write)
        sink(rows, 0)  # another run commits first
        return name

    monkeypatch.setattr(ledger, "write_batch", late)
    sink(rows_of(spark, [7]), 0)
    assert [r["n"] for r in ledger.read(spark, path, rows_of(spark, []).schema).collect()] == [7]
    assert not list((tmp_path / "t" / "writer=a").glob("_writing-*"))


def test_stream_without_its_checkpoint_adds_nothing(spark, tmp_path):
    for part in ([1, 2], [3]):
        rows_of(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("n long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for run in range(2):  # the second run has lost its checkpoint
        run_available(stream, str(tmp_path / f"checkpoint-{run}"), ledger.once(str(tmp_path / "t"), "a"))
    assert sorted(r["n"] for r in ledger.read(spark, str(tmp_path / "t"), stream.schema).collect()) == [1, 2, 3]
