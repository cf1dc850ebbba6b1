"""Opening data files at a row: a sparse index of byte offsets, and readers that seek.

``build_index`` reads the files once and keeps, for each block of some megabytes, the byte its first line
starts at and that line's number. ``open_at`` reads from a (shard, row) on: files before it are not opened, and
of its file nothing before the block that holds the row. ``stream_from`` is the same as a stream whose offsets
are (shard, row), so that it stops and goes on inside of a file, and shares its positions with ``ResumeState``.

Lines end with ``\\n`` or ``\\r\\n``; blank ones are not counted, as in ``jsonl.read_lines``. Paths may be local or of
any store that Arrow's file systems reach (``file``, ``s3``, ``gs``, ``hdfs``).
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from packloom.sources.jsonl import DATA_FILE_GLOB
from packloom.sources.state import ResumeState
from packloom.workspace import new_path

#: Bytes between two entries of an index, about.
BLOCK_BYTES = 8 << 20
# Bytes of blocks next to each other that one task reads.
TASK_BYTES = 128 << 20
# Bytes asked of a file at once.
CHUNK_BYTES = 1 << 20
# Fixed value: white space of any kind, as ``jsonl.not_blank`` has it.
WHITE = " \t\n\v\f\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))

LINES = "shard_index int, shard_name string, row_index long, value string"


def opened(path: str):
    """The file at a path or URI, for reading from anywhere in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file("/" + path[len("file:") :].lstrip("/"))
    if "://" not in path:
        return pafs.LocalFileSystem().open_input_file(path)
    store, inner = pafs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def lines_from(file, first: int, last: int | None = None, chunk: int = CHUNK_BYTES) -> Iterator[tuple[int, bytes]]:
    """First byte and content of the lines that start in [first, last), reading from ``first`` - 1 on.

    A line starts at byte 0 or after a line feed. Reading ends with the line that starts last.
    """
    at = max(first - 1, 0)
    file.seek(at)
    rest, begun = b"", first == 0
    while True:
        data = file.read(chunk)
        held = rest + data
        place = 0
        while (end := held.find(b"\n", place)) >= 0:
            if begun:
                if last is not None and at + place >= last:
                    return
                yield at + place, held[place:end].removesuffix(b"\r")
            begun, place = True, end + 1
        rest, at = held[place:], at + place
        if begun and last is not None and at >= last:
            return
        if not data:
            if begun and rest:
                yield at, rest.removesuffix(b"\r")
            return


def has_text(line: bytes) -> bool:
    return bool(line) and (line[0] > 32 or bool(line.decode("utf-8", "replace").strip(WHITE)))


def build_index(
    spark: SparkSession, paths: str | Sequence[str], path: str | None = None, *, recursive: bool = False, block: int = BLOCK_BYTES
) -> str:
    """Store the index of the files at ``path`` (by default, in the shared folder) and say where it is.

    One row per block: ``shard_index, shard_name, first_byte, end_byte, first_row, n_rows``; a file without lines has
    one. Blocks are counted by tasks of their own, however large a file is.
    """
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", DATA_FILE_GLOB)
    files = reader.load([paths] if isinstance(paths, str) else list(paths)).select(F.col("path").alias("shard_name"), "length")
    # Metadata: one row per file.
    files = files.withColumn("shard_index", (F.row_number().over(Window.orderBy("shard_name")) - 1).cast("int"))
    begins = F.sequence(F.lit(0).cast("long"), F.greatest("length", F.lit(1)) - 1, F.lit(block).cast("long"))
    blocks = files.select("shard_index", "shard_name", F.explode(begins).alias("first_byte"), "length")
    end = F.least(F.col("first_byte") + block, F.greatest("length", F.lit(1)))
    blocks = blocks.select("shard_index", "shard_name", "first_byte", end.alias("end_byte"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                with opened(row["shard_name"]) as file:
                    row["n_rows"] = sum(has_text(line) for _, line in lines_from(file, row["first_byte"], row["end_byte"]))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema(
        [("shard_index", pa.int32()), ("shard_name", pa.string()), ("first_byte", pa.int64()), ("end_byte", pa.int64()), ("n_rows", pa.int64())]
    )
    kinds = "shard_index int, shard_name string, first_byte long, end_byte long, n_rows long"
    counted = blocks.repartition("shard_name", "first_byte").mapInArrow(count, kinds)
    before = Window.partitionBy("shard_index").orderBy("first_byte").rowsBetween(Window.unboundedPreceding, -1)
    first_row = F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("first_row")
    path = path or new_path(spark, "line-index")
    counted.select("shard_index", "shard_name", "first_byte", "end_byte", first_row, "n_rows").write.parquet(path)
    return path


class _Range(InputPartition):
    """Rows [from_row, to_row) of a file; the line that starts at or after ``first_byte`` is row ``first_row``."""

    def __init__(self, shard_index: int, shard_name: str, first_byte: int, end_byte: int, first_row: int, from_row: int, to_row: int):
        self.shard_index, self.shard_name = shard_index, shard_name
        self.first_byte, self.end_byte = first_byte, end_byte
        self.first_row, self.from_row, self.to_row = first_row, from_row, to_row


def ranges(index: pa.Table, start: tuple[int, int], end: tuple[int, int] | None = None) -> list[_Range]:
    """What to read for the rows from ``start`` up to ``end``, both (shard, row): the blocks that hold any, joined for tasks."""
    found: list[_Range] = []
    rows = index.sort_by([("shard_index", "ascending"), ("first_byte", "ascending")])
    for row in rows.select(["shard_index", "shard_name", "first_byte", "end_byte", "first_row", "n_rows"]).to_pylist():
        shard = row["shard_index"]
        first, last = row["first_row"], row["first_row"] + row.pop("n_rows")
        if shard < start[0] or (end is not None and shard > end[0]):
            continue
        low = max(first, start[1]) if shard == start[0] else first
        high = min(last, end[1]) if end is not None and shard == end[0] else last
        if low >= high:
            continue
        before = found[-1] if found else None
        if before and (before.shard_index, before.end_byte) == (shard, row["first_byte"]) and row["end_byte"] - before.first_byte <= TASK_BYTES:
            before.end_byte, before.to_row = row["end_byte"], high
        else:
            found.append(_Range(**row, from_row=low, to_row=high))
    return found


def read_range(part: _Range, file=None) -> Iterator[tuple]:
    """Rows ``shard_index, shard_name, row_index, value`` of one range."""
    with file or opened(part.shard_name) as source:
        row = part.first_row
        for _, line in lines_from(source, part.first_byte, part.end_byte):
            if row >= part.to_row:
                return
            if has_text(line):
                if row >= part.from_row:
                    yield part.shard_index, part.shard_name, row, line.decode("utf-8", "replace")
                row += 1


class _Place:
    """An index, and the part of its files to read; by default up to the end of the last file."""

    def __init__(self, options: dict):
        place = lambda name: tuple(json.loads(options[name])) if name in options else None
        self.path, self.start, self.end = options["path"], place("start") or (0, 0), place("end")

    def index(self) -> pa.Table:
        import pyarrow.dataset as ds

        path = "/" + self.path[len("file:") :].lstrip("/") if self.path.startswith("file:") else self.path
        return ds.dataset(path, format="parquet").to_table()


class _Reader(DataSourceReader):
    def __init__(self, place: _Place):
        self.place = place

    def partitions(self) -> Sequence[InputPartition]:
        return ranges(self.place.index(), self.place.start, self.place.end)

    def read(self, partition: _Range | None) -> Iterator[tuple]:
        return read_range(partition) if partition is not None else iter(())  # None: nothing to read


class _StreamReader(DataSourceStreamReader):
    """Offsets are {"shard": ..., "row": ...}: the next row to read."""

    def __init__(self, place: _Place):
        self.place = place

    def initialOffset(self) -> dict:
        return {"shard": self.place.start[0], "row": self.place.start[1]}

    def latestOffset(self) -> dict:
        last = max(self.place.index()["shard_index"].to_pylist(), default=-1) + 1, 0
        shard, row = last if self.place.end is None else min(last, self.place.end)
        return {"shard": shard, "row": row}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return ranges(self.place.index(), (start["shard"], start["row"]), (end["shard"], end["row"]))

    def read(self, partition: _Range | None) -> Iterator[tuple]:
        return read_range(partition) if partition is not None else iter(())  # None: nothing to read


class LinesAt(DataSource):
    """Lines of indexed files. Options: ``path`` of the index, ``start`` and ``end`` as JSON lists [shard, row]."""

    @classmethod
    def name(cls) -> str:
        return "lines_at"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Place(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(_Place(self.options))


def _registered(spark: SparkSession) -> None:
    # Sent by value: the planner's and the executors' Python need not have this package.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(LinesAt)


def _options(reader, index: str, start: ResumeState | None, end: tuple[int, int] | None):
    reader = reader.format("lines_at").option("path", index)
    if start is not None:
        reader = reader.option("start", json.dumps([start.shard_index, start.row_index]))
    return reader if end is None else reader.option("end", json.dumps(list(end)))


def open_at(spark: SparkSession, index: str, start: ResumeState | None = None, end: tuple[int, int] | None = None) -> DataFrame:
    """``shard_index, shard_name, row_index, value`` from the state's position on, up to ``end`` (shard, row)."""
    _registered(spark)
    return _options(spark.read, index, start, end).load()


def state_at(spark: SparkSession, index: str, pos: int) -> ResumeState:
    """Where the line ``pos`` stands, counted over all files; behind the last file if there are fewer."""
    blocks = spark.read.parquet(index)
    order = Window.orderBy("shard_index", "first_byte").rowsBetween(Window.unboundedPreceding, -1)
    # Metadata: one row per block.
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n_rows").over(order), F.lit(0)))
    held = blocks.where((F.col("before") <= pos) & (F.col("before") + F.col("n_rows") > pos)).first()
    if held is None:
        return ResumeState((blocks.agg(F.coalesce(F.max("shard_index") + 1, F.lit(0))).first()[0]), 0)
    return ResumeState(held["shard_index"], held["first_row"] + pos - held["before"])


def stream_from(spark: SparkSession, index: str, start: ResumeState | None = None, end: tuple[int, int] | None = None) -> DataFrame:
    """As ``open_at``, as a stream. A query's checkpoint keeps its position; ``start`` counts for a new one only."""
    _registered(spark)
    return _options(spark.readStream, index, start, end).load()


def stream_state(spark: SparkSession, checkpoint: str) -> ResumeState:
    """The position after the last batch a query over ``stream_from`` has finished; the start if there is none."""
    done = spark.read.text(f"{checkpoint.rstrip('/')}/commits").select(_batch_number().alias("batch"))
    last = done.agg(F.max("batch")).first()[0]
    if last is None:
        return ResumeState()
    offsets = spark.read.text(f"{checkpoint.rstrip('/')}/offsets/{last}", wholetext=True).first()[0]
    place = json.loads(offsets.strip().splitlines()[-1])
    return ResumeState(place["shard"], place["row"])


def _batch_number():
    return F.regexp_extract("_metadata.file_name", r"^\d+$", 0).cast("long")
