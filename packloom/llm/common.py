"""Helpers the operators of this subpackage share: tables, joins of checked size, words of raw bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.operators.positions import dense_positions
from packloom.workspace import ship_package, stage

__all__ = ["begin", "fresh", "joinable", "lean", "numbered", "sections", "stage", "table", "unique_ids", "word_spans"]

# Rows of two or three longs that may be broadcast: about 100 MB in an executor. Larger sides are joined by shuffle.
BROADCAST_ROWS = 2_000_000
# Bytes of text whose NumPy intermediates are alive at once.
SECTION_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def begin(df: DataFrame) -> SparkSession:
    """Make this package importable in the Python workers; the session of ``df``."""
    ship_package(df.sparkSession)
    return df.sparkSession


def joinable(staged: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``staged``, a narrow stored table, with a broadcast hint if it is counted to be within ``limit`` rows."""
    return F.broadcast(staged) if staged.count() <= limit else staged


def fresh(name: str, df: DataFrame) -> str:
    """``name``, with underscores put before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def unique_ids(df: DataFrame, id_column: str = "doc_id") -> bool:
    """True if no id is null or occurs twice. Shuffles the ids alone."""
    rows, ids = df.agg(F.count("*"), F.count_distinct(id_column)).first()
    return rows == ids


def numbered(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Distinct ``id, text`` rows with ``doc``: their places in the order of ids (null last), then texts.

    For tables whose ids are null or not unique; the numbers are unique, whatever an id occurs with.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).distinct()
    rows = dense_positions(rows, F.col("id").isNull(), F.col("id"), F.xxhash64("text"), F.col("text"), name="doc")
    return stage(rows.select("id", "text", F.col("doc").cast("long").alias("doc")), "numbered")


def lean(read: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``read`` of a mapInArrow, at whose end the worker gives back memory it only keeps for later.

    Workers go on from stage to stage; without this, each holds what the largest task so far needed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from read(batches)
        finally:
            _powers.clear()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string (UTF-8) or binary column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
    else:
        column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def sections(column: pa.Array, limit: int = SECTION_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch of texts into runs of whole rows of about ``limit`` bytes.

    Gives first row, last row + 1, their bytes and the offsets in these. A text longer than the limit
    is a run of its own.
    """
    data, offsets = text_bytes(column)
    first, n = 0, len(column)
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash, element by element."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_GOLDEN = 0x9E3779B97F4A7C15
# A random value for each byte, and an odd base with its inverse modulo 2^64.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_GOLDEN))
BASE = 0xD1342543DE82EF95
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2^64 for i up to n."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, 2 * SECTION_BYTES)
        for key, base in (("up", BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of byte values times powers; ``span_hash`` turns two of them into the hash of a span."""
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end): equal spans have equal hashes wherever they lie."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_GOLDEN))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without the bytes 0x20, 0x09-0x0D) of each text: starts, ends, and their row.

    A word never reaches over the end of its text.
    """
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = ~space
    begins[1:] &= space[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    begins[inner] = ~space[inner]
    starts = np.flatnonzero(begins)
    stops = space.copy()
    stops[inner] = True
    ends = np.append(np.flatnonzero(stops), len(data))
    # The first stop after a word's first byte; a stop on that byte itself is the boundary it starts at.
    ends = ends[np.searchsorted(ends, starts, side="right")]
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word, in order, and the row it belongs to."""
    starts, ends, rows = word_spans(data, offsets)
    return span_hash(prefix_hash(data), starts, ends), rows
