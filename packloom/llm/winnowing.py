"""Document fingerprints by winnowing.

Every window of ``window`` consecutive k-gram hashes gives its smallest hash to the fingerprint, the
rightmost one on ties. Any text two documents share of at least ``window + k - 1`` characters therefore
leaves a common hash in both, and the positions say where.

Defined cases: a null text is empty. An empty text has an empty fingerprint; one shorter than a k-gram
has the hash of the whole text. Two empty fingerprints are alike (1.0), an empty and another are not
(0.0). Repeated rows are documents of their own, a null id comes last in descending order. An empty
table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.llm.common import begin, mix, powers

K = 16
WINDOW = 32
# Documents one range of ids holds; ranges are streamed, so this bounds no memory.
RANGE_ROWS = 20_000
_LOW = np.uint64(0xFFFFFFFF)


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Selected 32-bit hashes and their positions in code points, by position."""
    if not text:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    k = min(k, len(points))
    up, down = powers(len(points))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
    grams = mix((sums[k:] - sums[:-k]) * down[: len(sums) - k]) & ~_LOW
    # The smallest key of a window is its smallest hash and, among equals, the last position.
    keys = grams | (_LOW - np.arange(len(grams), dtype=np.uint64))
    width = min(window, len(keys))
    least = np.lib.stride_tricks.sliding_window_view(keys, width).min(axis=1)
    chosen = least[np.append(True, least[1:] != least[:-1])]
    return (chosen >> np.uint64(32)).astype(np.uint32), (_LOW - (chosen & _LOW)).astype(np.int32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def spelled(hashes: np.ndarray) -> str:
    """Eight hex digits for each hash."""
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(
    docs: DataFrame, k: int = K, window: int = WINDOW, *, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Rows ``doc_id, hashes, positions``."""
    begin(docs)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [winnow(text.as_py() or "", k, window) for text in batch.column(1)]
            hashes = pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64()))
            positions = pa.array([p for _, p in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), hashes, positions], ["doc_id", "hashes", "positions"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(read, f"doc_id {kind}, hashes array<long>, positions array<int>")


def in_descending_ranges(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Texts in descending order of integer ids, range by range, each range followed by a copy of the next one's first.

    Columns ``range, guest, doc_id, text``; a partition holds one range, sorted. After the last document
    comes a copy of the first. Bounds and first ids are one number per range.
    """
    least = -(1 << 63)
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(least)).alias("key"),
    )
    ids = rows.select("key")
    n = ids.count()
    wanted = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS))
    steps = [i / wanted for i in range(1, wanted)]
    cuts = sorted(set(ids.approxQuantile("key", steps, 0.25 / wanted))) if n else []
    finder = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="number", outputCol="found")

    def placed(df: DataFrame) -> DataFrame:
        if not cuts:
            return df.withColumn("range", F.lit(0))
        found = finder.transform(df.withColumn("number", F.col("key").cast("double")))
        return found.withColumn("range", F.col("found").cast("int")).drop("number", "found")

    firsts = sorted((r["range"], r["key"]) for r in placed(ids).groupBy("range").agg(F.max("key").alias("key")).collect())
    if not firsts:
        return rows.select(F.lit(0).alias("range"), F.lit(0).alias("guest"), "doc_id", "text")
    # The first id of a range follows the last one of the range above; the very first follows the very last.
    above = [r for r, _ in firsts[1:]] + [firsts[0][0]]
    guests = docs.sparkSession.createDataFrame(
        [(key, up) for (_, key), up in zip(firsts, above, strict=True)], "key long, up int"
    )
    own = F.struct(F.col("range"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("up").alias("range"), F.lit(1).alias("guest"))
    rows = placed(rows).join(F.broadcast(guests), "key", "left")
    rows = rows.withColumn("at", F.explode(F.when(F.col("up").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    return (
        rows.select("at.range", "at.guest", "doc_id", "key", "text")
        .repartitionById(firsts[-1][0] + 1, F.col("range"))
        .sortWithinPartitions("range", "guest", F.desc("key"), "text")
        .select("range", "guest", "doc_id", "text")
    )


def compare_with_next(
    docs: DataFrame, k: int = K, window: int = WINDOW, *, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to one another and to the next document.

    The edited text has its last floor(n/2) characters replaced by the first as many of the next document
    in descending order of ids (after the last: the first). One shuffle of the texts.
    """
    begin(docs)
    names = "doc_id n_chars edited_sha256 fingerprint positions edited_fingerprint near_edited near_next".split()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # (range, id, text, hashes, positions) of the row that waits for its next
        for batch in batches:
            found = []
            for part, guest, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kept is None and guest:
                    continue  # further copies of rows with a guest's id
                hashes, positions = winnow(text, k, window)
                if kept is not None:
                    _, doc, old, mine, places = kept
                    half = len(old) // 2
                    edited = old[: len(old) - half] + text[:half]
                    other, _ = winnow(edited, k, window)
                    found.append(
                        (
                            doc,
                            len(old),
                            hashlib.sha256(edited.encode()).hexdigest(),
                            spelled(mine),
                            places,
                            spelled(other),
                            likeness(mine, other),
                            likeness(mine, hashes),
                        )
                    )
                kept = None if guest else (part, key, text, hashes, positions)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(column), kind)
                        for column, kind in zip(
                            zip(*found, strict=True),
                            [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.float64(), pa.float64()],
                            strict=True,
                        )
                    ],
                    names,
                )

    kinds = "long long string string array<int> string double double".split()
    rows = in_descending_ranges(docs, id_column, text_column)
    return rows.mapInArrow(read, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
