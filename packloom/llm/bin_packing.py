"""Best-fit packing: documents become token pieces, pieces fill sequences of fixed length.

Lengths are whole numbers up to the sequence length, so the packing itself is worked out on the count
of pieces per length. Pieces above a third of a sequence are matched greedily, two at most to a
sequence; the smaller ones go to the tightest gap that holds them. The counted plan is then dealt to
the pieces by their rank among the pieces of equal length.

Defined cases: a null or empty text is one piece of one id (the separator). Repeated rows are packed
as often as they occur. An empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packloom.llm.common import begin, joinable, stage
from packloom.llm.token_ids import encoder

# Pieces of one length are numbered in so many groups at least, and groups of about ROWS pieces.
SLOTS = 64
ROWS = 100_000


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    *,
    separator: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Rows ``doc_id, piece, start, length, ids_crc32``: each text's ids and the separator, cut at ``capacity`` ids."""
    begin(docs)
    end = np.asarray([separator], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, step = encoder(tokenizer), 4 * capacity
        for batch in batches:
            owner, found = [], []
            for row, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    owner.append(row)
                    found.append((piece, at // 4, len(part) // 4, zlib.crc32(part)))
            piece, start, length, crc = np.asarray(found, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(owner, pa.int64())),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(crc),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Pack ``counts[length]`` pieces of each length. Works on counts alone, never on single pieces.

    Rows (length, first rank, end rank, first sequence, offset, copies): pieces of this length with these
    ranks lie in consecutive sequences, ``copies`` of them in each, one after the other from ``offset``.
    """
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    left = {length: count for length, count in counts.items() if count > 0}
    rank: dict[int, int] = defaultdict(int)
    dealt: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs (first sequence, sequences)
    open_gaps = 0  # bit g: a run with gap g exists
    sequences = 0

    def deal(length: int, pieces: int, first: int, offset: int, copies: int = 1) -> None:
        if pieces:
            dealt.append((length, rank[length], rank[length] + pieces, first, offset, copies))
            rank[length] += pieces
            left[length] -= pieces

    def leave(gap: int, first: int, n: int) -> None:
        nonlocal open_gaps
        if n and gap:
            gaps[gap].append((first, n))
            open_gaps |= 1 << gap

    def tightest(length: int) -> int:
        """The smallest open gap of at least ``length``, or 0."""
        fitting = open_gaps >> length
        return length + (fitting & -fitting).bit_length() - 1 if fitting else 0

    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    fits = sum(1 << x for x in large)  # bit x: large pieces of length x are left
    for length in large:
        while left[length]:
            below = fits & ((1 << (min(capacity - length, length) + 1)) - 1)
            partner = below.bit_length() - 1
            if partner == length and left[length] == 1:
                partner = (below ^ 1 << length).bit_length() - 1
            n = left[length] if partner < 0 else left[length] // 2 if partner == length else min(left[length], left[partner])
            first, sequences = sequences, sequences + n
            deal(length, n, first, 0)
            if partner >= 0:
                deal(partner, n, first, length)
                if not left[partner]:
                    fits &= ~(1 << partner)
            leave(capacity - length - max(partner, 0), first, n)
        fits &= ~(1 << length)

    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[length]:
            gap = tightest(length)
            if gap:
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    open_gaps &= ~(1 << gap)
            else:
                gap, first, n = capacity, sequences, -(-left[length] // (capacity // length))
                sequences += n
            copies = gap // length
            full = min(n, left[length] // copies)
            deal(length, full * copies, first, capacity - gap, copies)
            leave(gap - copies * length, first, full)
            rest = min(left[length], copies) if full < n else 0
            deal(length, rest, first + full, capacity - gap, max(rest, 1))
            used = full + (rest > 0)
            leave(gap - rest * length, first + full, used - full)
            leave(gap, first + used, n - used)
    return dealt


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length``. Stored once; one shuffle of the narrow rows."""
    spark = begin(pieces)
    keys = [c for c in pieces.columns if c != "length"]
    pieces = stage(pieces, "pieces")
    slots = max(SLOTS, -(-pieces.count() // ROWS))
    pieces = pieces.withColumn("__slot", F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int"))
    sizes = stage(pieces.groupBy("length", "__slot").count(), "sizes")
    before = Window.partitionBy("length").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    places = stage(
        sizes.select("length", "__slot", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before")), "places"
    )
    # One row per length, so never more than the capacity.
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    dealt = np.asarray(plan(counts, capacity), np.int64).reshape(-1, 6)
    dealt = dealt[np.lexsort((dealt[:, 1], dealt[:, 0]))]
    shared = spark.sparkContext.broadcast(dealt)
    inside = Window.partitionBy("length", "__slot").orderBy(*keys)
    ranked = (
        pieces.withColumn("__rank", F.row_number().over(inside) - 1)
        .join(joinable(places), ["length", "__slot"])
        .withColumn("__rank", (F.col("__rank") + F.col("__before")).cast("long"))
        .drop("__slot", "__before")
    )
    names = [*pieces.columns[:-1], "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        if not len(table):
            return
        starts = table[:, 0] * (1 << 48) + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("__rank").to_numpy(zero_copy_only=False)
            _, low, _, first, offset, copies = table[np.searchsorted(starts, length * (1 << 48) + rank, side="right") - 1].T
            sequence, spot = np.divmod(rank - low, copies)
            columns = [batch.column(c) for c in names[:-2]]
            columns += [pa.array(first + sequence), pa.array(offset + spot * length)]
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "__slot")
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, **columns: str) -> DataFrame:
    """Token pieces of all documents with the sequence and the place they are packed to."""
    return pack(token_pieces(docs, tokenizer, capacity, **columns), capacity)
