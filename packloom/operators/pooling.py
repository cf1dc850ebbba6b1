"""Token vectors to sample vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.functions.arrays import bind, each_element
from packloom.functions.numbers import floor_div
from packloom.functions.vectors import zeros


def _last_of_batch(tokens: DataFrame, *keys: str) -> DataFrame:
    """Of ``keys, pos, vec`` (whole numbers and a vector), the row of the highest ``pos`` for each key and batch.

    Leaves out most vectors before anything is sorted or shuffled.
    """

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "pos")]
            order = np.lexsort(columns[::-1])
            ends = np.ones(len(order), bool)
            ends[:-1] = np.any([c[order[1:]] != c[order[:-1]] for c in columns[:-1]], axis=0)
            yield batch.take(pa.array(order[ends]))

    narrow = tokens.select(*keys, "pos", "vec").where(" AND ".join(f"{c} IS NOT NULL" for c in (*keys, "pos")))
    return narrow.mapInArrow(last, narrow.schema)


def last_token_vectors(
    tokens: DataFrame, max_samples: int, num_negatives: int = 1
) -> DataFrame:
    """``pack_id, segment_id, sample_id, slot, vec``: the vector of each segment's last token.

    ``tokens(pack_id, pos, segment_id, attended, vec)`` has one row per token. Padding, unattended
    tokens and segments past the sample cap take no part. What is compared and shuffled is one vector
    per segment and batch of tokens.
    """
    num_slots = 2 + num_negatives
    segment = F.col("segment_id")
    inside = (segment >= 0) & (segment < max_samples * num_slots) & F.col("attended").cast("boolean")
    return (
        _last_of_batch(tokens.where(inside), "pack_id", "segment_id")
        .groupBy("pack_id", "segment_id")
        .agg(F.max_by("vec", "pos").alias("vec"))
        .select(
            "pack_id",
            "segment_id",
            floor_div(segment, num_slots).cast("int").alias("sample_id"),
            F.pmod(segment, F.lit(num_slots)).alias("slot"),
            "vec",
        )
    )


def dropped_segments(tokens: DataFrame, max_samples: int, num_negatives: int = 1) -> DataFrame:
    """Segments past the sample cap, which pooling leaves out, per pack."""
    past = F.col("segment_id") >= max_samples * (2 + num_negatives)
    return tokens.where(past).groupBy("pack_id").agg(
        F.countDistinct("segment_id").alias("dropped_segments")
    )


def slot_grid(
    pooled: DataFrame, packs: DataFrame, max_samples: int, num_negatives: int, size: int
) -> DataFrame:
    """Every (sample, slot) of every pack: ``pack_id, sample_id, slot, vec, present``.

    Absent slots hold a zero vector.
    """
    num_slots = 2 + num_negatives
    cells = packs.select(
        "pack_id", F.explode(F.sequence(F.lit(0), F.lit(max_samples * num_slots - 1))).alias("segment_id")
    )
    found = pooled.select("pack_id", "segment_id", F.col("vec").cast("array<double>").alias("vec"))
    return cells.join(found, ["pack_id", "segment_id"], "left").select(
        "pack_id",
        floor_div("segment_id", num_slots).cast("int").alias("sample_id"),
        F.pmod("segment_id", F.lit(num_slots)).alias("slot"),
        F.coalesce("vec", zeros(size)).alias("vec"),
        F.col("vec").isNotNull().alias("present"),
    )


def last_position_vectors(tokens: DataFrame, masked: bool = False) -> DataFrame:
    """``pack_id, vec``: the vector at each row's last position.

    Padding counts as a position unless ``masked``.
    """
    kept = tokens.where(F.col("attended").cast("boolean")) if masked else tokens
    return _last_of_batch(kept, "pack_id").groupBy("pack_id").agg(F.max_by("vec", "pos").alias("vec"))


def mean_vectors(vectors: DataFrame, by: str, column: str = "vec") -> DataFrame:
    """``by, vec``: mean of each dimension over the rows of a group. Null vectors and entries do not count.

    Each batch of rows is summed to one vector per group before anything becomes a row per dimension.
    """
    kind = vectors.schema[by].dataType.simpleString()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("vec")))
            if not batch.num_rows:
                continue
            codes = batch.column("key").dictionary_encode(null_encoding="encode")
            group = codes.indices.to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(batch.column("vec")).to_numpy(zero_copy_only=False)
            values = batch.column("vec").flatten()
            known = values.is_valid().to_numpy(zero_copy_only=False)
            values = pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False)
            width, groups = int(sizes.max()), len(codes.dictionary)
            dim = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            cell = np.repeat(group, sizes) * width + dim
            sums = np.bincount(cell, values, groups * width).reshape(groups, width)
            counts = np.bincount(cell, known, groups * width).astype(np.int64).reshape(groups, width)
            lists = [pa.array(list(x), pa.list_(t)) for x, t in ((sums, pa.float64()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([codes.dictionary, *lists], ["key", "sums", "counts"])

    rows = vectors.select(F.col(by).alias("key"), F.col(column).cast("array<double>").alias("vec"))
    partial = rows.mapInArrow(add_up, f"key {kind}, sums array<double>, counts array<long>")
    dims = each_element(partial, F.arrays_zip("sums", "counts"), "key", position="dim", value="x")
    means = dims.groupBy("key", "dim").agg((F.sum("x.sums") / F.sum("x.counts")).alias("x")).where("x IS NOT NULL")
    ordered = F.sort_array(F.collect_list(F.struct("dim", "x")))
    return means.groupBy(F.col("key").alias(by)).agg(ordered.getField("x").alias("vec"))


def vector_stats(tokens: DataFrame, by: str, column: str = "vec") -> DataFrame:
    """Count of rows, and mean, population deviation, minimum and maximum over all their entries.

    A row is reduced to five numbers before it is grouped; deviations are taken around its own mean.
    """
    x = F.transform(F.filter(column, lambda v: v.isNotNull()), lambda v: v.cast("double"))
    zero = F.lit(0.0)

    def spread(values: Column) -> Column:
        mean = F.aggregate(values, zero, lambda a, v: a + v) / F.size(values)
        return bind(mean, lambda m: F.struct(m.alias("mean"), F.aggregate(values, zero, lambda a, v: a + (v - m) * (v - m)).alias("m2")))

    values = tokens.select(by, x.alias("x")).where(F.size("x") > 0)
    rows = values.select(
        by,
        F.size("x").cast("double").alias("n"),
        F.array_min("x").alias("low"),
        F.array_max("x").alias("high"),
        bind(F.col("x"), spread).alias("s"),
    )
    n, mean = F.col("n"), F.col("s.mean")
    grouped = rows.groupBy(by).agg(
        F.count("*").alias("n_valid"),
        F.sum(n).alias("n"),
        (F.sum(n * mean) / F.sum(n)).alias("mean"),
        F.sum(F.col("s.m2")).alias("m2"),
        F.sum(n * mean * mean).alias("square"),
        F.min("low").alias("min"),
        F.max("high").alias("max"),
    )
    between = F.greatest(F.col("square") - F.col("n") * F.col("mean") * F.col("mean"), zero)
    return grouped.select(by, "n_valid", "mean", F.sqrt((F.col("m2") + between) / F.col("n")).alias("std"), "min", "max")


def layer_sizes(size: int, out: int) -> list[int]:
    """Sizes halve from layer to layer until ``out`` is reached; the last one is ``out``.

    A vector that is small enough already keeps its size and passes through unchanged.
    """
    sizes = [size]
    while sizes[-1] > out:
        sizes.append(sizes[-1] // 2)
    return sizes[:-1] + [out] if len(sizes) > 1 else sizes


def gelu(x: np.ndarray, approximate: bool = True) -> np.ndarray:
    if approximate:
        return 0.5 * x * (1.0 + np.tanh(math.sqrt(2.0 / math.pi) * (x + 0.044715 * x**3)))
    return 0.5 * x * (1.0 + erf(x / math.sqrt(2.0)))


def erf(x: np.ndarray) -> np.ndarray:
    """Error function: its series with terms of one sign, as far as doubles can tell it from 1."""
    z = np.clip(np.abs(x), 0.0, 6.0)
    term = 2.0 / math.sqrt(math.pi) * z * np.exp(-z * z)
    total = term.copy()
    for n in range(1, 160):
        term = term * (2.0 * z * z / (2 * n + 1))
        total += term
    return np.copysign(np.minimum(total, 1.0), x)


# Model weights are a few layers of hidden-size matrices; more than this is not a projection head.
MAX_WEIGHT_BYTES = 256 << 20

Layer = tuple[np.ndarray, np.ndarray | None]


def project(
    vectors: DataFrame, layers: Sequence[Layer], column: str = "vec", approximate: bool = True
) -> DataFrame:
    """Replace each vector by its projection: linear layers with GELU between them.

    ``layers`` holds (matrix [in, out], bias [out] or ``None``). One matrix product per Arrow batch
    and layer.
    """
    weights = [(np.asarray(w, dtype=np.float64), None if b is None else np.asarray(b)) for w, b in layers]
    if sum(w.nbytes for w, _ in weights) > MAX_WEIGHT_BYTES:
        raise ValueError("projection weights are too large to send to every task")
    shared = vectors.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("array<double>")
    def forward(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        width = shared.value[0][0].shape[0]
        out = shared.value[-1][0].shape[1]
        for batch in batches:
            known = batch.is_valid().to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(batch).to_numpy(zero_copy_only=False)[known]
            if (sizes != width).any():
                raise ValueError(f"vectors of {width} entries are projected, found {sorted(set(sizes.tolist()))}")
            # flatten() leaves null vectors out; they stay null. Null entries would be NaN.
            x = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            for i, (matrix, bias) in enumerate(shared.value):
                x = x @ matrix if bias is None else x @ matrix + bias
                if i < len(shared.value) - 1:
                    x = gelu(x, approximate)
            offsets = np.append(0, np.cumsum(np.where(known, out, 0))).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()), mask=pa.array(~known))

    if not weights:
        return vectors
    return vectors.withColumn(column, forward(F.col(column)))
