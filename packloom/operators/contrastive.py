"""In-batch contrastive loss and retrieval metrics.

Every anchor of a batch meets every negative of the batch. The pairs are never rows: vectors are
grouped into blocks, two blocks meet in one matrix product, and only a few sums per anchor leave it.
A batch of any size is spread over as many block pairs as it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.functions.arrays import bind, each_element
from packloom.functions.vectors import dot, zeros

# Vectors on each side of a block pair, and anchors multiplied at a time.
BLOCK_VECTORS = 8192
SLICE_VECTORS = 128
# Fixed value: keeps averages over no samples at 0.
COUNT_EPSILON = 1e-8

_PARTIAL = (
    "batch_id long, sample_key string, temperature double, num_negatives int, "
    "pos_sim double, neg_max double, neg_lse double, neg_sum double"
)
_NO_SCORES = pa.schema(
    [
        ("batch_id", pa.int64()),
        ("sample_key", pa.string()),
        ("temperature", pa.float64()),
        ("num_negatives", pa.int32()),
        ("pos_sim", pa.float64()),
        ("neg_max", pa.float64()),
        ("neg_lse", pa.float64()),
        ("neg_sum", pa.float64()),
    ]
)


def sample_triples(
    vectors: DataFrame, num_negatives: int, size: int, require_all: bool = False
) -> DataFrame:
    """``batch_id, sample_key, anchor, positive, negatives`` of the samples that have an anchor.

    ``vectors(batch_id, sample_key, slot, vec)`` has one row per slot that is present. A missing
    positive or negative counts as a zero vector, or removes the sample with ``require_all``.
    """
    slots = F.map_from_entries(F.collect_list(F.struct("slot", F.col("vec").cast("array<double>"))))
    key = F.col("sample_key").cast("string").alias("sample_key")
    wide = vectors.groupBy("batch_id", key).agg(slots.alias("by_slot"))

    def slot(k: int) -> Column:
        return F.try_element_at("by_slot", F.lit(k))

    wide = wide.where(slot(0).isNotNull())
    if require_all:
        for k in range(1, 2 + num_negatives):
            wide = wide.where(slot(k).isNotNull())
    absent = zeros(size)
    return wide.select(
        "batch_id",
        "sample_key",
        slot(0).alias("anchor"),
        F.coalesce(slot(1), absent).alias("positive"),
        F.array(*[F.coalesce(slot(2 + i), absent) for i in range(num_negatives)]).alias("negatives"),
    )


def _matrix(vectors: pa.Table) -> np.ndarray:
    values = pc.list_flatten(vectors.column("vec").combine_chunks())
    return values.to_numpy(zero_copy_only=False).reshape(vectors.num_rows, -1)


def _block_product(temperatures: Sequence[float], counts: Sequence[int]) -> Callable:
    """For a block of anchors (ordinal -1) and one of negatives: maximum, log-sum-exp and sum per
    anchor."""

    def scores(anchors: pa.Table, similarity: np.ndarray, count: int) -> Iterator[pa.Table]:
        rows = anchors.num_rows
        top, total = similarity.max(axis=1), similarity.sum(axis=1)
        raised, work = similarity - top[:, None], np.empty_like(similarity)
        for temperature in temperatures:
            np.divide(raised, temperature, out=work)
            spread = np.exp(work, out=work).sum(axis=1)
            columns = {
                "batch_id": anchors.column("batch_id"),
                "sample_key": anchors.column("sample_key"),
                "temperature": np.full(rows, temperature),
                "num_negatives": np.full(rows, count, dtype=np.int32),
                "pos_sim": anchors.column("pos_sim"),
                "neg_max": top,
                "neg_lse": top / temperature + np.log(spread),
                "neg_sum": total,
            }
            yield pa.table(columns)

    def product(pair: pa.Table) -> pa.Table:
        is_anchor = pc.less(pair.column("ordinal"), 0)
        anchors, negatives = pair.filter(is_anchor), pair.filter(pc.invert(is_anchor))
        if not anchors.num_rows or not negatives.num_rows:
            return _NO_SCORES.empty_table()
        right = _matrix(negatives).T
        ordinal = negatives.column("ordinal").to_numpy()
        parts = []
        for begin in range(0, anchors.num_rows, SLICE_VECTORS):
            some = anchors.slice(begin, SLICE_VECTORS)
            similarity = _matrix(some) @ right
            for count in counts:
                used = ordinal < count
                if used.any():
                    parts += scores(some, similarity if used.all() else similarity[:, used], count)
        return pa.concat_tables(parts) if parts else _NO_SCORES.empty_table()

    return product


def _log_sum_exp(values: Column) -> Column:
    def shifted(values: Column) -> Column:
        def total(top: Column) -> Column:
            return top + F.ln(F.aggregate(values, F.lit(0.0), lambda so_far, x: so_far + F.exp(x - top)))

        return bind(F.array_max(values), total)

    return bind(values, shifted)


def _block_pairs(triples: DataFrame, sizes: DataFrame, num_negatives: int, block: int) -> DataFrame:
    """One row per vector and block pair it takes part in: block ``a`` of anchors, ``b`` of negatives.

    A vector goes to one block of its own side by hash, and meets every block of the other side. A
    batch up to the block size is a single pair.
    """

    def blocks(per_sample: int) -> Column:
        return F.ceil(F.col("n_anchors") * per_sample / F.lit(block)).cast("int")

    sides = F.array(
        F.struct(F.lit(-1).alias("ordinal"), F.col("anchor").alias("vec")),
        *[
            F.struct(F.lit(i).alias("ordinal"), F.col("negatives")[i].alias("vec"))
            for i in range(num_negatives)
        ],
    )
    placed = triples.join(sizes, "batch_id").withColumns(
        {"na": blocks(1), "nb": blocks(num_negatives), "pos_sim": dot("anchor", "positive")}
    )
    rows = each_element(placed, sides, "batch_id", "sample_key", "pos_sim", "na", "nb", value="v")
    is_anchor = F.col("v.ordinal") < 0
    own = F.pmod(F.xxhash64("sample_key", "v.ordinal"), F.when(is_anchor, F.col("na")).otherwise(F.col("nb")))
    other = F.sequence(F.lit(0), F.when(is_anchor, F.col("nb")).otherwise(F.col("na")) - 1)
    met = rows.select("*", own.cast("int").alias("own"), F.explode(other).alias("other"))
    return met.select(
        "batch_id",
        F.when(is_anchor, F.col("own")).otherwise(F.col("other")).alias("a"),
        F.when(is_anchor, F.col("other")).otherwise(F.col("own")).alias("b"),
        "v.ordinal",
        "v.vec",
        F.when(is_anchor, F.col("sample_key")).alias("sample_key"),
        F.when(is_anchor, F.col("pos_sim")).alias("pos_sim"),
    )


def anchor_scores(
    triples: DataFrame,
    num_negatives: int,
    temperatures: Sequence[float] = (1.0,),
    negative_counts: Sequence[int] | None = None,
    sizes: DataFrame | None = None,
    block: int = BLOCK_VECTORS,
) -> DataFrame:
    """One row per valid anchor, temperature and negative count: similarities and its loss.

    ``negative_counts`` uses the first k negatives of each sample for every k given; by default all.
    ``sizes(batch_id, n_anchors)`` saves counting the triples.
    """
    counts = [num_negatives] if negative_counts is None else list(negative_counts)
    if sizes is None:
        sizes = triples.groupBy("batch_id").agg(F.count("*").alias("n_anchors"))
    product = _block_product([float(t) for t in temperatures], counts)
    partial = (
        _block_pairs(triples, sizes, num_negatives, block)
        .groupBy("batch_id", "a", "b")
        .applyInArrow(product, _PARTIAL)
    )
    scored = partial.groupBy("batch_id", "sample_key", "temperature", "num_negatives").agg(
        F.max("pos_sim").alias("pos_sim"),
        F.max("neg_max").alias("neg_max"),
        # One entry per block of negatives.
        _log_sum_exp(F.collect_list("neg_lse")).alias("neg_lse"),
        F.sum("neg_sum").alias("neg_sum"),
    )
    logit = F.col("pos_sim") / F.col("temperature")
    return scored.withColumn("loss", _log_sum_exp(F.array(logit, F.col("neg_lse"))) - logit)


def batch_metrics(
    scores: DataFrame, batches: DataFrame, temperatures: Sequence[float] = (1.0,), negative_counts: Sequence[int] = (1,)
) -> DataFrame:
    """One row per batch, temperature and negative count: loss, accuracy and mean similarities.

    A tie between the positive and the best negative counts as right. A batch of ``batches`` without
    a valid sample has zeros.
    """
    grid = F.explode(
        F.flatten(
            F.array(*[F.array(*[F.struct(F.lit(float(t)).alias("temperature"), F.lit(int(k)).alias("num_negatives")) for k in negative_counts]) for t in temperatures])
        )
    )
    wanted = batches.select("batch_id").distinct().select("batch_id", grid.alias("g")).select("batch_id", "g.*")
    count = F.count("*")
    sums = scores.groupBy("batch_id", "temperature", "num_negatives").agg(
        count.alias("n"),
        F.sum("loss").alias("loss"),
        F.count_if(F.col("pos_sim") >= F.col("neg_max")).alias("right"),
        F.sum("pos_sim").alias("pos"),
        F.sum("neg_sum").alias("neg"),
    )
    n = F.coalesce(F.col("n"), F.lit(0)).cast("double")
    valid = n + COUNT_EPSILON

    def mean(total: str, over: Column = valid) -> Column:
        return F.coalesce(F.col(total), F.lit(0)).cast("double") / over

    return wanted.join(sums, ["batch_id", "temperature", "num_negatives"], "left").select(
        "batch_id",
        "temperature",
        "num_negatives",
        mean("loss").alias("loss"),
        mean("right").alias("accuracy"),
        valid.alias("valid_samples"),
        mean("pos").alias("pos_sim_mean"),
        mean("neg", n * n * F.col("num_negatives") + COUNT_EPSILON).alias("neg_sim_mean"),
    )


def infonce(
    vectors: DataFrame,
    num_negatives: int,
    size: int,
    temperatures: Sequence[float] = (1.0,),
    negative_counts: Sequence[int] | None = None,
    block: int = BLOCK_VECTORS,
) -> DataFrame:
    """Contrastive loss and metrics of every batch from ``vectors(batch_id, sample_key, slot, vec)``.

    The vectors are taken as they are; ``functions.vectors.normalize`` is a separate step.
    """
    counts = [num_negatives] if negative_counts is None else list(negative_counts)
    triples = sample_triples(vectors, num_negatives, size)
    # Anchors are counted without touching a vector.
    anchors = vectors.where(F.col("slot") == 0).groupBy(F.col("batch_id").cast("long").alias("batch_id"))
    sizes = anchors.agg(F.count("*").alias("n_anchors"))
    scores = anchor_scores(triples, num_negatives, temperatures, counts, sizes, block)
    return batch_metrics(scores, vectors, temperatures, counts)
