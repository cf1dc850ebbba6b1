"""Exact top-k search by inner product over a pivot-distance index.

Each vector is keyed by its nearest pivot and its distance to it; vectors of like distance around a pivot
form an annulus, stored as blocks. For a query q and a block around pivot p with distances [low, high],
the triangle inequality gives |q - x| >= max(d(q, p) - high, low - d(q, p), 0), and with
2 q.x = |q|^2 + |x|^2 - |q - x|^2 an upper bound of every score in it. A first round expands the
annuli a query lies in; the k-th score found there stops most of the rest. All scores are whole numbers
and exact; bounds have slack for rounding. Components and scores beyond 64 bits are held at the largest or
smallest value, and rank by it.

Pivots are a sample of at most ``PIVOTS`` vectors (those with the smallest hash of their id). They shape
the index only, every vector is indexed and no result depends on them.

Defined cases: vectors that are null or hold a null, NaN or infinite component, and rows without id,
take no part. Shorter vectors count as filled up with zeros. A candidate with the query's id is the
query's own; further rows of one id are candidates of their own, and a query repeated with the same
vector is answered once. An empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.llm.common import begin, joinable, stage

PIVOTS = 64
BLOCK_ROWS = 1024
# Queries held by every task at once; further ones run as further passes over the index.
QUERIES = 4096
# Rows of one annulus that share a task when the index is built.
ANNULUS_ROWS = 50_000


_MOST = (1 << 63) - 1


def whole(vector: Column, factor: float) -> Column:
    """floor(factor * x) of each component as longs, within +-(2^63 - 1); null for vectors that take no part."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(fine, F.transform(x, lambda v: F.greatest(F.floor(v * F.lit(factor)).cast("long"), F.lit(-_MOST))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix, short rows filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float64), b.astype(np.float64)
    square = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as longs; by floating point where that is exact, and held within 64 bits."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if bound < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    scores = a @ b.T  # right modulo 2^64
    if bound >= 2.0**62:
        # Rounding of a sum of terms that may cancel: in doubt, whole numbers of any size decide.
        rough = a.astype(np.float64) @ b.astype(np.float64).T
        doubt = np.abs(rough) + bound * 2.0**-40 >= 2.0**63
        for i, j in np.argwhere(doubt):
            exact = sum(int(x) * int(y) for x, y in zip(a[i], b[j], strict=True))
            scores[i, j] = min(max(exact, -_MOST), _MOST)
    return scores


def build_index(vectors: DataFrame, pivots: int = PIVOTS, block: int = BLOCK_ROWS) -> tuple[DataFrame, np.ndarray]:
    """Blocks of ``vec_id, vec`` rows and the pivots; ``vec`` holds longs."""
    spark = begin(vectors)
    width = vectors.agg(F.max(F.size("vec"))).first()[0] or 0
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("vec").collect()
    centres = np.zeros((len(sample), width), np.int64)
    for row, x in zip(centres, sample, strict=True):
        row[: len(x["vec"])] = x["vec"]
    centres = np.unique(centres, axis=0)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"), width)
            far = _distances(x, centres)
            near = far.argmin(1) if len(centres) else np.zeros(len(x), np.int64)
            distance = far[np.arange(len(x)), near]
            norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
            columns = [batch.column("vec_id"), pa.array(near.astype(np.int32)), pa.array(distance), pa.array(norm), batch.column("vec")]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "pivot", "distance", "norm", "vec"])

    keyed = vectors.select("vec_id", "vec").mapInArrow(
        key, "vec_id long, pivot int, distance double, norm double, vec array<long>"
    )
    keyed = stage(keyed, "keyed")
    rows = keyed.count()
    # Annuli of about a block each; their bounds are a few numbers for each block of rows.
    rings = max(1, -(-rows // (block * max(len(centres), 1))))
    steps = F.array(*(F.lit(i / rings) for i in range(1, rings))) if rings > 1 else None
    if steps is not None:
        bounds = stage(keyed.groupBy("pivot").agg(F.percentile_approx("distance", steps, 10_000).alias("bounds")), "bounds")
        ring = F.size(F.filter("bounds", lambda b: b < F.col("distance")))
        keyed = keyed.join(F.broadcast(bounds), "pivot").withColumn("ring", ring).drop("bounds")
    else:
        keyed = keyed.withColumn("ring", F.lit(0))
    sizes = stage(keyed.groupBy("pivot", "ring").count(), "annuli")
    shares = F.ceil(F.col("count") / ANNULUS_ROWS).cast("int")
    dealt = keyed.join(joinable(sizes), ["pivot", "ring"]).withColumn("share", F.pmod(F.xxhash64("vec_id"), shares))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "pivot", "ring", "share").sortWithinPartitions("pivot", "ring", "distance")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, ring = batch.column("pivot").to_numpy(), batch.column("ring").to_numpy()
            cuts = np.flatnonzero((pivot[1:] != pivot[:-1]) | (ring[1:] != ring[:-1])) + 1
            found = []
            for first, last in zip([0, *cuts], [*cuts, len(pivot)], strict=True):
                for low in range(first, last, block):
                    part = batch.slice(low, min(block, last - low))
                    distance = part.column("distance").to_numpy()
                    norm = part.column("norm").to_numpy()
                    x = _matrix(part.column("vec"), width)
                    ids = part.column("vec_id").to_numpy()
                    found.append((pivot[low], distance.min(), distance.max(), norm.max(), ids.tobytes(), x.tobytes()))
            if found:
                kinds = [pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
                columns = [pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["pivot", "low", "high", "norm", "ids", "vecs"])

    blocks = dealt.select("vec_id", "pivot", "ring", "distance", "norm", "vec").mapInArrow(
        gather, "pivot int, low double, high double, norm double, ids binary, vecs binary"
    )
    return stage(blocks, "blocks"), centres


def _search(blocks: DataFrame, centres: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray, home: bool) -> DataFrame:
    """Best candidates of each task: ``query`` (row of ``x``), ``vec_id, score``. Scores below ``floor`` are of no use."""
    width = x.shape[1]
    shared = blocks.sparkSession.sparkContext.broadcast((centres, ids, x, floor))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, ids, x, floor = shared.value
        square = (x.astype(np.float64) ** 2).sum(1)
        far = _distances(x, centres)
        nearest = far.argmin(1)
        best = np.full((len(x), k), np.iinfo(np.int64).min)
        owner = np.full((len(x), k), np.iinfo(np.int64).max)
        filled = np.zeros(len(x), np.int64)
        limit = floor.copy()
        for batch in batches:
            pivot, low, high, norm = (batch.column(c).to_numpy() for c in ("pivot", "low", "high", "norm"))
            away = far[:, pivot]
            gap = np.maximum(np.maximum(away - high, low - away), 0)
            ceiling = np.minimum((square[:, None] + norm**2 - gap**2) / 2, np.sqrt(square)[:, None] * norm)
            ceiling += 1 + 1e-9 * (square[:, None] + norm**2)
            ceiling = np.maximum(ceiling, -(2.0**63))  # where scores are held
            inside = (nearest[:, None] == pivot) & (gap == 0) if home else None
            for j in np.argsort(-ceiling.max(0), kind="stable"):
                active = np.flatnonzero(inside[:, j] if home else ceiling[:, j] >= limit)
                if not len(active):
                    continue
                held = np.frombuffer(batch.column("ids")[int(j)].as_py(), np.int64)
                scores = _scores(x[active], np.frombuffer(batch.column("vecs")[int(j)].as_py(), np.int64).reshape(len(held), width))
                useful = (scores >= limit[active][:, None]) & (held != ids[active][:, None])
                for row in np.flatnonzero(useful.any(1)):
                    q, at = active[row], np.flatnonzero(useful[row])
                    s, o = np.append(best[q, : filled[q]], scores[row, at]), np.append(owner[q, : filled[q]], held[at])
                    order = np.lexsort((o, -s))[:k]
                    filled[q] = len(order)
                    best[q, : len(order)], owner[q, : len(order)] = s[order], o[order]
                    if len(order) == k:
                        limit[q] = max(limit[q], best[q, k - 1])
        kept = np.arange(k) < filled[:, None]
        rows = np.repeat(np.arange(len(x)), filled)
        columns = [pa.array(rows), pa.array(owner[kept]), pa.array(best[kept])]
        yield pa.RecordBatch.from_arrays(columns, ["query", "vec_id", "score"])

    return blocks.mapInArrow(expand, "query long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int = PIVOTS, block: int = BLOCK_ROWS) -> DataFrame:
    """Rows ``query_id, rank, vec_id, score`` for ``queries`` against ``vectors``, both ``vec_id, vec`` of longs.

    Highest scores first, ties to the smaller id. The queries pass through the driver in bounded batches.
    """
    spark = begin(vectors)
    blocks, centres = build_index(vectors, pivots, block)
    queries = stage(queries.select("vec_id", "vec").distinct(), "queries")
    batches = max(1, -(-queries.count() // QUERIES) * 2 - 1)
    results = None
    for number in range(batches):
        rows = queries.where(F.pmod(F.xxhash64("vec_id", "vec"), F.lit(batches)) == number).orderBy("vec_id", "vec").collect()
        width = max([centres.shape[1], *(len(r["vec"]) for r in rows)])
        x = np.zeros((len(rows), centres.shape[1]), np.int64)
        for row, r in zip(x, rows, strict=True):
            row[: len(r["vec"])] = r["vec"][: centres.shape[1]]
        ids = np.asarray([r["vec_id"] for r in rows], np.int64)
        floor = np.full(len(rows), np.iinfo(np.int64).min)
        if len(rows) and len(centres) and width:
            place = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
            first = _search(blocks, centres, ids, x, k, floor, home=True)
            # One score per query of this batch.
            kth = first.withColumn("rank", F.row_number().over(place)).where(F.col("rank") == k).select("query", "score")
            for r in kth.collect():
                floor[r["query"]] = r["score"]
            found = _search(blocks, centres, ids, x, k, floor, home=False)
            names = spark.createDataFrame(list(enumerate(ids.tolist())), "query long, query_id long")
            ranked = found.withColumn("rank", F.row_number().over(place).cast("int")).where(F.col("rank") <= k)
            ranked = ranked.join(F.broadcast(names), "query").select("query_id", "rank", "vec_id", "score")
            results = ranked if results is None else results.unionByName(ranked)
    if results is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return results
