"""Mixing sources to target weights by entropy balancing.

Each document gets a rate between 0 and ``cap``, as close as possible in entropy to taking and leaving
it evenly, such that the rates times the sizes of a source add up to its target. The solution tilts
every document's odds exponentially by its size, rate = cap / (1 + exp(-lambda * size / mean size)), with
one lambda per source that maximises a concave dual. Newton steps for all sources at once run as
aggregations over (source, size) counts. Rates are then rounded to whole copies so that the running
total of what is taken follows the running total of the rates.

Targets: sources ordered by code point, null last, weigh ``weights`` in turn and share ``share`` of all
sizes; a target stops at ``cap`` times its source's size, and the excess is shared again by weight among
the others until none is above.

Defined cases: a null text has size 0; a document of size 0 is not taken. A null source is a source. Repeated rows are documents of their own. An empty
table gives an empty result. Columns that clash with the added ones are replaced by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.llm.common import begin, fresh, joinable, stage, unique_ids
from packloom.operators.positions import dense_positions

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
# Documents that one rounding task takes in order.
GROUP_ROWS = 500
MAX_STEPS = 60
# Largest tilt; rates beyond it are 0 or the cap in double precision.
STEEPEST = 700.0


def count_words(text: Column) -> Column:
    """Runs without the bytes 0x20 and 0x09-0x0D; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Rows ``source, source_size, target`` of rows ``source, source_size``, one per source."""
    order = [F.col("source").isNull(), F.col("source")]
    numbered = dense_positions(sizes, *order, name="place")
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod("place", F.lit(len(weights))).cast("int"))
    rows = stage(numbered.select("source", "source_size", weight.alias("weight")), "weights")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    # A source is full once weight * level passes cap * size: the level rises until the rest fits.
    level, n = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > cap * F.col("source_size")
        held, open_weight, found = rows.agg(
            F.sum(F.when(full, cap * F.col("source_size")).otherwise(0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
            F.count_if(full),
        ).first()
        if found == n or not open_weight:
            break
        n, level = found, (share * total - held) / open_weight
    goal = F.when(full, (cap * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.lit(level))
    return rows.select("source", "source_size", goal.alias("target"))


def balance(counts: DataFrame, goals: DataFrame, cap: float = CAP, tolerance: float = 1e-9) -> DataFrame:
    """``source, tilt, mean`` solving the dual for ``source, size, count`` rows. Two short jobs a Newton step.

    Steps that leave the bracket of the solution halve it instead.
    """
    x = F.col("size") / F.col("mean")
    totals = counts.groupBy("source").agg((F.sum(F.col("size") * F.col("count")) / F.sum("count")).alias("mean"))
    state = goals.join(totals, goals["source"].eqNullSafe(totals["source"])).select(
        goals["source"],
        "mean",
        "target",
        # Half of all words at tilt 0. A source that is taken whole, or not at all, needs no tilt.
        F.when(F.col("target") >= cap * F.col("source_size"), STEEPEST).when(F.col("target") <= 0, -STEEPEST).otherwise(0.0).alias("tilt"),
        F.lit(-STEEPEST).alias("low"),
        F.lit(STEEPEST).alias("high"),
        ((F.col("target") >= cap * F.col("source_size")) | (F.col("target") <= 0)).alias("done"),
    )
    state = stage(state, "tilts")
    for _ in range(MAX_STEPS):
        if state.where("not done").isEmpty():
            break
        current = joinable(state.where("not done").withColumnRenamed("source", "__source"))
        rows = counts.join(current, counts["source"].eqNullSafe(F.col("__source")))
        odds = F.lit(1.0) / (1.0 + F.exp(-F.col("tilt") * x))
        words = F.col("size") * F.col("count")
        step = rows.groupBy("source").agg(
            F.sum(cap * odds * words).alias("taken"), F.sum(cap * odds * (1.0 - odds) * x * words).alias("slope")
        )
        step = step.withColumnRenamed("source", "__source")
        joined = state.join(step, state["source"].eqNullSafe(step["__source"]), "left")
        short = F.col("target") - F.col("taken")
        low = F.when(short > 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(short < 0, F.col("tilt")).otherwise(F.col("high"))
        moved = F.col("tilt") + short / F.col("slope")
        inside = (F.col("slope") > 0) & (moved > low) & (moved < high)
        near = F.abs(short) <= tolerance * F.col("target") + 1e-9
        state = joined.select(
            "source",
            "mean",
            "target",
            F.when(F.col("done") | near, F.col("tilt")).otherwise(F.when(inside, moved).otherwise((low + high) / 2)).alias("tilt"),
            F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"),
            F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"),
            (F.col("done") | near | (high - low < 1e-12)).alias("done"),
        )
        state = stage(state, "tilts")
    return state.select("source", "tilt", "mean")


def _group(groups: Column) -> Column:
    """The rounding group of a row. By size too: rows without id, or of one id, are not one group."""
    return F.pmod(F.xxhash64("doc_id", "size"), groups)


def mix(
    docs: DataFrame,
    size: Column,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
    *,
    source_column: str = "source",
    id_column: str = "doc_id",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Rows ``doc_id, source, size, source_size, target, rate, copies, taken``, and ``keep`` in a struct ``row``.

    Only narrow rows are shuffled unless ``keep`` names more. Equal rows may swap places, nothing else
    depends on where rows lie.
    """
    begin(docs)
    row = [F.struct(*(F.col(c) for c in keep)).alias("row")] if keep else []
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.col(source_column).cast("string").alias("source"), size.cast("long").alias("size"), *row
    )
    rows = stage(rows, "sizes")
    counts = stage(rows.groupBy("source", "size").count(), "counts")
    totals = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).cast("long").alias("source_size"), F.sum("count").alias("documents"))
    totals = stage(totals, "totals")
    goals = stage(targets(totals.select("source", "source_size"), weights, share, cap), "targets")
    tilts = balance(counts, goals, cap)
    parameters = stage(
        goals.join(tilts.withColumnRenamed("source", "s1"), goals["source"].eqNullSafe(F.col("s1")))
        .join(totals.select(F.col("source").alias("s2"), "documents"), goals["source"].eqNullSafe(F.col("s2")))
        .select(F.col("source").alias("__source"), "source_size", "target", "tilt", "mean", "documents"),
        "parameters",
    )
    rate = F.lit(float(cap)) / (1.0 + F.exp(-F.col("tilt") * F.col("size") / F.col("mean")))
    rate = F.when(F.col("tilt") >= STEEPEST, float(cap)).when(F.col("tilt") <= -STEEPEST, 0.0).otherwise(rate)
    # A hot source is rounded in groups by a hash of id and size; each ends within a word or two of its share.
    groups = F.greatest(F.ceil(F.col("documents") / GROUP_ROWS), F.lit(1))
    joined = rows.join(joinable(parameters), rows["source"].eqNullSafe(F.col("__source"))).select(
        "doc_id", "source", "size", "source_size", "target", rate.alias("rate"), _group(groups).alias("group"), *(["row"] if keep else [])
    )
    names = [c for c in joined.columns if c != "group"]

    def allot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; each group's running totals go on over batches."""
        key, wanted, taken = None, 0.0, 0.0
        for batch in batches:
            found = []
            for place in zip(*(batch.column(c).to_pylist() for c in ("source", "group", "size", "rate")), strict=True):
                if place[:2] != key:
                    key, wanted, taken = place[:2], 0.0, 0.0
                n, (size, rate) = 0, place[2:]
                wanted += size * rate
                if size:
                    n = min(max(int((wanted - taken) / size + 0.5), 0), cap)
                    taken += size * n
                found.append(n)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.int64())], [*names, "copies"])

    ordered = joined.repartition("source", "group").sortWithinPartitions("source", "group", F.desc("size"), "doc_id")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name != "group"]
    rounded = ordered.mapInArrow(allot, ", ".join([*kinds, "copies long"]))
    return rounded.withColumn("taken", F.col("copies") * F.col("size"))


def take(docs: DataFrame, size: Column, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, all columns; ``options`` as of ``mix``."""
    names = docs.columns
    id_column = options.get("id_column", "doc_id")
    key, times, nth = (fresh(name, docs) for name in ("__id", "__copies", "__nth"))
    if unique_ids(docs, id_column):
        copies = mix(docs, size, **options).where("copies > 0")
        copies = stage(copies.select(F.col("doc_id").alias(key), F.col("copies").cast("int").alias(times)), "copies")
        rows = docs.join(joinable(copies), docs[id_column] == F.col(key))
    else:
        rows = mix(docs, size, keep=tuple(names), **options).where("copies > 0")
        rows = rows.select("row.*", F.col("copies").cast("int").alias(times))
    rows = rows.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(times))))
    return rows.select(*(F.col(f"`{c}`") for c in names))
