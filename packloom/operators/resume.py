"""Reading on from a saved position, and finding the position to save."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.sources.state import ResumeState


def start_position(state: ResumeState, start_shard: int = 0, start_row: int = 0) -> tuple[int, int]:
    """An explicit start wins over the saved one, except (0, 0), which stands for "not given"."""
    if (start_shard, start_row) == (0, 0):
        return state.shard_index, state.row_index
    return start_shard, start_row


def at_or_after(shard: int | Column, row: int | Column) -> Column:
    later = F.col("shard_index") > shard
    return later | ((F.col("shard_index") == shard) & (F.col("row_index") >= row))


def resume_from(
    rows: DataFrame, state: ResumeState, start_shard: int = 0, start_row: int = 0
) -> DataFrame:
    """Rows not yet read: later shards, and the rest of the shard in progress."""
    return rows.where(at_or_after(*start_position(state, start_shard, start_row)))


def shards_to_read(shards: DataFrame, state: ResumeState) -> DataFrame:
    """Shards still holding unread rows, so that finished files are not even opened."""
    behind = F.col("shard_index") < state.shard_index
    finished = (F.col("shard_index") == state.shard_index) & (F.col("n_rows") <= state.row_index)
    return shards.where(~(behind | finished))


def progress(assigned: DataFrame, packs_done: int) -> DataFrame:
    """Where to go on after the first ``packs_done`` packs, as one row.

    ``shard_index, row_index``: first row of any pack not emitted yet, null when all are. Nothing
    before it is lost. ``already_packed`` counts later rows that were emitted all the same, as
    oversize samples that overtook the open pack; the next run skips these.
    """
    waiting = assigned.where(F.col("pack_id") >= packs_done)
    first = waiting.agg(F.min(F.struct("shard_index", "row_index")).alias("next")).first()["next"]
    if first is None:
        first = {"shard_index": None, "row_index": None}
    passed = (F.col("pack_id") < packs_done) & at_or_after(
        F.lit(first["shard_index"]), F.lit(first["row_index"])
    )
    return assigned.agg(F.count_if(F.coalesce(passed, F.lit(False))).alias("already_packed")).select(
        F.lit(first["shard_index"]).cast("int").alias("shard_index"),
        F.lit(first["row_index"]).cast("long").alias("row_index"),
        "already_packed",
    )


def emitted_progress(emitted: DataFrame) -> DataFrame:
    """Position after the last row read: the row following the highest one seen."""
    last = F.max(F.struct("shard_index", "row_index")).alias("last")
    return emitted.agg(last).select(
        F.col("last.shard_index").alias("shard_index"),
        (F.col("last.row_index") + 1).alias("row_index"),
    )
