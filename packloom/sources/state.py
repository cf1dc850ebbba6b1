"""Resume states: where reading stands, kept as small tables next to the checkpoints."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

STATE_SCHEMA = (
    "shard_index int, row_index long, step int, epoch int, dataset_states map<string, "
    "struct<shard_index: int, row_index: bigint, step: int, epoch: int>>"
)


@dataclass(frozen=True)
class ResumeState:
    """The next row to read, and the training step and epoch it belongs to."""

    shard_index: int = 0
    row_index: int = 0
    step: int = 0
    epoch: int = 0
    dataset_states: dict[str, dict[str, int]] = field(default_factory=dict)

    def moved(
        self, shard_index: int, row_index: int, step: int | None = None, epoch: int | None = None
    ) -> "ResumeState":
        """The state at a new position; step and epoch stay unless given."""
        return replace(
            self,
            shard_index=shard_index,
            row_index=row_index,
            step=self.step if step is None else step,
            epoch=self.epoch if epoch is None else epoch,
        )

    def stamped(self, step: int, epoch: int = 0) -> "ResumeState":
        return replace(self, step=step, epoch=epoch)

    def rewound(self) -> "ResumeState":
        """Start of the data again, keeping what is known about each dataset."""
        return ResumeState(dataset_states=self.dataset_states)

    def of_dataset(self, name: str | None = None) -> "ResumeState | None":
        """State of one named dataset, the first one by default, ``None`` if there is none."""
        if name is None:
            name = next(iter(self.dataset_states), None)
        own = self.dataset_states.get(name)
        return None if own is None else ResumeState(**own)


def initial_state(datasets: list[str]) -> ResumeState:
    zero = {"shard_index": 0, "row_index": 0, "step": 0, "epoch": 0}
    return ResumeState(dataset_states={name: dict(zero) for name in datasets})


def save_state(spark: SparkSession, state: ResumeState, path: str) -> None:
    row = (state.shard_index, state.row_index, state.step, state.epoch, state.dataset_states)
    frame = spark.createDataFrame([row], STATE_SCHEMA)
    frame.coalesce(1).write.mode("overwrite").json(path)


def _state(row) -> ResumeState:
    states = {k: v.asDict() for k, v in (row["dataset_states"] or {}).items()}
    return ResumeState(row["shard_index"], row["row_index"], row["step"], row["epoch"], states)


def load_state(spark: SparkSession, path: str) -> ResumeState | None:
    """The saved state, or ``None`` where nothing was saved. Any other failure to read is an error."""
    try:
        row = spark.read.schema(STATE_SCHEMA).json(path).first()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return None if row is None else _state(row)


def save_checkpoint_state(spark: SparkSession, state: ResumeState, checkpoint: str) -> None:
    save_state(spark, state, f"{checkpoint.rstrip('/')}/resume_state")


def with_checkpoint_step(names: DataFrame, name: str = "name") -> DataFrame:
    """Add ``checkpoint_step``: the first number in a checkpoint's name, -1 without one."""
    number = F.regexp_extract(name, r"\d+", 0)
    return names.withColumn(
        "checkpoint_step", F.when(number != "", number.cast("long")).otherwise(F.lit(-1))
    )


def checkpoint_names(spark: SparkSession, folder: str) -> DataFrame:
    """``name``: the checkpoints below ``folder``, found by the files in them; contents are not read."""
    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    inside = F.regexp_extract("path", r"^(?:[a-z0-9]+:)?/*(.*)$", 1)
    below = re.sub(r"^[a-z0-9]+:", "", root).lstrip("/")
    return files.select(F.split(F.substring(inside, len(below) + 2, 1 << 30), "/")[0].alias("name")).distinct()


def load_latest_checkpoint_state(spark: SparkSession, folder: str) -> ResumeState | None:
    """The state in the newest checkpoint below ``folder``, the one with the highest step.

    ``None`` if there is no checkpoint, or the newest one has no state: an older state must not meet a
    newer model.
    """
    try:
        named = with_checkpoint_step(checkpoint_names(spark, folder))
        newest = named.orderBy(F.desc("checkpoint_step"), F.desc("name")).first()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return newest and load_state(spark, f"{folder.rstrip('/')}/{newest['name']}/resume_state")
