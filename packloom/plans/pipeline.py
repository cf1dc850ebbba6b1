"""From data files to packed rows and batches in one call."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packloom.config import PackConfig
from packloom.functions.numbers import floor_div
from packloom.functions.text import Tokenizer
from packloom.operators.assembly import assemble_assigned, assemble_packs, pad_packs
from packloom.operators.batches import assign_batches, collate_packs, order_packs
from packloom.operators.packing import plan_packs
from packloom.operators.positions import number_rows
from packloom.operators.resume import resume_from
from packloom.operators.strategies import WINDOW_ROWS, assign_by_strategy
from packloom.operators.triplets import CORRUPT_LINE, limit_length, needed_tokens, outcome, reject_reason, tokenize_slots
from packloom.sources import jsonl
from packloom.sources.state import ResumeState
from packloom.workspace import stage

# Fixed value: the field that names where a sample comes from.
SOURCE_FIELD = "__source__"
# Buckets whose offsets are sent to every task when packs are numbered.
MAX_BUCKETS = 1 << 16


@dataclass(frozen=True)
class PackedDataset:
    """``packs`` are the padded rows with ``pack_seq``, their place in the (shuffled) order.

    ``rows`` are the same without padding: batches are made of them and padded last. ``start`` is the
    state the pass began with; ``rejects`` counts the input rows by what became of them.
    """

    samples: DataFrame
    rows: DataFrame
    n_packs: int
    config: PackConfig
    start: ResumeState = ResumeState()
    rejects: DataFrame | None = None

    @property
    def packs(self) -> DataFrame:
        return pad_packs(self.rows, self.config, "pack_seq")

    def batches(
        self, length: int | None = None, truncation_mode: str = "keep_end", drop_last: bool = True, skip: int = 0
    ) -> DataFrame:
        """Collated batches of ``config.batch_size`` packs, without the first ``skip`` of them.

        Packs are gathered to batches as they are and padded there.
        """
        batched = assign_batches(self.rows, self.n_packs, self.config.batch_size, drop_last)
        if skip:
            batched = batched.where(F.col("batch_id") >= skip)
        return collate_packs(batched, self.config, length or self.config.seq_length, truncation_mode)

    def state_after(self, batches: int) -> ResumeState:
        """The state to save when ``batches`` batches of this pass were used.

        Packs are used in ``pack_seq`` order, so under a shuffle no position in the files has all used
        rows before it. The state therefore keeps where the pass began and, as ``step``, how many
        batches are done: ``resume_packed`` plans the same pass again and goes on behind them.
        """
        return self.start.stamped(self.start.step + batches, self.start.epoch)


def read_rows(
    spark: SparkSession,
    data_files: str | Sequence[str],
    tokenizer: Tokenizer,
    config: PackConfig,
    resume: ResumeState | None = None,
    recursive: bool = False,
    fields: tuple[str, str, str] = ("anchor", "positive", "negative"),
    extras: T.StructType | None = None,
    shards: Sequence[int] | None = None,
) -> DataFrame:
    """Every row of JSONL files, parsed and tokenized once and stored, with positions and ``reject_reason``.

    ``slots`` has the tokens that samples need (``needed_tokens``), ``slot_sizes`` counts all.
    With ``resume``, finished files are not opened and rows before the saved position are left out;
    with ``shards``, only these files are opened.
    """
    lines, first_shard = jsonl.read_lines(spark, data_files, recursive), 0
    names = jsonl.shard_names(lines)
    if shards is not None:
        chosen = sorted(set(shards) & set(range(len(names))))
        lines = jsonl.read_lines(spark, [f for i in chosen for f in jsonl.unread_files(names[i : i + 1], 0)])
    elif resume is not None:
        # With all files finished the last one is read, and nothing of it is left below.
        first_shard = min(resume.shard_index, len(names) - 1)
        lines = jsonl.read_lines(spark, jsonl.unread_files(names, first_shard))
    extras = T.StructType([T.StructField(SOURCE_FIELD, T.StringType()), *(extras or [])])

    def prepare(rows: DataFrame) -> DataFrame:
        triplets = jsonl.parse_triplets(
            rows, *fields, num_negatives=config.num_negatives, extras=extras, mark_corrupt=True
        ).withColumnRenamed(SOURCE_FIELD, "source_id")
        reason = F.when(F.col("corrupt"), F.lit(CORRUPT_LINE)).otherwise(reject_reason(config.num_negatives))
        triplets = triplets.withColumn("reject_reason", reason).drop("corrupt")
        return needed_tokens(tokenize_slots(triplets, tokenizer, config), config)

    rows = jsonl.with_positions(lines, first_shard=first_shard, then=prepare)
    if shards is not None:
        numbers = F.array(*map(F.lit, chosen))
        rows = rows.withColumn("shard_index", F.get(numbers, F.col("shard_index")))
    elif resume is not None:
        rows = resume_from(rows, resume)
    return rows


def read_samples(
    spark: SparkSession,
    data_files: str | Sequence[str],
    tokenizer: Tokenizer,
    config: PackConfig,
    resume: ResumeState | None = None,
    recursive: bool = False,
    fields: tuple[str, str, str] = ("anchor", "positive", "negative"),
) -> DataFrame:
    """Samples of JSONL files in file and row order, tokenized once and staged."""
    return samples_of(read_rows(spark, data_files, tokenizer, config, resume, recursive, fields), config)


def samples_of(rows: DataFrame, config: PackConfig) -> DataFrame:
    """The rows that become samples, length-checked."""
    return limit_length(rows.where("reject_reason IS NULL").drop("reject_reason"), config)


def outcomes(rows: DataFrame, config: PackConfig) -> DataFrame:
    """``outcome, n_rows``: how many input rows became samples, and why the others did not."""
    return rows.groupBy(outcome(config).alias("outcome")).agg(F.count("*").alias("n_rows"))


def pack_dataset(
    samples: DataFrame, config: PackConfig, start: ResumeState = ResumeState(), rejects: DataFrame | None = None
) -> PackedDataset:
    """Pack staged samples under ``config.strategy`` and put the packs in order."""
    if config.strategy == "greedy":
        plan = plan_packs(samples, config)
        packs, n_packs = assemble_packs(samples, plan), plan.n_packs
    else:
        assigned = stage(assign_by_strategy(samples, config), "assigned")
        ids = assigned.select("pack_id").distinct()
        # Neighbouring windows share a bucket, so that the table of offsets stays within ``MAX_BUCKETS`` rows.
        windows = (ids.agg(F.max("pack_id")).first()[0] or 0) // WINDOW_ROWS + 1
        ids = ids.withColumn("window", floor_div("pack_id", WINDOW_ROWS * -(-windows // MAX_BUCKETS)))
        numbers = stage(number_rows(ids, "window", "pack_id", name="number"), "pack-numbers")
        n_packs = numbers.count()
        dense = assigned.join(numbers.select("pack_id", "number"), "pack_id")
        dense = dense.select("pos", F.col("number").alias("pack_id"), "sample_ord")
        packs = assemble_assigned(samples, dense, config)
    return PackedDataset(samples, order_packs(packs, n_packs, config), n_packs, config, start, rejects)


def load_packed(
    spark: SparkSession,
    data_files: str | Sequence[str],
    tokenizer: Tokenizer,
    config: PackConfig,
    resume: ResumeState | None = None,
    recursive: bool = False,
    fields: tuple[str, str, str] = ("anchor", "positive", "negative"),
    shards: Sequence[int] | None = None,
) -> PackedDataset:
    rows = read_rows(spark, data_files, tokenizer, config, resume, recursive, fields, shards=shards)
    start = (resume or ResumeState()).stamped(0, resume.epoch if resume else 0)
    return pack_dataset(samples_of(rows, config), config, start, outcomes(rows, config))


def resume_packed(
    spark: SparkSession,
    data_files: str | Sequence[str],
    tokenizer: Tokenizer,
    config: PackConfig,
    state: ResumeState,
    **options,
) -> tuple[PackedDataset, int]:
    """The pass that ``state`` (of ``state_after``) interrupted, and how many of its batches are done.

    Reading starts where that pass did and plans the same packs in the same order;
    ``batches(skip=done)`` gives the rest: nothing is lost and nothing comes twice.
    """
    whole = state.shard_index == 0 and state.row_index == 0
    data = load_packed(spark, data_files, tokenizer, config, None if whole else state, **options)
    return data, state.step


def load_datasets(
    spark: SparkSession,
    datasets: dict[str, str | Sequence[str]],
    tokenizer: Tokenizer,
    config: PackConfig,
    state: ResumeState | None = None,
    **options,
) -> dict[str, PackedDataset]:
    """Several named datasets, each from its own saved position."""
    own = {name: state.of_dataset(name) if state and state.dataset_states else None for name in datasets}
    return {name: load_packed(spark, files, tokenizer, config, own[name], **options) for name, files in datasets.items()}
