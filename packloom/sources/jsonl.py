"""JSON-lines triplet files with stable (shard, row) positions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packloom.functions.arrays import bind
from packloom.workspace import stage, stage_texts

# Fixed value: the file names taken from a data directory.
DATA_FILE_GLOB = "*.{json,jsonl}"


def not_blank(line: str = "value") -> Column:
    """True for lines with anything but white space of any kind."""
    return F.col(line).rlike(r"(?U)\S")


def read_lines(
    spark: SparkSession, paths: str | Sequence[str], recursive: bool = False
) -> DataFrame:
    """Non-blank lines of JSONL files, path list or glob, with the file and split they come from.

    ``recursive`` takes directories and finds all ``.json`` and ``.jsonl`` files below them.
    """
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", DATA_FILE_GLOB)
    lines = reader.text([paths] if isinstance(paths, str) else list(paths))
    return lines.where(not_blank()).select(
        "value",
        F.col("_metadata.file_path").alias("shard_name"),
        F.col("_metadata.file_block_start").alias("__block"),
        # A task reads its splits one after the other, so the id rises along each split.
        F.monotonically_increasing_id().alias("__seen"),
    )


# Splits whose places are sent to every task: some hundred bytes each.
MAX_BROADCAST_SPLITS = 1_000_000


def shard_names(lines: DataFrame) -> list[str]:
    """The files behind ``lines`` in path order, empty ones too. A shard's index is its place here."""
    return sorted(re.sub("^file:/+", "file:/", name) for name in lines.inputFiles())


def unread_files(names: Sequence[str], first_shard: int) -> list[str]:
    """Paths to read when everything before ``first_shard`` is done."""
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(name)) for name in names[first_shard:]]


def index_splits(lines: DataFrame) -> DataFrame:
    """One row per file split: ``shard_name, __block, __first, n_rows``, with the first row id seen.

    Stored, so that every other question about shards is answered from this table. How files are cut
    into splits may differ from one scan to the next, so places found here fit only rows of the scan
    they were counted in: to place rows, store them first (``with_positions`` does).
    """
    splits = lines.groupBy("shard_name", "__block").agg(
        F.min("__seen").alias("__first"), F.count("*").alias("n_rows")
    )
    return stage(splits, "splits")


def list_shards(counts: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """``shard_index, shard_name, n_rows, first_pos`` in name order.

    ``counts(shard_name, n_rows)`` may have several rows per shard; ``names`` adds shards without
    rows. One row per shard is left, so the ordering window is over metadata only.
    """
    shards = counts.groupBy("shard_name").agg(F.sum("n_rows").alias("n_rows"))
    if names is not None:
        every = counts.sparkSession.createDataFrame([(n,) for n in names], "shard_name string")
        shards = every.join(shards, "shard_name", "left").fillna({"n_rows": 0})
    by_name = Window.orderBy("shard_name")
    earlier = by_name.rowsBetween(Window.unboundedPreceding, -1)
    return shards.select(
        (F.row_number().over(by_name) - 1).alias("shard_index"),
        "shard_name",
        "n_rows",
        F.coalesce(F.sum("n_rows").over(earlier), F.lit(0)).alias("first_pos"),
    )


def with_positions(
    lines: DataFrame, first_shard: int = 0, then: Callable[[DataFrame], DataFrame] = lambda rows: rows
) -> DataFrame:
    """``shard_index, shard_name, row_index, pos`` and the other columns: where every line stands.

    The lines are read once and stored with the split they came from; splits are counted in the stored
    rows. Up to ``MAX_BROADCAST_SPLITS`` splits the rows are neither sorted nor shuffled. A row without
    a place is an error. ``pos`` numbers the lines over all shards read; ``first_shard`` is the index
    of the first of them. ``then`` adds columns before the rows are stored, and may drop the line; it
    has to keep every row.
    """
    names = shard_names(lines)
    stored = stage_texts(then(lines), "lines")
    index = index_splits(stored)
    shards = list_shards(index, names)
    earlier = (
        Window.partitionBy("shard_name")
        .orderBy("__block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offset = F.coalesce(F.sum("n_rows").over(earlier), F.lit(0)).alias("__offset")
    places = index.select("shard_name", "__block", "__first", offset).join(
        shards.drop("n_rows"), "shard_name"
    )
    if index.count() <= MAX_BROADCAST_SPLITS:
        places = F.broadcast(places)
    row_index = F.col("__seen") - F.col("__first") + F.col("__offset")
    missing = F.raise_error(F.concat(F.lit("no place for a line of "), F.col("shard_name")))
    rest = [c for c in stored.columns if c not in ("shard_name", "__block", "__seen")]
    return stored.join(places, ["shard_name", "__block"], "left").select(
        F.coalesce("shard_index", missing.cast("int")).alias("__shard"), "shard_name", row_index.alias("row_index"),
        (F.col("first_pos") + row_index).alias("pos"), *rest,
    ).select((F.col("__shard") + first_shard).alias("shard_index"), "shard_name", "row_index", "pos", *rest)


def open_shard(positioned: DataFrame, shard_name: str, row: int = 0) -> DataFrame:
    """The lines of one shard from ``row`` on."""
    return positioned.where((F.col("shard_name") == shard_name) & (F.col("row_index") >= row))


def select_shards(positioned: DataFrame, shard_indices: Sequence[int]) -> DataFrame:
    return positioned.where(F.col("shard_index").isin(list(shard_indices)))


def parse_triplets(
    lines: DataFrame,
    anchor: str = "anchor",
    positive: str = "positive",
    negative: str = "negative",
    num_negatives: int = 1,
    extras: T.StructType | None = None,
    column: str = "value",
    mark_corrupt: bool = False,
    record: str | None = None,
) -> DataFrame:
    """Parse JSON lines to ``anchor, positive, negatives`` and the ``extras`` fields.

    ``mark_corrupt`` adds ``corrupt``, true for lines that are no JSON object. ``record`` names a VARIANT column
    for the whole line: what fields it has need not be known (``other_field``). It is null for lines that are no
    JSON or have a key twice.

    A negative may be a text or a list of texts. Only an absent key takes the default of
    ``num_negatives`` empty texts; a null stays null and is dropped later as an empty field.
    """

    text = [T.StructField(f, T.StringType()) for f in (anchor, positive, negative)]
    schema = T.StructType([*text, *(extras or [])])
    listed = T.StructType([T.StructField(negative, T.ArrayType(T.StringType()))])

    def negatives(one: Column) -> Column:
        said = one.getField(negative)
        keys = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))
        # A list comes as its JSON text; a text that merely looks like one has no list in the line.
        several = F.when(F.startswith(said, F.lit("[")), F.from_json(column, listed).getField(negative))
        absent = said.isNull() & ~F.array_contains(keys, negative)
        text = F.when(said != "", F.array(said))
        return F.when(absent, F.array_repeat(F.lit(""), num_negatives)).otherwise(F.coalesce(several, text))

    def fields(one: Column) -> Column:
        return F.struct(
            one.getField(anchor).alias("anchor"),
            one.getField(positive).alias("positive"),
            negatives(one).alias("negatives"),
            F.json_object_keys(column).isNull().alias("corrupt"),
            *[one.getField(f.name).alias(f.name) for f in (extras or [])],
        )

    if record is not None:
        lines = lines.withColumn(record, F.try_parse_json(column))
    rest = [c for c in lines.columns if c != column]
    names = ["anchor", "positive", "negatives", *(["corrupt"] if mark_corrupt else [])]
    names += [f.name for f in (extras or [])]
    # Bound, so that a line is parsed once however many fields are taken from it.
    parsed = lines.select(*rest, bind(F.from_json(column, schema), fields).alias("__parsed"))
    return parsed.select(*rest, *[F.col("__parsed").getField(n).alias(n) for n in names])


def other_field(record: Column | str, path: str, kind: str) -> Column:
    """A field of a ``record`` nobody declared, as type ``kind``; null if it is not there or of another kind."""
    return F.try_variant_get(F.col(record) if isinstance(record, str) else record, path, kind)
