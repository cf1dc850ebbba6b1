"""Parquet tables: packed rows, vocabularies and vectors, and triplets made from text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packloom.operators.positions import dense_positions


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# An input with this many splits is left as it is, however many cores there are.
SMALL_SPLITS = 64


def over_all_cores(df: DataFrame, key: str) -> DataFrame:
    """Spread a small input before heavy work on its rows.

    One small file is one task however many cores there are. Only inputs of a few splits are shuffled,
    so what moves is bounded by as many splits; on a large input the split size is the setting to use
    (``spark.sql.files.maxPartitionBytes``).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < min(cores, SMALL_SPLITS) else df


def save(df: DataFrame, path: str, overwrite: bool = False, partition_by: tuple[str, ...] = ()) -> None:
    """Write a table. An existing one is an error unless ``overwrite``."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def conversation_triplets(conversations: DataFrame) -> DataFrame:
    """Triplets from chats: a user turn, the assistant turn right after it, and as the negative the
    first assistant turn of the next conversation (null when that has none).

    The turns are joined on (conversation, turn). The other conversation's answer is one row, joined on
    the conversation; adaptive execution splits a conversation that is a large part of all turns.
    """
    user = conversations.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("anchor")
    )
    assistant = conversations.where(F.col("role") == "assistant")
    answer = assistant.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("positive")
    )
    other = assistant.groupBy((F.col("conv_id") - 1).alias("conv_id")).agg(
        F.min_by("text", "turn").alias("negative")
    )
    return user.join(answer, ["conv_id", "turn"]).join(other, "conv_id", "left")


# Bytes of text in a span of documents, about: one task sorts it.
SPAN_BYTES = 64 << 20
# At most this many spans, whatever the input size: every task gets two numbers of each.
MAX_SPANS = 1 << 14


def text_bytes(documents: DataFrame) -> int:
    return documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _listed(numbers: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def _last_not_above(rising: list[int], number: Column | str) -> Column:
    """Place of the last of ``rising`` that is not above ``number``, by halving; 0 if all are."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(rising).bit_length()))])
    listed = _listed(rising)
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(listed, at + step) <= F.col(number), at + step).otherwise(at)
    )


def document_triplets(documents: DataFrame, labels: DataFrame, spans: int | None = None) -> DataFrame:
    """Triplets from documents: the text, and the texts of the two documents that follow by number.

    Numbers may have gaps: their order is found on the numbers alone. ``source_id`` is the document's source;
    unlabelled documents have null ``quality``.

    The order is cut into ``spans`` of as many documents. Each text is shuffled once, to its span, the first two of a span
    to the one before as well, and the texts that follow are looked up there. A partition of the result is a span, its
    rows in the order of their numbers.
    """
    numbers = dense_positions(documents.where(F.col("doc_id").isNotNull()).select("doc_id").distinct(), "doc_id")
    n = numbers.count()
    if spans is None:
        spans = max(documents.sparkSession.sparkContext.defaultParallelism, -(-text_bytes(documents) // SPAN_BYTES))
    # At least two, so that what follows a span is in the next one.
    held = max(2, -(-n // min(spans, MAX_SPANS)))
    edges = numbers.where(F.pmod("pos", F.lit(held)) < 2).orderBy("pos").select("doc_id").collect()
    first, second = ([row["doc_id"] for row in edges[k::2]] or [0] for k in range(2))

    def to_spans(rows: DataFrame, at: Column) -> DataFrame:
        return rows.where(F.col("doc_id").isNotNull()).withColumn("__span", at)

    span = _last_not_above(first, "doc_id")
    early = (F.get(_listed(first), F.col("__span")) == F.col("doc_id")) | (F.get(_listed(second), F.col("__span")) == F.col("doc_id"))
    # A copy for the span before is no row of the result.
    own = F.array(F.col("__span"), F.when(early & (F.col("__span") > 0), F.col("__span") - 1))
    texts = to_spans(documents, span).select("doc_id", "source", "text", F.posexplode(F.array_compact(own)).alias("__copy", "__span"))
    texts = texts.select("__span", "doc_id", F.col("source").alias("source_id"), F.col("text").alias("anchor"), "__copy")
    said = to_spans(labels, span).select("__span", "doc_id", F.struct("quality").alias("__label"))
    together = texts.unionByName(said, allowMissingColumns=True).repartitionById(len(first), "__span")
    of_document, in_span = Window.partitionBy("__span", "doc_id"), Window.partitionBy("__span").orderBy("doc_id")
    # A document has a row for each of its labels, or one.
    labelled = together.withColumn("__labels", F.collect_list("__label").over(of_document)).where("__copy IS NOT NULL")
    followed = labelled.withColumns({"positive": F.lead("anchor", 1).over(in_span), "negative": F.lead("anchor", 2).over(in_span)})
    rows = followed.where("__copy = 0").withColumn("__label", F.explode_outer("__labels"))
    return rows.select("doc_id", "anchor", "source_id", "positive", "negative", F.col("__label.quality").alias("quality"))
