"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.llm.bin_packing import pack_documents
from packloom.llm.common import stage, table
from packloom.llm.ngram_join import keep_one, near_duplicates
from packloom.llm.quality_fm import keep_good, train
from packloom.llm.queries import public_tokenizer
from packloom.llm.source_mixing import count_words, take
from packloom.llm.suffix_dedup import remove_repeats

#: Not expressible in SQL: a trained classifier, byte-wise deduplication and a tokenizer; tests/llm compares with brute force.
ORACLE_SQL = None


# Rows of whole texts that a worker and its executor hold at once.
BATCH_ROWS = 1_000


def _whole_texts(spark: SparkSession) -> None:
    """Smaller Arrow batches than the default, which is made for narrow rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality_classifier(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents the classifier does not reject. It learns from the labels of this folder."""
    _whole_texts(spark)
    return keep_good(docs, train(docs, table(spark, folder, "labels")))


def ngram_join(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    _whole_texts(spark)
    return keep_one(docs, near_duplicates(docs, words=5, share=(80, 100)))


def suffix_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without strings of 100 bytes that occur before; documents of which nothing is left go."""
    _whole_texts(spark)
    cut = remove_repeats(docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")))
    left = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return cut.where((F.col("n_chars") == 0) | (left > 0)).withColumn("n_chars", left)


def source_mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    _whole_texts(spark)
    return take(docs, count_words(F.col("text")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token pieces of the documents, placed in sequences of 2048 ids."""
    _whole_texts(spark)
    return pack_documents(docs, public_tokenizer("word_bpe_49k.json"), 2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("ngram_join", ngram_join),
    ("suffix_dedup", suffix_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of ``folder``."""
    rows = table(spark, folder, "documents")
    for name, function in STAGES[:-1]:
        rows = stage(function(spark, rows, folder), name)
    return STAGES[-1][1](spark, rows, folder)
