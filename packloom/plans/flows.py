"""The pipelines behind the registered queries: tables to samples, packs, batches and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.config import PackConfig
from packloom.functions.arrays import bind
from packloom.functions.text import codepoints, words
from packloom.operators.assembly import assemble_packs, assign_packs, pad_packs
from packloom.operators.packing import PackPlan, plan_packs
from packloom.operators.positions import dense_positions
from packloom.operators.triplets import limit_length, select_fields, token_slots, tokenize_slots, usable
from packloom.operators.vocabulary import append_eos, build_vocabulary, encode_slots
from packloom.sources.tables import conversation_triplets, document_triplets, load
from packloom.workspace import stage_texts

EOS = 1
FIRST_WORD_ID = 2

CHAT = PackConfig(eos_token_id=EOS, seq_length=8192, max_samples=None, max_sample_length=1600, shuffle=False)
CHAT_CAPPED = CHAT.with_(seq_length=6144, max_samples=5)
DOCS = PackConfig(eos_token_id=EOS, seq_length=8192, max_samples=8, max_sample_length=None, shuffle=False)


def joined(values: Column | str) -> Column:
    """An integer array as one short text, to compare long arrays by."""
    values = F.col(values) if isinstance(values, str) else values

    def digest(line: Column) -> Column:
        # Null entries are left out; only they are letters.
        spelled = F.array_join(values.cast("array<string>"), ",")
        whole = F.substring(line, F.lit(2), F.length(line) - 2)
        return F.md5(F.when(F.contains(line, F.lit("null")), spelled).otherwise(whole))

    # As JSON, since that makes no text of each single number.
    return bind(F.to_json(values), digest)


def chat_triplets(spark: SparkSession, folder: str) -> DataFrame:
    return select_fields(conversation_triplets(load(spark, folder, "conversations")))


def chat_samples(spark: SparkSession, folder: str, config: PackConfig = CHAT) -> DataFrame:
    """Chat triplets as numbered, staged and length-checked samples of characters."""
    numbered = dense_positions(
        usable(chat_triplets(spark, folder)),
        "conv_id",
        "turn",
        then=lambda triplets: tokenize_slots(triplets, codepoints, config),
    )
    return limit_length(numbered, config)


def word_samples(spark: SparkSession, folder: str, config: PackConfig = CHAT) -> DataFrame:
    """Chat triplets as samples of word ids from the vocabulary of all chats."""
    text = load(spark, folder, "conversations").select(words("text").alias("words"))
    vocabulary = build_vocabulary(text, first_id=FIRST_WORD_ID)

    def spell(triplets: DataFrame) -> DataFrame:
        fields = [F.col("anchor"), F.col("positive"), F.col("negatives")[0]]
        spelled = triplets.withColumn("word_slots", F.array(*[words(f) for f in fields]))
        # A word is one token and each slot ends with EOS, so lengths are known before the lookup.
        sizes = F.transform("word_slots", lambda slot: F.size(slot) + 1)
        return spelled.withColumn("slot_sizes", sizes).drop("anchor", "positive", "negatives")

    numbered = dense_positions(usable(chat_triplets(spark, folder)), "conv_id", "turn", then=spell)
    encoded = encode_slots(numbered, "word_slots", vocabulary, unknown_id=0, key="pos")
    return limit_length(encoded.withColumn("slots", append_eos("slots", config.eos_token_id)), config)


def document_texts(spark: SparkSession, folder: str, config: PackConfig = DOCS) -> DataFrame:
    """Document triplets as samples of characters, with their staged ``texts`` in place of slots; the document number is
    the position.

    Texts are stored, not their tokens: Parquet reads thousands of rows at once, and a token in an array takes a
    dozen times the memory of a character. They are one column, where a text lies near its copies in the rows around it and
    is compressed with them. Slot sizes are stored as well, so lengths are read without the texts.
    """
    texts = document_triplets(load(spark, folder, "documents"), load(spark, folder, "labels"))
    triplets = usable(select_fields(texts)).withColumn("pos", F.col("doc_id"))
    fields = [F.col("anchor"), F.col("positive"), F.col("negatives")[0]]
    # A character is one token.
    sizes = F.array(*[F.length(f) + int(config.add_special_tokens) for f in fields])
    rows = triplets.withColumns({"texts": F.array(*fields), "slot_sizes": sizes})
    return stage_texts(rows.drop("anchor", "positive", "negatives"), "samples")


def of_texts(texts: Column) -> Column:
    """Slots of the texts of a document's triplet."""
    return token_slots([texts[i] for i in range(DOCS.num_slots)], codepoints, DOCS)


def document_samples(spark: SparkSession, folder: str, config: PackConfig = DOCS) -> DataFrame:
    """``document_texts`` with their tokens, length-checked."""
    slots = token_slots([F.col("texts")[i] for i in range(DOCS.num_slots)], codepoints, config)
    return limit_length(document_texts(spark, folder, config).withColumn("slots", slots).drop("texts"), config)


def packed_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, PackPlan]:
    """As ``packed`` over ``document_samples`` and ``DOCS``: texts go to their packs, and are tokenized there."""
    samples = limit_length(document_texts(spark, folder, DOCS), DOCS)
    # A pack has no tokens behind ``seq_length`` of a slot, and a character is one token.
    texts = F.transform("texts", lambda text: F.left(text, F.lit(DOCS.seq_length)))
    samples = samples.select("pos", "n_tokens", texts.alias("texts"), "source_id")
    plan = plan_packs(samples, DOCS)
    return pad_packs(assemble_packs(samples, plan, of_texts), DOCS), plan


def packed(samples: DataFrame, config: PackConfig) -> tuple[DataFrame, PackPlan]:
    plan = plan_packs(samples, config)
    return pad_packs(assemble_packs(samples, plan), config), plan


def assigned(samples: DataFrame, config: PackConfig) -> DataFrame:
    return assign_packs(samples, plan_packs(samples, config))
