"""The registered queries: one per operator, each over whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from packloom.functions.arrays import each_element
from packloom.functions.numbers import floor_div
from packloom.functions.text import codepoints, words
from packloom.functions.vectors import cosine, normalize
from packloom.operators import batches, contrastive, id_bitmaps, pooling, quality, resume, unpack, vocabulary
from packloom.operators.assembly import assemble_packs
from packloom.operators.levels import assign_first_fit
from packloom.operators.packing import plan_packs
from packloom.operators.positions import dense_positions
from packloom.operators.records import pack_records
from packloom.operators.reservoir import reservoir_order
from packloom.operators.strategies import WINDOW_ROWS, assign_by_strategy
from packloom.operators.triplets import (
    rejected,
    select_fields,
    slot_labels,
    tokenize_slots,
    usable,
)
from packloom.plans import flows, pipeline
from packloom.plans.flows import CHAT, CHAT_CAPPED, DOCS, joined
from packloom.sources import jsonl, seek, state_log
from packloom.sources.buckets import save_bucketed
from packloom.sources.state import (
    ResumeState,
    initial_state,
    load_latest_checkpoint_state,
    load_state,
    save_checkpoint_state,
    save_state,
    with_checkpoint_step,
)
from packloom.sources.tables import document_triplets, load, over_all_cores, save, text_bytes
from packloom.streaming import ledger
from packloom.streaming.carry import carried, closed_packs, continue_lanes, left_open, pack_lanes, rocksdb_state
from packloom.streaming.ingest import run_available, small_batches, stream_triplets
from packloom.streaming.packer import lane_of, lanes_for, open_packs, pack_stream
from packloom.workspace import new_path, ship_package, shuffles_freed, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NUM_SLOTS = CHAT.num_slots
DOC_ID = StructType([StructField("doc_id", LongType())])
PACK_FIELDS = ("input_ids", "attention_mask", "segment_ids", "position_ids")


def query(function: Query) -> Query:
    @wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return function(spark, folder)

    QUERIES[function.__name__] = run
    return run


# --- triplets -----------------------------------------------------------------------------------


def _bucketed(rows: DataFrame, label: str, *sort: str) -> DataFrame:
    """``rows`` stored in as many buckets of ``batch_id`` as a shuffle has partitions."""
    path = new_path(rows.sparkSession, label)
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return save_bucketed(rows, path.rsplit("/", 1)[-1].replace("-", "_"), path, "batch_id", buckets, *sort)


@query
def triplet_build(spark: SparkSession, folder: str) -> DataFrame:
    return flows.chat_triplets(spark, folder).select(
        "conv_id", "turn", "anchor", "positive", F.col("negatives")[0].alias("negative")
    )


@query
def triplet_filter(spark: SparkSession, folder: str) -> DataFrame:
    kept = usable(flows.chat_triplets(spark, folder))
    return kept.select("conv_id", "turn", F.md5(F.concat("anchor", "positive", F.col("negatives")[0])).alias("texts"))


def _two_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Document triplets with a second negative where the document is labelled good."""
    texts = document_triplets(load(spark, folder, "documents"), load(spark, folder, "labels"))
    second = F.when(F.col("quality") == 1, F.col("positive"))
    return texts.select(
        "doc_id", "anchor", "positive", F.array_compact(F.array("negative", second)).alias("negative")
    )


@query
def triplet_rejects(spark: SparkSession, folder: str) -> DataFrame:
    triplets = select_fields(_two_negatives(spark, folder), num_negatives=2)
    return rejected(triplets, 2).select("doc_id", "reject_reason")


@query
def triplet_two_negatives(spark: SparkSession, folder: str) -> DataFrame:
    config = DOCS.with_(num_negatives=2)
    triplets = usable(select_fields(_two_negatives(spark, folder), num_negatives=2), 2)
    samples = tokenize_slots(triplets, codepoints, config)
    return samples.select(
        "doc_id", F.array_join(F.col("slot_sizes").cast("array<string>"), ",").alias("slot_sizes")
    )


@query
def tokenize_words(spark: SparkSession, folder: str) -> DataFrame:
    documents = over_all_cores(load(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    tokens = documents.select("doc_id", words("text").alias("words"))
    return tokens.select(
        "doc_id", F.size("words").alias("n_words"), F.md5(F.array_join("words", " ")).alias("words")
    )


@query
def tokenize_codepoints(spark: SparkSession, folder: str) -> DataFrame:
    documents = over_all_cores(load(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    tokens = documents.select("doc_id", codepoints("text").alias("points"))
    return tokens.select("doc_id", F.size("points").alias("n_points"), joined("points").alias("points"))


@query
def slot_label(spark: SparkSession, folder: str) -> DataFrame:
    samples = tokenize_slots(usable(flows.chat_triplets(spark, folder)), codepoints, CHAT)
    return samples.select(
        "conv_id",
        "turn",
        joined(F.flatten("slots")).alias("input_ids"),
        joined(slot_labels()).alias("triplet_type"),
    )


@query
def sample_lengths(spark: SparkSession, folder: str) -> DataFrame:
    samples = tokenize_slots(usable(flows.chat_triplets(spark, folder)), codepoints, CHAT)
    names = ("anchor_tokens", "positive_tokens", "negative_tokens")
    return samples.select("conv_id", "turn", *[F.col("slot_sizes")[i].alias(n) for i, n in enumerate(names)])


@query
def length_filter_truncate(spark: SparkSession, folder: str) -> DataFrame:
    return flows.chat_samples(spark, folder).select(
        "conv_id", "turn", "n_tokens", joined(F.flatten("slots")).alias("input_ids"), joined(slot_labels()).alias("triplet_type")
    )


# --- vocabulary ---------------------------------------------------------------------------------


def _document_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    documents = over_all_cores(load(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    texts = documents.select(words("text").alias("words"))
    return vocabulary.build_vocabulary(texts, first_id=flows.FIRST_WORD_ID)


@query
def vocab_build(spark: SparkSession, folder: str) -> DataFrame:
    return _document_vocabulary(spark, folder)


@query
def vocab_encode(spark: SparkSession, folder: str) -> DataFrame:
    return _encoded(spark, folder, vocabulary.MAX_LOOKUP_TOKENS)


@query
def vocab_encode_by_join(spark: SparkSession, folder: str) -> DataFrame:
    return _encoded(spark, folder, 0)


def _encoded(spark: SparkSession, folder: str, max_lookup: int) -> DataFrame:
    """Chat texts in the vocabulary of the documents; other words are unknown."""
    chats = load(spark, folder, "conversations")
    keyed = chats.select(
        F.concat_ws("-", "conv_id", "turn").alias("key"), F.array(words("text")).alias("word_slots")
    )
    encoded = vocabulary.encode_slots(
        keyed, "word_slots", _document_vocabulary(spark, folder), 0, "key", max_lookup
    )
    ids = F.col("slots")[0]
    return encoded.select("key", F.size(ids).alias("n_tokens"), joined(ids).alias("ids"))


@query
def vocab_extend(spark: SparkSession, folder: str) -> DataFrame:
    base = _benchmark_vocabulary(spark, folder)
    return vocabulary.extend_vocabulary(base, _chat_words(spark, folder))


def _benchmark_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    texts = load(spark, folder, "benchmark").select(words("text").alias("words"))
    return stage(vocabulary.build_vocabulary(texts), "vocabulary")


def _chat_words(spark: SparkSession, folder: str) -> DataFrame:
    chats = load(spark, folder, "conversations")
    return each_element(chats, words("text"), value="token").select("token").distinct()


def _token_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "embeddings").select(
        F.col("vec_id").cast("int").alias("token_id"), F.col("embedding").alias("vec")
    )


def _rounded_dims(vectors: DataFrame, *keys: str) -> DataFrame:
    dims = each_element(vectors, "vec", *keys, position="dim", value="x")
    return dims.select(*keys, "dim", F.round(F.col("x").cast("double"), 6).alias("x"))


def _new_rows(spark: SparkSession, folder: str, strategy: str, **options) -> DataFrame:
    """As many new vectors as there are benchmark items."""
    count = load(spark, folder, "benchmark").count()
    extended, before, _ = vocabulary.extend_vectors(_token_vectors(spark, folder), count, strategy, **options)
    return extended.where(F.col("token_id") >= before)


@query
def vocab_vectors_average(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_dims(_new_rows(spark, folder, "average"), "token_id")


@query
def vocab_vectors_zeros(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_dims(_new_rows(spark, folder, "zeros"), "token_id")


RANDOM_SEED = 7


@query
def vocab_vectors_random(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_dims(_new_rows(spark, folder, "random", seed=RANDOM_SEED), "token_id")


@query
def vocab_joint_extend(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens and vectors the chats' words add to the benchmark vocabulary, whose vectors are those of ``embeddings``."""
    base, known = _benchmark_vocabulary(spark, folder), load(spark, folder, "embeddings")
    rows = known.select(F.col("vec_id").alias("row"), F.col("embedding").alias("vec"))
    vectors = base.select("token_id", F.pmod("token_id", F.lit(known.count())).cast("long").alias("row")).join(rows, "row")
    tokens, more, before, _ = vocabulary.extend_both(base, vectors.select("token_id", "vec"), _chat_words(spark, folder), "average")
    added = tokens.where(F.col("token_id") >= before).join(more, "token_id")
    spelled = F.transform("vec", lambda x: F.round(x * 1_000_000).cast("long").cast("string"))
    return added.select("token", "token_id", F.array_join(spelled, ",").alias("millionths"))


@query
def pack_assign(spark: SparkSession, folder: str) -> DataFrame:
    samples = flows.chat_samples(spark, folder).drop("slots")
    return flows.assigned(samples, CHAT).select("conv_id", "turn", "n_tokens", "pack_id", "sample_ord")


@query
def pack_assign_capped(spark: SparkSession, folder: str) -> DataFrame:
    samples = flows.chat_samples(spark, folder, CHAT_CAPPED).drop("slots")
    return flows.assigned(samples, CHAT_CAPPED).select("conv_id", "turn", "n_tokens", "pack_id", "sample_ord")


@query
def pack_oversize(spark: SparkSession, folder: str) -> DataFrame:
    samples = flows.document_samples(spark, folder).drop("slots")
    return flows.assigned(samples, DOCS).select("doc_id", "n_tokens", "pack_id", "sample_ord")


ORDERS = DOCS.with_(seq_length=4096, max_samples=64)


def _order_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as samples, in order number; the customer number makes the length."""
    return load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("pos"), (F.pmod("o_custkey", F.lit(500)) + 1).cast("int").alias("n_tokens")
    )


@query
def pack_assign_orders(spark: SparkSession, folder: str) -> DataFrame:
    return flows.assigned(_order_samples(spark, folder), ORDERS)


@query
def pack_rows(spark: SparkSession, folder: str) -> DataFrame:
    packs, _ = flows.packed(flows.chat_samples(spark, folder, CHAT_CAPPED), CHAT_CAPPED)
    return packs.select("pack_id", "num_segments", *[joined(c).alias(c) for c in PACK_FIELDS])


@query
def pack_rows_words(spark: SparkSession, folder: str) -> DataFrame:
    config = CHAT_CAPPED.with_(seq_length=1024)
    packs, _ = flows.packed(flows.word_samples(spark, folder, config), config)
    return packs.select("pack_id", "num_segments", *[joined(c).alias(c) for c in PACK_FIELDS])


@query
def pack_rows_oversize(spark: SparkSession, folder: str) -> DataFrame:
    packs, _ = flows.packed_documents(spark, folder)
    return packs.select("pack_id", "num_segments", *[joined(c).alias(c) for c in PACK_FIELDS])


@query
def pack_sources(spark: SparkSession, folder: str) -> DataFrame:
    packs, _ = flows.packed_documents(spark, folder)
    return packs.select("pack_id", F.array_join("source_ids", ",").alias("source_ids"))


@query
def pack_fill_rate(spark: SparkSession, folder: str) -> DataFrame:
    return fill_rate(flows.chat_samples(spark, folder, CHAT_CAPPED), CHAT_CAPPED)


def fill_rate(samples: DataFrame, config) -> DataFrame:
    packs = assemble_packs(samples, plan_packs(samples, config))
    used = F.col("n_tokens")
    return packs.select(
        "pack_id",
        "num_segments",
        used.alias("used_tokens"),
        F.round(used / F.lit(config.seq_length), 6).alias("fill_rate"),
    )


# Samples of a window in the windowed queries; the library's own default would be one window here.
SMALL_WINDOW = 32


def _by_strategy(spark: SparkSession, folder: str, strategy: str, window: int = WINDOW_ROWS) -> DataFrame:
    config = CHAT_CAPPED.with_(strategy=strategy)
    return assign_by_strategy(flows.chat_samples(spark, folder, config), config, window)


@query
def pack_first_fit(spark: SparkSession, folder: str) -> DataFrame:
    return _by_strategy(spark, folder, "first_fit")


@query
def pack_pool(spark: SparkSession, folder: str) -> DataFrame:
    return _by_strategy(spark, folder, "pool")


@query
def pack_first_fit_windows(spark: SparkSession, folder: str) -> DataFrame:
    return _by_strategy(spark, folder, "first_fit", SMALL_WINDOW)


@query
def pack_pool_windows(spark: SparkSession, folder: str) -> DataFrame:
    return _by_strategy(spark, folder, "pool", SMALL_WINDOW)


@query
def packed_table(spark: SparkSession, folder: str) -> DataFrame:
    """Packed rows written as a partitioned table and read back."""
    packs, _ = flows.packed(flows.chat_samples(spark, folder, CHAT_CAPPED), CHAT_CAPPED)
    path = new_path(spark, "packed")
    save(packs, path, partition_by=("num_segments",))
    back = spark.read.parquet(path)
    return back.groupBy("num_segments").agg(
        F.count("*").alias("n_packs"), F.sum(F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)).alias("n_tokens")
    )


# --- order and batches --------------------------------------------------------------------------

SEED = 42
BATCH = 8


def _chat_packs(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    packs, plan = flows.packed(flows.chat_samples(spark, folder, CHAT_CAPPED), CHAT_CAPPED)
    return packs, plan.n_packs


def _order_plan(spark: SparkSession, folder: str) -> int:
    return plan_packs(_order_samples(spark, folder), ORDERS).n_packs


@query
def shuffle_order(spark: SparkSession, folder: str) -> DataFrame:
    return batches.shuffled_order(spark, _order_plan(spark, folder), SEED)


@query
def pack_first_fit_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Every sample of a first fit in levels, its tokens, and whether its pack holds no more than it may."""
    samples = _order_samples(spark, folder).select("pos", F.col("n_tokens").cast("long").alias("n_tokens"))
    placed = stage(assign_first_fit(samples, ORDERS, 64), "levelled").join(samples, "pos")
    packs = placed.groupBy("pack_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("held"), F.max("sample_ord").alias("last"))
    fits = (F.col("used") <= ORDERS.seq_length) & (F.col("held") <= ORDERS.sample_cap) & (F.col("last") == F.col("held") - 1)
    return placed.join(packs.select("pack_id", fits.alias("fits")), "pack_id").select("pos", "n_tokens", "fits")


#: Packs the reservoir holds.
RESERVOIR = 100


@query
def shuffle_buffer(spark: SparkSession, folder: str) -> DataFrame:
    return batches.shuffled_order(spark, _order_plan(spark, folder), SEED, buffer=100)


@query
def shuffle_reservoir(spark: SparkSession, folder: str) -> DataFrame:
    """Packs in the order in which they leave a reservoir of a hundred."""
    return reservoir_order(spark, _order_plan(spark, folder), RESERVOIR, SEED)


@query
def batch_assign(spark: SparkSession, folder: str) -> DataFrame:
    packs, n = _chat_packs(spark, folder)
    ordered = batches.order_packs(packs.select("pack_id", "num_segments"), n, CHAT.with_(shuffle=True, seed=SEED))
    return batches.assign_batches(ordered, n, BATCH)


@query
def batch_keep_partial(spark: SparkSession, folder: str) -> DataFrame:
    packs, n = _chat_packs(spark, folder)
    ordered = batches.order_packs(packs.select("pack_id", "num_segments"), n, CHAT)
    return batches.assign_batches(ordered, n, BATCH, drop_last=False)


def _collated(spark: SparkSession, folder: str, mode: str, length: int) -> DataFrame:
    packs, n = _chat_packs(spark, folder)
    batched = batches.assign_batches(batches.order_packs(packs, n, CHAT), n, BATCH)
    rows = batches.collate(batched.drop("source_ids"), length, mode)
    flat = [joined(F.flatten(c)).alias(c) for c in PACK_FIELDS]
    return rows.select("batch_id", "n_rows", *flat, joined("num_segments").alias("num_segments"))


@query
def collate_keep_end(spark: SparkSession, folder: str) -> DataFrame:
    return _collated(spark, folder, "keep_end", 5000)


@query
def collate_keep_start(spark: SparkSession, folder: str) -> DataFrame:
    return _collated(spark, folder, "keep_start", 5000)


@query
def collate_pad(spark: SparkSession, folder: str) -> DataFrame:
    return _collated(spark, folder, "keep_end", 7000)


# --- unpacking ----------------------------------------------------------------------------------


@query
def segment_decode(spark: SparkSession, folder: str) -> DataFrame:
    packs, _ = _chat_packs(spark, folder)
    tokens = unpack.decode_segments(packs, NUM_SLOTS)
    return tokens.groupBy("pack_id", "sample_id", "slot").agg(
        F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")
    )


def _bounds(info: DataFrame, key: str) -> DataFrame:
    return info.select(
        key,
        "num_samples",
        *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("sample_starts", "sample_lengths")],
    )


@query
def sample_bounds(spark: SparkSession, folder: str) -> DataFrame:
    packs, _ = _chat_packs(spark, folder)
    return _bounds(unpack.sample_info(packs), "pack_id")


@query
def sample_bounds_unmasked(spark: SparkSession, folder: str) -> DataFrame:
    packs, _ = _chat_packs(spark, folder)
    return _bounds(unpack.sample_info(packs, use_mask=False), "pack_id")


@query
def batch_sample_info(spark: SparkSession, folder: str) -> DataFrame:
    packs, n = _chat_packs(spark, folder)
    batched = batches.assign_batches(batches.order_packs(packs, n, CHAT), n, BATCH, drop_last=False)
    return _bounds(unpack.sample_info(batched, by="batch_id"), "batch_id")


@query
def bucketed_sample_info(spark: SparkSession, folder: str) -> DataFrame:
    """As ``batch_sample_info``, from a table in buckets of the batch."""
    packs, n = _chat_packs(spark, folder)
    batched = batches.assign_batches(batches.order_packs(packs, n, CHAT), n, BATCH, drop_last=False)
    stored = _bucketed(batched, "packs", "pack_seq")
    return _bounds(unpack.sample_info(stored, by="batch_id"), "batch_id")


@query
def split_samples(spark: SparkSession, folder: str) -> DataFrame:
    packs, _ = _chat_packs(spark, folder)
    split = unpack.split_samples(packs, use_mask=True)
    return split.select(
        "pack_id", "sample_ord", "start", "length", joined("input_ids").alias("input_ids"), joined("segment_ids").alias("segment_ids")
    )


# --- quality ------------------------------------------------------------------------------------


def _shifted(packs: DataFrame) -> DataFrame:
    """Packs whose position ids run through without a restart, as a faulty packer would write."""
    along = F.transform("segment_ids", lambda s, i: F.when(s >= 0, i).otherwise(F.lit(0)))
    return packs.withColumn("position_ids", along)


@query
def position_check(spark: SparkSession, folder: str) -> DataFrame:
    """Wrong positions per pack: of the packs as they are, and of packs without restarts."""
    packs, _ = _chat_packs(spark, folder)
    count = F.count("*").alias("n_errors")
    good = packs.select("pack_id").join(
        quality.position_errors(packs).groupBy("pack_id").agg(count), "pack_id", "left"
    )
    faulty = quality.position_errors(_shifted(packs)).groupBy("pack_id").agg(count.alias("n_faulty"))
    return good.join(faulty, "pack_id", "left").fillna(0)


@query
def sample_id_check(spark: SparkSession, folder: str) -> DataFrame:
    packs, _ = _chat_packs(spark, folder)
    return quality.sample_id_errors(packs, NUM_SLOTS)


@query
def slot_order_check(spark: SparkSession, folder: str) -> DataFrame:
    packs, _ = _chat_packs(spark, folder)
    return quality.slot_order_errors(packs, NUM_SLOTS)


@query
def overlap_check(spark: SparkSession, folder: str) -> DataFrame:
    packs, _ = _chat_packs(spark, folder)
    return quality.overlap_errors(packs, NUM_SLOTS)


@query
def split_check(spark: SparkSession, folder: str) -> DataFrame:
    """Samples split from packs against what went in; the count of both sides and of differences."""
    samples = flows.chat_samples(spark, folder, CHAT_CAPPED)
    plan = plan_packs(samples, CHAT_CAPPED)
    packs, _ = flows.packed(samples, CHAT_CAPPED)
    flows_in = flows.assign_packs(samples, plan).withColumn("tokens", F.flatten("slots"))
    wrong = quality.split_mismatches(unpack.split_samples(packs, use_mask=True), flows_in)
    counts = flows_in.agg(F.count("*").alias("n_samples"), F.lit(1).alias("one"))
    errors = wrong.agg(F.count("*").alias("n_mismatches"), F.lit(1).alias("one"))
    return counts.join(errors, "one").drop("one")


@query
def missing_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations without a packed sample."""
    chats = load(spark, folder, "conversations").select("conv_id")
    return quality.id_differences(chats, flows.chat_samples(spark, folder), "conv_id")


@query
def missing_ids_bitmaps(spark: SparkSession, folder: str) -> DataFrame:
    """As ``missing_ids``, by comparing bitmaps."""
    chats = load(spark, folder, "conversations").select("conv_id")
    return id_bitmaps.id_differences(chats, flows.chat_samples(spark, folder), "conv_id")


@query
def coverage_check(spark: SparkSession, folder: str) -> DataFrame:
    expected = load(spark, folder, "documents").count()
    seen = flows.document_samples(spark, folder).agg(F.count("*").alias("n_seen"))
    result = quality.coverage(seen, expected, *quality.MULTI_FILE_COVERAGE)
    return result.withColumn("coverage", F.round("coverage", 6))


@query
def pack_totals(spark: SparkSession, folder: str) -> DataFrame:
    packs, _ = _chat_packs(spark, folder)
    return quality.pack_totals(packs)


@query
def sample_cap_check(spark: SparkSession, folder: str) -> DataFrame:
    """Packs made without a cap that hold more samples than one would allow."""
    packs, _ = flows.packed(flows.chat_samples(spark, folder), CHAT)
    return quality.over_cap(packs, 5)


@query
def first_token_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """First tokens of the capped packs that also begin packs made without a cap."""
    before, _ = flows.packed(flows.chat_samples(spark, folder), CHAT)
    after, _ = _chat_packs(spark, folder)
    return quality.repeated_first_tokens(before, after)


@query
def first_token_overlap_bitmaps(spark: SparkSession, folder: str) -> DataFrame:
    """As ``first_token_overlap``, each token once, by comparing bitmaps."""
    before, _ = flows.packed(flows.chat_samples(spark, folder), CHAT)
    after, _ = _chat_packs(spark, folder)
    first = F.col("input_ids")[0].alias("first_token")
    return id_bitmaps.common_ids(before.select(first), after.select(first), "first_token")


@query
def generated_triplets(spark: SparkSession, folder: str) -> DataFrame:
    """Test triplets made from all documents."""
    short = F.concat_ws(" ", "lang", "source").alias("short")
    texts = load(spark, folder, "documents").select(F.col("doc_id").alias("sample_id"), short, "text")
    made = quality.generated_triplets(texts)
    return made.select("sample_id", *[F.md5(c).alias(c) for c in ("anchor", "positive", "negative")])


# --- files, positions and resuming --------------------------------------------------------------


#: Bytes of text in a file of triplets, about: one task sorts and writes it.
FILE_BYTES = 64 << 20


def _files_for(spark: SparkSession, folder: str, least: int) -> int:
    """Files for the triplets of all documents, each of whose texts is in three lines: they grow with the texts."""
    return max(least, -(-3 * text_bytes(load(spark, folder, "documents")) // FILE_BYTES))


def _written_lines(spark: SparkSession, lines: DataFrame, label: str) -> str:
    """Files of lines, one of each partition and in its order."""
    path = new_path(spark, label)
    with shuffles_freed(spark):
        lines.write.option("compression", "none").format("text").save(path)
    return path


def _written_triplets(spark: SparkSession, folder: str) -> str:
    """Document triplets as JSON lines over several files in document order; every third of the
    lines has a text, a list or no negative."""
    files = _files_for(spark, folder, 6)
    texts = document_triplets(load(spark, folder, "documents"), load(spark, folder, "labels"), files)
    texts = select_fields(texts).select("doc_id", "anchor", "positive", F.col("negatives")[0].alias("negative"))
    shapes = [
        F.to_json(F.struct("anchor", "positive", "negative", "doc_id"), {"ignoreNullFields": "false"}),
        F.to_json(F.struct("anchor", "positive", F.array("negative").alias("negative"), "doc_id")),
        F.to_json(F.struct("anchor", "positive", "doc_id")),
    ]
    shape = F.pmod("doc_id", F.lit(3))
    line = F.when(shape == 0, shapes[0]).when(shape == 1, shapes[1]).otherwise(shapes[2])
    return _written_lines(spark, texts.select(line.alias("value")), "triplets")


def _mixed_lines(spark: SparkSession, folder: str) -> str:
    """Document triplets as JSON lines, of which some are broken off or have a null among the negatives."""
    files = _files_for(spark, folder, 5)
    texts = document_triplets(load(spark, folder, "documents"), load(spark, folder, "labels"), files)
    texts = select_fields(texts).select("doc_id", "anchor", "positive", F.col("negatives")[0].alias("negative"))
    source = F.col("doc_id").cast("string").alias("__source__")
    nulls = F.array(F.lit(None).cast("string")).alias("negative")
    whole = F.to_json(F.struct("anchor", "positive", "negative", source), {"ignoreNullFields": "false"})
    listed = F.to_json(F.struct("anchor", "positive", nulls, source), {"ignoreNullFields": "false"})
    kind = F.pmod("doc_id", F.lit(10))
    broken = F.concat(F.lit("{"), F.expr("substring(whole, 2, length(whole) - 3)"))
    line = F.when(kind == 7, broken).when(kind == 5, F.col("listed")).otherwise(F.col("whole"))
    rows = texts.select("doc_id", whole.alias("whole"), listed.alias("listed"))
    return _written_lines(spark, rows.select(line.alias("value")), "lines")


@query
def row_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of every line of data files: samples, and the reasons for the others, to the last line."""
    rows = pipeline.read_rows(spark, _mixed_lines(spark, folder) + "/*.txt", codepoints, CHAT)
    return pipeline.outcomes(rows, CHAT)


@query
def recursive_discovery(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of data files in folders below the one given, a folder for each source."""
    texts = load(spark, folder, "documents").select("doc_id", F.col("text").alias("anchor"), "source")
    path = new_path(spark, "nested")
    texts.write.partitionBy("source").option("compression", "none").json(path)
    rows = jsonl.parse_triplets(jsonl.read_lines(spark, path, recursive=True), extras=DOC_ID)
    return rows.select("doc_id", F.md5("anchor").alias("anchor"), F.col("negatives")[0].alias("negative"))


RESUMED = CHAT.with_(shuffle=True, seed=SEED, batch_size=4)


@query
def resume_shuffled(spark: SparkSession, folder: str) -> DataFrame:
    """How often each sample is used by a shuffled run that stops half way and goes on from its saved state."""
    files = _mixed_lines(spark, folder) + "/*.txt"
    data = pipeline.load_packed(spark, files, codepoints, RESUMED)
    half = data.n_packs // RESUMED.batch_size // 2
    used = data.batches(drop_last=False).where(F.col("batch_id") < half)
    saved = new_path(spark, "resume-state")
    save_state(spark, data.state_after(half), saved)
    again, done = pipeline.resume_packed(spark, files, codepoints, RESUMED, load_state(spark, saved))
    both = used.unionByName(again.batches(drop_last=False, skip=done))
    samples = both.select(F.explode(F.flatten("source_ids")).alias("source_id"))
    return samples.groupBy(F.col("source_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n_used"))


def _read_back(spark: SparkSession, folder: str, **options) -> DataFrame:
    return jsonl.with_positions(jsonl.read_lines(spark, _written_triplets(spark, folder) + "/*.txt"), **options)


def _doc_id() -> Column:
    return F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id")


@query
def jsonl_positions(spark: SparkSession, folder: str) -> DataFrame:
    numbers = _read_back(spark, folder, then=lambda lines: lines.select("*", _doc_id()).drop("value"))
    return numbers.select("pos", "doc_id")


@query
def jsonl_triplets(spark: SparkSession, folder: str) -> DataFrame:
    parsed = jsonl.parse_triplets(_read_back(spark, folder), extras=DOC_ID)
    return usable(parsed).select(
        "doc_id", "pos", F.md5(F.concat("anchor", "positive")).alias("texts"), F.col("negatives")[0].alias("negative")
    )


@query
def shard_list(spark: SparkSession, folder: str) -> DataFrame:
    """Lines per dataset over all its shards, and whether shards follow each other without a gap."""
    lines = jsonl.read_lines(spark, _written_triplets(spark, folder) + "/*.txt")
    shards = jsonl.list_shards(jsonl.index_splits(lines), jsonl.shard_names(lines))
    return shards.agg(F.sum("n_rows").alias("n_rows"), F.max(F.col("first_pos") + F.col("n_rows")).alias("end"))


def _source_shards(documents: DataFrame) -> DataFrame:
    counts = documents.groupBy(F.col("source").alias("shard_name")).agg(F.count("*").alias("n_rows"))
    return jsonl.list_shards(counts)


def _sharded_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their source as the shard: ``shard_index, row_index``.

    Rows are numbered over the sorted table and counted from the shard's first, so a large source is
    not one task's work.
    """
    documents = load(spark, folder, "documents").select("source", "doc_id", F.length("text").alias("n_tokens"))
    numbered = dense_positions(documents, "source", "doc_id")
    shards = _source_shards(numbered)
    placed = numbered.withColumnRenamed("source", "shard_name").join(shards, "shard_name")
    return placed.withColumn("row_index", F.col("pos") - F.col("first_pos"))


RESUME = ResumeState(shard_index=7, row_index=20)


@query
def resume_explicit(spark: SparkSession, folder: str) -> DataFrame:
    """Rows from an explicit start on, which wins over the saved one."""
    rows = resume.resume_from(_sharded_documents(spark, folder), RESUME, 9, 5)
    return rows.select("doc_id", "shard_index", "row_index")


@query
def saved_states(spark: SparkSession, folder: str) -> DataFrame:
    """A state for each dataset (source), moved to its end, saved, loaded and taken apart again."""
    state = initial_state([])
    for shard in _source_shards(load(spark, folder, "documents")).collect():
        own = ResumeState().moved(shard["shard_index"], shard["n_rows"], step=shard["first_pos"]).stamped(shard["first_pos"], 1)
        entry = {"shard_index": own.shard_index, "row_index": own.row_index, "step": own.step, "epoch": own.epoch}
        state.dataset_states[shard["shard_name"]] = entry
    path = new_path(spark, "states")
    save_state(spark, state.moved(1, 2).rewound(), path)
    loaded = load_state(spark, path)
    rows = [(name, own.shard_index, own.row_index, own.step, own.epoch) for name in loaded.dataset_states if (own := loaded.of_dataset(name))]
    return spark.createDataFrame(rows, "name string, shard_index int, row_index long, step int, epoch int")


@query
def state_history(spark: SparkSession, folder: str) -> DataFrame:
    """Five saves at fifths of the documents, all of which a log keeps, and which one is the newest."""
    n, path = load(spark, folder, "documents").count(), new_path(spark, "state-log")
    for step in range(1, 6):
        state_log.append(spark, ResumeState(row_index=n * step // 5, step=step), path)
    newest = state_log.latest(spark, path)
    return state_log.history(spark, path).select("entry", "row_index", "step", (F.col("step") == newest.step).alias("newest"))


@query
def seek_open_at_row(spark: SparkSession, folder: str) -> DataFrame:
    """The second half of the lines of data files, opened at a row through the index of byte offsets."""
    index = seek.build_index(spark, _written_triplets(spark, folder) + "/*.txt")
    n = spark.read.parquet(index).agg(F.sum("n_rows")).first()[0]
    return seek.open_at(spark, index, seek.state_at(spark, index, n // 2)).select(_doc_id())


@query
def stream_then_batch(spark: SparkSession, folder: str) -> DataFrame:
    """A stream that stops inside of a file, goes on and stops again, and a batch from its position to the end."""
    index = seek.build_index(spark, _written_triplets(spark, folder) + "/*.txt")
    n = spark.read.parquet(index).agg(F.sum("n_rows")).first()[0]
    sink, checkpoint = new_path(spark, "lines-read"), new_path(spark, "lines-state")
    for part in (5, 3):
        stop = seek.state_at(spark, index, n // part)
        run_available(seek.stream_from(spark, index, end=(stop.shard_index, stop.row_index)), checkpoint, sink)
    rest = seek.open_at(spark, index, seek.stream_state(spark, checkpoint))
    both = spark.read.parquet(sink).withColumn("by", F.lit("stream")).unionByName(rest.withColumn("by", F.lit("batch")))
    return both.select(_doc_id(), "by")


@query
def undeclared_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Nested fields of the lines that no schema names, read back from the packs of their samples."""
    documents = load(spark, folder, "documents")
    meta = F.struct("lang", "n_chars", F.array("source", "lang").alias("tags"))
    line = F.to_json(F.struct(F.col("text").alias("anchor"), F.lit("p").alias("positive"), "doc_id", meta.alias("meta")))
    path = new_path(spark, "records")
    documents.select(line.alias("value")).write.option("compression", "none").format("text").save(path)
    rows = jsonl.parse_triplets(jsonl.with_positions(jsonl.read_lines(spark, path + "/*.txt")), record="record")
    samples = rows.select("pos", F.coalesce(F.length("anchor"), F.lit(0)).alias("n_tokens"), "record")
    packs = pack_records(stage(samples, "recorded"), DOCS)
    record = packs.select(F.explode("records").alias("line")).select(F.parse_json("line").alias("record"))
    found = {"doc_id": "$.doc_id", "lang": "$.meta.lang", "n_chars": "$.meta.n_chars", "tag": "$.meta.tags[0]"}
    kinds = {"doc_id": "long", "lang": "string", "n_chars": "long", "tag": "string"}
    return record.select(*(jsonl.other_field("record", path, kinds[name]).alias(name) for name, path in found.items()))


@query
def latest_checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    """The state in the newest of several checkpoints, one for each type of event, named by their number."""
    counts = load(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    path = new_path(spark, "checkpoints")
    for row in counts.collect():
        save_checkpoint_state(spark, ResumeState(row_index=row["last"]), f"{path}/step-{row['n']}-{row['event_type']}")
    newest = load_latest_checkpoint_state(spark, path)
    return spark.createDataFrame([(newest.shard_index, newest.row_index)], "shard_index int, row_index long")


@query
def saved_table(spark: SparkSession, folder: str) -> DataFrame:
    """A table that replaces another one under the same path."""
    documents, path = load(spark, folder, "documents"), new_path(spark, "table")
    save(documents.groupBy("source").agg(F.count("*").alias("n_rows")), path)
    save(documents.groupBy("lang").agg(F.count("*").alias("n_rows")), path, overwrite=True)
    return spark.read.parquet(path)


@query
def sample_positions(spark: SparkSession, folder: str) -> DataFrame:
    return quality.sample_positions(_sharded_documents(spark, folder), "doc_id")


@query
def shard_count(spark: SparkSession, folder: str) -> DataFrame:
    placed = _sharded_documents(spark, folder).join(load(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    return quality.shards_per_dataset(placed, "lang")


@query
def shard_select(spark: SparkSession, folder: str) -> DataFrame:
    return jsonl.select_shards(_sharded_documents(spark, folder), [0, 3, 11]).select("doc_id", "shard_index", "row_index")


@query
def shard_open_at_row(spark: SparkSession, folder: str) -> DataFrame:
    return jsonl.open_shard(_sharded_documents(spark, folder), "src12", 10).select("doc_id", "row_index")


@query
def resume_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = resume.resume_from(_sharded_documents(spark, folder), RESUME)
    return rows.select("doc_id", "shard_index", "row_index")


@query
def resume_shards(spark: SparkSession, folder: str) -> DataFrame:
    shards = _source_shards(load(spark, folder, "documents"))
    return resume.shards_to_read(shards, RESUME)


@query
def resume_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Where reading goes on when half of the packs have been used."""
    samples = _sharded_documents(spark, folder)
    plan = plan_packs(samples, DOCS.with_(seq_length=4096))
    return resume.progress(flows.assign_packs(samples, plan), plan.n_packs // 2)


@query
def resume_last_read(spark: SparkSession, folder: str) -> DataFrame:
    return resume.emitted_progress(_sharded_documents(spark, folder))


def _checkpoint_names(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    name = F.when(kind == "error", kind).otherwise(F.concat_ws("-", kind, "event_id", F.lit("v2")))
    return load(spark, folder, "events").select(name.alias("name"))


@query
def checkpoint_step(spark: SparkSession, folder: str) -> DataFrame:
    named = with_checkpoint_step(_checkpoint_names(spark, folder))
    return named.groupBy("checkpoint_step").agg(F.count("*").alias("n"))


@query
def resume_latest(spark: SparkSession, folder: str) -> DataFrame:
    named = with_checkpoint_step(_checkpoint_names(spark, folder))
    return named.agg(F.max("checkpoint_step").alias("checkpoint_step"), F.max_by("name", "checkpoint_step").alias("name"))


# --- vectors ------------------------------------------------------------------------------------

MAX_SAMPLES = 3
ROW_TOKENS = 40
#: Samples that a row of ``_token_table`` holds: segments 0 to 11, three slots each.
ROW_SAMPLES = 4


def _token_table(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as the token vectors of packed rows of 40 tokens: three tokens to a segment,
    four padding positions and two unattended ones at the end of each row."""
    pos = F.pmod("vec_id", F.lit(ROW_TOKENS)).cast("int")
    return load(spark, folder, "embeddings").select(
        floor_div("vec_id", ROW_TOKENS).alias("pack_id"),
        pos.alias("pos"),
        F.when(pos < 36, floor_div(pos, 3).cast("int")).otherwise(F.lit(-1)).alias("segment_id"),
        (pos < 38).alias("attended"),
        F.col("embedding").alias("vec"),
    )


VECTOR_SIZE = 64


@query
def last_token_pool(spark: SparkSession, folder: str) -> DataFrame:
    pooled = pooling.last_token_vectors(_token_table(spark, folder), MAX_SAMPLES)
    return _rounded_dims(pooled, "pack_id", "sample_id", "slot")


@query
def dropped_segments(spark: SparkSession, folder: str) -> DataFrame:
    return pooling.dropped_segments(_token_table(spark, folder), MAX_SAMPLES)


@query
def slot_grid(spark: SparkSession, folder: str) -> DataFrame:
    """A grid of four samples, the last of them absent."""
    tokens = _token_table(spark, folder)
    pooled = pooling.last_token_vectors(tokens, MAX_SAMPLES)
    grid = pooling.slot_grid(pooled, tokens.select("pack_id").distinct(), 4, 1, VECTOR_SIZE)
    return _rounded_dims(grid, "pack_id", "sample_id", "slot", "present")


@query
def last_position(spark: SparkSession, folder: str) -> DataFrame:
    tokens = _token_table(spark, folder)
    both = pooling.last_position_vectors(tokens).withColumn("masked", F.lit(False)).unionByName(
        pooling.last_position_vectors(tokens, masked=True).withColumn("masked", F.lit(True))
    )
    unit = both.withColumn("vec", normalize("vec"))
    return _rounded_dims(unit, "pack_id", "masked")


@query
def l2_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings by label: plain, and zeroed where the label is 0."""
    rows = load(spark, folder, "embeddings").select("vec_id", normalize("embedding", F.col("label") != 0).alias("vec"))
    return _rounded_dims(rows, "vec_id")


@query
def mean_pool(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_dims(pooling.mean_vectors(_token_table(spark, folder), "pack_id"), "pack_id")


@query
def cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each embedding with the one numbered after it."""
    vectors = load(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return vectors.join(following, "vec_id").select("vec_id", F.round(cosine("a", "b"), 6).alias("similarity"))


@query
def vector_stats(spark: SparkSession, folder: str) -> DataFrame:
    valid = _token_table(spark, folder).where("attended")
    stats = pooling.vector_stats(valid, "pack_id")
    return stats.select("pack_id", "n_valid", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")])


def projection_layers(sizes: list[int]) -> list[pooling.Layer]:
    """Weights from a rule: entry (i, j) is cos(i + 2 j) / 8, bias j is sin(j) / 10."""
    layers = []
    for rows, columns in zip(sizes, sizes[1:]):
        i, j = np.arange(rows)[:, None], np.arange(columns)[None, :]
        layers.append((np.cos(i + 2 * j) / 8, np.sin(np.arange(columns)) / 10))
    return layers


def _projected(spark: SparkSession, folder: str, out: int) -> DataFrame:
    layers = projection_layers(pooling.layer_sizes(VECTOR_SIZE, out))
    vectors = load(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return _rounded_dims(pooling.project(vectors, layers), "vec_id")


@query
def project_linear(spark: SparkSession, folder: str) -> DataFrame:
    return _projected(spark, folder, 32)


@query
def project_gelu(spark: SparkSession, folder: str) -> DataFrame:
    return _projected(spark, folder, 20)


@query
def project_identity(spark: SparkSession, folder: str) -> DataFrame:
    return _projected(spark, folder, 64)


# --- contrastive loss ---------------------------------------------------------------------------


def _slot_vectors(spark: SparkSession, folder: str, num_negatives: int, batch: int | None) -> DataFrame:
    """Neighbouring embeddings as anchor, positive and negatives of one sample."""
    slots = 2 + num_negatives
    sample = floor_div("vec_id", slots)
    return load(spark, folder, "embeddings").select(
        (F.lit(0) if batch is None else floor_div(sample, batch)).cast("long").alias("batch_id"),
        sample.alias("sample_key"),
        F.pmod("vec_id", F.lit(slots)).cast("int").alias("slot"),
        F.col("embedding").alias("vec"),
    )


METRICS = ("loss", "accuracy", "valid_samples", "pos_sim_mean", "neg_sim_mean")


def _metrics(result: DataFrame, *keys: str) -> DataFrame:
    return result.select(*keys, *[F.round(c, 6).alias(c) for c in METRICS])


#: Samples of a large batch; the work of a batch grows with their square, that of the table does not.
LOSS_BATCH = 128


@query
def infonce_loss(spark: SparkSession, folder: str) -> DataFrame:
    """Loss of every batch of ``LOSS_BATCH`` samples."""
    vectors = _slot_vectors(spark, folder, 1, LOSS_BATCH)
    result = contrastive.infonce(vectors, 1, VECTOR_SIZE, [0.07])
    return result.select("batch_id", F.round("loss", 6).alias("loss"))


@query
def infonce_metrics(spark: SparkSession, folder: str) -> DataFrame:
    result = contrastive.infonce(_slot_vectors(spark, folder, 1, 32), 1, VECTOR_SIZE, [0.07])
    return _metrics(result, "batch_id")


@query
def bucketed_infonce(spark: SparkSession, folder: str) -> DataFrame:
    """As ``infonce_metrics``, from a table in buckets of the batch."""
    stored = _bucketed(_slot_vectors(spark, folder, 1, 32), "vectors", "sample_key")
    return _metrics(contrastive.infonce(stored, 1, VECTOR_SIZE, [0.07]), "batch_id")


@query
def infonce_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Large batches over many small blocks each."""
    result = contrastive.infonce(_slot_vectors(spark, folder, 2, LOSS_BATCH), 2, VECTOR_SIZE, [0.07], block=64)
    return _metrics(result, "batch_id")


@query
def infonce_temperature_sweep(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _slot_vectors(spark, folder, 1, 32)
    result = contrastive.infonce(vectors, 1, VECTOR_SIZE, [0.05, 0.07, 0.1])
    return _metrics(result, "batch_id", "temperature")


@query
def infonce_negative_sweep(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _slot_vectors(spark, folder, 3, 32)
    result = contrastive.infonce(vectors, 3, VECTOR_SIZE, [0.07], [1, 2, 3])
    return _metrics(result, "batch_id", "num_negatives")


@query
def anchor_losses(spark: SparkSession, folder: str) -> DataFrame:
    triples = contrastive.sample_triples(_slot_vectors(spark, folder, 1, 32), 1, VECTOR_SIZE)
    scores = contrastive.anchor_scores(triples, 1, [0.07])
    return scores.select(
        "batch_id", "sample_key", *[F.round(c, 6).alias(c) for c in ("pos_sim", "neg_max", "neg_lse", "loss")]
    )


@query
def evaluate_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Token vectors of packed rows to metrics: pool, normalise, project, normalise, score. All samples of a row."""
    pooled = pooling.last_token_vectors(_token_table(spark, folder), ROW_SAMPLES)
    unit = pooled.withColumn("vec", normalize("vec"))
    projected = pooling.project(unit, projection_layers([VECTOR_SIZE, 32])).withColumn("vec", normalize("vec"))
    vectors = projected.select(
        floor_div("pack_id", 4).alias("batch_id"),
        F.concat_ws("-", "pack_id", "sample_id").alias("sample_key"),
        "slot",
        "vec",
    )
    return _metrics(contrastive.infonce(vectors, 1, 32, [0.07]), "batch_id")


# --- streams ------------------------------------------------------------------------------------


#: Files of one micro-batch.
STREAM_FILES = 64


def _document_feed(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as a stream."""
    table = load(spark, folder, "documents")
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", STREAM_FILES)
    # The table is a folder of files, or one file that is named like it.
    if any(name.endswith("/documents.parquet") for name in table.inputFiles()):
        return reader.option("pathGlobFilter", "documents.parquet").parquet(folder)
    return reader.parquet(f"{folder}/documents.parquet")


def _lane_samples(documents: DataFrame, lanes: int) -> DataFrame:
    return documents.select(
        lane_of(F.lit("documents"), F.col("doc_id"), lanes).alias("lane"),
        F.col("doc_id").alias("sample_key"),
        F.array(codepoints("text"), codepoints("lang"), codepoints("source")).alias("slots"),
        F.col("source").alias("source_id"),
    )


def _lane_packs(packs: DataFrame) -> DataFrame:
    return packs.select(
        "lane",
        "pack_no",
        "num_segments",
        joined("sample_keys").alias("sample_keys"),
        joined("input_ids").alias("input_ids"),
        F.md5(F.array_join("source_ids", ",")).alias("source_ids"),
    )


@query
def stream_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as a stream over lanes; all packs, those still open when the input is used up as well."""
    lanes = lanes_for(load(spark, folder, "documents").count())
    sink, checkpoint = new_path(spark, "stream-packs"), new_path(spark, "stream-state")
    stream = pack_stream(_lane_samples(_document_feed(spark, folder), lanes), DOCS)
    with small_batches(spark):
        run_available(stream, checkpoint, sink)
    packs = spark.read.schema(stream.schema).parquet(sink).unionByName(open_packs(spark, checkpoint, DOCS))
    return _lane_packs(packs)


@query
def stream_after_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The lower half of the documents packed as a batch, the upper half by a stream that begins with the open packs."""
    table = load(spark, folder, "documents")
    low, high, n = table.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    lanes, middle = lanes_for(n), ((low or 0) + (high or 0)) // 2
    packed = pack_lanes(_lane_samples(over_all_cores(table.where(F.col("doc_id") <= middle), "doc_id"), lanes), DOCS)
    later = _document_feed(spark, folder).where(F.col("doc_id") > middle)
    stream = continue_lanes(_lane_samples(later, lanes), DOCS, stage(carried(packed), "open-packs"))
    sink, checkpoint = new_path(spark, "stream-packs"), new_path(spark, "stream-state")
    with rocksdb_state(spark), small_batches(spark):
        run_available(stream, checkpoint, sink)
    streamed = spark.read.schema(stream.schema).parquet(sink).unionByName(left_open(spark, checkpoint, DOCS))
    return _lane_packs(closed_packs(packed, DOCS).unionByName(streamed))


@query
def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Triplet files read as a stream, two files at a time, into a table."""
    texts = document_triplets(load(spark, folder, "documents"), load(spark, folder, "labels"))
    path, sink = new_path(spark, "feed"), new_path(spark, "ingested")
    rows = select_fields(texts).select("doc_id", "anchor", "positive", F.col("negatives")[0].alias("negative"))
    with shuffles_freed(spark):
        rows.write.json(path, ignoreNullFields=False)
    # The feed is for this stream alone.
    stream = stream_triplets(spark, path, 2, extras=DOC_ID, delete_read=True)
    run_available(stream, new_path(spark, "feed-state"), sink)
    rows = spark.read.parquet(sink)
    return usable(rows).select("doc_id", F.length("anchor").alias("anchor_chars"), F.length(F.col("negatives")[0]).alias("negative_chars"))


@query
def stream_once(spark: SparkSession, folder: str) -> DataFrame:
    """As ``stream_ingest``, with every micro-batch run twice over a sink in which it counts once."""
    texts = document_triplets(load(spark, folder, "documents"), load(spark, folder, "labels"))
    path, table = new_path(spark, "feed"), new_path(spark, "ledger")
    select_fields(texts).select("doc_id", "anchor", "positive", F.col("negatives")[0].alias("negative")).write.json(
        path, ignoreNullFields=False
    )
    stream, sink = stream_triplets(spark, path, 2, extras=DOC_ID), ledger.once(table, "triplets")

    def again(rows: DataFrame, number: int) -> None:
        sink(rows, number)
        sink(rows, number)

    run_available(stream, new_path(spark, "feed-state"), again)
    rows = ledger.read(spark, table, stream.schema)
    return usable(rows).select("doc_id", F.length("anchor").alias("anchor_chars"), F.length(F.col("negatives")[0]).alias("negative_chars"))
