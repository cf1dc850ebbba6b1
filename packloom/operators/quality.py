"""Checks on samples and packs. Each gives the violating rows or the counts to look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.functions.arrays import bind, each_element
from packloom.operators.unpack import sample_of, with_sample_bounds

# Accepted shares of samples that come out of the packing.
MIN_COVERAGE = 0.95
MULTI_FILE_COVERAGE = (0.90, 1.10)


def _counts_up() -> Column:
    """Whether a pack's positions are right at first sight: every segment is one run of tokens that
    counts up from 0, and padding is 0."""
    # Zipped once; inside a lambda, a column that is still an expression would run per token.
    tokens = F.transform(
        F.arrays_zip("segment_ids", "position_ids", "attention_mask"),
        lambda t: F.struct(
            F.when(t["attention_mask"] == 1, t["segment_ids"]).alias("segment"),
            t["position_ids"].alias("position"),
        ),
    )

    def of_token(now: Column, then: Column) -> Column:
        attended, segment, position = now["segment"].isNotNull(), now["segment"], now["position"]
        goes_on = segment == then["segment"]
        expected = F.when(goes_on, then["position"] + 1).otherwise(F.lit(0))
        inside = attended & (segment >= 0)
        right = F.when(inside, position == expected).when(attended, F.lit(True)).otherwise(position == 0)
        return F.struct(
            F.coalesce(right, F.lit(False)).alias("right"),
            F.when(inside & ~F.coalesce(goes_on, F.lit(False)), segment).alias("begins"),
        )

    def of_pack(tokens: Column) -> Column:
        before = F.concat(
            F.array(F.lit(None).cast("struct<segment:int,position:int>")),
            F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))),
        )
        return F.zip_with(tokens, before, of_token)

    def verdict(checked: Column) -> Column:
        begins = F.array_compact(F.transform(checked, lambda t: t["begins"]))
        return F.forall(checked, lambda t: t["right"]) & (F.size(begins) == F.size(F.array_distinct(begins)))

    return bind(bind(tokens, of_pack), verdict)


def position_errors(packs: DataFrame) -> DataFrame:
    """``pack_id, pos, segment_id, position_id``: positions that do not run 0, 1, 2, ... along
    their segment, and padding positions other than 0.

    Only packs that are not right at first sight have their tokens shuffled.
    """
    zipped = F.arrays_zip("segment_ids", "position_ids", "attention_mask")
    suspects = packs.where(~F.coalesce(_counts_up(), F.lit(False)))
    tokens = each_element(suspects, zipped, "pack_id", value="t").select(
        "pack_id",
        "pos",
        F.col("t.segment_ids").alias("segment_id"),
        F.col("t.position_ids").alias("position_id"),
        (F.col("t.attention_mask") == 1).alias("attended"),
    )
    # A segment has at most seq_length tokens.
    along = Window.partitionBy("pack_id", "segment_id", "attended").orderBy("pos")
    ranked = tokens.withColumn("expected", F.row_number().over(along) - 1)
    wrong = F.when(
        F.col("attended"), (F.col("segment_id") >= 0) & (F.col("position_id") != F.col("expected"))
    ).otherwise(F.col("position_id") != 0)
    return ranked.where(wrong).select("pack_id", "pos", "segment_id", "position_id")


def sample_id_errors(packs: DataFrame, num_slots: int) -> DataFrame:
    """Per pack: samples found that hold several sample ids, and neighbours that share one."""
    bounds = with_sample_bounds(packs, num_slots, use_mask=False)

    def ids_of_samples(segments: Column) -> Column:
        def distinct_ids(start: Column, length: Column) -> Column:
            ids = F.transform(F.slice(segments, start + 1, length), lambda s: sample_of(s, num_slots))
            return F.array_distinct(F.filter(ids, lambda sample: sample >= 0))

        return F.zip_with("sample_starts", "sample_lengths", distinct_ids)

    each = bind(F.col("segment_ids"), ids_of_samples)
    counted = bounds.select("pack_id", each.alias("ids"))
    mixed = F.size(F.filter("ids", lambda ids: F.size(ids) > 1))
    following = F.slice("ids", F.lit(2), F.greatest(F.size("ids") - 1, F.lit(0)))
    pairs = F.zip_with("ids", following, lambda a, b: F.coalesce(a[0] == b[0], F.lit(False)))
    return counted.select(
        "pack_id",
        F.size("ids").alias("n_samples"),
        mixed.alias("mixed_samples"),
        F.size(F.filter(pairs, lambda same: same)).alias("equal_neighbours"),
    )


def segment_runs(segments: Column | str) -> Column:
    """Runs of equal segment ids in a pack: ``segment, low, high`` with the first and last position.

    A pack has a run for each slot, so these can become rows where its tokens should not.
    """
    values = F.col(segments) if isinstance(segments, str) else segments

    def runs(starts: Column) -> Column:
        def run(start: Column, k: Column) -> Column:
            after = F.coalesce(F.get(starts, k + 1), F.size(values))
            return F.struct(F.get(values, start).alias("segment"), start.alias("low"), (after - 1).alias("high"))

        return F.transform(starts, run)

    places = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.array().cast("array<int>"))
    begins = F.filter(places, lambda i: (i == 0) | (F.get(values, i) != F.get(values, i - 1)))
    return bind(begins, runs)


def slot_order_errors(packs: DataFrame, num_slots: int) -> DataFrame:
    """``pack_id, sample_id`` with the steps between neighbouring slots that are not 0 or +1, the
    slots that are missing, and the slots that begin before the one before has ended."""
    runs = each_element(packs, segment_runs("segment_ids"), "pack_id", value="run").where(F.col("run.segment") >= 0)
    segment = F.col("run.segment")
    per_slot = runs.groupBy(
        "pack_id", sample_of(segment, num_slots).alias("sample_id"), F.pmod(segment, F.lit(num_slots)).alias("slot")
    ).agg(
        F.min("run.low").alias("low"),
        F.max("run.high").alias("high"),
        F.sum(F.col("run.high") - F.col("run.low") + 1).alias("n"),
    )
    # A sample has num_slots rows here.
    along = Window.partitionBy("pack_id", "sample_id").orderBy("slot")
    stepped = per_slot.withColumns(
        {"before": F.lag("high").over(along), "slot_before": F.lag("slot").over(along)}
    )
    return stepped.groupBy("pack_id", "sample_id").agg(
        F.count_if(F.col("slot") - F.col("slot_before") > 1).alias("skipped_steps"),
        (F.lit(num_slots) - F.count("*")).alias("missing_slots"),
        F.count_if(F.col("before") >= F.col("low")).alias("overlapping_slots"),
        F.count_if(F.col("high") - F.col("low") + 1 != F.col("n")).alias("broken_slots"),
    )


def overlap_errors(packs: DataFrame, num_slots: int, use_mask: bool = True) -> DataFrame:
    """Per pack: samples that reach into the next one, and whether the counts agree."""
    bounds = with_sample_bounds(packs, num_slots, use_mask)
    following = F.slice("sample_starts", F.lit(2), F.greatest(F.size("sample_starts") - 1, F.lit(0)))
    ends = F.zip_with("sample_starts", "sample_lengths", lambda start, length: start + length)
    overlapping = F.zip_with(ends, following, lambda end, start: F.coalesce(end > start, F.lit(False)))
    return bounds.select(
        "pack_id",
        F.size("sample_starts").alias("n_samples"),
        F.size(F.filter(overlapping, lambda hit: hit)).alias("overlaps"),
        (F.size("sample_starts") == F.col("num_segments")).alias("counts_agree"),
    )


def split_mismatches(split: DataFrame, samples: DataFrame) -> DataFrame:
    """Split samples whose tokens differ from what was packed.

    ``samples(pack_id, sample_ord, tokens)`` are the packed samples; missing partners count too.
    """
    key = ["pack_id", "sample_ord"]
    got = split.select(*key, F.col("input_ids").alias("got"))
    want = samples.select(*key, F.col("tokens").alias("want"))
    both = got.join(want, key, "full")
    return both.where(~F.equal_null("got", "want")).select(*key)


def id_differences(expected: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Ids on one side only: ``key, problem`` with ``missing`` or ``unexpected``."""
    expected, seen = expected.select(key).distinct(), seen.select(key).distinct()
    missing = expected.join(seen, key, "left_anti").withColumn("problem", F.lit("missing"))
    unexpected = seen.join(expected, key, "left_anti").withColumn("problem", F.lit("unexpected"))
    return missing.unionByName(unexpected)


def coverage(n_seen: DataFrame, n_expected: int, low: float = MIN_COVERAGE, high: float | None = None) -> DataFrame:
    """``n_seen, n_expected, coverage, accepted`` from a one-column count frame."""
    share = F.col("n_seen") / F.lit(n_expected)
    accepted = (share >= low) if high is None else share.between(low, high)
    return n_seen.select(
        F.col(n_seen.columns[0]).alias("n_seen"), F.lit(n_expected).cast("long").alias("n_expected")
    ).select("n_seen", "n_expected", share.alias("coverage"), accepted.alias("accepted"))


def pack_totals(packs: DataFrame) -> DataFrame:
    """Packs, samples and non-padding tokens (ids above 0), and the largest samples per pack."""
    real = F.size(F.filter("input_ids", lambda token: token > 0))
    return packs.agg(
        F.count("*").alias("n_packs"),
        F.sum("num_segments").alias("n_samples"),
        F.sum(real).alias("n_tokens"),
        F.max("num_segments").alias("max_samples_per_pack"),
    )


def over_cap(packs: DataFrame, max_samples: int) -> DataFrame:
    """Packs holding more samples than allowed."""
    return packs.where(F.col("num_segments") > max_samples).select("pack_id", "num_segments")


def repeated_first_tokens(before: DataFrame, after: DataFrame) -> DataFrame:
    """First tokens of packs that appear both before and after a resume."""
    first = F.col("input_ids")[0].alias("first_token")
    return before.select(first).distinct().join(after.select(first), "first_token", "left_semi")


def sample_positions(positioned: DataFrame, key: str) -> DataFrame:
    """Where each sample id stands: ``key, shard_index, row_index``."""
    return positioned.select(key, "shard_index", "row_index")


def shards_per_dataset(positioned: DataFrame, dataset: str) -> DataFrame:
    return positioned.groupBy(dataset).agg(F.countDistinct("shard_index").alias("n_shards"))


def generated_triplets(texts: DataFrame) -> DataFrame:
    """Test triplets of three lengths from ``sample_id, short, text``, by ``sample_id % 3``.

    A field is its name and the sample's number, then the short text, the text, or the text five times.
    """
    sample = F.col("sample_id")
    kind = F.pmod(sample, F.lit(3))
    body = F.when(kind == 0, F.col("short")).when(kind == 1, F.col("text")).otherwise(F.repeat("text", 5))

    def field(name: str):
        # Fixed value: the form of the number, by which a sample is found again.
        return F.concat(F.format_string(f"{name.upper()}_%06d: ", sample), F.coalesce(body, F.lit(""))).alias(name)

    return texts.select("sample_id", *[field(name) for name in ("anchor", "positive", "negative")])
