"""Tables in buckets: plans without a shuffle on the batch, and the same results."""

import re

import numpy as np
import pytest
from packloom.config import PackConfig
from packloom.operators import batches, contrastive, unpack
from packloom.sources.buckets import open_bucketed, save_bucketed
from pyspark.sql import functions as F


def shuffles(df) -> list[str]:
    return re.findall(r"Exchange (?:hash|range|Round)\w*", df._jdf.queryExecution().executedPlan().toString())


def below(plan: str, operator: str) -> str:
    """The part of a plan under an operator."""
    depth = lambda line: re.search(r"\w", line).start()
    lines = [line for line in plan.splitlines() if re.search(r"\w", line)]
    at = next(i for i, line in enumerate(lines) if operator in line)
    end = next((i for i in range(at + 1, len(lines)) if depth(lines[i]) <= depth(lines[at])), len(lines))
    return "\n".join(lines[at:end])


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(b, f"s{i}", slot, rng.normal(size=4).tolist()) for b in range(6) for i in range(5) for slot in range(3)]
    return spark.createDataFrame(rows, "batch_id long, sample_key string, slot int, vec array<double>")


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_loss_reads_buckets_as_they_lie(spark, vectors, tmp_path, no_broadcast):
    stored = save_bucketed(vectors, "loss_vectors", str(tmp_path / "v"), "batch_id", 3, "sample_key")
    want, got = (contrastive.infonce(df, 1, 4, [0.1]) for df in (vectors, stored))
    plans = [below(df._jdf.queryExecution().executedPlan().toString(), "FlatMapGroupsInArrow") for df in (want, got)]
    # No vector moves; what is shuffled later is a row of sums per anchor.
    assert ["Exchange hash" in plan for plan in plans] == [True, False]
    assert len(shuffles(got)) < len(shuffles(want))
    rounded = [[F.round(c, 9).alias(c) if c != "batch_id" else F.col(c) for c in df.columns] for df in (want, got)]
    assert sorted(want.select(*rounded[0]).collect()) == sorted(got.select(*rounded[1]).collect())


def test_batches_and_bounds_read_buckets_as_they_lie(spark, tmp_path):
    rows = [(i, i, i // 4, [i, i, i], [1, 1, 1], [0, 1, 2], [0, 0, 0], 1) for i in range(20)]
    packs = spark.createDataFrame(
        rows,
        "pack_id long, pack_seq long, batch_id long, input_ids array<int>, attention_mask array<int>, segment_ids array<int>, "
        "position_ids array<int>, num_segments int",
    )
    path = str(tmp_path / "p")
    save_bucketed(packs, "packs_here", path, "batch_id", 4, "pack_seq")
    stored = open_bucketed(spark, "packs_elsewhere", path, packs.schema, "batch_id", 4, "pack_seq")
    for work in (lambda df: batches.collate(df, 3), lambda df: unpack.sample_info(df, by="batch_id")):
        assert shuffles(work(packs)) and not shuffles(work(stored))
        assert sorted(work(packs).collect()) == sorted(work(stored).collect())
    unpadded = packs.drop("attention_mask")
    config = PackConfig(eos_token_id=1, seq_length=3, max_samples=1)
    assert not shuffles(batches.collate_packs(stored.drop("attention_mask"), config, 3))
    assert batches.collate_packs(unpadded, config, 3).count() == 5
