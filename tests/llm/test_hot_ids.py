"""A third of all rows without an id, or of one id, is not one task."""

import collections

from pyspark.sql import functions as F

from packloom.llm import sharding, source_mixing
from test_text_operators import frame


def test_rows_of_one_id_are_dealt_by_several_windows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN_LIMITS", 4)
    rows = [(None, "x" * (i % 97)) for i in range(900)] + [(i, "y" * 40) for i in range(300)] + [(7, "z" * 70)] * 300
    placed = sharding.shard(frame(spark, rows), 500)
    parts = collections.defaultdict(list)
    for r in placed.collect():
        parts[r["shard"], r["part"]].append(r)
    assert sum(map(len, parts.values())) == len(rows)
    for items in parts.values():
        assert {r["shard_bytes"] for r in items} == {sum(r["n_bytes"] for r in items)}
        assert sum(r["n_bytes"] for r in items) <= 500 or len(items) == 1
    hot = [items for items in parts.values() if items[0]["doc_id"] is None]
    least = sum(i % 97 for i in range(900)) / 500
    # Parts start at half the limit, and each window leaves one unfilled.
    assert least <= len(hot) <= 2.8 * least


def test_rows_without_id_are_rounded_in_many_groups(spark):
    rows = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), (F.col("id") % 700).alias("size"))
    groups = rows.groupBy(source_mixing._group(F.lit(60)).alias("group")).count().collect()
    assert len(groups) == 60 and max(g["count"] for g in groups) < 3_000


def test_mix_of_rows_without_id(spark):
    rows = [(None, " ".join(["w"] * (1 + i % 50)), "a" if i % 3 else "b") for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = collections.Counter()
    targets = {}
    for r in source_mixing.mix(docs, source_mixing.count_words(F.col("text"))).collect():
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 0.01 * t for s, t in targets.items())
