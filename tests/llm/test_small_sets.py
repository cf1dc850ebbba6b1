"""Clusters of many small sets: cut by the number of their classes, not by set elements alone."""

import random

from packloom.llm import ngram_join
from test_text_operators import frame, linked_groups


def test_tasks_of_many_small_sets_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "MEMBERS", 10)
    placed, stage, r = [], ngram_join.stage, random.Random(2)

    def watched(rows, name):
        out = stage(rows, name)
        placed.extend([out] if name == "placed" else [])
        return out

    monkeypatch.setattr(ngram_join, "stage", watched)
    # Five of seven shingles in common: alike, not linked; a few are one shingle apart from another, in a set of fifteen.
    rows = [(i, " ".join([*(f"w{k}" for k in range(8)), f"end{i}"])) for i in range(80)]
    long = [f"v{k}" for k in range(18)]
    rows += [(100 + i, " ".join([*long[:17], r.choice(["a", "b", "c"]) + str(i)])) for i in range(80)]
    got = ngram_join.near_duplicates(frame(spark, rows), 4, (85, 100))
    assert sorted(map(tuple, got.collect())) == linked_groups(rows, 4, (85, 100))
    sizes = [c["count"] for p in placed for c in p.groupBy("component", "i", "j").count().collect()]
    assert sum(sizes) > 160 and max(sizes) <= 4 * 10  # two slots, unevenly filled by their hash
