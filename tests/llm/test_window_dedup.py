"""Word windows behind the sketch, against a plain set of windows."""

import hashlib
import random
import re

import numpy as np
import pytest
from packloom.llm import window_dedup
from packloom.llm.window_dedup import repeated_estimate, sketch, window_digests, without_repeats
from pyspark.sql import functions as F

KIND = "doc_id long, text string"


def plain(docs, window):
    """n_words, n_removed and kept words by document in order."""
    seen, out = set(), []
    for doc, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        out.append((doc, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def made(seed, n):
    """Texts of a small vocabulary with passages, copies, edited copies, periods and overlaps."""
    random_ = random.Random(seed)
    say = lambda k: [random_.choice("ab cd é x y zz Q".split()) + str(random_.randint(0, 3)) for _ in range(k)]
    passages = [say(random_.randint(10, 80)) for _ in range(6)]
    texts = []
    for _ in range(n):
        kind = random_.random()
        if kind < 0.3 and texts:
            words = list(random_.choice(texts))
            for _ in range(random_.randint(0, 3)):
                words[random_.randrange(len(words))] = "edited"
        elif kind < 0.4:
            words = say(random_.randint(1, 4)) * random_.randint(5, 60)
        else:
            words = say(random_.randint(1, 60)) + random_.choice(passages) + say(random_.randint(0, 60))
        texts.append(words)
    return [(i * 3 - 40, random_.choice([" ", "\n", "  \t"]).join(words)) for i, words in enumerate(texts)]


@pytest.mark.parametrize(("window", "gram", "flush", "most_cells"), [(20, 8, 1_000_000, 1 << 28), (5, 3, 50, 1 << 28), (20, 8, 100, 16)])
def test_windows_equal_brute_force(spark, monkeypatch, window, gram, flush, most_cells):
    monkeypatch.setattr(window_dedup, "FLUSH", flush)
    docs = made(window + flush, 400)
    frame = spark.createDataFrame(docs, KIND).repartition(5)
    got = without_repeats(frame, window, gram, most_cells).collect()
    assert sorted(map(tuple, got)) == plain(docs, window)
    digests = {r["doc_id"]: r["kept_sha256"] for r in window_digests(frame, window, gram, most_cells).collect()}
    assert digests == {r["doc_id"]: hashlib.sha256(r["kept"].encode()).hexdigest() for r in got}


def test_estimates_are_never_too_low(spark):
    """Every anchor met twice is estimated repeated, in a sketch far too small as well; most others are not in a large one."""
    docs = made(5, 200)
    frame = spark.createDataFrame(docs, KIND).withColumnRenamed("doc_id", "doc").repartition(4)
    words = [t.encode() for _, t in docs]
    data, offsets = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])
    known = window_dedup._Words(data, offsets)
    _, anchor = known.windows(20, 8)
    anchor = np.unique(anchor)
    hashes = known.runs(anchor, anchor + 8)
    found, counts = np.unique(hashes, return_counts=True)
    for cells in (1 << 16, 1 << 22):
        flagged = repeated_estimate(sketch(frame, cells), found, cells)
        assert flagged[counts > 1].all()
    assert flagged[counts == 1].mean() < 0.05


def test_odd_documents_windows(spark, odd_documents):
    rows = odd_documents.select("doc_id", "text").distinct().collect()
    docs = sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0))
    want = {d: w for d, w in zip(docs, plain(docs, 20), strict=True)}
    nulls = [d for d in docs if d[0] is None]
    got = [tuple(r) for r in without_repeats(odd_documents).collect()]
    expected = [want[d] for d in docs if d[0] is not None]
    expected.append(want[(4, dict(docs)[4])])  # the repeated row
    assert sorted(r for r in got if r[0] is not None) == sorted(expected)
    assert len([r for r in got if r[0] is None]) == len(nulls) == 2


def test_one_passage_in_all_documents(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = [(i, f"b{i} {passage} a{i}") for i in range(500)]
    got = {r["doc_id"]: r for r in without_repeats(spark.createDataFrame(docs, KIND)).collect()}
    assert got[0]["n_removed"] == 0
    assert all(got[i]["n_removed"] == 60 and got[i]["kept"] == f"b{i} a{i}" for i in range(1, 500))


def test_clashing_columns_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "a b c")], KIND)
    for name in ("doc", "start", "starts", "n", "kind", "bytes", "own_id"):
        frame = frame.withColumn(name, F.lit(1))
    assert [tuple(r) for r in without_repeats(frame).collect()] == [(1, 3, 0, "a b c")]
    assert window_digests(frame.where("false")).count() == 0
