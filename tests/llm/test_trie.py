"""Prefix trie against sets of plain prefixes."""

import hashlib
import random
import re
import zlib

import pytest
from packloom.llm import prefix_trie
from packloom.llm.prefix_trie import family_trie, numbered_turns, shard_nodes, trie
from pyspark.sql import functions as F

KIND = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def plain(convs):
    """Node rows of conversations, by their prefixes."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for key in members:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0 for k in members}
    out = []
    for key, ids in members.items():
        below = [k for k in members if k[: len(key)] == key]
        ends = sorted(c for c in ids if len(convs[c]) == len(key))
        out.append(
            (
                min(ids),
                len(key),
                min(members[key[:-1]]) if key else None,
                len(ids),
                len(kids.get(key, [])),
                sum(k not in kids for k in below),
                sum((len(members[k]) - 1) * size[k] for k in below),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def some(seed, n, letters="ab", most=6):
    random_ = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(random_.randint(1, most)):
            rows.append((c, t, random_.choice(["user", "assistant"]), " ".join(random_.choice(letters) for _ in range(random_.randint(0, 2)))))
    random_.shuffle(rows)
    return rows


@pytest.mark.parametrize(("shard", "letters"), [(1, "a"), (7, "ab"), (1000, "abc")])
def test_trie_equals_prefixes(spark, monkeypatch, shard, letters):
    monkeypatch.setattr(prefix_trie.trie, "__defaults__", (shard,))
    rows = some(shard, 160, letters)
    assert found(family_trie(spark.createDataFrame(rows, KIND))) == plain(rebuilt(rows))


def test_copies_fill_several_shards(spark):
    """One conversation many times, and one that goes on from it: ends and sums cross the shards."""
    rows = [(c, t, "user", f"word {t}") for c in range(90) for t in range(4)] + [(100, t, "user", f"word {t}") for t in range(6)]
    turns = numbered_turns(spark.createDataFrame(rows, KIND))
    got = found(trie(turns, shard=4))
    assert got == plain({c: [("user", f"word {t}") for t in range(4 + 2 * (c == 100))] for c in [*range(90), 100]})


def test_one_shard_has_whole_and_open_nodes():
    batch = shard_nodes([4, 9, 2], [[b"a"], [b"b"], [b"c"]], [[1], [2], [3]])
    assert batch.column("open").to_pylist() == [True, True, False, True]
    assert batch.column("conv_id").to_pylist() == [2, 4, 9, 2]


def test_odd_conversations(spark):
    rows = [
        (None, 0, "user", "no conversation"),
        (20, None, None, None),
        (20, 1, "user", "x y"),
        (20, 1, "user", "x y"),
        (20, 1, None, "x y"),
        (21, 0, "user", ""),
        (22, 0, "user", "word " * 50_000),
        (23, 0, "", None),
        (45, 0, "user", "alone"),
        (-7, 0, "user", "below zero"),
        *((41, t, "user", str(t % 3)) for t in range(400)),
    ]
    frame = spark.createDataFrame(rows, KIND)
    for name in ("path", "words", "place", "key", "h", "head", "n"):
        frame = frame.withColumn(name, F.lit(1))
    # As in SQL, the remainder of a negative id is negative.
    convs = rebuilt([r for r in rows if r[0] is None or r[0] >= 0])
    convs[-7] = [("user", "below zero")][zlib.crc32(b"-7") % 4 :]
    assert found(family_trie(frame)) == plain(convs)


def test_no_conversations(spark):
    assert family_trie(spark.createDataFrame([], KIND)).count() == 0
    assert family_trie(spark.createDataFrame([(None, 1, "user", "x")], KIND)).count() == 0
