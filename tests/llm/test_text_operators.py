"""Join, deduplication, fingerprints, packing and mixing against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from packloom.llm import ngram_join, source_mixing, suffix_dedup
from packloom.llm.bin_packing import pack_documents, plan
from packloom.llm.queries import QUERIES, public_tokenizer
from packloom.llm.source_mixing import count_words, mix, take, targets
from packloom.llm.token_ids import encoder
from packloom.llm.winnowing import compare_with_next, fingerprints, likeness, winnow
from pyspark.sql import functions as F

WORD = re.compile(r"[^ \t-\r]+")
DOCUMENT = "doc_id long, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCUMENT).repartition(3)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- n-gram join


def linked_groups(rows, words, share):
    sets = []
    for _, text in rows:
        said = WORD.findall(lower(text))
        n = len(said) - words + 1
        sets.append({tuple(said[i : i + words]) for i in range(n)} if n > 0 else {tuple(said)} if said else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for token in s:
            holders[token].append(i)
    for group in holders.values():
        for a in group:
            for b in group:
                if a < b and find(a) != find(b):
                    common = len(sets[a] & sets[b])
                    if share[1] * common >= share[0] * len(sets[a] | sets[b]):
                        parent[find(a)] = find(b)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key), key)
    return sorted((key, len(sets[i]), least[find(i)]) for i, (key, _) in enumerate(rows))


def near_texts(n=400, seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    line, base, made = r.choices(vocabulary, k=12), r.choices(vocabulary, k=60), []
    for _ in range(n):
        kind = r.random()
        if kind < 0.3:
            words = line + r.choices(vocabulary, k=r.randint(5, 80))
        elif kind < 0.6:
            words = list(base)
            for _ in range(r.randint(0, 4)):
                words[r.randrange(60)] = r.choice(vocabulary)
        elif kind < 0.7:
            words = r.choices(vocabulary[:4], k=r.randint(0, 6))
        elif kind < 0.9 and made:
            words = list(r.choice(made))
            for _ in range(r.randint(0, 2) if words else 0):
                words[r.randrange(len(words))] = r.choice(vocabulary)
        else:
            words = r.choices(vocabulary, k=r.randint(1, 200))
        made.append(words)
    return [(7 * i, " ".join(w)) for i, w in enumerate(made)] + [(9999, None), (10000, "")]


@pytest.mark.parametrize(("words", "share", "hot"), [(4, (85, 100), 8), (3, (70, 100), 16), (5, (80, 100), 64)])
def test_join_equals_brute_force(spark, words, share, hot):
    rows = near_texts()
    got = ngram_join.near_duplicates(frame(spark, rows), words, share, hot=hot)
    assert sorted(map(tuple, got.collect())) == linked_groups(rows, words, share)


@pytest.mark.parametrize(("words", "share"), [(4, (85, 100)), (5, (80, 100))])
def test_join_of_short_texts_of_hot_shingles(spark, words, share):
    """More than ``HOT`` texts of six or seven shingles that have all but one in common."""
    same = " ".join(f"w{i}" for i in range(words + 5))
    rows = [(i, f"{same} other{i}" if i else same) for i in range(ngram_join.HOT + 10)]
    got = ngram_join.near_duplicates(frame(spark, rows), words, share)
    want = linked_groups(rows, words, share)
    assert {group for _, _, group in want} == {0}
    assert sorted(map(tuple, got.collect())) == want


def test_join_in_slots(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET", 20)
    monkeypatch.setattr(ngram_join, "ELEMENTS", 2000)
    rows = near_texts(seed=4)
    got = ngram_join.near_duplicates(frame(spark, rows), 4, (85, 100), hot=1000)
    assert sorted(map(tuple, got.collect())) == linked_groups(rows, 4, (85, 100))


def test_tasks_of_a_cluster_without_links_hold_two_slots(spark, monkeypatch):
    """Texts alike enough to be one cluster and too little to be linked."""
    monkeypatch.setattr(ngram_join, "ELEMENTS", 800)
    r, placed, stage = random.Random(5), [], ngram_join.stage

    def watched(rows, name):
        out = stage(rows, name)
        placed.extend([out] if name == "placed" else [])
        return out

    monkeypatch.setattr(ngram_join, "stage", watched)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(90):
        words = list(base)
        for at in (r.randrange(0, 20), r.randrange(20, 40), r.randrange(40, 60)) if i % 15 else ():
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join([*words, f"end{i}"])))
    got = ngram_join.near_duplicates(frame(spark, rows), 4, (80, 100), hot=1000)
    want = linked_groups(rows, 4, (80, 100))
    assert sorted(map(tuple, got.collect())) == want
    sizes = dict((key, n) for key, n, _ in want)
    assert len(placed) == 2
    for held in placed:
        groups = collections.Counter()
        for x in held.collect():
            groups[x["component"], x["i"], x["j"]] += sizes[x["node"]]
        # Slots are filled by hash: 90 texts of about 58 elements over about seven slots.
        assert max(groups.values()) < sum(sizes.values()) / 2


def test_join_of_documents(spark, folder, texts):
    got = QUERIES["op1_ngram_join"](spark, folder).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == linked_groups(texts, 4, (85, 100))


def test_tree_prunes_but_loses_nothing():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 2**63, n).astype(np.uint64)) for n in sorted(r.integers(5, 300, 150))]
    sets += [np.unique(np.append(s[: int(len(s) * 0.97)], r.integers(0, 2**63, 1).astype(np.uint64))) for s in sets[::3]]
    sets.sort(key=len)
    sizes = np.asarray([len(s) for s in sets])
    asked = []

    def linked(a, b):
        asked.append((a, b))
        common = len(np.intersect1d(sets[a], sets[b]))
        return 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common)

    component = ngram_join.traverse(sizes, [ngram_join.bitmap(s, 4) for s in sets], (85, 100), linked)
    wanted = {(a, b) for a in range(len(sets)) for b in range(a) if linked(a, b)}
    assert all(component[a] == component[b] for a, b in wanted) and len(set(component)) == len(sets) - len(wanted)
    assert len(asked) - len(sets) * (len(sets) - 1) // 2 < 2 * len(wanted)


def test_components_of_a_long_chain(spark):
    from packloom.llm.graph import components

    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b").where("a <> 150")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 if i <= 150 else 151 for i in range(301)}


def test_odd_documents_join(spark, odd_documents):
    got = ngram_join.near_duplicates(odd_documents, 4, (85, 100)).collect()
    assert len(got) == odd_documents.count()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[4]["component_id"] == 3 and by_id[8]["component_id"] == 6 and by_id[1]["n_shingles"] == 0
    assert by_id[2]["component_id"] == 2 and by_id[9]["n_shingles"] == 0
    groups = ngram_join.near_duplicates(odd_documents)
    kept = ngram_join.keep_one(odd_documents, groups)
    assert kept.columns == odd_documents.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 3, 5, 6, 7, 9, None, None], key=str)


def test_null_and_repeated_ids_link_by_their_texts(spark):
    """Against documents with ids of their own; ids are put back afterwards, a null after all others."""
    r = random.Random(8)
    texts = [t for _, t in near_texts(250, 4)]
    ids = [r.choice([None, None, 5, i]) for i in range(len(texts))]
    rows = list(zip(ids, texts, strict=True)) + [(None, texts[0]), (5, texts[1]), (5, texts[1])]
    order = sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0))
    own = {row: i for i, row in enumerate(order)}
    plain = {i: (n, least) for i, n, least in linked_groups([(i, t) for i, (_, t) in enumerate(order)], 4, (85, 100))}
    want = [(row[0], plain[own[row]][0], order[plain[own[row]][1]][0]) for row in rows]
    got = ngram_join.near_duplicates(frame(spark, rows), 4, (85, 100)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_a_null_id_bridges_and_is_linked(spark):
    words = [f"w{i}" for i in range(61)]
    text = lambda *changed: " ".join("x" if i in changed else w for i, w in enumerate(words))
    rows = [(7, text(60)), (None, text()), (3, text(0)), (None, "other words of no document"), (None, "other words of no document")]
    got = ngram_join.near_duplicates(frame(spark, rows), 4, (93, 100)).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=repr) == [(3, 3), (7, 3), (None, 3), (None, None), (None, None)]


# --- suffix-array deduplication


def removed(rows, length=100):
    seen, out = set(), []
    for key, text in sorted(rows, key=lambda r: r[0]):
        data = np.frombuffer((text or "").encode(), np.uint8)
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            window = data[i : i + length].tobytes()
            if window in seen:
                gone[i : i + length] = True
            seen.add(window)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((key, len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
    return sorted(out)


def patched_texts(n=150, seed=5):
    r = random.Random(seed)

    def any_text(size):
        return "".join(r.choices("abcé \n", k=size))

    passages = [any_text(r.randint(60, 400)) for _ in range(30)]
    rows = []
    for i in range(n):
        parts = [
            r.choice((any_text(r.randint(0, 150)), r.choice(passages), r.choice(passages)[: r.randint(0, 300)], "x" * r.randint(0, 250)))
            for _ in range(r.randint(0, 6))
        ]
        rows.append((3 * i - 50, "".join(parts)))
    return rows + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "y" * 99), (10**6 + 3, "y" * 100), (10**6 + 4, "y" * 101)]


@pytest.mark.parametrize(("length", "spread"), [(100, 100_000), (60, 100_000), (100, 40)])
def test_dedup_equals_brute_force(spark, monkeypatch, length, spread):
    monkeypatch.setattr(suffix_dedup, "GRAM_ROWS", 20)
    monkeypatch.setattr(suffix_dedup, "SPREAD_ROWS", spread)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    monkeypatch.setattr(suffix_dedup, "RANGE_ROWS", 100)
    rows = patched_texts()
    got = suffix_dedup.span_digests(frame(spark, rows), length)
    assert sorted(map(tuple, got.collect())) == removed(rows, length)


def test_dedup_of_documents(spark, folder, texts):
    got = QUERIES["op3_suffix_dedup"](spark, folder)
    assert sorted(map(tuple, got.collect())) == removed(texts)


def test_multikey_order_is_lexicographic():
    r = np.random.default_rng(2)
    keys = [r.integers(0, 4, 500) for _ in range(4)]
    order = suffix_dedup.multikey_order(*keys)
    assert [tuple(k[i] for k in keys) for i in order] == sorted(zip(*(k.tolist() for k in keys), strict=True))


def test_text_keeps_whole_characters(spark):
    passage = "ß" * 30 + "".join(map(chr, range(0x400, 0x440)))
    rows = [(1, "a" + passage + "b"), (2, "c" + passage + "d"), (3, "e" + passage[1:])]
    got = dict(map(tuple, suffix_dedup.remove_repeats(frame(spark, rows)).collect()))
    assert got == {1: rows[0][1], 2: "cd", 3: "e"}


def test_odd_documents_dedup(spark, odd_documents):
    got = suffix_dedup.span_digests(odd_documents).collect()
    assert len(got) == odd_documents.count()
    by_id = {r["doc_id"]: r for r in got if r["n_bytes"]}
    same = len(odd_documents.where("doc_id = 3").first()["text"])
    # Equal rows are one document; the null id comes last.
    assert by_id[4]["n_removed"] == same - 1 or by_id[4]["n_removed"] == same
    assert by_id[None]["n_removed"] == same and by_id[5]["n_bytes"] == 140_000
    assert by_id[5]["n_removed"] == 140_000 - 2 and by_id[6]["n_removed"] == 0
    kept = suffix_dedup.remove_repeats(odd_documents)
    assert kept.columns == odd_documents.columns and kept.count() == odd_documents.count()


# --- fingerprints


def test_winnowing_selects_rightmost_minima():
    text = "".join(random.Random(1).choices("ab", k=300))
    hashes, positions = winnow(text, 5, 8)
    grams = {}
    for i in range(len(text) - 4):
        grams[i] = int(winnow(text[i : i + 5], 5, 1)[0][0])
    wanted = []
    for i in range(len(grams) - 7):
        at = min(range(i, i + 8), key=lambda j: (grams[j], -j))
        if at not in wanted:
            wanted.append(at)
    assert positions.tolist() == wanted and hashes.tolist() == [grams[i] for i in wanted]


def test_shared_strings_leave_a_common_hash():
    r = random.Random(2)
    shared = "".join(r.choices("abcdefgh ", k=16 + 32 - 1))
    for _ in range(50):
        a, b = ("".join(r.choices("abcdefgh ", k=r.randint(0, 90))) + shared + "".join(r.choices("abcdefgh ", k=r.randint(0, 90))) for _ in "ab")
        assert set(winnow(a)[0].tolist()) & set(winnow(b)[0].tolist())


def check_fingerprints(got, rows):
    rows = sorted(rows, key=lambda r: -r[0])
    by_id = {r["doc_id"]: r for r in got}
    for i, (key, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        row = by_id[key]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["near_edited"] == likeness(winnow(text)[0], winnow(edited)[0])
        assert row["near_next"] == likeness(winnow(text)[0], winnow(after)[0])
    assert len(got) == len(rows)


def test_fingerprints_of_documents(spark, folder, texts):
    check_fingerprints(QUERIES["op4_fingerprints"](spark, folder).collect(), texts)


@pytest.mark.parametrize("n", [0, 1, 2, 40])
def test_fingerprints_of_few_documents(spark, monkeypatch, n):
    monkeypatch.setattr("packloom.llm.winnowing.RANGE_ROWS", 3)
    rows = [(i * i - 7, None if i % 5 == 3 else "é🙂x" * i) for i in range(n)]
    check_fingerprints(compare_with_next(frame(spark, rows)).collect(), rows)


def test_odd_documents_fingerprints(spark, odd_documents):
    got = compare_with_next(odd_documents).collect()
    assert len(got) == odd_documents.count()
    assert all(r["fingerprint"] == "" for r in got if r["n_chars"] == 0)
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (3, 4)}) == 1
    assert fingerprints(odd_documents).count() == odd_documents.count()


# --- packing


def test_plan_fills_without_gaps_or_overlaps():
    for seed in range(60):
        r = random.Random(seed)
        capacity = r.choice([10, 30, 100, 2048])
        lengths = r.sample(range(1, capacity + 1), r.randint(1, min(capacity, 200)))
        counts = {length: r.choice([1, 2, 3, 5, 50, 400]) for length in lengths}
        bins, placed = collections.defaultdict(list), collections.Counter()
        for length, low, high, first, offset, copies in plan(counts, capacity):
            assert low == placed[length]
            placed[length] = high
            for rank in range(high - low):
                nth, spot = divmod(rank, copies)
                bins[first + nth].append((offset + spot * length, length))
        assert placed == counts
        for items in bins.values():
            end = 0
            for offset, length in sorted(items):
                assert offset == end
                end += length
            assert end <= capacity and sum(3 * length > capacity for _, length in items) <= 2
        large = sum(n for length, n in counts.items() if 2 * length > capacity)
        least = max(large, -(-sum(length * n for length, n in counts.items()) // capacity))
        assert len(bins) <= 1.5 * least + 1


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizer("word_bpe_49k.json")
    tokenizer, encode, r = Tokenizer.from_file(path), encoder(path), random.Random(1)
    parts = [*" \n\t\x0b\x0c\r\x1c\x85\xa0 'sAÉΣςİ́é<>|3٣!?漢字🙂\x00\x7f\xad×÷ÿßÀ$%&*#.,-_~`\\", "<|endoftext|>", "'re", "'ll", "the", "Ñando"]
    for _ in range(3000):
        text = "".join(r.choices(parts, k=r.randint(0, 25)))
        assert encode(text) == np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def check_packed(rows, documents, encode, capacity):
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for key, text in documents:
        ids = encode(text or "") + bytes(4)
        for i, r in enumerate(sorted(pieces.pop(key), key=lambda r: r["piece"])):
            part = ids[4 * capacity * i : 4 * capacity * (i + 1)]
            assert (r["piece"], r["start"], r["length"], r["ids_crc32"]) == (i, capacity * i, len(part) // 4, zlib.crc32(part))
        assert len(ids) <= 4 * capacity * (i + 1)
    assert not pieces
    for items in sequences.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), sum(r["length"] for r in rows)


def test_packing_of_documents(spark, folder, texts):
    rows = QUERIES["op7_bin_packing"](spark, folder).collect()
    sequences, ids = check_packed(rows, texts, encoder(public_tokenizer("word_bpe_49k.json")), 2048)
    assert sequences <= 1.02 * ids / 2048 + 1


def test_odd_documents_packing(spark, odd_documents):
    path = public_tokenizer("word_bpe_49k.json")
    rows = pack_documents(odd_documents, path, 64).collect()
    ids = sum(len(encoder(path)(r["text"] or "")) // 4 + 1 for r in odd_documents.collect())
    assert sum(r["length"] for r in rows) == ids
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


# --- mixing


def water_fill(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal, full = {}, set()
    total = share * sum(sizes.values())
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        weights_left = sum(weight[s] for s in order if s not in full)
        goal = {s: cap * sizes[s] if s in full else left * weight[s] / weights_left for s in order}
        above = {s for s in order if s not in full and goal[s] > cap * sizes[s]}
        if not above:
            return goal
        full |= above


def check_mix(rows):
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    goal = water_fill(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
    largest = {s: max(r["size"] for r in rows if r["source"] == s) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= max(largest[s], 1)
    return taken, goal


def test_mix_of_documents(spark, folder):
    first, again = (sorted(map(tuple, QUERIES["op8_source_mixing"](spark, folder).collect())) for _ in range(2))
    assert first == again
    taken, goal = check_mix(QUERIES["op8_source_mixing"](spark, folder).collect())
    assert sum(abs(taken[s] - goal[s]) for s in goal) < 0.01 * sum(goal.values())


def test_rates_are_tilted_exponentially(spark):
    rows = [(i, " ".join(["w"] * (i % 37 + 1)), "ab"[i % 2]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs, count_words(F.col("text"))).collect()
    check_mix(got)
    for source in "ab":
        tilts = {round(np.log(r["rate"] / (2 - r["rate"])) / r["size"], 9) for r in got if r["source"] == source and 0 < r["rate"] < 2}
        assert len(tilts) <= 1
    assert sum(r["rate"] * r["size"] for r in got) == pytest.approx(1.5 * sum(r["size"] for r in got))


def test_rounding_in_groups(spark, monkeypatch):
    monkeypatch.setattr(source_mixing, "GROUP_ROWS", 20)
    rows = [(i, "w " * (1 + i * i % 50), f"s{i % 4}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, goal = check_mix(mix(docs, count_words(F.col("text"))).collect())
    assert all(abs(taken[s] - goal[s]) < 0.02 * goal[s] for s in goal)


def test_targets_without_words(spark):
    sizes = spark.createDataFrame([("a", 0), ("b", 0), (None, 0)], "source string, source_size long")
    assert {r["target"] for r in targets(sizes).collect()} == {0.0}


def test_odd_documents_mix(spark, odd_documents):
    rows = mix(odd_documents, count_words(F.col("text"))).collect()
    assert len(rows) == odd_documents.count()
    check_mix(rows)
    taken = take(odd_documents, count_words(F.col("text")))
    assert taken.columns == odd_documents.columns
    assert taken.count() == sum(r["copies"] for r in rows)


# --- empty tables


@pytest.mark.parametrize(
    "operator",
    [
        lambda d: ngram_join.near_duplicates(d),
        lambda d: suffix_dedup.span_digests(d),
        lambda d: suffix_dedup.remove_repeats(d),
        lambda d: compare_with_next(d),
        lambda d: fingerprints(d),
        lambda d: pack_documents(d, public_tokenizer("word_bpe_49k.json")),
        lambda d: take(d.withColumn("source", F.lit("s")), count_words(F.col("text"))),
    ],
)
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], DOCUMENT)).count() == 0
