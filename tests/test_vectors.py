import math

import numpy as np
import pytest
from packloom.functions.vectors import cosine, dot, normalize
from packloom.operators import contrastive, pooling, vocabulary
from packloom.plans.queries import evaluate_packed, projection_layers
from pyspark.sql import functions as F


def test_normalize_and_cosine(spark):
    rows = [([3.0, 4.0],), ([0.0, 0.0],), ([math.nan, 2.0],), ([math.inf, -math.inf],)]
    df = spark.createDataFrame(rows, "v array<double>")
    unit = [r[0] for r in df.select(normalize("v")).collect()]
    assert unit == [[0.6, 0.8], [0.0, 0.0], [0.0, 1.0], [0.0, 0.0]]
    hidden = [r[0] for r in df.select(normalize("v", F.lit(False))).collect()]
    assert hidden == [[0.0, 0.0]] * 4
    small = spark.createDataFrame([([3e-6, 4e-6],)], "v array<double>")
    assert small.select(normalize("v")).first()[0] == pytest.approx([3e-2, 4e-2])
    pair = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in pair.select(cosine("a", "b")).collect()] == pytest.approx([1 / math.sqrt(2), 0.0])
    assert [r[0] for r in pair.select(dot("a", "b")).collect()] == [1.0, 0.0]


def test_last_tokens_and_grid(spark):
    segments = [0, 0, 0, 1, 1, 2, 2, 2, 3, 3, 4, 5, 9, 9, -1, -1]
    tokens = spark.createDataFrame(
        [(0, i, s, i != 11, [float(i), 1.0]) for i, s in enumerate(segments)],
        "pack_id long, pos int, segment_id int, attended boolean, vec array<double>",
    )
    pooled = pooling.last_token_vectors(tokens, 2)
    assert {r["segment_id"]: r["vec"][0] for r in pooled.collect()} == {0: 2, 1: 4, 2: 7, 3: 9, 4: 10}
    assert pooling.dropped_segments(tokens, 2).first()["dropped_segments"] == 1
    grid = pooling.slot_grid(pooled, tokens.select("pack_id").distinct(), 2, 1, 2).collect()
    assert len(grid) == 6
    absent = [r for r in grid if not r["present"]]
    assert [(r["sample_id"], r["slot"], r["vec"]) for r in absent] == [(1, 2, [0.0, 0.0])]
    assert pooling.last_position_vectors(tokens).first()["vec"] == [15.0, 1.0]
    assert pooling.last_position_vectors(tokens.withColumn("attended", F.col("segment_id") >= 0), True).first()["vec"] == [13.0, 1.0]
    assert pooling.mean_vectors(tokens, "pack_id").first()["vec"] == [7.5, 1.0]
    stats = pooling.vector_stats(tokens.where("segment_id = 0"), "pack_id").first()
    values = np.array([0, 1, 1, 1, 2, 1.0])
    assert (stats["n_valid"], stats["min"], stats["max"]) == (3, 0, 2)
    assert (stats["mean"], stats["std"]) == pytest.approx((values.mean(), values.std()))


def test_projection(spark):
    assert pooling.layer_sizes(1024, 256) == [1024, 512, 256]
    assert pooling.layer_sizes(64, 20) == [64, 32, 20]
    assert pooling.layer_sizes(100, 30) == [100, 50, 30]
    assert pooling.layer_sizes(16, 256) == [16]
    x = np.random.default_rng(0).normal(size=(50, 16))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, vec array<double>")
    layers = projection_layers([16, 8, 4])
    for approximate in (True, False):
        got = {r["id"]: r["vec"] for r in pooling.project(df, layers, approximate=approximate).collect()}
        hidden = x @ layers[0][0] + layers[0][1]
        gelu = (
            0.5 * hidden * (1 + np.tanh(np.sqrt(2 / np.pi) * (hidden + 0.044715 * hidden**3)))
            if approximate
            else 0.5 * hidden * (1 + np.vectorize(math.erf)(hidden / math.sqrt(2)))
        )
        want = gelu @ layers[1][0] + layers[1][1]
        assert np.allclose([got[i] for i in range(50)], want)
    assert pooling.project(df, []).first()["vec"] == x[0].tolist()


def loss_by_matrix(anchor, positive, negatives, valid, temperature):
    """Loss and metrics of one batch written with dense matrices and masks."""
    n = valid.sum() + 1e-8
    pos = (anchor * positive).sum(-1)
    neg = anchor @ negatives.reshape(-1, anchor.shape[1]).T
    mask = np.repeat(valid, negatives.shape[1])
    logits = np.concatenate([pos[:, None], np.where(mask[None, :] > 0, neg, -1e9)], 1) / temperature
    logits = np.where(valid[:, None] > 0, logits, -1e9)
    top = logits.max(1, keepdims=True)
    log_prob = logits[:, 0] - (top[:, 0] + np.log(np.exp(logits - top).sum(1)))
    pairs = valid[:, None] * mask[None, :]
    return (
        (-log_prob * valid).sum() / n,
        ((logits.argmax(1) == 0) * valid).sum() / n,
        n,
        (pos * valid).sum() / n,
        (neg * pairs).sum() / (pairs.sum() + 1e-8),
    )


@pytest.mark.parametrize("block", [3, 2048])
def test_loss_equals_the_dense_form(spark, block):
    rng = np.random.default_rng(4)
    k, h = 3, 6
    vectors, batches = [], {}
    for batch, size in ((0, 11), (1, 4), (2, 3)):
        x = rng.normal(size=(size, 2 + k, h))
        x /= np.linalg.norm(x, axis=-1, keepdims=True)
        present = rng.random((size, 2 + k)) > 0.15
        if batch == 1:
            # A tie between positive and best negative counts as right.
            present[:] = True
            x[0, 1] = x[0, 2] = x[0, 0]
        if batch == 2:
            present[:, 0] = False
        x[~present] = 0
        batches[batch] = (x, present[:, 0].astype(float))
        vectors += [(batch, f"s{i}", s, x[i, s].tolist()) for i in range(size) for s in range(2 + k) if present[i, s]]
    df = spark.createDataFrame(vectors, "batch_id long, sample_key string, slot int, vec array<double>")
    result = contrastive.infonce(df, k, h, [0.07, 1.0], [1, 3], block=block).collect()
    assert len(result) == 3 * 2 * 2
    for r in result:
        x, valid = batches[r["batch_id"]]
        want = loss_by_matrix(x[:, 0], x[:, 1], x[:, 2 : 2 + r["num_negatives"]], valid, r["temperature"])
        got = (r["loss"], r["accuracy"], r["valid_samples"], r["pos_sim_mean"], r["neg_sim_mean"])
        assert got == pytest.approx(want, abs=1e-9)
        assert r["loss"] >= 0 and 0 <= r["accuracy"] <= 1
    strict = contrastive.sample_triples(df, k, h, require_all=True)
    whole = sum(1 for b, (x, _) in batches.items() for s in x if (np.abs(s).sum(-1) > 0).all())
    assert strict.count() == whole


def vocab(spark, texts):
    df = spark.createDataFrame([(t.split(),) for t in texts], "words array<string>")
    return vocabulary.build_vocabulary(df)


def test_vocabulary(spark):
    table = vocab(spark, ["b a b", "c a b", ""])
    assert [tuple(r) for r in table.orderBy("token_id").collect()] == [("b", 3, 0), ("a", 2, 1), ("c", 1, 2)]
    extended = vocabulary.extend_vocabulary(table, ["z", "a", "y", "z"])
    assert {r["token"]: r["token_id"] for r in extended.collect()} == {"b": 0, "a": 1, "c": 2, "z": 3, "y": 4}
    with pytest.raises(ValueError):
        vocabulary.extend_vocabulary(table, [])


@pytest.mark.parametrize("max_lookup", [0, 10])
def test_encoding_both_ways(spark, max_lookup):
    table = vocab(spark, ["b a b", "c a b"])
    df = spark.createDataFrame([(1, [["a", "q", "b"], []]), (2, [["c"], ["b", "b"]]), (3, [])], "k int, w array<array<string>>")
    got = vocabulary.encode_slots(df, "w", table, 99, "k", max_lookup).collect()
    ids = {r["k"]: r["slots"] for r in got}
    assert ids[1] == [[1, 99, 0], []] and ids[2] == [[2], [0, 0]]
    assert ids.get(3) == []


def test_vectors_follow_the_vocabulary(spark):
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 6.0])], "token_id int, vec array<double>")
    more, before, after = vocabulary.extend_vectors(vectors, 2, "average")
    assert (before, after) == (2, 4)
    assert {r["token_id"]: r["vec"] for r in more.collect()} == {0: [1, 2], 1: [3, 6], 2: [2, 4], 3: [2, 4]}
    zero, _, _ = vocabulary.extend_vectors(vectors, 1, "zeros")
    assert zero.where("token_id = 2").first()["vec"] == [0.0, 0.0]
    wide = spark.createDataFrame([(0, [0.0] * 50)], "token_id int, vec array<double>")
    random = vocabulary.extend_vectors(wide, 400, "random", seed=3)[0].where("token_id > 0")
    values = np.array([r["vec"] for r in random.orderBy("token_id").collect()])
    again = np.array([r["vec"] for r in random.repartition(7).orderBy("token_id").collect()])
    assert (values == again).all()
    assert abs(values.mean()) < 1e-3 and values.std() == pytest.approx(0.02, rel=0.03)
    for bad in (lambda: vocabulary.extend_vectors(vectors, 0), lambda: vocabulary.extend_vectors(vectors, 1, "other")):
        with pytest.raises(ValueError):
            bad()
    ragged = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "token_id int, vec array<double>")
    with pytest.raises(ValueError):
        vocabulary.extend_vectors(ragged, 1)


def test_joint_extension(spark):
    table = vocab(spark, ["b a"])
    vectors = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "token_id int, vec array<double>")
    tokens, more, before, after = vocabulary.extend_both(table, vectors, ["x", "a"], "zeros")
    assert (before, after, tokens.count(), more.count()) == (2, 3, 3, 3)
    with pytest.warns(UserWarning, match="no token"):
        assert vocabulary.extend_both(table, vectors, ["a"])[2:] == (2, 2)
    with pytest.warns(UserWarning, match="1 vectors for 2"):
        assert vocabulary.extend_both(table, vectors.limit(1), ["x"])[1].count() == 2


def test_projection_keeps_nulls_and_checks_sizes(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [3.0, 4.0]), (3, None)]
    frame = spark.createDataFrame(rows, "id long, vec array<double>").coalesce(1)
    layers = [(np.asarray([[1.0, 0.0, 2.0], [0.0, 1.0, 0.0]]), None)]
    got = {r["id"]: r["vec"] for r in pooling.project(frame, layers).collect()}
    assert got == {0: [1.0, 2.0, 2.0], 1: None, 2: [3.0, 4.0, 6.0], 3: None}
    wide = spark.createDataFrame([(0, [1.0, 2.0, 3.0, 4.0])], "id long, vec array<double>")
    with pytest.raises(Exception, match="vectors of 2 entries"):
        pooling.project(wide, layers).collect()


def test_error_function():
    x = np.linspace(-8, 8, 2001)
    assert np.abs(pooling.erf(x) - [math.erf(v) for v in x]).max() < 1e-13


def test_means_and_stats_skip_nulls(spark):
    rows = [("a", [1.0, 2.0]), ("a", [3.0, None]), ("a", None), (None, [5.0, 7.0]), ("b", [1e8, 1e8 + 1])]
    frame = spark.createDataFrame(rows, "k string, vec array<double>").repartition(3)
    assert {r["k"]: r["vec"] for r in pooling.mean_vectors(frame, "k").collect()} == {"a": [2.0, 2.0], None: [5.0, 7.0], "b": [1e8, 1e8 + 1]}
    stats = {r["k"]: r for r in pooling.vector_stats(frame, "k").collect()}
    assert (stats["a"]["n_valid"], stats["a"]["mean"], stats["a"]["min"], stats["a"]["max"]) == (2, 2.0, 1.0, 3.0)
    assert stats["a"]["std"] == pytest.approx(np.std([1, 2, 3])) and stats["b"]["std"] == pytest.approx(0.5)


def test_release_deletes_staged_tables(spark):
    import os

    from packloom.workspace import new_path, release, stage

    path = new_path(spark, "x")
    spark.range(3).write.parquet(path)
    staged = stage(spark.range(4), "y")
    assert staged.count() == 4 and release(spark) >= 2
    assert not os.path.exists(path.removeprefix("file:"))


def test_evaluation_takes_all_samples_of_a_row(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=64).tolist()) for i in range(160)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    # Four rows of twelve segments are one batch of sixteen samples.
    assert [(x["batch_id"], x["valid_samples"]) for x in evaluate_packed(spark, str(tmp_path)).collect()] == [(0, 16)]
