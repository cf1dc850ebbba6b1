import pytest
from packloom.config import PackConfig, resolve_eos
from packloom.functions.text import arrow_tokenizer, codepoints, words
from packloom.operators.triplets import (
    build_samples,
    limit_length,
    rejected,
    select_fields,
    slot_labels,
    tokenize_slots,
    usable,
)
from pyspark.sql import functions as F

CONFIG = PackConfig(eos_token_id=1, seq_length=100, max_sample_length=None)


def test_empty_and_miscounted_fields(spark):
    rows = [
        (1, "a", "p", ["n"]),
        (2, "", "p", ["n"]),
        (3, "a", None, ["n"]),
        (4, "a", "p", []),
        (5, "a", "p", None),
        (6, "a", "p", ["n", "m"]),
        (7, "a", "p", [""]),
    ]
    triplets = select_fields(spark.createDataFrame(rows, "id int, anchor string, positive string, negative array<string>"))
    assert {r["id"] for r in usable(triplets).collect()} == {1, 7}
    reasons = {r["id"]: r["reject_reason"] for r in rejected(triplets).collect()}
    assert reasons == {2: "empty_field", 3: "empty_field", 4: "empty_field", 5: "empty_field", 6: "negative_count"}


def test_field_names_single_text_and_default_negative(spark):
    df = spark.createDataFrame([("q", "d", "x", 9)], "query string, doc string, other string, extra int")
    row = select_fields(df, "query", "doc", "other").first()
    assert (row["anchor"], row["positive"], row["negatives"], row["extra"]) == ("q", "d", ["x"], 9)
    row = select_fields(df.drop("other"), "query", "doc", "other", num_negatives=2).first()
    assert row["negatives"] == ["", ""]


def test_slots_labels_and_extra_fields(spark):
    df = spark.createDataFrame([("ab", "é😀", ["c", ""], 5)], "anchor string, positive string, negative array<string>, k int")
    config = CONFIG.with_(num_negatives=2)
    row = tokenize_slots(select_fields(df, num_negatives=2), codepoints, config).withColumn("labels", slot_labels()).first()
    assert row["slots"] == [[97, 98, 1], [233, 128512, 1], [99, 1], [1]]
    assert row["slot_sizes"] == [3, 3, 2, 1]
    assert row["labels"] == [0, 0, 0, 1, 1, 1, 2, 2, 3]
    assert row["k"] == 5


def test_without_eos_empty_text_has_no_tokens(spark):
    df = spark.createDataFrame([("a", "b", [""])], "anchor string, positive string, negative array<string>")
    config = CONFIG.with_(add_special_tokens=False)
    row = limit_length(tokenize_slots(select_fields(df), codepoints, config), config).first()
    assert row["slots"] == [[97], [98], []] and row["n_tokens"] == 2


@pytest.mark.parametrize("anchor,positive,kept", [(4, 5, False), (4, 4, True), (3, 4, True)])
def test_length_limit(spark, anchor, positive, kept):
    # Lengths include EOS; the limit is 11 tokens.
    df = spark.createDataFrame([("a" * anchor, "b" * positive, ["c" * 9])], "anchor string, positive string, negative array<string>")
    config = CONFIG.with_(max_sample_length=11)
    rows = build_samples(select_fields(df), codepoints, config).collect()
    assert len(rows) == int(kept)
    if kept:
        assert rows[0]["n_tokens"] == 11
        assert [len(s) for s in rows[0]["slots"]] == [anchor + 1, positive + 1, 11 - anchor - positive - 2]


def test_cut_keeps_empty_slots(spark):
    df = spark.createDataFrame([("aaa", "bb", ["cccc", "dd"])], "anchor string, positive string, negative array<string>")
    config = CONFIG.with_(num_negatives=2, max_sample_length=9)
    row = build_samples(select_fields(df, num_negatives=2), codepoints, config).first()
    assert [len(s) for s in row["slots"]] == [4, 3, 2, 0]


def test_words_and_user_tokenizer(spark):
    df = spark.createDataFrame([("Das IST gut, n°7!",), ("",)], "t string")
    assert [r[0] for r in df.select(words("t")).collect()] == [["das", "ist", "gut", "n", "7"], []]
    lengths = arrow_tokenizer(lambda texts: [[len(w) for w in t.split()] for t in texts])
    assert [r[0] for r in df.select(lengths(F.col("t"))).collect()] == [[3, 3, 4, 4], []]


def test_parameters():
    assert resolve_eos(5, None) == 5

    class Tokenizer:
        eos_token_id = 9

    assert resolve_eos(None, Tokenizer()) == 9
    with pytest.raises(ValueError):
        resolve_eos(None, object())
    with pytest.warns(UserWarning):
        assert PackConfig(eos_token_id=1, seq_length=10, max_sample_length=20).max_sample_length == 10
    with pytest.raises(ValueError):
        PackConfig(eos_token_id=1, num_negatives=0)
    with pytest.raises(ValueError):
        PackConfig(eos_token_id=1, strategy="best")
    assert PackConfig(eos_token_id=1, max_samples=None).sample_cap == 1_000_000


def test_no_sample_cap_in_long_rows():
    assert PackConfig(eos_token_id=1, seq_length=3_000_000, max_samples=None).sample_cap >= 3_000_000
