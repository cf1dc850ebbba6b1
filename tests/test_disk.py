"""What queries over texts write: each text is shuffled once, and what is stored is what is read later."""

import json
import os
import time

import pyarrow.parquet as pq
import pytest
from packloom import PackConfig
from packloom.functions.text import codepoints
from packloom.operators.triplets import limit_length, needed_tokens, tokenize_slots
from packloom.plans import flows, queries
from packloom.plans.pipeline import read_rows, samples_of
from packloom.sources import jsonl
from packloom.sources.tables import document_triplets
from packloom.streaming.ingest import run_available, stream_triplets
from packloom.workspace import shuffles_freed, stage_texts
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("spans", [1, 3, 20, 1000, None])
def test_texts_are_shuffled_once_and_followed_over_the_edges_of_spans(spark, spans):
    ids = [-(1 << 40), -7, -1, *range(0, 60, 3), 1 << 53, (1 << 53) + 1, 1 << 62]
    texts = {i: None if i == 9 else f"text {i}" for i in ids}
    said = {0: [1], 3: [0, 1], 9: [None], 1 << 62: [1]}
    documents = [(i, texts[i], "en", f"s{i % 4}", 1) for i in reversed(ids)] + [(None, "lost", "en", "s", 1)]
    labels = [(i, q, 0) for i, found in said.items() for q in found] + [(1, 1, 0), (None, 1, 0)]
    rows = document_triplets(spark.createDataFrame(documents, DOCUMENTS), spark.createDataFrame(labels, LABELS), spans)
    want = []
    for k, i in enumerate(ids):
        later = [texts[j] for j in ids[k + 1 : k + 3]] + [None, None]
        want += [(i, texts[i], f"s{i % 4}", later[0], later[1], q) for q in said.get(i, [None])]
    got = [tuple(r) for r in rows.select("doc_id", "anchor", "source_id", "positive", "negative", "quality").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert [r[0] for r in got] == sorted(r[0] for r in got)
    assert plan(rows).count("Exchange ") == 1


def test_no_documents_have_no_triplets(spark):
    rows = document_triplets(spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([], LABELS))
    assert rows.count() == 0


def shuffle_files(spark) -> set[str]:
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def left_by(spark, write) -> set[str]:
    before = shuffle_files(spark)
    kept = write()  # what garbage collection would free stays in use
    until = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert kept is not None
    return left


def test_stored_texts_leave_no_shuffle_files(spark):
    rows = spark.range(1000).select("id", F.repeat(F.col("id").cast("string"), 50).alias("text")).repartition(3, "id")
    assert left_by(spark, lambda: stage_texts(rows, "texts")) == set()
    assert stage_texts(rows, "texts").count() == 1000
    with pytest.raises(ZeroDivisionError), shuffles_freed(spark):
        1 // 0
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("write", [queries._written_triplets, queries._mixed_lines])
def test_written_files_leave_no_shuffle_files_of_texts(spark, write):
    def texts_left():
        before = shuffle_files(spark)
        assert write(spark, FOLDER)
        time.sleep(1)
        root = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        new = [root.apply(i) for i in range(root.size()) if root.apply(i).getName() not in before]
        return sum(f.length() for f in new if f.getName().startswith("shuffle_"))

    assert texts_left() < 50_000  # the numbers; the texts alone have 500 KB


LIMITED = PackConfig(eos_token_id=1, seq_length=64, max_sample_length=20)


def test_no_token_is_stored_that_no_sample_has(spark, tmp_path):
    lines = [
        {"anchor": "a" * 5, "positive": "p" * 5, "negative": "n" * 5},
        {"anchor": "a" * 5, "positive": "p" * 5, "negative": "n" * 5000},
        {"anchor": "a" * 9000, "positive": "p", "negative": "n"},
        {"anchor": "a" * 9, "positive": "p" * 9, "negative": "n"},
        {"anchor": "a" * 700, "positive": "", "negative": "n"},
    ]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{broken")
    rows = read_rows(spark, str(tmp_path / "x.jsonl"), codepoints, LIMITED)
    held = F.coalesce(F.size(F.coalesce(F.flatten("slots"), F.array().cast("array<int>"))), F.lit(0))
    stored = sorted(tuple(r) for r in rows.select("pos", held, "slot_sizes").collect())
    assert [r[1] for r in stored] == [18, 20, 0, 0, 0, 0]
    assert [r[2] for r in stored[:4]] == [[6, 6, 6], [6, 6, 5001], [9001, 2, 2], [10, 10, 2]]
    assert sorted((r["pos"], r["n_tokens"]) for r in samples_of(rows, LIMITED).collect()) == [(0, 18), (1, 20)]


def test_needed_tokens_change_no_sample(spark):
    triplets = [(i, "a" * (i % 7), "p" * (i % 11), ["n" * (i % 13)]) for i in range(200)]
    rows = tokenize_slots(spark.createDataFrame(triplets, "id long, anchor string, positive string, negatives array<string>"), codepoints, LIMITED)
    for config in (LIMITED, LIMITED.with_(max_sample_length=None)):
        want, got = limit_length(rows, config), limit_length(needed_tokens(rows, config), config)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.fixture
def documents(spark, tmp_path):
    """A folder of documents: empty ones, one longer than a pack in each slot, and characters beyond 16 bits."""
    texts = [f"{i} " + "wörd \U0001f600 " * (i % 9) for i in range(60)]
    texts[7], texts[20], texts[21], texts[22], texts[40] = "", "x" * 20_000, "y\U0001f600" * 9_000, "z" * 8_191, "w" * 8_192
    rows = [(5 * i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_texts_go_to_packs_as_tokens_do(spark, documents):
    want, _ = flows.packed(flows.document_samples(spark, documents), flows.DOCS)
    got, _ = flows.packed_documents(spark, documents)
    assert got.columns == want.columns and got.count() > 8
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_texts_are_shuffled_to_packs_in_place_of_tokens(spark, documents):
    packs, _ = flows.packed_documents(spark, documents)
    tree = packs._jdf.queryExecution().optimizedPlan().toString()
    moved = tree.split("RepartitionByExpression")[1:]
    assert len(moved) == 2 and not any("ascii" in part for part in moved) and "ascii" in tree.split("RepartitionByExpression")[0]


def test_stored_texts_are_compressed_with_their_copies(spark, tmp_path):
    words = F.concat_ws(" ", *[F.md5(F.concat(F.col("id"), F.lit(f"-{k}"))) for k in range(40)])
    rows = spark.range(500).select(F.col("id").alias("doc_id"), words.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    rows.write.option("compression", "none").parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    files = flows.document_samples(spark, str(tmp_path)).inputFiles()
    size = sum(os.path.getsize(name.removeprefix("file://")) for name in files)
    assert size < 500 * 40 * 33  # each text is in three samples


def codecs(files) -> set[str]:
    found = [pq.ParquetFile(name.removeprefix("file://")).metadata for name in files]
    return {m.row_group(g).column(c).compression for m in found for g in range(m.num_row_groups) for c in range(m.num_columns)}


def test_lines_are_stored_compressed(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("".join(json.dumps({"anchor": f"{i}"}) + "\n" for i in range(20)))
    rows = jsonl.with_positions(jsonl.read_lines(spark, str(tmp_path)))
    assert rows.count() == 20
    lines = [name for name in rows.inputFiles() if "/lines-" in name]
    assert lines and codecs(lines) == {"ZSTD"}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_numbers_of_lines_are_stored_without_the_lines(spark):
    files = queries.jsonl_positions(spark, FOLDER).inputFiles()
    lines = [name.removeprefix("file://") for name in files if "/lines-" in name]
    assert lines and all("value" not in pq.ParquetFile(name).schema_arrow.names for name in lines)


def feed(folder, n=5):
    folder.mkdir()
    for i in range(n):
        line = {"anchor": f"a{i}", "positive": "p", "negative": "n"}
        (folder / f"f{i}.json").write_text(json.dumps(line) + "\n")
    return str(folder)


@pytest.mark.parametrize("delete", [False, True])
def test_a_feed_may_be_deleted_as_it_is_read(spark, tmp_path, delete):
    path, sink, state = feed(tmp_path / "feed"), str(tmp_path / "sink"), str(tmp_path / "state")
    run_available(stream_triplets(spark, path, 1, delete_read=delete), state, sink)
    rows = spark.read.parquet(sink)
    assert sorted(r["anchor"] for r in rows.collect()) == [f"a{i}" for i in range(5)]
    assert codecs(rows.inputFiles()) == {"ZSTD"}
    until = time.time() + 10
    while delete and len(os.listdir(path)) > 1 and time.time() < until:
        time.sleep(0.2)
    left = [name for name in os.listdir(path) if name.endswith(".json")]
    assert len(left) <= 1 if delete else len(left) == 5
    # Files that come later are read, and none a second time.
    (tmp_path / "feed" / "later.json").write_text(json.dumps({"anchor": "later", "positive": "p", "negative": "n"}) + "\n")
    run_available(stream_triplets(spark, path, 1, delete_read=delete), state, sink)
    assert sorted(r["anchor"] for r in spark.read.parquet(sink).collect()) == [*(f"a{i}" for i in range(5)), "later"]
