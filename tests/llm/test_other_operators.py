"""Extraction, scoring, sharding, search, chats and the pipeline."""

import collections
import hashlib
import html
import random
import re
import time
import zlib

import corpus_pipeline
import numpy as np
import pytest
from packloom.llm import html_extract, quality_fm, sharding, topk_search
from packloom.llm.chat_format import chat_digests, fold_events, format_chats, read_back
from packloom.llm.html_labels import labelled_pages
from packloom.llm.queries import QUERIES
from pyspark.sql import functions as F

# --- extraction


@pytest.fixture(scope="module")
def model():
    return html_extract.trained_model()


def test_marginals_equal_enumeration(model):
    """Sum-product against the sum over all labellings of a small tree."""
    page = '<div class="post"><p>One two three.</p></div><div class="ad">Buy</div><p>Four</p>'
    nodes, _ = html_extract.parse(page)
    n, total, content = len(nodes), 0.0, np.zeros(len(nodes))
    for code in range(3 ** (n - 1)):
        states, weight = [0], 1.0
        for i in range(1, n):
            code, state = divmod(code, 3)
            states.append(state)
            weight *= model.pair[nodes[i].tag in html_extract._FLOW][states[nodes[i].parent]][state]
            weight *= np.exp(sum(model.unary[f][state] for f in html_extract._features(nodes[i]) if f in model.unary))
        total += weight
        content += weight * (np.asarray(states) == html_extract.CONTENT)
    assert model.marginals(nodes) == pytest.approx((content / total).tolist())


def test_held_out_layouts(model):
    right = wrong = exact = 0
    pages = list(labelled_pages(200, seed=77))
    for page in pages:
        nodes, blocks = html_extract.parse(page)
        chances = model.marginals(nodes)
        misses = sum((nodes[i].label == html_extract.CONTENT) != (chances[i] >= 0.5) for i, _ in blocks)
        right, wrong, exact = right + len(blocks) - misses, wrong + misses, exact + (misses == 0)
    assert wrong < 0.02 * right and exact > 0.9 * len(pages)


def test_pages(spark, folder):
    got = {r["page_id"]: r for r in QUERIES["op2_html_extraction"](spark, folder).collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        text = "\n".join(x for x in parts if x)
        assert (got[page["page_id"]]["text"], got[page["page_id"]]["n_chars"]) == (text, len(text))


def test_parts_that_are_no_text(model):
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no";</script></head><body>
      <header><a href=/>Logo</a></header><nav><ul><li><a href=a>Menu</a><li><a href=b>More</a></ul></nav>
      <div class="cookie-notice"><p>We use cookies on this site, as every site does.</p><button>OK</button></div>
      <main><article><h1>Head &amp; line</h1><p>First&nbsp;  line<br>goes on &lt;here&gt;<p>Second <b>bold <i>and</b> slanted
      <!-- <p>not this</p> --><ul><li>one<li>two</ul><div class="advert">Buy now, buy more.</div><p>Last</article></main>
      <aside class="sidebar"><p>Other stories that you may like to read.</p></aside>
      <form><label>Mail</label><input name=m><button>Go</button></form>
      <section class="comments"><div class="comment"><p>I do not agree with any of this at all.</p></div></section>
      <footer>&copy; 2020</footer><style>p{}</style>"""
    text = html_extract.main_text(page, model)
    assert text == "Head & line\nFirst line goes on <here>\nSecond bold and slanted\none\ntwo\nLast"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "a < b", "</p></div>", "<p>" * 2000, "<div>" * 2000 + "x", "&#xD800;&bogus;", "<a href='>x"])
def test_broken_pages(model, page):
    assert isinstance(html_extract.main_text(page, model), str)


SAID = "The harbour was rebuilt over eleven years, and each of its walls was measured twice before it was let into the sea."


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>t</title><p>{}</html>",
        "<html><head><meta charset=x><link rel=y href=z><style>p {{}}</style><p>{}<p>More.</html>",
        "<body><article><p><svg viewBox='0 0 1 1'><path d='M0'></p><p>{}</p></article><p><svg><path/></svg></p></body>",
        "<body><article><svg><path d='M0'><p>{}</p></article></body>",
        "<body><article><div><video src=a><p>none</div><p>{}</p></article><video src=b></video></body>",
        "<body><article><div><audio src=a></div><p>{}</p></article></body>",
        "<body><article><div><canvas></div><p>{}</p><div><canvas></canvas></div></article></body>",
        "<body><article><div><span><video><source src=a></span></div><p>{}</p></article></body>",
        "<body><ul><li><svg><title>a</title><li>{}</ul></body>",
    ],
)
def test_open_elements_do_not_swallow_the_page(page):
    blocks = [text for _, text in html_extract.parse(page.format(SAID))[1]]
    assert SAID in blocks
    assert not {"t", "a", "p {}"} & set(blocks)


@pytest.mark.parametrize(
    "page",
    [
        "<body><svg><foreignObject><div>none</div></foreignObject><text>none</text></svg><p>{}</p></body>",
        "<body><p><video src=a><p>none</p><div>none</div></video></p><p>{}</p></body>",
        "<body><select><option>none<option>none</select><p>{}</p><object><p>none</p><object>none</object></object></body>",
        "<head><title>none</title><script>'<p>none'</script></head><body><p>{}</p><script>none",
        "<p>{}</p><div><canvas><script>'</div>none'</script>none</canvas></div><template><p>none",
    ],
)
def test_unseen_elements_are_left_out_whole(page):
    assert [text for _, text in html_extract.parse(page.format(SAID))[1]] == [SAID]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><body>" + f"{SAID} " * 20, " ".join([SAID] * 20)),
        ("<h1>T</h1>text<br>more<p>para</p>tail", "T\ntext more\npara\ntail"),
        (f"<article><p>{SAID}</p>tail text</article>", f"{SAID}\ntail text"),
        (f"{SAID} {SAID}", f"{SAID} {SAID}"),
        (f"<b>{SAID}</b> and <i>{SAID}</i>", f"{SAID} and {SAID}"),
        (f"<body><nav><a href=x>Menu</a><a href=y>Other</a></nav>{SAID}<p>{SAID}</p>", f"{SAID}\n{SAID}"),
        (f"<body><nav>Go to<ul><li><a href=x>Menu</a></ul></nav><article>{SAID}<ul><li>one</ul></article>", f"{SAID}\none"),
    ],
)
def test_text_outside_of_blocks(model, page, text):
    assert html_extract.main_text(page, model) == text


@pytest.mark.parametrize("page", ["<section>" * 30_000 + "</div>" * 30_000, "<div><svg>" * 30_000, "<div>" * 30_000 + "x", "<p><canvas>" * 30_000])
def test_parsing_takes_linear_time(page):
    began = time.process_time()
    html_extract.parse(page)
    assert time.process_time() - began < 3


def test_odd_pages(spark, model):
    rows = [(1, None, None), (1, None, None), (None, "u", "<article><p>x</p></article>"), (2, "u", "<article><p>" + "y " * 200_000 + "</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extract(pages, model).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 1, 399_999]
    assert html_extract.extract(pages.where("false"), model).count() == 0


# --- quality


def test_interactions_in_linear_time():
    generator = np.random.default_rng(3)
    model = quality_fm.Model(0.3, generator.normal(size=50), generator.normal(size=(50, 4)))
    index, weight = np.asarray([3, 7, 20, 41]), np.asarray([0.5, 1.0, -2.0, 0.1])
    pairs = sum(
        model.factors[index[i]] @ model.factors[index[j]] * weight[i] * weight[j] for i in range(4) for j in range(i)
    )
    assert model.margin(index, weight) == pytest.approx(0.3 + model.linear[index] @ weight + pairs)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_held_out_accuracy(spark, folder, sf):
    folder = folder.replace("sf0.001", sf)
    got = {r["doc_id"]: r for r in QUERIES["op6_quality_classifier"](spark, folder).collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    right = n = 0
    for r in got.values():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    for label in labels:
        row = got[label["doc_id"]]
        if row["held_out"]:
            n += 1
            right += (row["score"] >= 0.5) == label["quality"]
            assert row["predicted"] == 1 or label["quality"] == 0
    assert right / n > 0.95


def test_scores_do_not_depend_on_order_or_neighbours(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    first = quality_fm.train(docs, labels)
    again = quality_fm.train(docs.repartition(5).select("text", "doc_id"), labels.repartition(3))
    assert first.packed() == again.packed()
    some = docs.where("doc_id < 20")
    alone = {r["doc_id"]: r["score"] for r in quality_fm.score(some, first).collect()}
    together = {r["doc_id"]: r["score"] for r in quality_fm.score(docs, first).collect()}
    assert all(together[k] == v for k, v in alone.items())


def test_odd_documents_quality(spark, odd_documents):
    labels = spark.createDataFrame([(3, 1), (3, 0), (7, 0), (None, 1), (6, None), (99, 1)], "doc_id long, quality int")
    model = quality_fm.train(odd_documents, labels)
    got = quality_fm.score(odd_documents, model).collect()
    assert len(got) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in got)
    kept = quality_fm.keep_good(odd_documents, model, 0.0)
    assert kept.columns == odd_documents.columns and kept.count() == odd_documents.count()
    empty = odd_documents.where("false")
    assert quality_fm.score(empty, quality_fm.train(empty, labels)).count() == 0
    assert quality_fm.keep_good(empty, model).count() == 0


def test_one_text_of_an_id_is_learned_from(spark):
    """However many rows an id has, a sample of n labelled ids fits n rows; more raise in the task."""
    docs = spark.range(3000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(spark.range(2, 40).select(F.col("id").cast("int").alias("doc_id"), F.lit("other words").alias("text")))
    labels = spark.range(1, 40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    first = quality_fm.train(docs, labels, sample=20)
    assert first.packed() == quality_fm.train(docs.repartition(7), labels, sample=20).packed()


# --- sharding


def check_shards(rows, limit):
    shards = collections.defaultdict(list)
    for r in rows:
        shards[r["shard"], r["part"]].append(r)
        assert len(r["shard"]) == r["depth"]
    for items in shards.values():
        size = sum(r["n_bytes"] for r in items)
        assert {r["shard_bytes"] for r in items} == {size}
        assert size <= limit or len(items) == 1
    names = {s for s, _ in shards}
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    return shards


@pytest.mark.parametrize("limit", [2000, 50_000, 10**9])
def test_shards_fit(spark, folder, texts, limit):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = sharding.shard(docs, limit).collect()
    assert sorted((r["doc_id"], r["n_bytes"]) for r in rows) == sorted((k, len((t or "").encode())) for k, t in texts)
    shards = check_shards(rows, limit)
    # Only buckets above the limit are split: a bucket and its sibling together exceed it.
    sizes = collections.Counter()
    for (name, _), items in shards.items():
        for depth in range(len(name) + 1):
            sizes[name[:depth]] += sum(r["n_bytes"] for r in items)
    assert all(sizes[name[:-1]] > limit for name, _ in shards if name)


def test_shards_of_odd_documents(spark, odd_documents, tmp_path):
    rows = sharding.shard(odd_documents, 150).collect()
    assert len(rows) == odd_documents.count()
    check_shards(rows, 150)
    assert sharding.shard(odd_documents.where("false"), 150).count() == 0
    sharding.write_shards(odd_documents.drop("range"), str(tmp_path / "out"), 150)
    assert spark.read.parquet(str(tmp_path / "out")).count() == odd_documents.count()


def test_rows_of_one_id_are_dealt_to_parts(spark):
    docs = spark.range(50).selectExpr("7L AS doc_id", "repeat('x', cast(id AS int)) AS text")
    check_shards(sharding.shard(docs, 100).collect(), 100)


# --- search


def best(vectors, k):
    out = []
    for q, a in vectors:
        if q % 100 == 0:
            found = sorted((-int(np.dot(a, b)), i) for i, b in vectors if i != q)[:k]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("n", "block", "queries"), [(700, 16, 4096), (300, 1024, 2), (5, 16, 4096)])
def test_search_equals_brute_force(spark, monkeypatch, n, block, queries):
    monkeypatch.setattr(topk_search, "QUERIES", queries)
    monkeypatch.setattr(topk_search, "ANNULUS_ROWS", 40)
    generator = np.random.default_rng(n)
    rows = [(i, generator.integers(-50, 50, 6).tolist()) for i in range(n)]
    rows = [(i, rows[3 % n][1] if i % 4 == 1 else v) for i, v in rows]
    frame = spark.createDataFrame(rows, "vec_id long, vec array<long>").repartition(3)
    got = topk_search.top_k(frame, frame.where("vec_id % 100 = 0"), 10, pivots=8, block=block)
    assert sorted(map(tuple, got.collect())) == best([(i, np.asarray(v)) for i, v in rows], 10)


def test_search_with_large_values(spark):
    rows = [(i, [10**8 * (i % 7), -(10**8), i]) for i in range(120)]
    frame = spark.createDataFrame(rows, "vec_id long, vec array<long>")
    got = topk_search.top_k(frame, frame.where("vec_id % 100 = 0"), 10)
    assert sorted(map(tuple, got.collect())) == best([(i, np.asarray(v, dtype=object)) for i, v in rows], 10)


def test_search_beyond_64_bits(spark):
    """Scores out of range are held at its ends; those in range are exact though their terms are not."""
    big = 1e17
    rows = [(0, [big, 1.0]), (1, [big, 0.0]), (2, [-big, 0.0]), (3, [0.0, 5.0]), (4, [1e-14, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>").select("vec_id", topk_search.whole(F.col("vector"), 1024.0).alias("vec"))
    whole = {r["vec_id"]: r["vec"] for r in frame.collect()}
    most = 2**63 - 1
    assert whole[1] == [most, 0] and whole[2] == [-most, 0]
    want = sorted(((i, max(-most, min(most, sum(a * b for a, b in zip(whole[0], v, strict=True))))) for i, v in whole.items() if i), key=lambda x: (-x[1], x[0]))
    got = topk_search.top_k(frame, frame.where("vec_id = 0"), 10).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == want
    a, b = np.asarray([[2**40, -(2**40), 3]]), np.asarray([[2**30, 2**30, 5], [2**30, -(2**30), 0], [-(2**30), 2**30, 0]])
    assert topk_search._scores(a, b).tolist() == [[15, most, -most]]


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [-inf, 1.0]), (5, []), (6, [0.5]), (7, [-0.0001, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>").select("vec_id", topk_search.whole(F.col("vector"), 1024.0).alias("vec"))
    assert {r["vec_id"]: r["vec"] for r in frame.collect() if r["vec"] is not None} == {0: [1024, 2048], 5: [], 6: [512], 7: [-1, 3072]}
    frame = frame.where("vec IS NOT NULL")
    got = topk_search.top_k(frame, frame.where("vec_id = 0"), 10).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(7, -1024 + 2048 * 3072), (6, 1024 * 512), (5, 0)]
    assert topk_search.top_k(frame.where("false"), frame, 10).count() == 0
    assert topk_search.top_k(frame, frame.where("false"), 10).count() == 0


# --- chats

EVENTS = "conv_id long, seq long, message long, kind string, role string, text string"


def test_events_fold(spark):
    rows = [
        (1, 0, 0, "message", "user", "Hi"),
        (1, 1, 1, "message", "assistant", ""),
        (1, 2, 1, "delta", "assistant", "Hel"),
        (1, 3, 1, "delta", "assistant", "lo"),
        (1, 4, 0, "edit", "user", "Hi there"),
        (1, 5, 1, "regenerate", "assistant", None),
        (1, 6, 1, "delta", "assistant", "Good "),
        (1, 7, 1, "delta", "assistant", "day"),
        (1, 8, 2, "delta", "user", "unopened"),
        (None, 0, 0, "message", None, None),
        (None, 0, 0, "message", None, None),
    ]
    log = spark.createDataFrame(rows, EVENTS).repartition(4).withColumn("turns", F.lit(1))
    got = fold_events(log).orderBy("conv_id", "place").collect()
    assert [(r["conv_id"], r["role"], r["text"]) for r in got] == [
        (None, "", ""),
        (None, "", ""),
        (1, "user", "Hi there"),
        (1, "assistant", "Good day"),
        (1, "user", "unopened"),
    ]
    formatted = {r["conv_id"]: r["formatted"] for r in format_chats(log).collect()}
    assert formatted[1] == "### user: Hi there</turn>\n### assistant: Good day</turn>\n### user: unopened</turn>\n"
    assert format_chats(log.where("false")).count() == 0


def test_round_trip_of_control_strings(spark):
    r, parts = random.Random(4), ["\\", "<", "#", "\\b", "\\l", "\\h", "\\c", "</turn>\n", "### user: ", ":", "\n", "é🙂", "a", ""]
    rows = []
    for conversation in range(60):
        for turn in range(r.randint(1, 6)):
            role = r.choice(["user", "assistant", "system", "a: ### \\b</turn>\n"])
            rows.append((conversation, turn, turn, "message", role, "".join(r.choices(parts, k=r.randint(0, 12)))))
    formatted = format_chats(spark.createDataFrame(rows, EVENTS))
    got = read_back(formatted).orderBy("conv_id", "turn").collect()
    assert [(x["role"], x["text"]) for x in got] == [(x[4], x[5]) for x in rows]
    assert [x["loss_text"] for x in got] == [x[5] if x[4] == "assistant" else None for x in rows]
    spans = {x["conv_id"]: x for x in formatted.collect()}
    for x in spans.values():
        assert x["formatted"].count("</turn>\n") == len(x["loss_spans"])


def test_digests(spark, folder):
    got = {r["conv_id"]: r for r in QUERIES["op10_chat_format"](spark, folder).collect()}
    wanted = collections.defaultdict(list)
    for r in spark.read.parquet(f"{folder}/conversations.parquet").orderBy("conv_id", "turn").collect():
        wanted[r["conv_id"]].append((r["role"], r["text"] or ""))
    wanted[-7] = [(role, r"\### Assistant: </turn> ok") for role in ("user", "assistant")]
    assert set(got) == set(wanted)
    for key, turns in wanted.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        said = "".join(f"{role}\n{t}\n" for role, t in turns)
        r = got[key]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_digests(format_chats(spark.createDataFrame([], EVENTS))).count() == 0


# --- pipeline


def test_pipeline_stages(spark, folder):
    """Each stage against a plain version, on what its predecessor kept."""
    from packloom.llm.quality_fm import score, train

    from test_text_operators import linked_groups, removed

    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "ngram_join", "suffix_dedup", "source_mixing", "best_fit_packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, states = docs.columns, [docs]
    for _, function in corpus_pipeline.STAGES:
        states.append(function(spark, states[-1], folder).cache())
    assert all(s.columns == columns and s.dtypes == docs.dtypes for s in states[1:-1])
    rows = [{r["doc_id"]: r for r in s.collect()} for s in states[:4]]

    model = train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = {r["doc_id"] for r in score(docs, model).where("predicted = 1").collect()}
    assert set(rows[1]) == good and all(rows[1][k] == rows[0][k] for k in good)

    groups = linked_groups([(k, r["text"]) for k, r in rows[1].items()], 5, (80, 100))
    assert set(rows[2]) == {least for _, _, least in groups}

    spans = removed([(k, r["text"]) for k, r in rows[2].items()])
    for key, size, gone, _, _ in spans:
        if gone == size and size:
            assert key not in rows[3]
        else:
            kept = len(rows[3][key]["text"].encode())
            assert size - gone <= kept <= size and rows[3][key]["n_chars"] == len(rows[3][key]["text"])
            assert gone or rows[3][key]["text"] == rows[2][key]["text"]

    copies = collections.Counter(r["doc_id"] for r in states[4].collect())
    assert set(copies) <= set(rows[3]) and max(copies.values()) <= 2
    words = {k: len(re.findall(r"[^ \t-\r]+", r["text"])) for k, r in rows[3].items()}
    assert sum(copies[k] * n for k, n in words.items()) == pytest.approx(1.5 * sum(words.values()), rel=0.02)

    final = states[5].collect()
    assert collections.Counter(r["doc_id"] for r in final if r["piece"] == 0) == copies
    assert len({(r["sequence_id"], r["offset"]) for r in final}) == len(final)
