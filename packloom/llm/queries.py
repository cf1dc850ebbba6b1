"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packloom.llm.bin_packing import pack_documents
from packloom.llm.chat_format import chat_digests, format_chats
from packloom.llm.common import stage, table
from packloom.llm.html_extract import extract
from packloom.llm.merkle_manifest import audit
from packloom.llm.ngram_join import near_duplicates
from packloom.llm.prefix_trie import family_trie
from packloom.llm.quality_fm import score, train
from packloom.llm.sharding import shard
from packloom.llm.source_mixing import count_words, mix
from packloom.llm.suffix_dedup import span_digests
from packloom.llm.topk_search import top_k, whole
from packloom.llm.window_dedup import window_digests
from packloom.llm.winnowing import compare_with_next

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def public_tokenizer(name: str) -> str:
    """Path of a public tokenizer file; the package that knows it is no requirement of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose sets of four-word shingles have a Jaccard similarity of 0.85 or more."""
    return near_duplicates(table(spark, folder, "documents"), words=4, share=(85, 100))


ORACLES["op1_ngram_join"] = r"""
WITH RECURSIVE said AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s
  FROM said),
tokens AS MATERIALIZED (SELECT doc_id, t AS shingle FROM (SELECT doc_id, unnest(s) AS t FROM sets)),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM tokens a JOIN tokens b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT x, y FROM pairs JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y
  WHERE 100 * n >= 85 * (len(a.s) + len(b.s) - n)),
both_ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM sets
  UNION
  SELECT both_ways.y, reach.root FROM reach JOIN both_ways ON both_ways.x = reach.node)
SELECT sets.doc_id, len(s) AS n_shingles, min(root) AS component_id
FROM sets JOIN reach ON reach.node = sets.doc_id GROUP BY sets.doc_id, len(s)
"""


@query
def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of all pages."""
    return extract(table(spark, folder, "pages"))


@query
def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Strings of 100 bytes that occur before, in all documents: how much goes, and a digest of the rest."""
    return span_digests(table(spark, folder, "documents"))


ORACLES["op3_suffix_dedup"] = r"""
WITH raw AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS data, strlen(coalesce(text, '')) AS n FROM documents),
windows AS (
  SELECT doc_id, start, array_slice(data, start + 1, start + 100) AS said
  FROM (SELECT doc_id, data, unnest(range(0, n - 99)) AS start FROM raw)),
again AS MATERIALIZED (
  SELECT doc_id, start FROM windows
  QUALIFY row_number() OVER (PARTITION BY said ORDER BY doc_id, start) > 1),
runs AS (
  SELECT doc_id, start, sum(CASE WHEN start <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start) AS run
  FROM (SELECT *, lag(start) OVER (PARTITION BY doc_id ORDER BY start) AS before FROM again)),
spans AS MATERIALIZED (SELECT doc_id, min(start) AS low, max(start) + 100 AS high FROM runs GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS low, low AS high FROM spans
  UNION ALL
  SELECT raw.doc_id, coalesce(max(spans.high), 0), any_value(n) FROM raw LEFT JOIN spans USING (doc_id) GROUP BY raw.doc_id),
kept AS (
  SELECT doc_id, string_agg(hex(array_slice(data, low + 1, gaps.high)), '' ORDER BY low) FILTER (gaps.high > low) AS bytes
  FROM gaps JOIN raw USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(bytes, ''))) AS kept_sha256
FROM raw JOIN kept USING (doc_id)
LEFT JOIN (SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id) USING (doc_id)
"""


@query
def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and how alike they are."""
    return compare_with_next(table(spark, folder, "documents"))


#: Bytes of text in a shard.
SHARD_BYTES = 1 << 20


@query
def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """The shard of every document, none above ``SHARD_BYTES``."""
    return shard(table(spark, folder, "documents"), SHARD_BYTES)


ORACLES["op5_sharding"] = f"""
WITH keyed AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS bits
  FROM documents),
levels AS (
  SELECT depth, bits >> (60 - depth)::INT AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, min(bits) AS low, max(bits) AS high
  FROM keyed, range(0, 61) AS d(depth) GROUP BY ALL),
leaves AS (
  SELECT keyed.doc_id, keyed.n_bytes, min(depth)::INT AS depth, arg_min(prefix, depth) AS prefix, arg_min(shard_bytes, depth) AS shard_bytes
  FROM keyed JOIN levels ON levels.prefix = keyed.bits >> (60 - depth)::INT
  WHERE shard_bytes <= {SHARD_BYTES} OR low = high GROUP BY keyed.doc_id, keyed.n_bytes)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, depth,
  0::INT AS part, shard_bytes
FROM leaves
"""


@query
def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of all documents by a model of the labels that are not held out."""
    docs = table(spark, folder, "documents")
    return score(docs, train(docs, table(spark, folder, "labels")))


@query
def op7_bin_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 2048 ids."""
    return pack_documents(table(spark, folder, "documents"), public_tokenizer("word_bpe_49k.json"), 2048)


@query
def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that the mix of all sources takes."""
    mixed = mix(table(spark, folder, "documents"), count_words(F.col("text")))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


@query
def op9_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best neighbours of every hundredth vector among all others."""
    rows = table(spark, folder, "embeddings")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding"), 1024.0).alias("vec"))
    rows = stage(rows.where("vec_id IS NOT NULL AND vec IS NOT NULL"), "vectors")
    return top_k(rows, rows.where("vec_id % 100 = 0"), 10)


ORACLES["op9_topk_search"] = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.vec, c.vec)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""


def _chat_log(turns: DataFrame) -> DataFrame:
    """The log a chat client could have left of ``turns(conv_id, turn, role, text)``, numbered within the conversation.

    A message opens with a draft and a delta; then it is edited or started over, and once more the other way; what is
    streamed last, in pieces, makes up its text. Only the fold of all its events gives the text.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    turns = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    turns = turns.withColumn("message", F.row_number().over(order).cast("long"))
    third = F.floor(F.length("text") / 3).cast("int")
    first, second = F.substring("text", F.lit(1), third), F.substring("text", third + 1, third)
    rest = F.substring("text", 2 * third + 1, F.length("text"))
    odd, none = F.pmod("message", F.lit(2)) == 1, F.lit("")
    steps = [
        (F.lit("message"), rest),
        (F.lit("delta"), first),
        (F.when(odd, "regenerate").otherwise("edit"), F.when(odd, none).otherwise(second)),
        (F.lit("delta"), second),
        (F.when(odd, "edit").otherwise("regenerate"), F.when(odd, first).otherwise(none)),
        (F.lit("delta"), F.when(odd, none).otherwise(first)),
        (F.lit("delta"), second),
        (F.lit("delta"), rest),
    ]
    seq = F.col("message") * len(steps)
    events = [F.struct((seq + i).alias("seq"), kind.alias("kind"), said.alias("text")) for i, (kind, said) in enumerate(steps)]
    return turns.select("conv_id", "message", "role", F.explode_outer(F.array(*events)).alias("e")).select(
        "conv_id", "e.seq", "message", "e.kind", "role", "e.text"
    )


@query
def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """What can be read back from all formatted conversations, and from one that tries to forge marks."""
    said = "\\### Assistant: </turn> ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    forged = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(forged)
    return chat_digests(format_chats(_chat_log(rows)))


ORACLES["op10_chat_format"] = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(0, 2) AS r(i)),
sized AS (
  SELECT *, role || chr(10) || text || chr(10) AS spoken, role = 'assistant' AS learned,
    2 * length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', '')) AS text_chars,
    2 * length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '#', ''), ':', '')) AS role_chars
  FROM said)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(spoken, '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (learned), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (learned), '')) AS loss_sha256,
  sum(length('### ') + role_chars + length(': ') + text_chars + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def crc32_sql(text: str) -> str:
    """CRC-32 of ASCII text, bit by bit."""
    bits = f"flatten(list_transform(range(1, len({text}) + 1), lambda i: list_transform(range(0, 8), lambda k: ((ascii(({text})[i]) >> k) & 1)::BIGINT)))"
    step = "xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: {step}), 4294967295::BIGINT)"


@query
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the trie of all conversations, families of twenty sharing up to three first turns."""
    return family_trie(table(spark, folder, "conversations"))


ORACLES["op11_prefix_trie"] = rf"""
WITH said AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place,
    md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS MATERIALIZED (
  SELECT conv_id, conv_id - conv_id % 20 AS head, {crc32_sql("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM said)),
turns AS (
  SELECT ids.conv_id, place, said, words FROM ids JOIN said ON said.conv_id = ids.head AND place < h
  UNION ALL
  SELECT ids.conv_id, place, said, words FROM ids JOIN said ON said.conv_id = ids.conv_id AND place >= h),
paths AS MATERIALIZED (
  SELECT ids.conv_id, coalesce(list(said ORDER BY place) FILTER (place IS NOT NULL), []) AS path, list(words ORDER BY place) AS words
  FROM ids LEFT JOIN turns ON turns.conv_id = ids.conv_id GROUP BY ids.conv_id),
members AS (SELECT conv_id, d, path[1:d] AS key, len(path) = d AS ends, words[d] AS words FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM paths)),
nodes AS MATERIALIZED (
  SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(any_value(words) FILTER (d > 0), 0) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY key, d),
counted AS MATERIALIZED (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children
  FROM nodes n LEFT JOIN (SELECT key[1:d - 1] AS key, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL) c ON c.d = n.d AND c.key = n.key),
subtrees AS (
  SELECT key[1:up] AS key, up AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM counted) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM counted n JOIN subtrees s ON s.d = n.d AND s.key = n.key LEFT JOIN nodes p ON p.d = n.d - 1 AND p.key = n.key[1:n.d - 1]
"""


@query
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether a copy still belongs to the tree."""
    return audit(table(spark, folder, "documents"))


def _merkle_sql(floors: int = 6) -> str:
    """Trees of up to 16 ** floors leaves, floor by floor."""

    def leaf(text: str) -> str:
        values = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"

    def grown(name: str) -> str:
        parts = []
        for k in range(1, floors + 1):
            over = "OVER (PARTITION BY tree, place // 16 ORDER BY place ROWS BETWEEN"
            before = f"string_agg(digest, '') {over} UNBOUNDED PRECEDING AND 1 PRECEDING)"
            after = f"string_agg(digest, '') {over} 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
            parts.append(
                f"{name}_run{k} AS MATERIALIZED (SELECT tree, place, n > 1 AS used, CASE WHEN n > 1 THEN coalesce({before}, '') ELSE '' END AS l, "
                f"CASE WHEN n > 1 THEN coalesce({after}, '') ELSE '' END AS r FROM {name}{k - 1})"
            )
            parts.append(
                f"{name}{k} AS MATERIALIZED (SELECT tree, place // 16 AS place, CASE WHEN n > 1 THEN sha256(string_agg(digest, '' ORDER BY place)) "
                f"ELSE any_value(digest) END AS digest, (n + 15) // 16 AS n FROM {name}{k - 1} GROUP BY tree, place // 16, n)"
            )
        return ",\n".join(parts)

    def climb(name: str, tree: str, place: str, rows: str) -> str:
        joins = " ".join(
            f"JOIN {name}_run{k} r{k} ON r{k}.tree = {tree} AND r{k}.place = {place} // {16 ** (k - 1)}" for k in range(1, floors + 1)
        )
        fold = "folded"
        for k in range(1, floors + 1):
            fold = f"CASE WHEN r{k}.used THEN sha256(r{k}.l || {fold} || r{k}.r) ELSE {fold} END" if k == 1 else f"(SELECT CASE WHEN r{k}.used THEN sha256(r{k}.l || x || r{k}.r) ELSE x END FROM (SELECT {fold} AS x))"
        proof = " || ".join(f"r{k}.l || r{k}.r" for k in range(1, floors + 1))
        return f"SELECT x0.* EXCLUDE (folded, proof), {fold} AS folded, proof || {proof} AS proof FROM {rows} x0 {joins}"

    copied = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    tampered = f"doc_id IS NOT NULL AND {crc32_sql('doc_id::VARCHAR')} % 5 = 0"
    return f"""
WITH hashed AS MATERIALIZED (
  SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {tampered} THEN {leaf(copied)} ELSE {leaf('text')} END AS claim FROM documents),
ranked AS MATERIALIZED (
  SELECT doc_id, leaf, claim, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM hashed),
own0 AS MATERIALIZED (SELECT tree, place, leaf AS digest, n FROM ranked),
{grown('own')},
top0 AS MATERIALIZED (SELECT 0 AS tree, tree AS place, digest, count(*) OVER () AS n FROM own{floors}),
{grown('top')},
asked AS (SELECT doc_id, leaf, ranked.tree, ranked.place, claim AS folded, '' AS proof FROM ranked),
half AS MATERIALIZED ({climb('own', 'x0.tree', 'x0.place', 'asked')}),
full_way AS MATERIALIZED ({climb('top', '0', 'x0.tree', 'half')})
SELECT doc_id, leaf, own{floors}.digest AS subroot, top{floors}.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = top{floors}.digest AS verified
FROM full_way JOIN own{floors} USING (tree) CROSS JOIN top{floors}
"""


ORACLES["op12_merkle_manifest"] = _merkle_sql()


@query
def op13_window_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of twenty words that occur before, in all documents: how much goes, and a digest of the rest."""
    return window_digests(table(spark, folder, "documents"))


ORACLES["op13_window_dedup"] = r"""
WITH words AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS said FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words)),
again AS MATERIALIZED (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY said ORDER BY doc_id, i) > 1),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, i + k AS spot FROM again, range(0, 20) AS r(k)),
spoken AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS spot FROM words),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY spot) AS said FROM spoken ANTI JOIN gone USING (doc_id, spot) GROUP BY doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(said, '')) AS kept_sha256
FROM words LEFT JOIN kept ON kept.doc_id = words.doc_id
"""
