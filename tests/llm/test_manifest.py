"""Merkle manifest against a plain recursion."""

import hashlib
import zlib

import pytest
from packloom.llm.merkle_manifest import audit, build, folded, proof_digest, prove
from pyspark.sql import functions as F

KIND = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, lower=False):
    doc, source, lang, n_chars, text = row
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    values = [None if v is None else str(v) for v in (doc, source, lang, n_chars, text)]
    return digest(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def climb(nodes, place):
    """Root of some digests, and the siblings of one of them from below."""
    path = []
    while len(nodes) > 1:
        run = nodes[place // 16 * 16 : place // 16 * 16 + 16]
        path.append((run[: place % 16], run[place % 16 + 1 :]))
        nodes = [digest(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        place //= 16
    return nodes[0], path


def plain(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for source in order:
        by_source[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    leaves = {s: [leaf_of(r) for r in by_source[s]] for s in order}
    tops = [climb(leaves[s], 0)[0] for s in order]
    out = []
    for nth, source in enumerate(order):
        root, above = climb(tops, nth)
        for place, row in enumerate(by_source[source]):
            subroot, path = climb(leaves[source], place)
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            claim = leaf_of(row, tampered)
            for left, right in path + above:
                claim = digest(*left, claim, *right)
            proof = digest(*(x for left, right in path + above for x in left + right))
            out.append((row[0], leaf_of(row), subroot, root, proof, claim, claim == root))
    return sorted(out, key=repr)


def found(spark, rows):
    return sorted(map(tuple, audit(spark.createDataFrame(rows, KIND)).collect()), key=repr)


@pytest.mark.parametrize("sizes", [(1,), (17,), (300, 1, 16, 33, 2), (1,) * 18])
def test_manifest_equals_recursion(spark, sizes):
    rows = [(s * 1000 + i, f"src{s}", "en", i, f"Text {i} of {s}") for s, n in enumerate(sizes) for i in range(n)]
    assert found(spark, rows) == plain(rows)


def test_tampering_breaks_the_proof(spark):
    rows = [(i, "s", "en", 1, "All in Capitals" if i % 2 else "none") for i in range(60)]
    for row in audit(spark.createDataFrame(rows, KIND)).collect():
        changed = row["doc_id"] % 2 == 1 and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0
        assert row["verified"] != changed


def test_odd_documents_manifest(spark, odd_documents):
    rows = [tuple(r) for r in odd_documents.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    clashing = odd_documents.withColumn("leaf", F.lit(1)).withColumn("tree", F.lit(1)).withColumn("path", F.lit(1))
    assert sorted(map(tuple, audit(clashing).collect()), key=repr) == plain(rows)


def test_repeated_rows_and_null_sources(spark):
    rows = [(None, None, None, None, None)] * 40 + [(7, None, "en", 1, "B")] * 3 + [(7, "", "en", 1, "b"), (7, "é", "en", 1, "A"), (8, "z", None, 1, "")]
    assert found(spark, rows) == plain(rows)


def test_few_requests_read_their_paths_only(spark):
    rows = [(i, f"s{i % 3}", "en", 1, str(i)) for i in range(700)]
    manifest = build(spark.createDataFrame(rows, KIND))
    asked = manifest.leaves.where("doc_id IN (5, 333, 698)").select("tree", "place", "leaf", "doc_id")
    missing = spark.createDataFrame([(0, 10_000, "x", -1), (99, 0, "x", -2)], "tree long, place long, leaf string, doc_id long")
    got = prove(manifest, asked.unionByName(asked).unionByName(missing))
    got = got.select("doc_id", folded(F.col("path"), F.col("leaf")).alias("root"), proof_digest(F.col("path")).alias("proof")).collect()
    want = {r[0]: (r[3], r[4]) for r in plain(rows)}
    assert sorted(r["doc_id"] for r in got) == [5, 5, 333, 333, 698, 698]
    assert all((r["root"], r["proof"]) == want[r["doc_id"]] for r in got)


def test_empty_manifest(spark):
    docs = spark.createDataFrame([], KIND)
    assert audit(docs).count() == 0
    assert build(docs).root is None
