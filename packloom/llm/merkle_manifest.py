"""Merkle manifest of a table: a content-addressed tree over its rows, membership proofs, and their check.

Rows are leaves. The leaves of a source, in order of their ids, are taken ``FANOUT`` at a time, and so are
the runs' digests, until one is left: the source's subroot. Subroots in order of the sources give the root
in the same way. What is stored of a tree are records digest -> children, one for each distinct digest.

A proof is asked for by a leaf's source and rank. Nodes descend from the root: a node finds its record by
digest, the digits of the rank (in base ``FANOUT``) select the child to go on with, and the children on its
left and right are collected as a path segment. Requests below one node descend together, so the hot upper
nodes are rows of their own only once, and a request meets its path in the lowest node. The segments, which
come from the root down, are then reversed, and the leaf is folded up with them.

Leaves are hashed where they lie; only ids, sources and digests are shuffled. A large source is ranked
by range partitions, never in a single window, and a run is never more than ``FANOUT`` rows.

Defined cases: a null is its own mark in a leaf and differs from an empty text. A null source is a source, the
first one; null ids come first in their source and are never tampered with; rows of one id are ordered by
their digests, repeated rows are leaves of their own. A source of one leaf has it as subroot, a table of
one source has its subroot as root. An empty table gives an empty result. Columns that are not hashed
are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.llm.common import joinable, stage
from packloom.operators.positions import dense_positions

#: Children of a node; a power of two.
FANOUT = 16
_BITS = FANOUT.bit_length() - 1

HASHED = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def leaf_digest(*values: Column) -> Column:
    """Digest of a row: each value as ``-`` if null, else its count of UTF-8 bytes, ``:`` and itself."""

    def spelled(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(spelled, values)), 256)


@dataclass(frozen=True)
class Manifest:
    """A stored tree.

    ``leaves`` has ``tree, place, doc_id, leaf, claim`` (source number, rank in the source), ``trees`` has
    ``tree, source, n, height, subroot``. ``floors[f]`` has the records ``digest, children`` of nodes f + 1 floors
    above the leaves of their source, ``top[f]`` those of the tree over the subroots. ``root`` is null if
    the table is empty.
    """

    leaves: DataFrame
    trees: DataFrame
    floors: list[DataFrame]
    top: list[DataFrame]
    root: str | None


def _height(n: Column) -> Column:
    """Floors above n leaves: digits of the last rank."""
    return F.when(n > 1, F.ceil(F.length(F.bin(n - 1)) / _BITS)).otherwise(0).cast("int")


def _grow(nodes: DataFrame, tallest: int) -> tuple[list[DataFrame], DataFrame]:
    """Records of each floor above ``tree, height, place, digest`` nodes, and the highest nodes ``tree, subroot``."""
    floors = []
    tops = nodes.where("height = 0").select("tree", F.col("digest").alias("subroot"))
    for floor in range(1, tallest + 1):
        run = F.sort_array(F.collect_list(F.struct("place", "digest")))
        runs = nodes.where(F.col("height") >= floor).groupBy("tree", "height", F.shiftright("place", _BITS).alias("place")).agg(run.alias("run"))
        runs = runs.select("tree", "height", "place", F.transform("run", lambda x: x["digest"]).alias("children"))
        nodes = stage(runs.withColumn("digest", F.sha2(F.array_join("children", ""), 256)), "nodes")
        # Equal runs are one record.
        floors.append(stage(nodes.groupBy("digest").agg(F.first("children").alias("children")), "records"))
        tops = tops.unionByName(nodes.where(F.col("height") == floor).select("tree", F.col("digest").alias("subroot")))
    return floors, tops


def build(docs: DataFrame, claim: Column | None = None, hashed: tuple[str, ...] = HASHED) -> Manifest:
    """Manifest of ``docs``; of ``hashed``, the first column is the id and the second the source.

    ``claim`` is a digest per row that a proof will be folded with; without it, the leaf.
    """
    name, source = hashed[:2]
    leaf = leaf_digest(*(F.col(f"`{c}`") for c in hashed))
    rows = docs.select(
        F.col(f"`{name}`").cast("long").alias("doc_id"),
        F.col(f"`{source}`").cast("string").alias("source"),
        leaf.alias("leaf"),
        (leaf if claim is None else claim).alias("claim"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = stage(rows, "leaves")
    # ``row`` only spreads rows that are equal in all else.
    rows = dense_positions(rows, "source", "doc_id", "leaf", "row", name="pos")
    trees = stage(rows.groupBy("source").agg(F.min("pos").alias("first"), F.count("*").alias("n")), "sources")
    trees = dense_positions(trees, "first", name="tree").withColumn("height", _height(F.col("n")))
    trees = stage(trees, "trees")
    own = joinable(trees.select(F.col("source").alias("own"), "tree", "height", "first"))
    leaves = rows.join(own, rows["source"].eqNullSafe(F.col("own")))
    leaves = leaves.select("tree", "height", (F.col("pos") - F.col("first")).alias("place"), "doc_id", "leaf", "claim")
    leaves = stage(leaves, "ranked")
    n_trees, tallest = trees.agg(F.count("*"), F.coalesce(F.max("height"), F.lit(0))).first()
    floors, tops = _grow(leaves.withColumnRenamed("leaf", "digest"), tallest)
    trees = stage(trees.join(tops, "tree").select("tree", "source", "n", "height", "subroot"), "subroots")
    nodes = trees.select(
        F.lit(0).alias("tree"), _height(F.lit(n_trees)).alias("height"), F.col("tree").alias("place"), F.col("subroot").alias("digest")
    )
    top, roots = _grow(nodes, -(-(n_trees - 1).bit_length() // _BITS) if n_trees else 0)
    root = roots.first()
    return Manifest(leaves, trees, floors, top, root and root["subroot"])


def _segment(children: Column, digit: Column) -> Column:
    """What stands left and right of the selected child."""
    digit = digit.cast("int")
    left = F.array_join(F.slice(children, F.lit(1), digit), "")
    return F.struct(left.alias("left"), F.array_join(F.slice(children, digit + 2, F.lit(FANOUT)), "").alias("right"))


def _descend(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """The children of all nodes, with the segments that select them."""
    met = nodes.join(records, "digest").withColumn("below", F.col("children"))
    kept = [c for c in nodes.columns if c not in ("digest", "place", "path")]
    rows = met.select(*kept, "place", "path", "below", F.posexplode("children").alias("digit", "digest"))
    place = F.shiftleft("place", _BITS) + F.col("digit")
    path = F.array_append("path", _segment(F.col("below"), F.col("digit")))
    return rows.select(*kept, place.alias("place"), "digest", path.alias("path"))


def prove(manifest: Manifest, requests: DataFrame, *, every: bool = False) -> DataFrame:
    """``requests`` (``tree, place`` and other columns) with ``subroot, root`` and ``path``.

    ``path`` has a segment ``left, right`` of sibling digests for each floor, from the leaf to the root. Nodes
    that no request lies below are left out of the descent unless ``every`` says there are none. Requests for
    places that do not exist have no row.
    """
    spark = manifest.trees.sparkSession
    empty = "array<struct<left string, right string>>"
    start = spark.range(1 if manifest.root else 0).select(
        F.col("id").alias("place"), F.lit(manifest.root).alias("digest"), F.from_json(F.lit("[]"), empty).alias("path")
    )
    for records in reversed(manifest.top):
        start = _descend(start, records)
    heights = manifest.trees.select("tree", "height")
    start = start.select(F.col("place").alias("tree"), F.col("digest").alias("subroot"), "path").join(heights, "tree")
    start = stage(start, "descent")
    wanted = None if every else stage(requests.select("tree", F.shiftright("place", _BITS).alias("place")).distinct(), "wanted")
    asked = [wanted]
    for _ in manifest.floors[1:]:
        asked.append(None if every else asked[-1].select("tree", F.shiftright("place", _BITS).alias("place")).distinct())
    nodes = None
    for floor in range(len(manifest.floors), 0, -1):
        begun = start.where(F.col("height") == floor).select(
            "tree", "subroot", F.lit(0).cast("long").alias("place"), F.col("subroot").alias("digest"), "path"
        )
        nodes = begun if nodes is None else begun.unionByName(_descend(nodes, manifest.floors[floor]))
        if not every:
            nodes = nodes.join(asked[floor - 1], ["tree", "place"], "left_semi")
    root, path = F.lit(manifest.root), F.reverse("path").alias("path")
    alone = requests.where("place = 0").join(start.where("height = 0").select("tree", "subroot", "path"), "tree")
    found = alone.select(*requests.columns, "subroot", root.alias("root"), path)
    if nodes is None:
        return found
    # The lowest nodes meet the requests; a path is copied to them in the task that has it.
    lowest = nodes.join(manifest.floors[0], "digest").select("tree", F.col("place").alias("node"), "subroot", "path", "children")
    met = requests.withColumn("node", F.shiftright("place", _BITS)).join(lowest, ["tree", "node"])
    digit = F.col("place").bitwiseAND(F.lit(FANOUT - 1))
    met = met.where(digit < F.size("children")).withColumn("path", F.array_append("path", _segment(F.col("children"), digit)))
    return found.unionByName(met.select(*requests.columns, "subroot", root.alias("root"), path))


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf digest and the siblings of a path lead to."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def audit(docs: DataFrame) -> DataFrame:
    """Every row's leaf, subroot, root and proof, and whether a copy of the row still folds to the root.

    The copies of rows whose id has a CRC-32 divisible by 5 have A-Z in their text lower-cased.
    """
    text = F.translate("text", _UPPER, _UPPER.lower())
    copied = leaf_digest(*(text if c == "text" else F.col(c) for c in HASHED))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    claim = F.when(tampered, copied).otherwise(leaf_digest(*(F.col(c) for c in HASHED)))
    manifest = build(docs.select(*HASHED), claim)
    rows = prove(manifest, manifest.leaves.select("tree", "place", "doc_id", "leaf", "claim"), every=True)
    rows = rows.withColumn("folded_root", folded(F.col("path"), F.col("claim")))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
