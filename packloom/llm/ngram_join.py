"""N-gram Jaccard join: documents whose shingle sets are alike, and the groups their links make.

Documents of equal sets are one class. Linked sets share a token among their first tokens by hash (the
prefix of |s| - needed overlap + 1 tokens), so classes meet in a bucket for each such token. Tokens that
more than ``HOT`` classes have are passed over: a class with k of them reaches k tokens further, which
leaves every linked pair a shared token that is not hot; only classes that consist mostly of hot tokens,
or have fewer others than their prefix needs, meet at those. Buckets with the same members are visited once.

In a bucket the classes form a signature tree: leaves hold bitmaps of the sets' tokens, nodes the bitmaps
OR-combined and the range of set sizes. The tree is traversed against itself; a pair of nodes is left
where the sizes, or the most tokens their bitmaps could share, rule out every link between them. What
remains joins classes to clusters, and each cluster's whole sets go through a second tree with an exact
check at the leaves. A bucket too large for one task is cut into slots, and pairs of slots are traversed
in tasks of their own. A cluster too large is cut into slots as well: each is traversed alone and
against the first one. What the links leave outside of the cluster's largest component, usually little, is
then cut into slots anew, and so is that component: pairs of slots with one outside are traversed, so that no
task holds more than two slots. No step lists the pairs of a group: edges lead to the smallest member of
what hangs together.

Set elements are 64-bit hashes of shingles.

Defined cases: null and empty texts, and texts without a word, have an empty set and no link; texts with
fewer words than a shingle have one element. Rows that share a doc_id are documents of their own, which
their texts alone can link; repeated rows are one document and each get its result. A null doc_id takes part
like any other, and stands for its group only if there is no other. An empty table gives an empty result.
Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.llm.common import begin, fresh, joinable, lean, lower_ascii, mix, numbered, sections, stage, unique_ids, word_hashes
from packloom.llm.graph import components

# A token of more classes is hot.
HOT = 64
# Classes of a bucket, and set elements and classes of a cluster, that one task traverses.
BUCKET = 4096
ELEMENTS = 4_000_000
MEMBERS = 8192
LEAF = 24
FANOUT = 6

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    weights = mix(np.arange(1, words + 1, dtype=np.uint64) * _GOLDEN)
    for first, last, data, offsets in sections(column):
        hashes, rows = word_hashes(lower_ascii(data), offsets)
        cuts = np.searchsorted(rows, np.arange(last - first + 1))
        # Shingles of the whole section; those that reach over a text's end are not used.
        n = max(len(hashes) - words + 1, 0)
        sums = np.zeros(n, np.uint64)
        for j, weight in enumerate(weights):
            sums += hashes[j : j + n] * weight
        sums = mix(sums)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a >= words:
                yield np.unique(sums[a : b - words + 1])
            elif b > a:
                short = (hashes[a:b] * weights[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mix(np.asarray([short], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def bitmap(tokens: np.ndarray, per_token: int = 1) -> np.ndarray:
    """Bits of the tokens' low digits in 64-bit words; a power of two of bits, at least ``per_token`` for each."""
    bits = 64
    while bits < per_token * len(tokens):
        bits *= 2
    out = np.zeros(bits // 64, np.uint64)
    spots = tokens & np.uint64(bits - 1)
    np.bitwise_or.at(out, (spots >> np.uint64(6)).astype(np.int64), np.uint64(1) << (spots & np.uint64(63)))
    return out


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    return bits if len(bits) == words else np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


class _Node:
    """A run of members, sorted by size: OR of their bitmaps, size range, most tokens that share a bit with others."""

    __slots__ = ("bits", "children", "extra", "first", "last", "matrix", "most", "least")

    def __init__(self, first: int, last: int, least: int, most: int, bits: np.ndarray, extra: int, children: list, matrix=None):
        self.first, self.last, self.least, self.most = first, last, least, most
        self.bits, self.extra, self.children, self.matrix = bits, extra, children, matrix


def traverse(
    sizes: np.ndarray,
    bitmaps: list[np.ndarray],
    share: tuple[int, int],
    linked: Callable[[int, int], bool] | None = None,
    side: np.ndarray | None = None,
    known: np.ndarray | None = None,
) -> np.ndarray:
    """Component numbers (the least member) of sets linked by a dual traversal of their signature tree.

    Members must be sorted by size. A pair of sets that no bound rules out is linked if ``linked`` says so,
    or at once without it. With ``side``, pairs of one side are looked at elsewhere; with ``known``, members
    of equal labels are linked from the start.
    """
    part, whole = share
    n = len(sizes)
    sizes = sizes.astype(np.int64)
    component = np.arange(n)
    if known is not None:
        _, first, label = np.unique(known, return_index=True, return_inverse=True)
        component = first[label]

    def node(first: int, last: int) -> _Node:
        words = min(len(b) for b in bitmaps[first:last])
        matrix = np.stack([_fold(b, words) for b in bitmaps[first:last]])
        set_bits = np.bitwise_count(matrix).sum(1).astype(np.int64)
        extra = sizes[first:last] - set_bits
        return _Node(first, last, int(sizes[first]), int(sizes[last - 1]), np.bitwise_or.reduce(matrix, axis=0), int(extra.max()), [], (matrix, extra))

    # A leaf's sizes stay within a factor of 1.5, so folding to its smallest bitmap loses little.
    level, first = [], 0
    while first < n:
        last = min(first + LEAF, int(np.searchsorted(sizes, max(sizes[first] * 3 // 2, sizes[first]), side="right")), n)
        level.append(node(first, last))
        first = last
    while len(level) > 1:
        above = []
        for i in range(0, len(level), FANOUT):
            group = level[i : i + FANOUT]
            words = min(len(g.bits) for g in group)
            folded = [_fold(g.bits, words) for g in group]
            # Folding lets more tokens of one set share a bit.
            extra = max(g.extra + int(np.bitwise_count(g.bits).sum()) * (len(g.bits) > words) for g in group)
            above.append(_Node(group[0].first, group[-1].last, group[0].least, group[-1].most, np.bitwise_or.reduce(np.stack(folded), axis=0), extra, group))
        level = above

    def settled(u: _Node, v: _Node) -> bool:
        """True if all members are linked already, or no pair of them is for this traversal."""
        a, b = component[u.first : u.last], component[v.first : v.last]
        if a.min() == a.max() == b.min() == b.max():
            return True
        if side is None:
            return False
        c, d = side[u.first : u.last], side[v.first : v.last]
        return c.min() == c.max() == d.min() == d.max()

    def hopeless(u: _Node, v: _Node) -> bool:
        """True if sizes or the most tokens in common rule out all pairs."""
        if whole * u.most < part * v.least or whole * v.most < part * u.least:
            return True
        words = min(len(u.bits), len(v.bits))
        common = int(np.bitwise_count(_fold(u.bits, words) & _fold(v.bits, words)).sum())
        folded_u, folded_v = len(u.bits) > words, len(v.bits) > words
        most = min(
            u.most if folded_u else common + u.extra,
            v.most if folded_v else common + v.extra,
        )
        return (whole + part) * most < part * (u.least + v.least)

    def meet(u: _Node, v: _Node) -> None:
        """All pairs of two leaves that could be alike."""
        (a, a_extra), (b, b_extra) = u.matrix, v.matrix
        words = min(a.shape[1], b.shape[1])
        if a.shape[1] > words:
            a = np.bitwise_or.reduce(a.reshape(len(a), -1, words), axis=1)
            a_extra = sizes[u.first : u.last] - np.bitwise_count(a).sum(1)
        if b.shape[1] > words:
            b = np.bitwise_or.reduce(b.reshape(len(b), -1, words), axis=1)
            b_extra = sizes[v.first : v.last] - np.bitwise_count(b).sum(1)
        common = np.bitwise_count(a[:, None, :] & b[None, :, :]).sum(2, dtype=np.int64)
        most = np.minimum(common + a_extra[:, None], common + b_extra)
        both = sizes[u.first : u.last][:, None] + sizes[v.first : v.last]
        open_pairs = (whole + part) * most >= part * both
        if u is v:
            open_pairs = np.triu(open_pairs, 1)
        if side is not None:
            open_pairs &= side[u.first : u.last][:, None] != side[v.first : v.last]
        while True:
            open_pairs &= component[u.first : u.last][:, None] != component[v.first : v.last]
            at = np.flatnonzero(open_pairs)
            if not len(at):
                return
            # Until the first link; those before it are not alike.
            for flat in at:
                i, j = divmod(int(flat), open_pairs.shape[1])
                open_pairs[i, j] = False
                if linked is None or linked(u.first + i, v.first + j):
                    x, y = component[u.first + i], component[v.first + j]
                    component[component == max(x, y)] = min(x, y)
                    break

    if n:
        pairs = [(level[0], level[0])]
        while pairs:
            u, v = pairs.pop()
            if (u is not v and hopeless(u, v)) or settled(u, v):
                continue
            if not u.children and not v.children:
                meet(u, v)
            elif u is v:
                pairs += [(x, y) for i, x in enumerate(u.children) for y in u.children[i:]][::-1]
            elif v.children and (not u.children or v.last - v.first >= u.last - u.first):
                pairs += [(u, y) for y in v.children][::-1]
            else:
                pairs += [(x, v) for x in u.children][::-1]
    return component


def _needed(sizes_sum: int, share: tuple[int, int]) -> int:
    part, whole = share
    return -(-part * sizes_sum // (whole + part))


def _prefix(n: int, share: tuple[int, int]) -> int:
    """Tokens of a set of which at least one is shared with every set linked to it."""
    part, whole = share
    return n - -(-part * n // whole) + 1


def _further(prefix: int) -> int:
    """Tokens beyond the prefix that are kept to make up for hot ones."""
    return 16 + prefix // 4


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first ``keys`` columns of a sorted stream."""
    rest: list[pa.RecordBatch] = []
    last: tuple[Any, ...] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        changed = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            changed |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if rest and key != last:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(a, b - a))
            last = key
    if rest:
        yield pa.Table.from_batches(rest)


def _stars(nodes: np.ndarray, component: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of all members to the smallest node of their component."""
    least = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(least, component, nodes)
    root = least[component]
    away = nodes != root
    return nodes[away], root[away]


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
    b = np.concatenate([y for _, y in found]) if found else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def signatures(docs: DataFrame, words: int, share: tuple[int, int], id_column: str, text_column: str) -> DataFrame:
    """Rows ``doc_id, n, c1, c2, head, bits``: set size, digest of the set, its first tokens, its bitmap."""
    begin(docs)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, c1, c2, heads, bits = [], [], [], [], []
            for tokens in shingle_sets(batch.column(1), words):
                n.append(len(tokens))
                c1.append(int(mix(tokens).sum(dtype=np.uint64).view(np.int64)))
                c2.append(int(mix(tokens ^ _GOLDEN).sum(dtype=np.uint64).view(np.int64)))
                prefix = _prefix(len(tokens), share)
                heads.append(tokens[: prefix + _further(prefix)].view(np.int64))
                bits.append(bitmap(tokens).tobytes())
            columns = [pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64())]
            columns += [pa.array(heads, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n", "c1", "c2", "head", "bits"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(lean(read), "doc_id long, n long, c1 long, c2 long, head array<long>, bits binary")


def buckets(nodes: DataFrame, share: tuple[int, int], hot: int = HOT) -> DataFrame:
    """Rows ``token, members, node``: the buckets of ``node, n, head`` rows in which all linked pairs meet.

    Counts per token are combined before they are shuffled; a hot token is counted, not gathered.
    """
    part, whole = share
    # As in _prefix and _further, in whole numbers.
    prefix = F.col("n") - F.expr(f"({part} * n + {whole - 1}) div {whole}") + 1
    rows = nodes.select("node", "n", prefix.cast("int").alias("prefix"), F.posexplode("head").alias("pos", "token"))
    counts = rows.groupBy("token").count().where("count > 1")
    shared = stage(rows.join(counts, "token"), "shared")
    # Positions of hot tokens: each one below the cut moves the cut on by one.
    heavy = shared.where(F.col("count") > hot).groupBy("node", "n", "prefix").agg(F.sort_array(F.collect_list("pos")).alias("hots"))
    room = F.expr("(16 + prefix div 4) * 4 div 5 - 1")
    cut = F.aggregate("hots", F.col("prefix"), lambda c, x: F.when(x < c, c + 1).otherwise(c))
    # A cut beyond the last token: fewer plain tokens than the prefix has, so linked sets may share hot ones only.
    mostly = (cut - F.col("prefix") > room) | (cut > F.col("n"))
    heavy = stage(heavy.select("node", cut.alias("cut"), mostly.alias("mostly")), "heavy")
    rows = shared.drop("n").join(joinable(heavy), "node", "left")
    plain = F.col("count") <= hot
    kept = (
        F.when(F.col("cut").isNull(), plain & (F.col("pos") < F.col("prefix")))
        .when(F.col("mostly"), plain | (F.col("pos") < F.col("prefix")))
        .otherwise(plain & (F.col("pos") < F.col("cut")))
    )
    rows = stage(rows.where(kept).select("token", "node"), "prefixes")
    groups = rows.groupBy("token").agg(
        F.count("*").alias("members"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum"), F.min("node").alias("least")
    )
    # Buckets of the same members are one.
    groups = groups.where("members > 1").groupBy("members", "sum", "least").agg(F.min("token").alias("token"))
    return rows.join(groups.select("token", "members"), "token")


def _slots(rows: DataFrame, group: str, slots, *others: str) -> DataFrame:
    """Rows with ``i, j, slot``: groups of several slots go to every pair of slots that holds theirs."""
    slot = F.pmod(F.xxhash64("node", F.lit(7)), F.col("slots")).cast("int")
    rows = rows.withColumn("slots", slots.cast("int")).withColumn("slot", slot)
    other = F.explode(F.sequence(F.lit(0), F.col("slots") - 1))
    rows = rows.withColumn("other", other)
    return rows.select(
        group, F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"), "slot", "node", *others
    )


def _weight():
    """Elements that a class of ``n`` counts for: as many small ones as ``MEMBERS`` fill a task as well."""
    return F.greatest("n", F.lit(ELEMENTS // MEMBERS))


def _outside(large: DataFrame, main: DataFrame) -> DataFrame:
    """Rows ``node, component, i, j, slot, label``: what lies outside of the main components meets itself and these.

    Both are cut into slots of their own, those of the main component last, and go to pairs of slots of which
    the first is outside.
    """
    rows = large.select("node", "component", "label").join(main, "component")
    outside = F.col("label") != F.col("main.label")
    rows = rows.withColumn("away", F.ceil((F.col("elements") - F.col("main.elements")) / ELEMENTS).cast("int")).where("away > 0")
    rows = rows.withColumn("home", F.ceil(F.col("main.elements") / ELEMENTS).cast("int"))
    place = F.xxhash64("node", F.lit(7))
    slot = F.when(outside, F.pmod(place, F.col("away"))).otherwise(F.col("away") + F.pmod(place, F.col("home")))
    rows = rows.withColumn("slot", slot.cast("int"))
    others = F.col("away") + F.when(outside, F.col("home")).otherwise(0)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    return rows.select("node", "component", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"), "slot", "label")


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    share: tuple[int, int] = (80, 100),
    *,
    hot: int = HOT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Rows ``doc_id, n_shingles, component_id`` for links at ``share[1]`` * intersection >= ``share[0]`` * union.

    ``component_id`` is the smallest doc_id that links reach.
    """
    begin(docs)
    if unique_ids(docs, id_column):
        return _linked(docs, words, share, hot, id_column, text_column)
    # Ids that are null or not unique: the distinct rows are numbered in the order of ids, a null last.
    rows = numbered(docs, id_column, text_column)
    found = stage(_linked(rows, words, share, hot, "doc", "text"), "linked")
    found = found.withColumnRenamed("doc_id", "doc").withColumnRenamed("component_id", "first")
    found = found.join(rows.select(F.col("doc").alias("first"), F.col("id").alias("component_id")), "first")
    found = found.join(rows, "doc").select("id", F.col("text").alias("own"), "n_shingles", "component_id")
    each = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("text").eqNullSafe(F.col("own"))
    return each.join(found, same).select("doc_id", "n_shingles", "component_id")


def _linked(docs: DataFrame, words: int, share: tuple[int, int], hot: int, id_column: str, text_column: str) -> DataFrame:
    """``near_duplicates`` of documents with unique ids."""
    sets = stage(signatures(docs, words, share, id_column, text_column), "signatures")
    classes = stage(sets.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("node")), "classes")
    leaders = joinable(classes.select("c1", "c2", F.col("node").alias("doc_id")))
    nodes = sets.where("n > 0").join(leaders, ["c1", "c2", "doc_id"], "left_semi")
    nodes = nodes.withColumnRenamed("doc_id", "node")
    rows = buckets(nodes.select("node", "n", "head"), share, hot)
    rows = _slots(rows, "token", F.ceil(F.col("members") / BUCKET))
    signed = sets.where("n > 0").select(F.col("doc_id").alias("node"), "n", "bits")
    rows = rows.join(signed, "node").select("token", "i", "j", "n", "slot", "node", "bits")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "node")

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for group in _groups(batches, 3):
            node = group.column("node").to_numpy()
            slot = group.column("slot").to_numpy()
            bits = [np.frombuffer(b.as_py(), np.uint64) for b in group.column("bits")]
            component = traverse(group.column("n").to_numpy(), bits, share, side=slot if slot.min() != slot.max() else None)
            found.append(_stars(node, component))
            if len(found) >= 5000:
                yield _edges(found)
                found = []
        yield _edges(found)

    clusters = stage(components(rows.mapInArrow(lean(cluster), "a long, b long")), "clusters")

    # Whole sets, once for each class that has a candidate; the tree of each cluster ends in exact checks.
    members = nodes.select("node", "n").join(clusters, "node")
    totals = members.groupBy("component").agg(F.sum(_weight()).alias("elements"))
    slots = F.ceil(F.col("elements") / ELEMENTS).cast("int")
    slot = F.pmod(F.xxhash64("node", F.lit(7)), F.col("slots")).cast("int")
    members = members.join(totals, "component").select("node", "n", "component", slots.alias("slots")).withColumn("slot", slot)
    members = stage(members.select("node", "n", "component", "slots", "slot", F.col("node").alias("label")), "members")
    texts = docs.select(F.col(id_column).cast("long").alias("node"), F.col(text_column).cast("string").alias("text"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            tokens = list(shingle_sets(group.column("text").combine_chunks(), words))
            sizes = np.asarray([len(t) for t in tokens], np.int64)
            order = np.argsort(sizes, kind="stable")
            order = order[sizes[order] > 0]
            tokens = [tokens[i] for i in order]
            slot, label = (group.column(c).to_numpy()[order] for c in ("slot", "label"))

            def linked(x: int, y: int, tokens: list = tokens) -> bool:
                a, b = tokens[x], tokens[y]
                spots = np.minimum(np.searchsorted(b, a), len(b) - 1)
                common = int((b[spots] == a).sum())
                return common >= _needed(len(a) + len(b), share)

            # Two slots that meet have been, or are, traversed alone, or are linked: only what lies between them is open.
            side = slot if len(slot) and slot.min() != slot.max() else None
            component = traverse(sizes[order], [bitmap(t, 4) for t in tokens], share, linked, side, label)
            yield _edges([_stars(group.column("node").to_numpy()[order], component)])

    def checked(placed: DataFrame) -> DataFrame:
        """Links found in each group ``component, i, j`` of ``node, slot, label`` rows."""
        rows = texts.join(joinable(stage(placed, "placed")), "node").select("component", "i", "j", "slot", "label", "node", "text")
        rows = rows.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j")
        return stage(rows.mapInArrow(lean(check), "a long, b long"), "linked")

    alone = F.struct(F.col("slot").alias("i"), F.col("slot").alias("j"))
    first = F.struct(F.lit(0).alias("i"), F.col("slot").alias("j"))
    all_others = F.transform(F.sequence(F.lit(1), F.col("slots") - 1), lambda j: F.struct(F.lit(0).alias("i"), j.alias("j")))
    meets = F.when(F.col("slots") == 1, F.array(alone)).when(F.col("slot") > 0, F.array(alone, first)).otherwise(F.concat(F.array(alone), all_others))
    placed = members.withColumn("at", F.explode(meets)).select("node", "component", "slot", "label", "at.*")
    links = checked(placed)
    large = members.where("slots > 1")
    if not large.isEmpty():
        # A link that is still missing has an end outside of its cluster's largest component.
        reached = stage(components(links), "reached").withColumnRenamed("component", "reached")
        large = large.drop("label").join(reached, "node", "left").withColumn("label", F.coalesce("reached", "node"))
        large = stage(large.drop("reached"), "labelled")
        labels = large.groupBy("component", "label").agg(F.count("*").alias("count"), F.sum(_weight()).alias("elements"))
        main = labels.groupBy("component").agg(
            F.max_by(F.struct("label", "elements"), F.struct("count", "label")).alias("main"), F.sum("elements").alias("elements")
        )
        links = links.unionByName(checked(_outside(large, main)))
    found = stage(components(links), "components").withColumnRenamed("component", "reached")
    groups = classes.join(joinable(found), "node", "left").select("c1", "c2", F.coalesce("reached", "node").alias("component_id"))
    return (
        sets.join(joinable(stage(groups, "groups")), ["c1", "c2"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).alias("group"))
        .select("doc_id", "n_shingles", F.coalesce("group", "doc_id").alias("component_id"))
    )


def keep_one(docs: DataFrame, groups: DataFrame, *, id_column: str = "doc_id") -> DataFrame:
    """The document of each group that has its smallest id, all columns; ``groups`` as of ``near_duplicates``.

    Of rows that share this id one stays. A row without id cannot be named by a group and stays.
    """
    key, place = fresh("__id", docs), fresh("__place", docs)
    same = docs[id_column].cast("long").eqNullSafe(F.col(key))
    if unique_ids(docs, id_column):
        first = stage(groups.where("doc_id = component_id").select(F.col("doc_id").alias(key)), "first")
        return docs.join(joinable(first), same, "left_semi")
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    kept = docs.where(F.col(id_column).isNotNull()).join(first, same, "left_semi")
    # Combined before the shuffle: an id of very many rows is one row a task.
    others = [F.col(f"`{c}`") for c in docs.columns if c != id_column]
    kept = kept.groupBy(id_column).agg(F.min(F.struct(*others)).alias(place))
    kept = kept.select(*(F.col(f"`{c}`") if c == id_column else F.col(place)[c].alias(c) for c in docs.columns))
    return kept.unionByName(docs.where(F.col(id_column).isNull()))
