"""Prefix trie of conversations: which conversations begin alike, for how long, and what that saves.

A node is a distinct sequence of first turns. Conversations are sorted by their sequences of turn digests and
cut into shards of neighbours. A shard holds a vertical index: for each (position, turn) the bitset of the
conversations that have this turn there. The trie is walked depth first: a node's bitset, intersected with
the posting of the turn that its first remaining member has next, is a child; the members of it are taken
out, until none is left. Bit counts are the nodes' members, and the members without a next turn end there.

Only nodes on the path of a shard's first or last conversation can go on in another shard. These open nodes
come out in parts, which are merged by the digest of their turns: members and leaves are summed, lists of
ends follow each other in the order of the shards. All others are whole, with the sums over their subtrees. A
group of equal conversations, or of equal beginnings, however large, is cut between shards like any other.

Digests have 128 bits and stand for turns and sequences.

Defined cases: turns are ordered by turn (null first), then role and text; a null role or text is empty. Equal
rows are turns of their own. Rows without a conversation id belong to no conversation and have no node. A
conversation without turns is a member of the root alone. An empty table has no node. Other columns are left
out. A conversation's digests (24 bytes a turn) have to fit one row; its texts need not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.llm.common import begin, joinable, stage
from packloom.llm.source_mixing import count_words

#: Conversations of a shard, about.
SHARD = 1024
ROOT = b"\0" * 16


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits of role and text."""
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(said, 256)), 1, 16)


def numbered_turns(rows: DataFrame) -> DataFrame:
    """Rows ``conv_id, place, turn, words`` of ``conv_id, turn, role, text``: places from 0, digests, words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("nth"), role, text)
    # Texts are not shuffled. The head of the text decides between turns of one number, and then its digest.
    turn = turn_digest(F.col("role"), F.col("text")).alias("turn")
    rows = rows.select("conv_id", "nth", "role", "text", turn, count_words(F.col("text")).cast("long").alias("words"))
    twice = Window.partitionBy("conv_id").orderBy("nth", "role", "text")
    tied = rows.groupBy("conv_id", "nth").agg(F.count("*").alias("n")).where("n > 1").select("conv_id").distinct()
    tied = joinable(stage(tied, "tied"))
    place = (F.row_number().over(Window.partitionBy("conv_id").orderBy("nth")) - 1).cast("long")
    plain = rows.drop("role", "text").join(tied, "conv_id", "left_anti").select("conv_id", place.alias("place"), "turn", "words")
    # Conversations with turns of equal number, usually none, are ordered by role and text as well.
    odd = rows.join(tied, "conv_id", "left_semi").select("conv_id", (F.row_number().over(twice) - 1).cast("long").alias("place"), "turn", "words")
    return plain.unionByName(odd)


def rebuilt(turns: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """``conv_id, place, turn, words`` where each conversation's first h turns are those of the first of its family.

    Conversation c has h = crc32(c) % ``most`` and the family c - c % ``family``; a family's head that has fewer
    turns, or does not exist, gives what it has. Conversations left without a turn have one row with a null place.
    """
    ids = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    ids = ids.select("conv_id", "n", h, (F.col("conv_id") - F.col("conv_id") % family).alias("head"))
    first = turns.where(F.col("place") < most - 1).select(F.col("conv_id").alias("head"), F.struct("place", "turn", "words").alias("t"))
    first = first.groupBy("head").agg(F.collect_list("t").alias("given"))  # fewer than ``most``
    own = turns.where(F.col("place") >= F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    heads = ids.join(first, "head", "left")
    given = F.filter(F.coalesce("given", F.array()), lambda t: t["place"] < F.col("h"))
    # A row per given turn, and one with nulls where neither given nor own turns are left.
    none = (F.size(given) == 0) & (F.col("n") <= F.col("h"))
    heads = heads.select("conv_id", given.alias("given"), none.alias("none"))
    heads = heads.where("none OR size(given) > 0").select("conv_id", F.explode_outer("given").alias("t"))
    return own.unionByName(heads.select("conv_id", "t.*"))


def paths(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, path`` (digests in order), ``words``."""
    step = F.when(F.col("place").isNotNull(), F.struct("place", "turn", "words"))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    return listed.select("conv_id", F.col("steps.turn").alias("path"), F.col("steps.words").alias("words"))


class _Nodes:
    """Nodes of one shard in depth-first order."""

    def __init__(self, ids: list[int], paths_: list[list[bytes]], words: list[list[int]]):
        self.ids, self.paths, self.words = ids, paths_, words
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.members: list[int] = []
        self.key: list[bytes] = []
        self.size: list[int] = []  # words of the last text
        self.ends: list[int] = []  # bitsets
        # The vertical index.
        self.postings: dict[tuple[int, bytes], int] = {}
        going: list[int] = []  # bitset of the conversations that have a turn at each position
        for i, path in enumerate(paths_):
            bit = 1 << i
            going.extend([0] * (len(path) - len(going)))
            for place, turn in enumerate(path):
                self.postings[place, turn] = self.postings.get((place, turn), 0) | bit
                going[place] |= bit
        self.going = [*going, 0]
        self._walk()

    def _add(self, parent: int, depth: int, members: int, key: bytes, size: int) -> int:
        for column, value in zip(
            (self.parent, self.depth, self.members, self.key, self.size, self.ends),
            (parent, depth, members, key, size, members & ~self.going[depth]),
            strict=True,
        ):
            column.append(value)
        return len(self.parent) - 1

    def _walk(self) -> None:
        stack = [self._add(-1, 0, (1 << len(self.ids)) - 1, ROOT, 0)]
        while stack:
            node = stack.pop()
            depth, key = self.depth[node], self.key[node]
            left = self.members[node] & self.going[depth]
            while left:
                first = (left & -left).bit_length() - 1
                turn = self.paths[first][depth]
                child = left & self.postings[depth, turn]
                left ^= child
                below = hashlib.blake2b(key + turn, digest_size=16).digest()
                stack.append(self._add(node, depth + 1, child, below, self.words[first][depth]))


def _listed(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def _ends_digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


_NODE = pa.schema(
    [
        ("open", pa.bool_()),
        ("key", pa.binary()),
        ("parent", pa.binary()),
        ("open_parent", pa.bool_()),
        ("conv_id", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("depth", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("words", pa.int64()),
        ("ends_sha256", pa.string()),
        ("ends", pa.list_(pa.int64())),
        ("above", pa.list_(pa.binary())),
    ]
)


def shard_nodes(ids: list[int], paths_: list[list[bytes]], words: list[list[int]]) -> pa.RecordBatch:
    """The nodes of one shard: whole ones with all their figures, open ones with what this shard adds.

    The counts of an open node are of its whole children and what is below them; ``above`` has the keys from
    the root to it.
    """
    nodes = _Nodes(ids, paths_, words)
    n = len(nodes.parent)
    # Members are numbered in the order of their paths, not of their ids.
    ends = [sorted(ids[i] for i in _listed(bits)) for bits in nodes.ends]
    edge = 1 | 1 << (len(ids) - 1)
    is_open = [bool(m & edge) for m in nodes.members]
    least = [min(x, default=None) for x in ends]
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):  # children come after their parents
        if not is_open[i]:
            leaves[i] += children[i] == 0
            saved[i] += (nodes.members[i].bit_count() - 1) * nodes.size[i]
        up = nodes.parent[i]
        if up >= 0:
            least[up] = least[i] if least[up] is None else min(least[up], least[i])
            if not is_open[i]:
                children[up] += 1
                leaves[up] += leaves[i]
                saved[up] += saved[i]
    above: list[list[bytes] | None] = []
    for i in range(n):
        up = nodes.parent[i]
        over = (above[up] if up >= 0 else None) or []  # the parent of an open node is open
        above.append([*over, nodes.key[i]] if is_open[i] else None)
    up_keys = [nodes.key[p] if p >= 0 else None for p in nodes.parent]
    columns = [
        is_open,
        nodes.key,
        up_keys,
        [p >= 0 and is_open[p] for p in nodes.parent],
        least,
        [least[p] if p >= 0 else None for p in nodes.parent],
        nodes.depth,
        [m.bit_count() for m in nodes.members],
        children,
        leaves,
        saved,
        nodes.size,
        [None if o else _ends_digest(e) for o, e in zip(is_open, ends, strict=True)],
        [e if o else None for o, e in zip(is_open, ends, strict=True)],
        above,
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODE, strict=True)], schema=_NODE)


def _merged(parts: DataFrame) -> DataFrame:
    """Open nodes, whole: the parts of all shards together."""
    summed = parts.groupBy("key").agg(
        F.first("parent").alias("parent"),
        F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"),
        F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("whole_children"),
        F.sum("n_leaves").alias("below_leaves"),
        F.sum("saved_tokens").alias("below_saved"),
        F.first("words").alias("words"),
        F.first("above").alias("above"),
    )
    summed = stage(summed, "open")
    grown = summed.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("open_children"))
    summed = summed.join(grown, "key", "left").withColumn("n_children", F.col("whole_children") + F.coalesce("open_children", F.lit(0)))
    own = summed.select(
        F.explode("above").alias("key"),
        (F.col("below_leaves") + (F.col("n_children") == 0).cast("long")).alias("leaves"),
        (F.col("below_saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    subtrees = own.groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One digest per key of sorted lists of ends, fed list by list."""
        key, state, begun = None, hashlib.sha256(), False
        for batch in batches:
            keys, found = [], []
            for now, ends in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if now != key:
                    if key is not None:
                        keys.append(key)
                        found.append(state.hexdigest())
                    key, state, begun = now, hashlib.sha256(), False
                if len(ends):
                    said = ",".join(map(str, ends.as_py()))
                    state.update((("," if begun else "") + said).encode())
                    begun = True
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    # Of conversations that end at a node, shards have ascending runs of ids.
    lists = parts.select("key", F.get("ends", F.lit(0)).alias("first"), "ends").repartition("key").sortWithinPartitions("key", "first")
    digests = lists.select("key", "ends").mapInArrow(digest, "key binary, ends_sha256 string")
    return summed.join(subtrees, "key").join(digests, "key").select(
        "key", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


_COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def trie(turns: DataFrame, shard: int = SHARD) -> DataFrame:
    """Nodes of ``conv_id, place, turn, words`` rows (see ``numbered_turns``), as the columns of ``_COLUMNS``."""
    spark = begin(turns)
    rows = stage(paths(turns), "paths")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // shard))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema)
        for at in range(0, table.num_rows, 4 * shard):  # a shard that drew far more than its share
            part = table.slice(at, 4 * shard)
            yield shard_nodes(*(part.column(c).to_pylist() for c in ("conv_id", "path", "words")))

    schema = pa.schema([("conv_id", pa.int64()), ("path", pa.list_(pa.binary())), ("words", pa.list_(pa.int64()))])
    kinds = (
        "open boolean, key binary, parent binary, open_parent boolean, conv_id long, parent_conv_id long, depth long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, words long, ends_sha256 string, ends array<long>, above array<binary>"
    )
    sorted_rows = rows.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    nodes = stage(sorted_rows.mapInArrow(walk, kinds), "nodes")
    merged = stage(_merged(nodes.where("open")), "merged")
    named = joinable(merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("named")))
    whole = nodes.where("NOT open")
    inner = whole.where("NOT open_parent").select(*_COLUMNS)
    hung = whole.where("open_parent").drop("parent_conv_id").join(named, "parent").withColumnRenamed("named", "parent_conv_id")
    tops = merged.join(named, "parent", "left").withColumnRenamed("named", "parent_conv_id")
    return inner.unionByName(hung.select(*_COLUMNS)).unionByName(tops.select(*_COLUMNS))


def family_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations after ``rebuilt`` has given families common first turns."""
    turns = stage(numbered_turns(conversations), "turns")
    return trie(rebuilt(turns))
