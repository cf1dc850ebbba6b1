"""Suffix-array deduplication: byte strings of a given length that occur before are found and removed.

Documents are byte strings in order of their ids. A sparse suffix array is enough to judge every string
of ``LENGTH`` bytes (a window): the smallest hash of its 32-byte grams picks one suffix in it, and equal
windows pick equal places. Windows of a document that pick the same suffix are one row: the suffix's
leading bytes and gram, a hash of all bytes the windows cover, and where they lie.

1. Splitters sampled from the rows cut their order into ranges; each row goes to its range.
2. A range is sorted by multikey quicksort, by leading bytes and gram, then covered bytes, then place.
   Rows of equal covered bytes after the first are repeats. First rows that share a gram with other
   bytes around it have windows still to compare. Groups at either end of a range may go on in the
   next one and are settled across boundaries, by sums over those groups alone.
3. For the rows still to compare, the covered bytes themselves are brought together by gram, and their
   windows sorted and compared.

All of this works on the input as it is; nothing depends on what another comparison removes.

Defined cases: a null text is empty, texts below the length have no window. Ids are integers; a null id
comes last. Rows equal in id and text are one document, rows that share only the id are ordered by
their text. An empty table gives an empty result. Other columns are kept or left out as the function says.
Windows, grams and covered bytes are compared by 64-bit hashes together with their leading bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.llm.common import BROADCAST_ROWS, begin, fresh, joinable, mix, prefix_hash, sections, span_hash, stage, text_bytes, unique_ids
from packloom.operators.positions import dense_positions

LENGTH = 100
GRAM = 32
# Rows of a range, about, and rows sampled for the splitters.
RANGE_ROWS = 400_000
SAMPLE_ROWS = 100_000
# Rows of one gram whose bytes are compared in one task. A larger group is cut by its windows' hashes and read
# once for each cut; from SPREAD_ROWS on its windows are rows of their own, each of which goes to one task.
GRAM_ROWS = 2_000
SPREAD_ROWS = 100_000
# Texts whose rows to compare are cut out at once.
CUT_TEXTS = 256
# Longer runs of bytes are worked through in pieces that overlap by a window.
PIECE = 1 << 22

_SIGN = np.uint64(1 << 63)


def _signed(x: np.ndarray) -> np.ndarray:
    """Longs in the order of the unsigned values."""
    return (x ^ _SIGN).view(np.int64)


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each run of ``width`` values: smallest of a block's end and the next block's beginning."""
    n = len(keys) - width + 1
    padded = np.append(keys, np.full(-len(keys) % width, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def picked_suffixes(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Rows of some texts: order key of the suffix, hash of the covered bytes, text, first window, windows."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    sums = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    grams = span_hash(sums, at, at + gram)
    low = np.uint64((1 << 24) - 1)
    least = _sliding_min((grams & ~low) | (low - at.astype(np.uint64)), length - gram + 1)
    anchor = (low - (least & low)).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(len(least)), side="right") - 1
    windows = np.flatnonzero(np.arange(len(least)) + length <= offsets[row + 1])
    if not len(windows):
        return none, none, none, none, none
    anchor, row = anchor[windows], row[windows]
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))
    start, end = windows[first], windows[np.append(first[1:], len(windows)) - 1]
    anchor, row = anchor[first], row[first]
    covered = mix(span_hash(sums, start, end + length) + (anchor - start).astype(np.uint64))
    lead = np.zeros(len(anchor), np.uint64)
    for i in range(3):
        lead = (lead << np.uint64(8)) | data[anchor + i]
    key = (lead << np.uint64(40)) | (grams[anchor] >> np.uint64(24))
    return _signed(key), _signed(covered), row, start - offsets[row], end - start + 1


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, byte offset of its beginning, bytes and offsets of runs of texts; a long text comes in pieces."""
    for first, _, data, offsets in sections(column):
        if len(data) <= PIECE:
            yield first, 0, data, offsets
            continue
        for at in range(0, max(len(data) - length + 1, 1), PIECE):
            part = data[at : at + PIECE + length - 1]
            yield first, at, part, np.asarray([0, len(part)])


_SUFFIX = "key long, covered long, doc long, place long"


def _suffixes(docs: DataFrame, length: int, every: int = 1, splitters: np.ndarray | None = None) -> DataFrame:
    """Rows ``key, covered, doc, place`` (first window and windows in one number), and their range."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for base, shift, data, offsets in _pieces(batch.column(1), length):
                key, covered, row, start, count = picked_suffixes(data, offsets, length)
                columns = [key, covered, ids[base + row], (start + shift << 16) | count]
                columns = [c[::every] for c in columns]
                if splitters is not None:
                    columns.append(np.searchsorted(splitters, _spelled(*columns[:3]), side="right").astype(np.int32))
                names = ["key", "covered", "doc", "place", "range"][: len(columns)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return docs.mapInArrow(read, _SUFFIX + (", range int" if splitters is not None else ""))


def _spelled(key: np.ndarray, covered: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Byte strings in the order of the three columns."""
    words = np.stack([key, covered, doc], 1).view(np.uint64) ^ _SIGN
    return words.astype(">u8").view("S24").ravel()


def multikey_order(*keys: np.ndarray) -> np.ndarray:
    """Order by several keys: by the first, then only what is equal so far by the next."""
    order = np.argsort(keys[0], kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = keys[0][order[1:]] == keys[0][order[:-1]]
    for key in keys[1:]:
        tied = same.copy()
        tied[:-1] |= same[1:]
        spots = np.flatnonzero(tied)
        if not len(spots):
            break
        part = order[spots]
        run = np.cumsum(~same[spots])
        part = part[np.lexsort((key[part], run))]
        order[spots] = part
        again = np.zeros(len(spots), bool)
        again[1:] = (run[1:] == run[:-1]) & (key[part[1:]] == key[part[:-1]])
        same = np.zeros(len(order), bool)
        same[spots] = again
    return order


# What a row turned out to be.
REPEAT, COMPARE, OPEN = 0, 1, 2


def _sort_ranges(rows: DataFrame) -> DataFrame:
    """Rows that repeat others, have windows to compare, or belong to a group at an end of their range."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), rows_schema)
        if not table.num_rows:
            return
        key, covered, doc, place = (table.column(c).to_numpy() for c in ("key", "covered", "doc", "place"))
        order = multikey_order(key, covered, doc, place)
        key, covered, doc, place = key[order], covered[order], doc[order], place[order]
        new_key = np.append(True, key[1:] != key[:-1])
        new = new_key | np.append(True, covered[1:] != covered[:-1])
        group = np.cumsum(new_key) - 1
        several = np.bincount(group, new)[group] > 1
        kind = np.where(~new, REPEAT, np.where(several, COMPARE, -1))
        # A row after another of its kind repeats it wherever the group begins and ends.
        kind[new & ((group == 0) | (group == group[-1]))] = OPEN
        used = kind >= 0
        known = kind[used] != REPEAT  # key and bytes matter for the others only
        columns = [kind[used].astype(np.int32), key[used] * known, covered[used] * known, doc[used], place[used]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "key", "covered", "doc", "place"])

    rows_schema = pa.schema([("key", pa.int64()), ("covered", pa.int64()), ("doc", pa.int64()), ("place", pa.int64())])
    return rows.select("key", "covered", "doc", "place").mapInArrow(sort, "kind int, " + _SUFFIX)


def _settle(rows: DataFrame) -> DataFrame:
    """Open rows judged across the boundaries of ranges."""
    firsts = rows.groupBy("key", "covered").agg(F.min(F.struct("doc", "place")).alias("first"))
    firsts = stage(firsts, "firsts")
    several = firsts.groupBy("key").agg(F.count("*").alias("several"))
    firsts = firsts.join(several, "key")
    kind = F.when(F.struct("doc", "place") != F.col("first"), REPEAT).when(F.col("several") > 1, COMPARE)
    return rows.join(firsts, ["key", "covered"]).select(kind.alias("kind"), "key", "covered", "doc", "place").where("kind IS NOT NULL")


def _compare_windows(docs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """Windows ``doc, place`` of the rows to compare that occur before."""
    wanted = rows.groupBy("doc").agg(F.collect_list(F.struct("key", "place")).alias("wanted"))
    if rows.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, CUT_TEXTS) for b in batches for at in range(0, b.num_rows, CUT_TEXTS)):
            data, offsets = text_bytes(batch.column("text"))
            lists = batch.column("wanted")
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            items = lists.flatten()
            key, place = (items.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            begin_ = offsets[owner] + (place >> 16)
            end = begin_ + (place & 0xFFFF) + length - 1
            parts = [data[a:b].tobytes() for a, b in zip(begin_, end, strict=True)]
            doc = batch.column("doc").to_numpy()[owner]
            columns = [pa.array(key), pa.array(doc), pa.array(place >> 16), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "doc", "start", "bytes"])

    parts = docs.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(cut, "key long, doc long, start long, bytes binary")
    sizes = rows.groupBy("key").count().where(F.col("count") > GRAM_ROWS)
    sizes = stage(sizes.select("key", F.ceil(F.col("count") / GRAM_ROWS).cast("int").alias("cuts")), "cuts")
    parts = parts.join(joinable(sizes), "key", "left").withColumn("slots", F.coalesce("cuts", F.lit(1)))
    spread = F.col("slots") > -(-SPREAD_ROWS // GRAM_ROWS)
    hot = parts.where(spread).select("key", F.lit(0).alias("slot"), F.lit(1).alias("slots"), "doc", "start", "bytes")
    parts = parts.where(~spread).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    parts = parts.repartition("key", "slot").sortWithinPartitions("key", "slot")

    def windows_of(batch: pa.RecordBatch) -> list[np.ndarray]:
        """Gram, slot, leading bytes, hash, document and start of the windows that fall to the rows' slots."""
        key, doc, start, slot, slots = (batch.column(c).to_numpy() for c in ("key", "doc", "start", "slot", "slots"))
        found = []
        for base, _, data, offsets in sections(batch.column("bytes")):
            sums = prefix_hash(data)
            windows = np.diff(offsets) - length + 1
            owner = np.repeat(np.arange(len(windows)), windows)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
            at = offsets[owner] + nth
            said = span_hash(sums, at, at + length)
            lead = np.zeros(len(at), np.uint64)
            for i in range(8):
                lead = (lead << np.uint64(8)) | data[at + i]
            row = base + owner
            own = said % slots[row].astype(np.uint64) == slot[row].astype(np.uint64)
            row, nth = row[own], nth[own]
            found.append((key[row], slot[row], lead[own], said[own], doc[row], start[row] + nth))
        return [np.concatenate(c) for c in zip(*found, strict=True)]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # windows of the last gram and slot so far, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            found = windows_of(batch)
            if held is not None:
                found = [np.concatenate(c) for c in zip(held, found, strict=True)]
            last = batch.num_rows - 1
            over = (found[0] != batch.column("key")[last].as_py()) | (found[1] != batch.column("slot")[last].as_py())
            yield judged(*(c[over] for c in found))
            held = [c[~over] for c in found]
        if held is not None:
            yield judged(*held)

    def judged(key, slot, lead, said, doc, start) -> pa.RecordBatch:
        """Repeated windows of some grams, neighbours joined to one row."""
        order = multikey_order(key, lead, said, doc, start)
        again = np.zeros(len(order), bool)
        now, before = order[1:], order[:-1]
        again[1:] = (key[now] == key[before]) & (lead[now] == lead[before]) & (said[now] == said[before])
        doc, start = doc[order[again]], start[order[again]]
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1))[: len(doc)]
        nth = np.arange(len(doc))
        new |= (nth - np.maximum.accumulate(np.where(new, nth, 0))) % 60_000 == 0  # what a place can count
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(doc)))
        return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array((start[first] << 16) | count)], ["doc", "place"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            key, _, lead, said, doc, start = windows_of(batch)
            columns = [pa.array(c) for c in (key, _signed(lead), _signed(said), doc, start)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "lead", "said", "doc", "start"])

    compared = parts.select("key", "slot", "slots", "doc", "start", "bytes").mapInArrow(compare, "doc long, place long")
    if sizes.where(F.col("cuts") > -(-SPREAD_ROWS // GRAM_ROWS)).isEmpty():
        return compared
    # Equal windows of very frequent grams: all but the first, counted by hash, not gathered.
    same = stage(hot.mapInArrow(windows, "key long, lead long, said long, doc long, start long"), "windows")
    firsts = same.groupBy("key", "lead", "said").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n"))
    again = same.join(firsts.where("n > 1"), ["key", "lead", "said"]).where(F.struct("doc", "start") != F.col("first"))
    return compared.unionByName(again.select("doc", (F.col("start") * 65536 + 1).alias("place")))


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows ``doc, place``: windows of ``doc long, text string`` (unique ids) that occur before.

    ``place`` is the first window times 65536, plus how many follow each other.
    """
    begin(docs)
    spark = docs.sparkSession
    n = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = max(n // 32, 1)  # picked suffixes
    every = 7
    share = max(1, expected // (every * SAMPLE_ROWS))
    sample = _suffixes(docs.where(F.pmod(F.xxhash64("doc"), F.lit(share)) == 0), length, every)
    seen = np.asarray(sample.limit(2 * SAMPLE_ROWS).select("key", "covered", "doc").toPandas(), np.int64).reshape(-1, 3)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-expected // RANGE_ROWS))
    ordered = np.sort(_spelled(*seen.T.copy())) if len(seen) else np.zeros(0, "S24")
    splitters = np.unique(ordered[np.arange(1, ranges) * len(ordered) // ranges]) if len(ordered) >= ranges else ordered[:0]
    rows = _suffixes(docs, length, 1, splitters).repartitionById(ranges, F.col("range"))
    sorted_rows = stage(_sort_ranges(rows), "sorted")
    settled = stage(_settle(sorted_rows.where(F.col("kind") == OPEN)), "settled")
    judged = sorted_rows.where(F.col("kind") != OPEN).unionByName(settled)
    compared = _compare_windows(docs, judged.where(F.col("kind") == COMPARE), length)
    return judged.where(F.col("kind") == REPEAT).select("doc", "place").unionByName(compared)


def with_repeats(
    docs: DataFrame, length: int = LENGTH, *, id_column: str = "doc_id", text_column: str = "text"
) -> tuple[DataFrame, str]:
    """``docs`` and a column with the places of repeated windows in each text, null where there are none; its name."""
    begin(docs)
    name, key, said = (fresh(n, docs) for n in ("__places", "__id", "__text"))
    listed = F.collect_list("place").alias(name)
    if unique_ids(docs, id_column):
        rows = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).cast("string").alias("text"))
        places = repeats(rows, length).groupBy(F.col("doc").alias(key)).agg(listed)
        return docs.join(places, docs[id_column].cast("long") == F.col(key), "left").drop(key), name
    # Ids that are null or not unique: number the distinct rows by id and text.
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).distinct()
    rows = dense_positions(rows, F.col("id").isNull(), F.col("id"), F.xxhash64("text"), F.col("text"), name="doc")
    rows = stage(rows, "numbered")
    places = repeats(rows.select("doc", "text"), length).groupBy("doc").agg(listed)
    found = rows.join(places, "doc").select(F.col("id").alias(key), F.col("text").alias(said), name)
    same = docs[id_column].cast("long").eqNullSafe(F.col(key)) & docs[text_column].cast("string").eqNullSafe(F.col(said))
    return docs.join(found, same, "left").drop(key, said), name


def removed_bytes(n: int, places: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """True for the bytes of a text of ``n`` bytes that its repeated windows cover."""
    change = np.zeros(n + 1, np.int64)
    start = places >> 16
    np.add.at(change, start, 1)
    np.add.at(change, start + (places & 0xFFFF) + length - 1, -1)
    return np.cumsum(change[:n]) > 0


def span_digests(docs: DataFrame, length: int = LENGTH, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            found = []
            for i, places in enumerate(batch.column(2)):
                text = data[offsets[i] : offsets[i + 1]]
                gone = np.zeros(len(text), bool)
                if places.is_valid:
                    gone = removed_bytes(len(text), places.values.to_numpy(zero_copy_only=False), length)
                spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                found.append((len(text), int(gone.sum()), spans, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
            sizes, removed, spans, digests = zip(*found, strict=True) if found else ((), (), (), ())
            columns = [pa.array(c, pa.int64()) for c in (sizes, removed, spans)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    kind = docs.schema[id_column].dataType.simpleString()
    rows, places = with_repeats(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")), length)
    kinds = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return rows.select("doc_id", "text", places).mapInArrow(read, kinds)


def remove_repeats(docs: DataFrame, length: int = LENGTH, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the repeated strings in their text.

    Characters of several bytes go only where all of their bytes are repeated. Null texts stay null.
    """
    names = docs.columns
    at = names.index(text_column)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            texts = batch.column(at).to_pylist()
            for i, places in enumerate(batch.column(len(names))):
                if places.is_valid:
                    text = data[offsets[i] : offsets[i + 1]]
                    gone = removed_bytes(len(text), places.values.to_numpy(zero_copy_only=False), length)
                    first = np.flatnonzero((text & 0xC0) != 0x80)
                    whole = np.minimum.reduceat(gone, first) if len(first) else gone
                    gone = np.repeat(whole, np.diff(np.append(first, len(text))))
                    texts[i] = text[~gone].tobytes().decode()
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    rows, places = with_repeats(docs, length, id_column=id_column, text_column=text_column)
    return rows.select(*(F.col(f"`{c}`") for c in names), places).mapInArrow(read, kinds)
