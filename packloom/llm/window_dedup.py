"""Substring deduplication of word windows behind a count-min prefilter.

A window is a run of ``WINDOW`` words of one document. Words covered by a window that also starts earlier go.

1. Every window has an anchor: the smallest hash among its runs of ``GRAM`` words, rightmost on ties. Equal
   windows have equal anchors, so an anchor occurs at least as often as each of its windows, and windows next
   to each other mostly share one. Each partition counts its anchors in a count-min sketch (sparse: the
   cells it touches, and whether twice), partial sketches are merged cell by cell, and a cell of the merged
   sketch says whether it was met twice. Collisions and other windows of an anchor only raise a count: what
   a window is estimated at is never below its true count.
2. Windows estimated repeated, and only these, are grouped exactly, by 96 bits of hash. Runs of them are cut
   into segments where the text says so (at anchors with low bits of zero), and equal segments are grouped
   first: a segment that occurred before is repeated from end to end. The windows of the first segment of
   each kind are then rows of their own, and all but the first of equal windows are repeats.

The sketch has ``MOST_CELLS`` bits at most (32 MB), so it can be broadcast whatever the input. Where the input has far
more anchors than that, more windows pass for repeated, none for unique: the exact pass then has more to do.

Before each shuffle, equal segments and windows of a batch are reduced to the first, so a very frequent one
is a row per batch, not per occurrence. All of this works on the input as it is; nothing depends on removals.

Defined cases: a null text has no words; a text of fewer words than a window keeps all. Ids are integers, a
null id comes last; rows equal in id and text are one document (all get its result), rows that share only
the id are ordered by their text. An empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.llm.common import begin, mix, powers, prefix_hash, sections, span_hash, stage, text_bytes, unique_ids, word_spans
from packloom.operators.positions import dense_positions

WINDOW = 20
GRAM = 8
# Rows of the sketch, and its bits in all rows together.
ROWS = 2
MOST_CELLS = 1 << 28
# Bits of a cell's number within a block of the sketch, which is one row of its table.
_BLOCK_BITS = 15
# Anchors a task counts before it gives out a partial sketch.
FLUSH = 1_000_000
# Of this many anchors one is a cut between segments.
CUT = 8

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


class _Words:
    """Words of some texts: byte spans, text numbers, hashes of runs of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.rows = word_spans(data, offsets)
        hashes = span_hash(prefix_hash(data), self.starts, self.ends)
        up, self._down = powers(len(hashes) + 1)
        self._sums = [np.append(np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])) for h in (hashes, mix(hashes ^ _OTHER))]

    def runs(self, first: np.ndarray, last: np.ndarray, nth: int = 0) -> np.ndarray:
        """Hash ``nth`` of the words [first, last)."""
        sums = self._sums[nth]
        return mix((sums[last] - sums[first]) * self._down[first] + (last - first).astype(np.uint64) * _GOLDEN)

    def windows(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows that lie in one text, and their anchors' first words."""
        n = len(self.rows)
        if n < window:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(n - gram + 1)
        grams = self.runs(at, at + gram)
        low = np.uint64((1 << 24) - 1)
        # Texts of a section are shorter than 2^24 words, or alone in it: places count back from the end of a block.
        keys = (grams & ~low) | (low - (at.astype(np.uint64) & low))
        least = _sliding_min(keys, window - gram + 1)
        first = np.arange(len(least))
        back = (low - (least & low)).astype(np.int64)
        anchor = first + ((back - first) & int(low))
        inside = self.rows[: len(least)] == self.rows[window - 1 : window - 1 + len(least)]
        return first[inside], anchor[inside]


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each run of ``width`` values, by runs of doubling length."""
    reach = 1
    while 2 * reach <= width:
        keys = np.minimum(keys[:-reach], keys[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def _cells(hashes: np.ndarray, cells: int) -> np.ndarray:
    """Cell of each hash in each row of a sketch of ``cells`` in all; one array after the other."""
    width = np.uint64(cells // ROWS)
    found = [(mix(hashes + np.uint64(i) * _GOLDEN) & (width - np.uint64(1))) + np.uint64(i) * width for i in range(ROWS)]
    return np.concatenate(found).astype(np.int64)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a value of sorted columns differs from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def sketch(docs: DataFrame, cells: int, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Bits of the merged count-min sketch of all anchors: whether a cell was met at least twice."""
    begin(docs)

    def partial(hashes: list[np.ndarray]) -> pa.RecordBatch:
        """Cells touched, by block: number within the block times 2, plus 1 if met twice."""
        met = np.sort(_cells(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), cells))
        first = np.flatnonzero(_changes(met))
        twice = np.diff(np.append(first, len(met))) > 1
        met = met[first]
        block = met >> _BLOCK_BITS
        cuts = np.flatnonzero(_changes(block))
        inner = (((met & ((1 << _BLOCK_BITS) - 1)) << 1) | twice).astype("<u2")
        ends = np.append(cuts, len(met))[1:]
        touched = [inner[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(block[cuts]), pa.array(touched, pa.binary())], ["block", "touched"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, _, data, offsets in sections(batch.column(0)):
                words = _Words(data, offsets)
                _, anchor = words.windows(window, gram)
                anchor = anchor[_changes(anchor)]  # an anchor counts once for all windows that share its place
                held.append(words.runs(anchor, anchor + gram))
                n += len(anchor)
            if n >= FLUSH:
                yield partial(held)
                held, n = [], 0
        yield partial(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of the merged sketch, as bits."""
        now, counts = None, None
        for batch in batches:
            done = []
            for block, touched in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block != now:
                    if now is not None:
                        done.append((now, np.packbits(counts >= 2, bitorder="little").tobytes()))
                    now, counts = block, np.zeros(1 << _BLOCK_BITS, np.uint8)
                inner = np.frombuffer(touched.as_buffer(), "<u2")
                cell = inner >> 1  # each at most once in a partial sketch
                counts[cell] = np.minimum(counts[cell] + 1 + (inner & 1), 2)
            yield _blocks(done)
        if now is not None:
            yield _blocks([(now, np.packbits(counts >= 2, bitorder="little").tobytes())])

    parts = docs.select("text").mapInArrow(count, "block long, touched binary")
    parts = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block long, bits binary")
    bits = np.zeros(max(cells, 1 << _BLOCK_BITS) >> 3, np.uint8)
    size = 1 << (_BLOCK_BITS - 3)
    for row in stage(parts, "sketch").collect():  # as bounded as the sketch
        bits[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _blocks(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["block", "bits"])


def repeated_estimate(bits: np.ndarray, hashes: np.ndarray, cells: int) -> np.ndarray:
    """True where every row of the sketch has the hash at two or more."""
    cell = _cells(hashes, cells)
    met = (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1
    return met.reshape(ROWS, -1).all(axis=0)


_KEYED = "kind int, h1 long, h2 int, doc long, start long, n long, bytes binary"
# What a row is: a segment to group, a window to group, windows found repeated.
SEGMENT, ONE_WINDOW, REPEAT = 0, 1, 2


def _rows(kind: int, h1=None, h2=None, doc=None, start=None, n=None, parts=None) -> pa.RecordBatch:
    size = len(doc)
    if h1 is None:  # nothing to group by: any task will do
        h1 = mix(doc.view(np.uint64) * _GOLDEN + start.view(np.uint64))
    columns = [
        pa.array(np.full(size, kind, np.int32)),
        pa.array(h1.view(np.int64)),
        pa.nulls(size, pa.int32()) if h2 is None else pa.array(h2),
        pa.array(doc),
        pa.array(start),
        pa.nulls(size, pa.int64()) if n is None else pa.array(n),
        pa.nulls(size, pa.binary()) if parts is None else pa.array(parts, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["kind", "h1", "h2", "doc", "start", "n", "bytes"])


def _short(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _joined(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Single windows as runs: document, first window, windows."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.zeros(len(doc), bool)
    new[:1] = True
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return doc[first], start[first], np.diff(np.append(first, len(doc)))


def _firsts(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key and place, and, in this order, whether a row is the first of its key."""
    order = np.lexsort((start, doc, h2, h1))
    return order, _changes(h1[order], h2[order])


def _segments(docs: DataFrame, bits, cells: int, window: int, gram: int) -> DataFrame:
    """Segments of windows estimated repeated: the first of each kind in a batch, and what it repeats."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = bits.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for base, _, data, offsets in sections(batch.column(1)):
                words = _Words(data, offsets)
                first, anchor = words.windows(window, gram)
                if not len(first):
                    continue
                new = _changes(anchor)
                place = anchor[new]
                hashes = words.runs(place, place + gram)
                nth = np.cumsum(new) - 1
                kept = repeated_estimate(seen, hashes, cells)[nth]
                cut = new & ((hashes % np.uint64(CUT)) == 0)[nth]
                first, cut = first[kept], np.cumsum(cut)[kept]
                if not len(first):
                    continue
                head = np.zeros(len(first), bool)
                head[:1] = True
                head[1:] = (first[1:] != first[:-1] + 1) | (cut[1:] != cut[:-1])
                head = np.flatnonzero(head)
                start, n = first[head], np.diff(np.append(head, len(first)))
                end = start + n + window - 1
                row = words.rows[start]
                # Numbers of words within their text.
                begins = np.searchsorted(words.rows, np.arange(len(offsets)))
                doc, at = ids[base + row], start - begins[row]
                h1, h2 = words.runs(start, end), _short(words.runs(start, end, 1))
                order, is_first = _firsts(h1, h2, doc, at)
                again = order[~is_first]
                yield _rows(REPEAT, doc=doc[again], start=at[again], n=n[again])
                own = np.sort(order[is_first])
                parts = [data[words.starts[a] : words.ends[b - 1]].tobytes() for a, b in zip(start[own], end[own], strict=True)]
                yield _rows(SEGMENT, h1[own], h2[own], doc[own], at[own], n[own], parts)

    return docs.select("doc", "text").mapInArrow(read, _KEYED)


def _by_key(rows: DataFrame) -> DataFrame:
    """Rows to group by key and place, and behind them those known to be repeated."""
    return rows.repartition("h1").sortWithinPartitions("kind", "h1", "h2", "doc", "start")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.RecordBatch]]:
    """Of each batch of ``_by_key``: rows to group, which of them are the first of their key, rows known to be repeated."""
    last = None
    for batch in batches:
        known = batch.column("kind").to_numpy() == REPEAT
        keyed = batch.filter(pa.array(~known))
        h1, h2 = (keyed.column(c).to_numpy() for c in ("h1", "h2"))
        new = _changes(h1, h2)
        if len(new):
            new[0] = last != (h1[0], h2[0])
            last = (h1[-1], h2[-1])
        yield keyed, new, batch.filter(pa.array(known))


def _first_windows(rows: DataFrame, window: int) -> DataFrame:
    """Windows of the first segment of each kind (the first of equal ones in a batch), and what is repeated."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keyed, new, known in _grouped(batches):
            yield known
            doc, start, n = (keyed.column(c).to_numpy() for c in ("doc", "start", "n"))
            yield _rows(REPEAT, doc=doc[~new], start=start[~new], n=n[~new])
            own = np.flatnonzero(new)
            for at, _, data, offsets in sections(keyed.column("bytes").take(pa.array(own))):
                words = _Words(data, offsets)
                begins = np.searchsorted(words.rows, np.arange(len(offsets)))
                first = np.flatnonzero(words.rows[: max(len(words.rows) - window + 1, 0)] == words.rows[window - 1 :])
                row = words.rows[first]
                owner = own[at + row]
                where = start[owner] + first - begins[row]
                w1, w2 = words.runs(first, first + window), _short(words.runs(first, first + window, 1))
                order, is_first = _firsts(w1, w2, doc[owner], where)
                again, kept = order[~is_first], order[is_first]
                d, s, count = _joined(doc[owner[again]], where[again])
                yield _rows(REPEAT, doc=d, start=s, n=count)
                yield _rows(ONE_WINDOW, w1[kept], w2[kept], doc[owner[kept]], where[kept])

    return _by_key(rows).mapInArrow(read, _KEYED)


def _later_windows(rows: DataFrame) -> DataFrame:
    """All but the first of equal windows, and what is known to be repeated, as runs ``doc, start, n``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keyed, new, known in _grouped(batches):
            yield known.select(["doc", "start", "n"])
            columns = _joined(*(keyed.column(c).to_numpy()[~new] for c in ("doc", "start")))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "start", "n"])

    return _by_key(rows.drop("bytes")).mapInArrow(read, "doc long, start long, n long")


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most_cells: int = MOST_CELLS) -> DataFrame:
    """Runs ``doc, start, n`` of windows of ``doc long, text string`` (unique ids) that also start earlier.

    ``start`` is the number of a window's first word in its document. A window can be in several runs.
    """
    spark: SparkSession = begin(docs)
    gram = min(gram, window)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = 1 << (_BLOCK_BITS + 1)
    while cells < size // 8 and cells < most_cells:  # some five cells for an anchor
        cells *= 2
    bits = spark.sparkContext.broadcast(sketch(docs, cells, window, gram))
    segments = _segments(docs, bits, cells, window, gram)
    return _later_windows(_first_windows(segments, window))


def _kept(text: np.ndarray, starts: np.ndarray, n: np.ndarray, window: int) -> tuple[int, int, bytes]:
    """Words of a text, words removed, and the rest joined by blanks."""
    begins, ends, _ = word_spans(text, np.asarray([0, len(text)]))
    change = np.zeros(len(begins) + 1, np.int64)
    if len(starts):
        np.add.at(change, starts, 1)
        np.add.at(change, starts + n + window - 1, -1)
    stays = np.cumsum(change[:-1]) == 0
    begins_, ends_ = begins[stays], ends[stays]
    # The byte after a word becomes the blank after it.
    data = np.append(text, np.uint8(32))
    data[ends_] = 32
    edge = np.zeros(len(data) + 1, np.int8)
    edge[begins_] += 1
    edge[ends_ + 1] -= 1
    return len(begins), len(begins) - len(begins_), data[np.cumsum(edge[:-1], dtype=np.int8) > 0][:-1].tobytes()


def _cut(docs: DataFrame, window: int, gram: int, most_cells: int, id_column: str, text_column: str, last: str) -> DataFrame:
    """Rows ``doc_id, n_words, n_removed`` and the words that stay, or their digest, in a column named ``last``."""
    begin(docs)
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    if unique_ids(rows):
        rows = rows.withColumn("doc", F.col("doc_id").cast("long"))
        numbered = rows.select("doc", "text")
    else:
        # Ids that are null or not unique: number the distinct rows by id and text.
        distinct = rows.distinct()
        distinct = dense_positions(distinct, F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.col("text"), name="doc")
        distinct = stage(distinct.withColumn("doc", F.col("doc").cast("long")), "numbered")
        numbered = distinct.select("doc", "text")
        own = distinct.select(F.col("doc_id").alias("own_id"), F.col("text").alias("own_text"), "doc")
        same = F.col("doc_id").eqNullSafe(F.col("own_id")) & F.col("text").eqNullSafe(F.col("own_text"))
        rows = rows.join(own, same).select("doc_id", "text", "doc")
    runs = repeated_windows(numbered, window, gram, most_cells)
    runs = runs.groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("n"))
    rows = rows.join(runs, "doc", "left").select("doc_id", "text", "starts", "n")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            data, offsets = text_bytes(batch.column("text"))
            found = []
            for i, lists in enumerate(zip(batch.column("starts"), batch.column("n"), strict=True)):
                places = [x.values.to_numpy(zero_copy_only=False) if x.is_valid else none for x in lists]
                words, removed, kept = _kept(data[offsets[i] : offsets[i + 1]], *places, window)
                found.append((words, removed, hashlib.sha256(kept).hexdigest() if last == "kept_sha256" else kept.decode()))
            columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_removed", last])

    return rows.mapInArrow(read, f"doc_id {kind}, n_words long, n_removed long, {last} string")


def window_digests(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most_cells: int = MOST_CELLS, *, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Rows ``doc_id, n_words, n_removed, kept_sha256``: how many words go, and a digest of the rest."""
    return _cut(docs, window, gram, most_cells, id_column, text_column, "kept_sha256")


def without_repeats(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most_cells: int = MOST_CELLS, *, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Rows ``doc_id, n_words, n_removed, kept``: the words of each text without repeated windows, joined by blanks."""
    return _cut(docs, window, gram, most_cells, id_column, text_column, "kept")
