"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

A text is a sparse vector: weights of its words hashed to ``BUCKETS`` features, and indicators of bins of
structure statistics (letter case, digits, marks, lengths, repetition of words and lines, size). The
score is the logistic of bias + w.x + sum of pairwise interactions <v_i, v_j> x_i x_j, where the
interactions cost linear time: half of the sum over factors of (sum v x)^2 - sum (v x)^2.

It is fitted on at most ``SAMPLE`` labelled documents, those with the smallest hash of their id, and of the
rows that share an id on one (the text with the smallest hash); that is the only bound. Every row of a table is scored, whole.

Defined cases: a null text is scored as an empty one, an empty text has the bins of its statistics and no
word. Labels that are null or belong to no document are not used; a document with several labels
counts as 1 if one of them is. Without labels, or with labels of one kind, the model is a constant.
Repeated rows get equal scores, an empty table gives an empty result, other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.llm.common import begin, lean, lower_ascii, prefix_hash, sections, span_hash, word_spans

#: Labelled rows the model is fitted on, at most.
SAMPLE = 12_000
BUCKETS = 1 << 14
FACTORS = 8
BINS = 12
# Passes over the sample, and steps of 64 rows that few rows are passed over for.
EPOCHS = 6
STEPS = 800
# Share of a text's norm that its words have; the bins have the rest.
WORD_SHARE = 0.7

# Bytes by class: 1 upper case, 2 lower case, 3 digit, 4 white space, 5 sentence mark, 6 other ASCII, 7 beyond ASCII.
_CLASS = np.full(256, 7, np.uint8)
_CLASS[:128] = 6
_CLASS[[ord(c) for c in " \t\n\v\f\r"]] = 4
_CLASS[[ord(c) for c in ".,;:!?"]] = 5
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 2


def _statistics(data: np.ndarray, words: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> list[float]:
    """Shares between 0 and 1 of one text: its bytes, word hashes, word lengths and last bytes of its words."""
    n, m = max(len(data), 1), max(len(words), 1)
    kinds = np.bincount(_CLASS[data], minlength=8) / n
    _, counts = np.unique(words, return_counts=True)
    lines = data.tobytes().split(b"\n")
    return [
        *kinds[1:].tolist(),
        np.bincount(_CLASS[ends], minlength=8)[6] / m,
        len(counts) / m,
        (counts.max() if len(counts) else 0) / m,
        min(float(lengths.mean()) / 16, 1.0) if len(lengths) else 0.0,
        min(float(lengths.std()) / 8, 1.0) if len(lengths) else 0.0,
        len(set(lines)) / len(lines),
        float((words[1:] == words[:-1]).sum()) / m,
        min(np.log1p(len(words)) / 12, 1.0),
        min(np.log1p(len(data) / len(lines)) / 12, 1.0),
    ]


STATISTICS = 16
FEATURES = BUCKETS + STATISTICS * (BINS + 1)


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices and weights of each text of a column."""
    for first, last, data, offsets in sections(column):
        starts, ends, rows = word_spans(data, offsets)
        lengths = ends - starts
        hashes = span_hash(prefix_hash(lower_ascii(data)), starts, ends)
        buckets = (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
        cuts = np.searchsorted(rows, np.arange(last - first + 1))
        for i in range(last - first):
            a, b = cuts[i], cuts[i + 1]
            text = data[offsets[i] : offsets[i + 1]]
            shares = np.asarray(_statistics(text, hashes[a:b], lengths[a:b], data[ends[a:b] - 1]))
            where = np.clip(np.ceil(np.sqrt(shares) * BINS), 0, BINS).astype(np.int64)
            bins = BUCKETS + np.arange(STATISTICS) * (BINS + 1) + where
            found, counts = np.unique(buckets[a:b], return_counts=True)
            weights = np.sqrt(counts)
            if len(weights):
                weights *= WORD_SHARE / np.linalg.norm(weights)
            yield np.append(found, bins), np.append(weights, np.full(STATISTICS, 1 / np.sqrt(STATISTICS)))


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, index: np.ndarray, weight: np.ndarray) -> float:
        inner = self.factors[index] * weight[:, None]
        pairs = (inner.sum(0) ** 2 - (inner**2).sum(0)).sum() / 2
        return self.bias + float(self.linear[index] @ weight) + float(pairs)

    def score(self, index: np.ndarray, weight: np.ndarray) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.margin(index, weight), -50, 50))))

    def packed(self) -> bytes:
        return np.concatenate([[self.bias], self.linear, self.factors.ravel()]).astype("<f8").tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> Model:
        values = np.frombuffer(data, "<f8")
        return cls(float(values[0]), values[1 : 1 + FEATURES], values[1 + FEATURES :].reshape(FEATURES, -1))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, factors: int = FACTORS, seed: int = 1) -> Model:
    """Adaptive gradient steps over small batches of (indices, weights, label)."""
    labels = np.asarray([y for _, _, y in rows], np.float64)
    generator = np.random.default_rng(seed)
    rate = (labels.sum() + 1) / (len(labels) + 2)
    model = Model(float(np.log(rate / (1 - rate))), np.zeros(FEATURES), generator.normal(0, 0.05, (FEATURES, factors)))
    if not labels.any() or labels.all():
        model.factors[:] = 0
        return model
    squares = [np.full(FEATURES, 1e-3), np.full((FEATURES, factors), 1e-3)]
    epochs = max(epochs, -(-STEPS * 64 // len(rows)))
    for epoch in range(epochs):
        order = generator.permutation(len(rows))
        for at in range(0, len(order), 64):
            part = [rows[i] for i in order[at : at + 64]]
            index = np.concatenate([i for i, _, _ in part])
            weight = np.concatenate([w for _, w, _ in part])
            begins = np.cumsum([0, *(len(i) for i, _, _ in part[:-1])])
            owner = np.repeat(np.arange(len(part)), [len(i) for i, _, _ in part])
            inner = model.factors[index] * weight[:, None]
            sums = np.add.reduceat(inner, begins)
            pairs = (sums**2 - np.add.reduceat(inner**2, begins)).sum(1) / 2
            margin = model.bias + np.add.reduceat(model.linear[index] * weight, begins) + pairs
            error = 1 / (1 + np.exp(-np.clip(margin, -50, 50))) - labels[order[at : at + 64]]
            step = 0.3 / (1 + EPOCHS * epoch / epochs)
            model.bias -= step * 0.1 * error.mean()
            used, place = np.unique(index, return_inverse=True)
            slope = np.bincount(place, error[owner] * weight) / len(part) + 1e-6 * model.linear[used]
            squares[0][used] += slope**2
            model.linear[used] -= step * slope / np.sqrt(squares[0][used])
            each = (error[owner] * weight)[:, None] * (sums[owner] - inner)
            slope = np.stack([np.bincount(place, each[:, f]) for f in range(factors)], 1) / len(part)
            slope += 1e-5 * model.factors[used]
            squares[1][used] += slope**2
            model.factors[used] -= 0.3 * step * slope / np.sqrt(squares[1][used])
    return model


def held_out(id_column: str = "doc_id"):
    """True for the rows whose labels are not learned from."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents, ``labels`` being ``doc_id, quality``.

    The sample's ids are bounded, so they are broadcast; texts are turned to features where they lie, and
    only the features of the sample meet in the one task that fits.
    """
    begin(docs)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # One text an id, however many rows have it: combined before the shuffle, of at most ``sample`` ids.
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")
    texts = texts.groupBy("doc_id").agg(least, F.first("quality").alias("quality")).select("doc_id", "quality", "least.text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, weight = zip(*features(batch.column("text")), strict=True) if len(batch) else ((), ())
            columns = [pa.array(list(index), pa.list_(pa.int64())), pa.array(list(weight), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.string()), batch.column("quality"), *columns], ["key", "quality", "index", "weight"]
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for key, label, index, weight in zip(*batch.columns, strict=True):
                i, w = (np.asarray(x.values.to_numpy(zero_copy_only=False)) for x in (index, weight))
                rows.append((key.as_py(), i.tolist(), w.tolist(), i, w, min(max(label.as_py(), 0), 1)))
        if len(rows) > sample:
            raise ValueError(f"{len(rows)} rows to fit, more than {sample}")
        rows.sort(key=lambda r: r[:3])  # the same model whatever order rows come in
        model = fit([r[3:] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([model.packed()], pa.binary())], ["model"])

    described = texts.select("doc_id", "quality", "text").mapInArrow(
        lean(describe), "key string, quality int, index array<long>, weight array<double>"
    )
    found = described.repartition(1).mapInArrow(lean(learn), "model binary").collect()
    return Model.unpacked(found[0]["model"])


def score(docs: DataFrame, model: Model, threshold: float = 0.3, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows ``doc_id, held_out, score, predicted``. One pass, no shuffle."""
    spark = begin(docs)
    shared = spark.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.asarray([shared.value.score(i, w) for i, w in features(batch.column(2))])
            predicted = pa.array((scores >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), predicted], ["doc_id", "held_out", "score", "predicted"]
            )

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), held_out(id_column).alias("held_out"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(lean(read), f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, *, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``. One pass, no shuffle."""
    spark = begin(docs)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_column)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [shared.value.score(i, w) >= threshold for i, w in features(batch.column(at))]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(lean(read), docs.schema)
