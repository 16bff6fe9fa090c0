"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A rating has grades 0 < 1 < ... < G - 1. With the hashed text's weights w, shared by all grades, and ordered
thresholds b_1 < ... < b_(G-1), P(grade >= j) = sigmoid(w . x - b_j). The expected grade is the sum of these
tail probabilities; documents are selected by one of them.

Features of a text, hashed into a fixed number of slots: presence of each lower-cased word without its
punctuation and of its beginnings, its shape (classes of characters, runs made one) by its share of the words, and the share of words
that repeat the word before. The model is fitted by full-batch accelerated gradient steps on a bounded sample of
rated documents (those of smallest hashed id, `sample` at most, a documented parameter), collected as
hashed slots. Its weights are of fixed size and broadcast.

Edge cases: null or empty text has no features, so its tails follow from the thresholds; ratings with null
parts, or of documents that are missing, are left out; a document rated several times counts as often; with no ratings
at all, or of one grade, the model keeps every document (tails of the grades seen); an empty table gives no
rows; all columns of the input are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, chunks, hash_spans, lower_ascii, mix, named, spans, table, tidy

SLOTS = 1 << 20
#: Rated documents that the model is fitted on, at most.
SAMPLE = 6000
ROUNDS = 120
RIDGE = 2e-4
#: Bytes of the beginnings of words that are features.
PREFIXES = (4, 5)
#: Slots that fewer sampled documents have get no weight: a word of one document says nothing of others.
LEAST_DOCS = 8
#: A document is kept if P(grade >= KEEP_GRADE) is at least KEEP.
KEEP_GRADE, KEEP = 2, 0.5

#: Bytes of texts worked on at once: features take some sixty bytes for each.
CHUNK_BYTES = 1 << 20

_CLASS = np.arange(256).astype(np.uint8)
_CLASS[97:123] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("0")
_CLASS[128:] = ord("a")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, offsets: np.ndarray, slots: int = SLOTS):
    """(row, slot, value) triples, one for each row and slot."""
    n = len(offsets) - 1
    start, end, row = spans(data, offsets, SPACE)
    total = np.maximum(np.bincount(row, minlength=n), 1)
    low = lower_ascii(data)
    # Words of letters and digits inside: presence.
    ls, le, lrow = spans(low, offsets, ~_LETTER)
    words = mix(hash_spans(low, ls, le, 1))
    out_row, out_slot, out_value = [lrow], [(words % np.uint64(slots)).astype(np.int64)], [np.full(len(words), -1.0)]
    # Beginnings of words, which inflected forms share: presence.
    for size in PREFIXES:
        long = np.flatnonzero(le - ls > size)
        begun = mix(hash_spans(low, ls[long], ls[long] + size, 2 + size))
        out_row.append(lrow[long])
        out_slot.append((begun % np.uint64(slots)).astype(np.int64))
        out_value.append(np.full(len(long), -1.0))
    # Shapes: classes with runs made one, by share.
    cls = _CLASS[data]
    if len(start):
        fresh = np.ones(len(data), bool)
        fresh[1:] = cls[1:] != cls[:-1]
        fresh[start] = True
        weight = np.where(fresh, mix(cls.astype(np.uint64) + np.uint64(77)), np.uint64(0))
        count = np.concatenate([[0], np.cumsum(fresh)])
        place = count[:-1] - count[start][np.searchsorted(start, np.arange(len(data)), side="right") - 1]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weight * (mix(place.astype(np.uint64)) | np.uint64(1)), dtype=np.uint64)])
        shape = mix(sums[end] - sums[start])
        out_row.append(row)
        out_slot.append((shape % np.uint64(slots)).astype(np.int64))
        out_value.append(1.0 / total[row])
        whole = hash_spans(data, start, end)
        same = np.flatnonzero((whole[1:] == whole[:-1]) & (row[1:] == row[:-1])) + 1
        out_row.append(row[same])
        out_slot.append(np.zeros(len(same), np.int64))
        out_value.append(1.0 / total[row[same]])
    row, slot, value = (np.concatenate(x) for x in (out_row, out_slot, out_value))
    keys, inverse = np.unique(row * slots + slot, return_inverse=True)
    present = np.zeros(len(keys))
    share = np.zeros(len(keys))
    np.maximum.at(present, inverse[value < 0], 0.25)
    np.add.at(share, inverse[value > 0], value[value > 0])
    # Shares work by their root, so that a habit of a part of the text shows.
    return keys // slots, keys % slots, present + np.sqrt(share)


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1 .. G - 1, one column each; they fall from left to right."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(np.clip(x, -60, 60) / 2))


def loss(row: np.ndarray, slot: np.ndarray, value: np.ndarray, grades: np.ndarray, w: np.ndarray, first: np.ndarray, gaps: np.ndarray, ridge: float):
    """Mean negative log likelihood and ridge / 2 of the squared weights, and the gradients by the weights, the first threshold and the logarithms of the steps."""
    n, levels = len(grades), len(gaps) + 2
    cuts = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
    score = np.bincount(row, weights=value * w[slot], minlength=n)
    p = _sigmoid(score[:, None] - cuts[None, :])
    bounded = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], 1)
    i = np.arange(n)
    hi, lo = bounded[i, grades], bounded[i, grades + 1]
    mass = np.maximum(hi - lo, 1e-12)
    dhi, dlo = hi * (1 - hi), lo * (1 - lo)
    g_score = -(dhi - dlo) / mass / n
    g_w = np.bincount(slot, weights=value * g_score[row], minlength=len(w)) + ridge * w
    g_cut = np.zeros(levels + 1)
    np.add.at(g_cut, grades, dhi / mass / n)
    np.add.at(g_cut, grades + 1, -dlo / mass / n)
    g_cut = g_cut[1:-1]
    g_gaps = np.cumsum(g_cut[::-1])[::-1][1:] * np.exp(gaps)
    return -np.log(mass).mean() + ridge / 2 * float(w @ w), g_w, np.array([g_cut.sum()]), g_gaps


def fit(row: np.ndarray, slot: np.ndarray, value: np.ndarray, grades: np.ndarray, levels: int, slots: int = SLOTS, rounds: int = ROUNDS, ridge: float = RIDGE, least_docs: int = LEAST_DOCS) -> Ordinal:
    """Nesterov steps on the mean negative log likelihood. The thresholds stay ordered, being a first value and positive steps."""
    n = len(grades)
    common = np.bincount(slot, minlength=slots) >= least_docs
    kept = common[slot]
    row, slot, value = row[kept].astype(np.int64), slot[kept].astype(np.int64), value[kept].astype(np.float64)
    counts = np.bincount(grades, minlength=levels)
    tail = (np.cumsum(counts[::-1])[::-1][1:] + 0.5) / (n + 1)
    weights, base = np.zeros(slots), -np.log(tail / (1 - tail))
    steps = np.log(np.maximum(np.diff(base), 1e-3))
    params = [weights, base[:1].copy(), steps]
    look = [p.copy() for p in params]
    for t in range(rounds):
        w, first, gaps = look
        _, g_w, g_first, g_gaps = loss(row, slot, value, grades, w, first, gaps, ridge)
        fresh = [w - 3.0 * g_w, first - 0.5 * g_first, gaps - 0.5 * g_gaps]
        look = [f + t / (t + 3) * (f - p_) for f, p_ in zip(fresh, params, strict=True)]
        params = fresh
    w, first, gaps = params
    return Ordinal(w, np.concatenate([first, first + np.cumsum(np.exp(gaps))]))


def grade_of(quality, toxic):
    """Grades of the labels: 0 toxic, 1 not toxic but of low quality, 2 good."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).otherwise(2)


def _slots_of(docs: DataFrame, slots: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, data, offsets in chunks(batch.column(1), CHUNK_BYTES):
                row, slot, value = features(data, offsets, slots)
                at = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x, t)) for x, t in ((slot, pa.int32()), (value, pa.float32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), *lists], names=["grade", "slots", "values"])

    return docs.mapInArrow(tidy(run), "grade int, slots array<int>, values array<float>")


def train(docs: DataFrame, ratings: DataFrame, levels: int, sample: int = SAMPLE, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> Ordinal | None:
    """ratings(doc_id, grade). None if nothing is rated."""
    rated = ratings.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_rated"), F.col("grade").cast("int").alias("_grade"))
    # Only ids and grades are sorted; `sample` bounds what is broadcast and collected.
    drawn = rated.orderBy(F.xxhash64("_rated"), "_rated", "_grade").limit(sample)
    plain = docs.select(named(id_col).alias("_id"), named(text_col).alias("_text"))
    texts = plain.join(F.broadcast(drawn), F.col("_id") == F.col("_rated")).select("_grade", "_text")
    found = _slots_of(texts, slots).toArrow()
    grades = found.column("grade").to_numpy().astype(np.int64)
    if not len(grades):
        return None
    sizes = np.array([len(x) for x in found.column("slots")])
    row = np.repeat(np.arange(len(grades), dtype=np.int32), sizes)
    slot = found.column("slots").combine_chunks().flatten().to_numpy()
    value = found.column("values").combine_chunks().flatten().to_numpy()
    return fit(row, slot, value, grades, levels, slots)


def score(docs: DataFrame, model: Ordinal | None, levels: int, slots: int = SLOTS, text_col: str = "text") -> DataFrame:
    """docs with struct `_quality`: expected (grade) and tails (array of P(grade >= j), j from 1)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)] + [T.StructField("_expected", T.DoubleType()), T.StructField("_tails", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for first, n, data, offsets in chunks(batch.column(at), CHUNK_BYTES):
                if own is None:
                    tails = np.ones((n, levels - 1))
                else:
                    row, slot, value = features(data, offsets, slots)
                    tails = own.tails(np.bincount(row, weights=value * own.weights[slot], minlength=n))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (levels - 1)), pa.array(tails.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.slice(first, n).columns, pa.array(tails.sum(1)), lists], names=[*names, "_expected", "_tails"])

    out = docs.select(*(named(c).alias(n) for c, n in zip(docs.columns, names, strict=True))).mapInArrow(tidy(run), schema)
    return out.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)), F.struct(F.col("_expected").alias("expected"), F.col("_tails").alias("tails")).alias("_quality"))


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    return labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade"))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Scores docs with the model fitted on those of them that sf_dir's labels rate."""
    return score(docs, train(docs, rated(spark, sf_dir), 3), 3)


def kept():
    return F.col("_quality.tails")[KEEP_GRADE - 1] >= KEEP


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir)
    return found.select("doc_id", F.col("_quality.expected").alias("expected_grade"), F.col("_quality.tails")[0].alias("p_not_toxic"), F.col("_quality.tails")[1].alias("p_good"), kept().alias("kept"))
