"""Quality classifier: naive Bayes support vectors.

A document is the set of its n-grams: words, and runs of one to three word shapes (letter case, digits, punctuation,
and whether a word repeats the one before). Indicators are hashed to ``BUCKETS`` columns, scaled by the classes'
log-count ratio, and a linear hinge-loss model is fitted to them by dual coordinate descent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gleanery.llm.texts import BASE, FOLD, SPACED, U64, blocks, hash_spans, mix, text_buffer, word_spans

BUCKETS = 1 << 18
#: Byte classes of word shapes: A, a, 0 for upper, lower (and all beyond ASCII) and digits; others are themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[0x41:0x5B], SHAPE[0x61:0x7B], SHAPE[0x30:0x3A], SHAPE[0x80:] = ord("A"), ord("a"), ord("0"), ord("a")


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words' shapes: runs of one byte class written once."""
    lens = ends - starts
    at = np.cumsum(lens) - lens
    shape = SHAPE[data[np.arange(int(lens.sum())) - np.repeat(at, lens) + np.repeat(starts, lens)]]
    new = np.ones(len(shape), bool)
    new[1:] = shape[1:] != shape[:-1]
    new[at] = True
    kept = np.cumsum(new)
    to = kept[at + lens - 1]
    return hash_spans(shape[new], kept[at] - 1, to)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and feature columns of the rows' distinct n-grams, ordered by row."""
    data, offsets = text_buffer(column)
    starts, ends, rows = word_spans(data, offsets, SPACED)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = hash_spans(FOLD[data], starts, ends)
    shape = _shapes(data, starts, ends)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    shape = mix(shape + again.astype(U64) * BASE)
    grams, of = [words, shape], [rows, rows]
    h = shape
    for n in (2, 3):
        h = h[:-1] * BASE + shape[n - 1 :]
        inside = rows[: len(h)] == rows[n - 1 :]
        grams.append(mix(h + U64(n))[inside])
        of.append(rows[: len(h)][inside])
    key = np.concatenate(of) * BUCKETS + (np.concatenate(grams) % U64(BUCKETS)).astype(np.int64)
    key = np.unique(key)
    return key // BUCKETS, key % BUCKETS


@dataclass
class Model:
    """``weights`` has one number a feature column: the fitted weight times the column's log-count ratio."""

    weights: np.ndarray
    bias: float
    slope: float = 3.0

    def scores(self, column: pa.Array) -> np.ndarray:
        rows, cols = features(column)
        n = np.bincount(rows, minlength=len(column))
        margin = np.bincount(rows, self.weights[cols], len(column)) / np.sqrt(np.maximum(n, 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin, -60, 60)))


def log_count_ratios(sets: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = np.full((2, BUCKETS), smooth)
    for s, label in zip(sets, y):
        counts[int(label > 0), s] += 1
    counts /= counts.sum(1, keepdims=True)
    return np.log(counts[1] / counts[0])


def dual_coordinate_descent(
    sets: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int, seed: int = 7
) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss model over rows ``scale[set] / sqrt(len(set))``."""
    w, b, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(sets))
    rows = [scale[s] / np.sqrt(max(1, len(s))) for s in sets]
    norm = np.array([x @ x + 1 for x in rows])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(len(sets)):
            g = y[i] * (w[sets[i]] @ rows[i] + b) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[sets[i]] += step * rows[i]
                b += step
                most = max(most, abs(step))
                alpha[i] = new
        if most < 1e-4:
            break
    return w, b


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches, 2 << 20):
        rows, cols = features(b.column("text"))
        ends = np.searchsorted(rows, np.arange(b.num_rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cols, pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), lists], ["doc_id", "label", "cols"])


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 6000, cost: float = 1.0, rounds: int = 30) -> Model:
    """Fit to at most ``most_rows`` labelled documents, those first in the order of their ids' hash.

    ``labels`` has ``doc_id`` and ``label`` (1 is good). The bound keeps the sample small enough to be broadcast to the
    scan of ``docs`` and its feature sets small enough for one fit. Rows with a null id or label are left out; without
    labels of both classes the model gives every document that class's side (or 0.5 where there are none).
    """
    order = F.xxhash64(F.col("doc_id").cast("string"))
    pick = labels.where("doc_id is not null and label is not null").select("doc_id", F.col("label").cast("int").alias("label"))
    pick = pick.distinct().orderBy(order, "doc_id", "label").limit(most_rows)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(pick), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(_sets, f"doc_id {kind}, label int, cols array<int>").toArrow().sort_by("doc_id")
    y = np.where(np.asarray(got.column("label").combine_chunks()) > 0, 1.0, -1.0)
    if len(set(y)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), float(y[0]) if len(y) else 0.0)
    sets = [np.asarray(x.values) for x in got.column("cols")]
    ratio = log_count_ratios(sets, y)
    balance = np.where(y > 0, cost * len(y) / (2 * (y > 0).sum()), cost * len(y) / (2 * (y < 0).sum()))
    w, b = dual_coordinate_descent(sets, ratio, y, balance, rounds)
    return Model((w * ratio).astype(np.float32), float(b))


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each whole text; null and empty texts get the bias alone. All columns stay, but one
    of the score's name, which the score replaces. Repeated rows and null ids are rows like others; an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*(c for c in docs.columns if c.lower() == out.lower()))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 2 << 20):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.scores(b.column("text")))], [*names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))
