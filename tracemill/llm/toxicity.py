"""Toxicity scores by FTRL-proximal logistic regression over hashed n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text

BITS = 20
MAX_TRAIN = 20_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.0
THRESHOLD = 0.5
#: (tokens between the two, salt): word pairs next to each other, and skip-grams over one and two words.
_PAIRS = ((1, 0x51), (2, 0x52), (3, 0x53))


def features(t: _text.Tokens, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the rows' words, word pairs and skip-grams, repeats included."""
    rows, out = [t.row], [t.hash >> np.uint64(64 - bits)]
    for far, salt in _PAIRS:
        both = t.row[far:] == t.row[:-far] if len(t.row) > far else np.zeros(0, bool)
        h = _text.mix64(t.hash[: len(both)][both] * np.uint64(0x9E3779B97F4A7C15) + t.hash[far:][both] + np.uint64(salt))
        rows.append(t.row[: len(both)][both])
        out.append(h >> np.uint64(64 - bits))
    return np.concatenate(rows), np.concatenate(out).astype(np.int64)


def _per_text(col: pa.Array, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = _text.buffers(col)
    for lo, hi in _text.chunks(offsets):
        part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        yield (lo, hi, *features(_text.tokens(*_text.fold(part, off)), bits))


class Ftrl:
    """FTRL-proximal: a learning rate for each coordinate, and weights of exactly 0 where L1 isn't overcome."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) > self.l1, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


@dataclass
class Model:
    """The weights other than 0; the bias is bucket 2**bits."""

    bits: int
    at: np.ndarray
    weight: np.ndarray


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bits: int = BITS, max_train: int = MAX_TRAIN, epochs: int = EPOCHS) -> Model:
    """A model fitted on at most max_train labelled ids: those of the smallest hashes, in their order.

    Null labels and ids are left out; of an id labelled both ways the larger
    label counts.  Null texts teach nothing; each row of an id that has several
    does, in the order of id hash, id, text hash.  Without rows of both classes,
    as in an empty table, the model is empty.  Other columns are not read.
    """
    some = labels.select(F.col(id_col).cast("bigint").alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id is not null and _label is not null").groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    text = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_text is not null")
    rows = text.join(F.broadcast(some), "_id").select("_id", "_label", F.xxhash64("_text").alias("_th"), "_text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for lo, hi, row, at in _per_text(b.column(3), bits):
                both = (row << 32) | at
                both.sort()
                both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
                found += [x.astype(np.int32).tobytes() for x in np.split(both & 0xFFFFFFFF, np.searchsorted(both >> 32, np.arange(1, hi - lo)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, pa.binary())], names=["id", "label", "th", "at"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [(y, np.append(np.frombuffer(x, np.int32), 1 << bits)) for b in batches for y, x in zip(b.column(1).to_pylist(), b.column(3).to_pylist())]
        if len({y for y, _ in given}) == 2:
            model = Ftrl((1 << bits) + 1)
            for _ in range(epochs):
                for y, at in given:
                    model.learn(at, y)
            w = model.weights(slice(None))
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at])], names=["at", "w"])

    one = rows.mapInArrow(extract, "id bigint, label int, th bigint, at binary").repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "th")
    got = one.mapInArrow(fit, "at int, w double").toArrow()
    return Model(bits, got.column("at").to_numpy().copy(), got.column("w").to_numpy().copy())


def score(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, toxic_score, is_toxic) of every row, repeated rows included.

    A null text, one without tokens, and any text under a model that had not
    both classes to learn from, scores 0 and isn't toxic.  Other columns are
    not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros((1 << model.bits) + 1)
        weight[model.at] = model.weight
        for b in batches:
            out = np.zeros(b.num_rows)
            for lo, hi, row, at in _per_text(b.column(1), model.bits):
                some = np.zeros(hi - lo, bool)
                some[row] = len(model.at) > 0
                used = np.flatnonzero(weight[at])
                both = np.unique((row[used] << 32) | at[used])
                total = np.bincount(both >> 32, weight[both & 0xFFFFFFFF], minlength=hi - lo) + weight[-1]
                out[lo:hi] = np.where(some, 1 / (1 + np.exp(-np.clip(total, -35, 35))), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out), pa.array(out >= threshold)], names=[id_col, "toxic_score", "is_toxic"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, toxic_score double, is_toxic boolean")
