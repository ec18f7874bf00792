"""Toxicity by FTRL-proximal logistic regression on hashed words, word pairs and skip-grams.

A text's features are the distinct hashes, in 2**BITS buckets, of its words (runs of letters, digits and non-ASCII bytes; A-Z folded), of its
pairs of neighbouring words and of its pairs with one word between. Each coordinate has its own learning rate, and an L1
penalty keeps almost all weights at exactly zero, so that the model is a short list of weights which goes with every
scoring task.

Fitting reads a bounded sample: the TRAIN_ROWS labelled documents whose hashed ids are smallest, whole texts. Features
are made in parallel, the passes over them run in one task. Scoring reads all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

BITS = 20
TRAIN_ROWS = 12_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 1.0


@dataclass
class Model:
    """Weights other than zero; at most 2**bits of them."""

    bias: float
    features: np.ndarray
    weights: np.ndarray
    bits: int = BITS
    #: Labelled documents that it was fitted to.
    rows: int = 0

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.features] = self.weights
        return out


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document number, bucket), with repetitions."""
    hashes, offsets = words.word_hashes(texts, "alnum")
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))
    docs, found = [doc], [hashes]
    with np.errstate(over="ignore"):
        for gap, factor in ((1, 0x9FB21C651E98DF25), (2, 0xA0761D6478BD642F)):
            same = doc[gap:] == doc[:-gap]
            found.append((common.mix64(hashes[:-gap] * np.uint64(factor) + hashes[gap:]))[same])
            docs.append(doc[gap:][same])
    return np.concatenate(docs), (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int32)


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> Model:
    """Fits to (distinct buckets, label) in the given order, several times over. The bias has no penalty."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits

    def weights(i: np.ndarray) -> np.ndarray:
        zi, ni = z[i], n[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        w[np.abs(zi) <= l1] = 0
        if i[-1] == bias:
            w[-1] = -zi[-1] / ((beta + np.sqrt(ni[-1])) / alpha)
        return w

    for _ in range(epochs):
        for own, label in rows:
            i = np.append(own, bias)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            ni = n[i]
            z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[i] = ni + g * g
    every = weights(np.arange((1 << bits) + 1))
    used = np.flatnonzero(every[:-1])
    return Model(float(every[-1]), used.astype(np.int32), every[used], bits, len(rows))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits to labels (id, 0 or 1) and their documents. Null labels and ids are left out; an id labelled twice counts as
    toxic if any label says so. Without any labelled document, the model scores every text 0.5."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null")
    sample = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # at most `rows` pairs of numbers

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.chunks(batches):
            doc, found = features(part.column("text"), bits)
            cuts = np.searchsorted(order := np.sort(doc.astype(np.int64) << 32 | found), np.arange(part.num_rows + 1, dtype=np.int64) << 32)
            own = [np.unique(order[a:b]).astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(own, pa.binary())], ["doc_id", "label", "own"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(np.frombuffer(x, np.int32), y) for b in batches for x, y in zip(b.column("own").to_pylist(), b.column("label").to_pylist())]
        if known:
            m = ftrl(known, bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(m.features, [-1, -2]).astype(np.int32)), pa.array(np.append(m.weights, [m.bias, m.rows]))], ["feature", "weight"])

    texts = common.id_text(docs, id_col, text_col).join(F.broadcast(sample), "doc_id")
    made = common.written(texts.mapInArrow(extract, "doc_id long, label int, own binary"), "toxicity-features")
    found = made.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "own").mapInArrow(fit, "feature int, weight double").toArrow()
    feature, weight = found["feature"].to_numpy(), found["weight"].to_numpy()
    own = feature >= 0
    return Model(float(weight[feature == -1].sum()), feature[own], weight[own], bits, int(weight[feature == -2].sum()))


def _scores(texts: pa.Array, dense: np.ndarray, model: Model) -> np.ndarray:
    doc, found = features(texts, model.bits)
    hit = dense[found] != 0
    both = np.unique(doc[hit].astype(np.int64) << 32 | found[hit])
    sums = np.bincount(both >> 32, dense[both & 0xFFFFFFFF], len(texts)) + model.bias
    return 1 / (1 + np.exp(-np.clip(sums, -35, 35)))


def accepted(docs: DataFrame, model: Model, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that score below the limit, all columns as they were. A null text scores as an empty one. A model
    that no labelled document taught rejects nothing; an empty table gives no rows."""
    if not model.rows:
        return docs
    held: list[np.ndarray] = []

    def keep(texts: pa.Array) -> np.ndarray:
        if not held:
            held.append(model.dense())
        return _scores(texts, held[0], model) < limit

    return common.kept_rows(docs, keep, text_col)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1): one row a document. Null and empty texts have the bias alone. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.dense()
        for part in common.chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_scores(part.column("text"), dense, model))], ["doc_id", "score"])

    return common.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, common.table(spark, sf_dir, "labels").where(~held_out()))
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
