"""Toxicity by logistic regression, trained with FTRL-proximal.

Features are hashed words, word pairs and pairs with one word between them, each present or
not. Every coordinate has a learning rate of its own, and the L1 penalty keeps the weights of
rare features at zero, so that few remain and are sent to all tasks.

The model is fitted on at most ``max_per_class`` documents of each label, those with the smallest seeded
hash of their id among the training folds; scoring covers every text. Null labels are no labels; of
several labels of a document the larger counts. Without labels of both kinds every score is the
prior. Null and empty texts have no features and score as the bias says. Repeated rows score alike, an empty
table gives an empty table, and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import fold, fold_number
from millrace.llm.text import chunks, lowered, mixed, word_hashes

BITS = 18
MAX_PER_CLASS = 3000
EPOCHS = 6
SEED = 11


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0


def features(words: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distinct places of the words, pairs and skip pairs of one text."""
    shift = np.uint64(64 - bits)
    pair = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]
    skip = words[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + words[2:] + np.uint64(1)
    return np.unique(mixed(np.concatenate([words, pair, skip])) >> shift).astype("i4")


def _texts_features(texts: pa.Array, bits: int) -> Iterator[np.ndarray]:
    hashes, counts = word_hashes(lowered(texts))
    for words in np.split(hashes, np.cumsum(counts)[:-1]):
        yield features(words, bits)


def train_ftrl(examples: list[np.ndarray], labels: np.ndarray, bits: int = BITS, rule: Ftrl = Ftrl(), epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias. ``examples`` hold the places of the features that are present.

    The rarer label weighs more, by the square root of how much rarer it is.
    """
    share = np.clip(labels.mean() if len(labels) else 0.5, 1e-9, 1 - 1e-9)
    weight = np.maximum(1, np.sqrt([share / (1 - share), (1 - share) / share])) if 0 < labels.sum() < len(labels) else np.ones(2)
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - rule.l1, 0)
        return -shrunk / ((rule.beta + np.sqrt(n[at])) / rule.alpha + rule.l2)

    bias = 1 << bits
    order = np.random.default_rng(SEED)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            at = np.append(examples[i], bias)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - labels[i]
            g *= weight[int(labels[i])]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / rule.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    trained = weights(np.arange((1 << bits) + 1))
    return trained[:-1].astype("f4"), float(trained[-1])


def training_sample(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """``doc_id`` and ``toxic`` of at most ``max_per_class`` training documents of each label."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(fold_number(F.col("doc_id")) != 0).withColumn("order", fold(SEED, F.col("doc_id")))
    parts = [known.where(F.col("toxic") == label).orderBy("order", "doc_id").limit(max_per_class) for label in (0, 1)]
    return parts[0].unionByName(parts[1]).select("doc_id", "toxic")


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Weights and bias from the sample's hashed features, gathered in an order that does not change."""
    sample = training_sample(docs, labels, max_per_class)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            places = [x.tobytes() for x in _texts_features(batch.column(2), bits)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int32()), pa.array(places, pa.binary())], names=["doc_id", "toxic", "places"])

    rows = texts.mapInArrow(extract, "doc_id long, toxic int, places binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"], bytes(r["places"])))
    examples = [np.frombuffer(bytes(r["places"]), "i4") for r in rows]
    return train_ftrl(examples, np.array([r["toxic"] for r in rows], float), bits)


def score_toxicity(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, bits: int = BITS) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for each document."""
    weights, bias = fit(docs, labels, max_per_class, bits)
    kept = np.flatnonzero(weights).astype("i4")
    model = docs.sparkSession.sparkContext.broadcast((kept, weights[kept], bias))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, values, bias = model.value
        table = np.zeros(1 << bits)
        table[places] = values
        for batch in chunks(batches):
            sums = np.array([table[x].sum() for x in _texts_features(batch.column(2), bits)]) + bias
            scores = 1 / (1 + np.exp(-np.clip(sums, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(scores)], names=schema.names)

    rows = docs.select("doc_id", (fold_number(F.col("doc_id")) == 0).alias("held_out"), "text")
    return rows.mapInArrow(score, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
