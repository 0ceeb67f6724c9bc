"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

A document has or hasn't an n-gram. For each n-gram the ratio of its rates in toxic and other documents is learnt; the
n-grams that tell most apart are kept, and a logistic regression weighs them, each scaled by its log ratio.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barograph.llm import labelled
from barograph.llm.textbatch import SMALL_SLICE, slices, with_text

#: Characters in an n-gram; n-grams are hashed to 2^BITS features.
SIZES, BITS = (3, 4, 5, 6), 20
#: Documents of either label that are learnt from, and the features kept.
PER_CLASS, FEATURES = 4000, 12_000
#: A feature is in at least so many documents of the sample.
LEAST_DOCUMENTS = 4
SMOOTHING, PENALTY, ROUNDS = 1.0, 1e-4, 300
THRESHOLD = 0.3

#: Lower case of each character that has a single one below U+10000, white space as a blank.
_LOWER = np.array([ord(" ") if chr(i).isspace() else ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(1 << 16)], np.uint32)


def hashed(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: the document of each n-gram, and its feature. A document is ringed by blanks."""
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[starts]
    lengths = np.diff(begins)
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 2)
    ringed = np.full(len(doc), ord(" "), np.uint32)
    inner = np.ones(len(doc), bool)
    edge = begins[:-1] + 2 * np.arange(len(lengths))
    inner[edge] = inner[edge + lengths + 1] = False
    ringed[inner] = _LOWER[np.minimum(chars, 0xFFFF)]
    for n in SIZES:
        if len(doc) < n:
            continue
        last = len(doc) - n + 1
        h = np.full(last, n, np.uint32)
        for k in range(n):
            h *= np.uint32(0x01000193)
            h ^= ringed[k : k + last]
            h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x9E3779B1)
        within = doc[:last] == doc[n - 1 :]
        yield doc[:last][within], (h >> np.uint32(32 - BITS))[within]


def present(data: np.ndarray, starts: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every feature that a document has, each once; only ``wanted`` ones if given."""
    found = []
    for doc, feature in hashed(data, starts):
        if wanted is not None:
            at = np.flatnonzero(wanted[feature])
            doc, feature = doc[at], feature[at]
        found.append((doc.astype(np.int64) << BITS) | feature)
    pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass
class Model:
    """feature: sorted numbers of those kept; weight: their weights in the log-odds, with the ratio in them."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
        doc, feature = present(data, starts, table != 0)
        odds = np.bincount(doc, weights=table[feature], minlength=len(starts) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))

    def table(self) -> np.ndarray:
        table = np.zeros(1 << BITS)
        table[self.feature] = self.weight
        return table


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    # all n-grams of a slice are held here, so it is a small one
    for batch, data, starts in slices(batches, limit=SMALL_SLICE):
        doc, feature = present(data, starts)
        label = batch.column("label").to_numpy(zero_copy_only=False)[doc]
        for c in (0, 1):
            counts[c] += np.bincount(feature[label == c], minlength=1 << BITS)
    at = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["feature", "clean", "toxic"])


def _chosen(kept: np.ndarray):
    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << BITS, bool)
        wanted[kept] = True
        for batch, data, starts in slices(batches, limit=SMALL_SLICE):
            doc, feature = present(data, starts, wanted)
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.searchsorted(kept, feature), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("label"), lists], names=["label", "features"])

    return chosen


def regression(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, scale: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on features that are ``scale`` where a row has them; classes weigh alike."""
    x = scale.astype(np.float32)[columns]
    weigh = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    # columns are brought to a like step by their squares (a fixed diagonal), then accelerated gradient steps
    step = 1 / (0.25 * np.bincount(columns, x * x * weigh[rows] * np.sqrt(np.bincount(rows, minlength=len(labels)))[rows], len(scale)) + penalty + 1e-3)
    w, b, v, c = np.zeros(len(scale)), 0.0, np.zeros(len(scale)), 0.0
    for t in range(rounds):
        odds = np.bincount(rows, x * v[columns], len(labels)) + c
        slope = weigh * (1 / (1 + np.exp(-np.clip(odds, -700, 700))) - labels)
        to = v - 0.3 * step * (np.bincount(columns, x * slope[rows], len(scale)) + penalty * v)
        to_b = c - slope.sum()
        v, c = to + t / (t + 3) * (to - w), to_b + t / (t + 3) * (to_b - b)
        w, b = to, to_b
    return w, b


def fit(sampled: DataFrame, features: int = FEATURES) -> Model:
    """A model from (text, label) rows, a bounded sample. Ratios are counted by tasks; the driver gets ``features`` rows
    of them, and for each document of the sample which of these it has. One label alone gives a constant score."""
    sizes = {r["label"]: r["count"] for r in sampled.groupBy("label").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return Model(np.empty(0, np.int64), np.empty(0), 4.0 if toxic else -4.0)
    counts = sampled.mapInArrow(_counted, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    a, b = F.col("toxic") + SMOOTHING, F.col("clean") + SMOOTHING
    counts = counts.where(F.col("clean") + F.col("toxic") >= LEAST_DOCUMENTS).withColumn("ratio", F.log(a / (toxic + 2 * SMOOTHING)) - F.log(b / (clean + 2 * SMOOTHING)))
    best = counts.orderBy(F.desc(F.abs("ratio") / F.sqrt(1 / a + 1 / b)), "feature").limit(features).select("feature", "ratio").toPandas().sort_values("feature")
    kept, ratio = best["feature"].to_numpy(np.int64), best["ratio"].to_numpy(float)
    rows = sampled.mapInArrow(_chosen(kept), "label int, features array<int>").toArrow().combine_chunks()
    if not len(kept):
        return Model(kept, ratio, -4.0)
    labels, lists = rows["label"].to_numpy().astype(float), rows["features"].combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    w, bias = regression(np.repeat(np.arange(len(labels), dtype=np.int32), lengths), lists.flatten().to_numpy(), labels, ratio)
    return Model(kept, w * ratio, bias)


def _scored(model: Model, text: str, columns: list[str]):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch, data, starts in slices(batches, text, SMALL_SLICE):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(model.scores(data, starts, table))], names=[*columns, "score"])

    return scored


def score(docs: DataFrame, model: Model, columns: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """``columns`` of ``docs``, score (0 to 1) of ``text`` and predicted (1 if the score is at least ``threshold``).

    Empty and null texts are scored by the few n-grams of a blank text. Equal texts have equal scores. Columns named
    score or predicted are replaced.
    """
    df, text, kept, schema = with_text(docs, columns, T.StructType([T.StructField("score", T.DoubleType())]))
    return df.mapInArrow(_scored(model, text, kept), schema).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def learnt(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learns ``labels.toxic`` from documents whose crc32(doc_id) mod 4 is not 2."""
    return fit(labelled.sample(spark, docs, labels, "toxic", labelled.remainder(4) != 2, per_class))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (false for a null doc_id), score, predicted for each row of ``docs``."""
    scores = score(docs, learnt(spark, docs, labels), ["doc_id"])
    return scores.select("doc_id", F.coalesce(labelled.remainder(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
