"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. A line's evidence are coarse measures of itself and of the lines before and after it; the
chain ties neighbouring lines together. Forward-backward gives each line's probability of being good, and the mean of
these, weighted by the lines' lengths, is the document's quality. Lines of labelled documents are learnt with the label
of their document.
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
from barograph.llm.textbatch import RangeHash, mixed, slices, with_text, word_spans

#: Documents of either label that are learnt from.
PER_CLASS = 3000
PENALTY, ROUNDS, RATE = 1e-3, 250, 0.15
THRESHOLD = 0.3

#: Edges between the classes of a share, and of a number.
SHARES = np.array([0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75])
NUMBERS = np.array([0.0, 1.0, 3.0, 6.0, 12.0, 25.0, 50.0, 100.0, 300.0])
CLASSES = len(SHARES) + 1

_BYTE = np.arange(256)
_UPPER, _LOWER = (_BYTE >= 65) & (_BYTE <= 90), ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_SYMBOL, _BAR, _BANG, _STOP = (np.isin(_BYTE, list(x)) for x in (b"#*$%&<>=_^~@/\\{}[]+", b"|", b"!", b".,;:?"))
MEASURES = 11


def _again(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def lines_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one after another: the document of each line, its measures as classes (lines x MEASURES) and its bytes.

    A text has a line more than it has line breaks.
    """
    breaks = np.flatnonzero(data == 10)
    docs = len(starts) - 1
    per_doc = np.diff(np.searchsorted(breaks, starts)) + 1
    doc = np.repeat(np.arange(docs), per_doc)
    # all line starts: of the documents, and behind breaks
    first = np.cumsum(per_doc) - per_doc
    begin, end = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
    inner, last = np.ones(len(doc), bool), np.zeros(len(doc), bool)
    inner[first] = False
    last[first + per_doc - 1] = True
    begin[first], begin[inner] = starts[:-1], breaks + 1
    end[last], end[~last] = starts[1:], breaks
    size = end - begin

    def total(per_byte: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(per_byte, dtype=np.int32 if len(data) < 1 << 30 else np.int64)])
        return (sums[end] - sums[begin]).astype(float)

    upper, lower, digit, symbol, bar, bang, stop = (total(t[data]) for t in (_UPPER, _LOWER, _DIGIT, _SYMBOL, _BAR, _BANG, _STOP))
    word_at, word_end = word_spans(data, starts)
    words = np.diff(np.searchsorted(word_at, np.concatenate([begin, [len(data)]]))).astype(float) if len(begin) else np.empty(0)
    ranged = RangeHash(data)
    word, of = ranged(word_at, word_end), np.searchsorted(starts, word_at, "right") - 1
    again = np.zeros(len(word), bool)
    if len(word) > 2:
        three = mixed(word[:-2] * np.uint64(3) + mixed(word[1:-1] * np.uint64(5) + mixed(word[2:] * np.uint64(7)))) + mixed(of[:-2].astype(np.uint64) + np.uint64(1))
        whole = of[:-2] == of[2:]
        twice = np.zeros(len(three), bool)
        twice[whole] = _again(three[whole])
        for k in range(3):
            again[k : k + len(twice)] |= twice
    repeated = np.concatenate([[0], np.cumsum(again)])
    at = np.searchsorted(word_at, np.concatenate([begin, [len(data)]]))
    repeated = (repeated[at[1:]] - repeated[at[:-1]]).astype(float)
    line_again = _again(ranged(begin, end) + mixed(doc.astype(np.uint64) + np.uint64(1))) & (words > 0)
    tail = np.where(size > 0, data[np.maximum(end - 1, 0)] if len(data) else 0, 0)
    n, w, letters = np.maximum(size, 1), np.maximum(words, 1), np.maximum(upper + lower, 1)
    shares = [upper / letters, digit / n, symbol / n, bar / w, bang / w, stop / w, repeated / w, line_again.astype(float), np.isin(tail, list(b".?!")).astype(float)]
    numbers = [words, (size - words) / w]
    classes = [np.searchsorted(SHARES, x, "left") for x in shares] + [np.searchsorted(NUMBERS, x, "left") for x in numbers]
    return doc, np.stack(classes, axis=1), size


def evidence(doc: np.ndarray, classes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log-odds of good of each line from its own classes and its neighbours'. weights: before, own, after x MEASURES x CLASSES."""
    at = np.arange(MEASURES)
    out = weights[1][at, classes].sum(axis=1)
    if len(doc) > 1:
        linked = (doc[1:] == doc[:-1]).astype(float)
        out[1:] += linked * weights[0][at, classes[:-1]].sum(axis=1)
        out[:-1] += linked * weights[2][at, classes[1:]].sum(axis=1)
    return out


class Chain:
    """Forward-backward over all documents in step. ties: log-weights of bad-bad, bad-good, good-bad, good-good."""

    def __init__(self, doc: np.ndarray):
        counts = np.bincount(doc) if len(doc) else np.empty(0, np.int64)
        counts = counts[counts > 0]
        order = np.argsort(-counts, kind="stable")
        self.first, self.counts = (np.cumsum(counts) - counts)[order], counts[order]

    def run(self, e: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward log-odds (with a line's own evidence) and backward log-odds (without)."""
        bb, bg, gb, gg = ties
        forward, backward = e.copy(), np.zeros(len(e))
        longest = int(self.counts[0]) if len(self.counts) else 0
        live = [int(np.searchsorted(-self.counts, -t, "left")) for t in range(longest)]
        for t in range(1, longest):
            at = self.first[: live[t]] + t
            a = forward[at - 1]
            forward[at] += np.logaddexp(gg + a, bg) - np.logaddexp(gb + a, bb)
        for t in range(longest - 1, 0, -1):
            at = self.first[: live[t]] + t
            z = e[at] + backward[at]
            backward[at - 1] = np.logaddexp(gg + z, gb) - np.logaddexp(bg + z, bb)
        return forward, backward


def _good(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


@dataclass
class Model:
    weights: np.ndarray
    ties: np.ndarray

    def scores(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        doc, classes, size = lines_of(data, starts)
        forward, backward = Chain(doc).run(evidence(doc, classes, self.weights), self.ties)
        # a text without bytes is one empty line
        weight = np.where(np.bincount(doc, size, len(starts) - 1)[doc] > 0, size, 1)
        return np.bincount(doc, _good(forward + backward) * weight, len(starts) - 1) / np.bincount(doc, weight, len(starts) - 1)


def fit(doc: np.ndarray, classes: np.ndarray, label: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> Model:
    """Maximum likelihood with a penalty, by Adam. doc, classes: lines in order; label: of each line."""
    weights, ties = np.zeros((3, MEASURES, CLASSES)), np.array([1.0, -1.0, -1.0, 1.0])
    if not len(doc) or label.min() == label.max():
        weights[1] += (4.0 if len(doc) and label[0] == 1 else -4.0 if len(doc) else 0.0) / MEASURES
        return Model(weights, ties)
    chain, at = Chain(doc), np.arange(MEASURES) * CLASSES
    cells = classes + at
    linked = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    # both labels weigh alike, a document's lines together as much as its length's root
    per_line = np.where(label == 1, 0.5 / (label == 1).sum(), 0.5 / (label == 0).sum())
    kind = (2 * label[linked - 1] + label[linked]).astype(int)
    seen = np.bincount(kind, per_line[linked], 4)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, ties)]
    sums = lambda rows, slope: np.bincount(cells[rows].ravel(), np.repeat(slope, MEASURES), MEASURES * CLASSES).reshape(MEASURES, CLASSES)
    everything = np.arange(len(doc))
    for step in range(1, rounds + 1):
        e = evidence(doc, classes, weights)
        forward, backward = chain.run(e, ties)
        slope = (_good(forward + backward) - label) * per_line
        own = np.stack([sums(linked - 1, slope[linked]), sums(everything, slope), sums(linked, slope[linked - 1])])
        a, z = forward[linked - 1], e[linked] + backward[linked]
        pair = np.stack([np.full(len(a), ties[0]), ties[1] + z, ties[2] + a, ties[3] + a + z])
        pair = np.exp(pair - pair.max(axis=0))
        expected = (pair / pair.sum(axis=0) * per_line[linked]).sum(axis=1)
        for x, g, (m, v) in zip((weights, ties), (own + penalty * weights, expected - seen + penalty * ties), moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(weights, ties)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, starts in slices(batches):
        doc, classes, _ = lines_of(data, starts)
        ends = np.searchsorted(doc, np.arange(batch.num_rows + 1)) * MEASURES
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(classes.ravel(), pa.int8()))], names=["label", "classes"])


def learnt(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learns ``labels.quality`` from documents whose crc32(doc_id) mod 5 is not 0: a sample of bounded size, whose lines'
    classes go to the driver."""
    sampled = labelled.sample(spark, docs, labels, "quality", labelled.remainder(5) != 0, per_class)
    rows = sampled.mapInArrow(_lines, "label int, classes array<tinyint>").toArrow().combine_chunks()
    if not rows.num_rows:
        return fit(np.empty(0, np.int64), np.empty((0, MEASURES), np.int64), np.empty(0))
    lists = rows["classes"].combine_chunks()
    count = lists.value_lengths().to_numpy(zero_copy_only=False) // MEASURES
    classes = lists.flatten().to_numpy().astype(np.int64).reshape(-1, MEASURES)
    return fit(np.repeat(np.arange(len(count)), count), classes, np.repeat(rows["label"].to_numpy(), count))


def _scored(model: Model, text: str, columns: list[str]):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(model.scores(data, starts))], names=[*columns, "score"])

    return scored


def score(docs: DataFrame, model: Model, columns: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """``columns`` of ``docs``, score (0 to 1, higher is better) of ``text`` and predicted (1 from ``threshold`` on).

    An empty or null text is one empty line. Equal texts have equal scores. Columns named score or predicted are replaced.
    """
    df, text, kept, schema = with_text(docs, columns, T.StructType([T.StructField("score", T.DoubleType())]))
    return df.mapInArrow(_scored(model, text, kept), schema).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (false for a null doc_id), score, predicted for each row of ``docs``."""
    scores = score(docs, learnt(spark, docs, labels), ["doc_id"])
    return scores.select("doc_id", F.coalesce(labelled.remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
