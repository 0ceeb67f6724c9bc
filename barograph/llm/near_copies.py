"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Candidates are found by SimHash fingerprints of these sets, linked as in ``simhash`` at a Hamming distance of at most 4.
Pairs of similarity 0.8 often differ in more bits, so candidates meet under bands of min-hashes as well: with 20 bands of
5, such a pair shares one with a probability of 0.9996, a closer pair with a greater one. Only documents that have a link
or share a band with another one go on, with their shingles; there each link is verified by its exact similarity, in parts
of bounded size, and a part returns the links of a spanning forest, so that links grow with the rows. Shingles and sets
are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barograph.llm import simhash
from barograph.llm.components import smallest_reachable
from barograph.llm.textbatch import SMALL_SLICE, RangeHash, mixed, slices, word_spans
from barograph.session import shared_dir

SHINGLE_WORDS = 5
#: Least similarity, as numerator and denominator.
LEAST = (4, 5)
BANDS, ROWS = 20, 5
#: Documents of one band that are compared at a time; a band with more is cut into parts, and each pair of parts compared.
PART = 1024

_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_SEEDS = mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, -1)


def shingles(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles, sorted and once each within a text, and where each text's begin and end.

    Fewer than five words are one shingle; no words, none.
    """
    data, docs = _LOWER[data], len(starts) - 1
    begin, end = word_spans(data, starts)
    doc = np.searchsorted(starts, begin, "right") - 1
    word, words = RangeHash(data)(begin, end), np.bincount(doc, minlength=docs)
    first, n = np.cumsum(words) - words, len(doc)
    h = np.zeros(n, np.uint64)
    for j in range(min(SHINGLE_WORDS, n)):
        inside = doc[j:] == doc[: n - j]
        h[: n - j] += np.where(inside, mixed(word[j:] + np.uint64(j + 1)), np.uint64(0))
    place = np.arange(n) - first[doc]
    own = (place + SHINGLE_WORDS <= words[doc]) | (place == 0)
    h, doc = mixed(h[own]), doc[own]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(docs + 1))


def bands(h: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """BANDS hashes for each text that has shingles, a row for each."""
    filled = edges[:-1][edges[1:] > edges[:-1]]
    out = np.zeros((len(filled), BANDS), np.uint64)
    for i in range(BANDS * ROWS if len(filled) else 0):
        least = np.minimum.reduceat(((h ^ _SEEDS[0, i]) * (_SEEDS[1, i] | np.uint64(1))) >> np.uint64(20), filled)
        out[:, i // ROWS] = mixed(out[:, i // ROWS] + least + np.uint64(i))
    return out


def fingerprints(h: np.ndarray, edges: np.ndarray, at_a_time: int = 1 << 16) -> np.ndarray:
    """The SimHash of each text's set, unsigned: a bit is 1 if it is set in over half of the hashes; 0 without shingles."""
    filled, counts = np.flatnonzero(edges[1:] > edges[:-1]), np.zeros((len(edges) - 1, 64), np.int64)
    doc = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    for i in range(0, len(h), at_a_time):
        part, of = h[i : i + at_a_time], doc[i : i + at_a_time]
        new = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts[of[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    out = np.zeros(len(edges) - 1, np.uint64)
    out[filled] = np.packbits(2 * counts[filled] > np.diff(edges)[filled, None], axis=1).view(">u8").reshape(-1)
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, starts in slices(batches, "__text", SMALL_SLICE):
        h, edges = shingles(data, starts)
        at, of = edges.tolist(), iter(bands(h, edges).view(np.int64).tolist())
        keys = [xxhash.xxh64_intdigest(h[a:b].tobytes()) - (1 << 63) for a, b in zip(at, at[1:], strict=False)]
        made = [pa.array(keys, pa.int64()), pa.array([next(of) if b > a else [] for a, b in zip(at, at[1:], strict=False)], pa.list_(pa.int64())), pa.array(fingerprints(h, edges).view(np.int64))]
        kept = [(f, c) for f, c in zip(batch.schema.names, batch.columns, strict=True) if f != "__text"]
        yield pa.RecordBatch.from_arrays([*(c for _, c in kept), *made], names=[*(f for f, _ in kept), "__key", "__bands", "__print"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, starts in slices(batches, limit=SMALL_SLICE):
        h, edges = shingles(data, starts)
        at = edges.tolist()
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([h[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())], names=["key", "shingles"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the least similarity."""
    up, down = LEAST
    if min(len(a), len(b)) * down < max(len(a), len(b)) * up:
        return False
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return common * down >= (len(both) - common) * up


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect all sets that are similar; what is known to be connected is not compared."""
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for step in range(1, len(sets)):
        if len(out) == len(sets) - 1:
            break
        for i in range(len(sets) - step):
            x, y = root(i), root(i + step)
            if x != y and similar(sets[i], sets[i + step]):
                parent[max(x, y)] = min(x, y)
                out.append((i, i + step))
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; a group may go over several batches."""
    group, keys, sets = None, [], []

    def linked() -> pa.RecordBatch:
        found = forest(sets)
        return pa.RecordBatch.from_arrays([pa.array([keys[i] for i, _ in found], pa.int64()), pa.array([keys[j] for _, j in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("which", "bits", "low", "high")), strict=True)
        for now, key, held in zip(rows, batch.column("key").to_pylist(), batch.column("shingles"), strict=True):
            if now != group:
                if len(keys) > 1:
                    yield linked()
                group, keys, sets = now, [], []
            keys.append(key)
            sets.append(np.frombuffer(held.as_py(), np.uint64))
    if len(keys) > 1:
        yield linked()


def _leading(documents: DataFrame, leads: DataFrame, made: Column) -> DataFrame:
    """``made`` of the rows of ``documents`` that have a key of ``leads`` (__key, __first) and its doc_id, a row for each key.

    Rows are dealt by key and id: exact copies, which all have one key, go to as many tasks as they have ids.
    """
    rows = documents.withColumn("__at", F.xxhash64("doc_id"))
    found = rows.join(leads.withColumn("__at", F.xxhash64("__first")), ["__key", "__at"]).where(F.col("doc_id").eqNullSafe(F.col("__first")))
    return found.groupBy("__key", "__at").agg(made)


def close_prints(nodes: DataFrame) -> DataFrame:
    """(a, b): keys of sets whose fingerprints are equal, or linked by ``simhash``; enough to connect all such sets."""
    filled = nodes.where(F.size("bands") > 0)
    prints = filled.groupBy("print").agg(F.min("key").alias("least"))
    same = filled.join(prints, "print").where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b"))
    first, second = (prints.select(F.col("print").alias(c), F.col("least").alias(f"key_{c}")) for c in "ab")
    near = simhash.near_links(prints.select("print")).distinct().join(first, "a").join(second, "b")
    return same.unionByName(near.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")))


def _met(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """(which, bits, n, key): the groups of keys that are to be compared, of bands and of linked fingerprints."""
    keyed = nodes.select("key", F.posexplode("bands").alias("which", "bits"))
    shared = keyed.groupBy("which", "bits").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.min("key").alias("least"), F.max("key").alias("most")).where("n > 1")
    # a group that meets under several bands is compared under one of them
    shared = shared.groupBy("n", "x", "least", "most").agg(F.min(F.struct("which", "bits")).alias("at")).select("at.which", "at.bits", "n")
    at, links_at, pairs_at = shared_dir(spark, "copies-met"), shared_dir(spark, "prints-linked"), shared_dir(spark, "prints-met")
    keyed.join(shared, ["which", "bits"]).write.parquet(at)
    close_prints(nodes).write.parquet(links_at)
    banded, linked = spark.read.parquet(at), spark.read.parquet(links_at)
    # a pair that a band has too is compared there; the others are groups of two
    of_a = linked.join(banded.select(F.col("key").alias("a"), "which", "bits"), "a")
    there = of_a.join(banded.select(F.col("key").alias("b"), "which", "bits"), ["b", "which", "bits"]).select("a", "b")
    pairs = linked.join(there.distinct(), ["a", "b"], "left_anti")
    group = [F.lit(BANDS).alias("which"), F.xxhash64("a", "b").alias("bits"), F.lit(2).cast("long").alias("n")]
    pairs.select(*group, F.explode(F.array("a", "b")).alias("key")).write.parquet(pairs_at)
    return banded.select("which", "bits", "n", "key").unionByName(spark.read.parquet(pairs_at))


def links(spark: SparkSession, documents: DataFrame, nodes: DataFrame, part: int = PART) -> DataFrame:
    """(a, b): verified links between keys of ``nodes``, enough to connect all similar pairs that share a band, beside those
    of fingerprints."""
    met = _met(spark, nodes)
    wanted = nodes.join(met.select("key").distinct(), "key", "left_semi").select(F.col("key").alias("__key"), F.col("first").alias("__first"))
    texts = _leading(documents, wanted, F.min("__row.text").alias("text")).select(F.col("__key").alias("key"), "text")
    sets = texts.mapInArrow(_sets, "key long, shingles binary")
    met = met.withColumn("parts", F.ceil(F.col("n") / F.lit(part)))
    met = met.withColumn("mine", F.pmod(F.xxhash64("key"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = met.select("which", "bits", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "key").join(sets, "key")
    return met.repartition("which", "bits", "low", "high").sortWithinPartitions("which", "bits", "low", "high", "key").mapInArrow(_links, "a long, b long")


def one_of_each(spark: SparkSession, docs: DataFrame, part: int = PART) -> DataFrame:
    """``docs`` with one document of each group that near copies connect: that with the smallest doc_id, and of repeated
    rows one. Texts without words are copies of each other; null is empty."""
    at, nodes_at = shared_dir(spark, "documents-sketched"), shared_dir(spark, "sketches")
    # the caller's row goes along as one struct, so that none of its names meets one used here
    row = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text").alias("__text"))
    schema = T.StructType([*row.drop("__text").schema, T.StructField("__key", T.LongType()), T.StructField("__bands", T.ArrayType(T.LongType())), T.StructField("__print", T.LongType())])
    row.mapInArrow(_sketched, schema).write.parquet(at)
    documents = spark.read.parquet(at)
    documents.groupBy(F.col("__key").alias("key")).agg(F.min("doc_id").alias("first"), F.first("__bands").alias("bands"), F.first("__print").alias("print")).write.parquet(nodes_at)
    nodes = spark.read.parquet(nodes_at)
    roots = smallest_reachable(spark, links(spark, documents, nodes, part))
    rooted = nodes.join(roots, F.col("key") == F.col("node"), "left").select("key", "first", F.coalesce("root", "key").alias("root"))
    lead = rooted.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "key")).alias("lead"))
    lead = lead.select(F.col("lead.key").alias("__key"), F.col("lead.first").alias("__first"))
    # of rows that differ in other columns the smallest stays, so that reruns agree
    return _leading(documents, lead, F.min("__row").alias("__row")).select("__row.*")
