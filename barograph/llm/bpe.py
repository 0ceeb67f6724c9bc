"""Byte-level BPE: texts to token ids by ranked merges, and back.

Merges are folded over the distinct words of a slice of texts, all words at once: in each round every word joins its
pair of lowest rank, the leftmost of equals. A task keeps the ids of words it has met, up to a bound. The rank map
comes from a public vocabulary file, some 50,000 entries, and goes to tasks as a broadcast of that size.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barograph.llm.textbatch import slices, with_text

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Words whose ids a task keeps before it starts anew, and the bytes of text it takes at a time.
KEPT_WORDS, SLICE = 250_000, 2 << 20
#: Longer words are merged one by one with a heap of pairs; the joint rounds would go on for the longest word.
JOINT_BYTES = 48
#: No rank: larger than any.
NONE = np.iinfo(np.int64).max


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Numbers(dict):
    """Numbers words in the order in which they are first looked up."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Codec:
    """Encodes and decodes arrays of texts by a rank map; special tokens are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks = ranks
        # in this library \s takes the information separators for white space, in the pattern's own they are none
        self.words_of = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        size = max(ranks.values(), default=-1) + 1
        by_id = [b""] * size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.bytes_at = np.concatenate([[0], np.cumsum([len(t) for t in by_id])]).astype(np.int64)
        self.all_bytes = np.frombuffer(b"".join(by_id), np.uint8)
        digits = [b"%d," % i for i in range(size)]
        self.digits_at = np.concatenate([[0], np.cumsum([len(t) for t in digits])]).astype(np.int64)
        self.all_digits = np.frombuffer(b"".join(digits), np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # every way to cut a token into two tokens, in a hash table with open places
        pairs = {ranks[t[:i]] * size + ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.size, self.bits = size, max(4, (4 * len(pairs)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE)
        left, right = np.array([*pairs.keys()], np.int64), np.array([*pairs.values()], np.int64)
        step = 0
        while len(left):
            place = self.place(left, step)
            free = self.keys[place] < 0
            _, one = np.unique(place, return_index=True)
            put = one[free[one]]
            self.keys[place[put]], self.values[place[put]] = left[put], right[put]
            stay = np.ones(len(left), bool)
            stay[put] = False
            left, right, step = left[stay], right[stay], step + 1
        self.steps = step
        self.clear()

    def clear(self) -> None:
        self.index = Numbers()
        self.ids, self.ends = np.empty(0, np.int64), np.zeros(1, np.int64)

    def place(self, pair: np.ndarray, step: int) -> np.ndarray:
        """Where a pair is looked for in the table at its n-th try."""
        mixed = (pair.view(np.uint64) + np.uint64(step)) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).view(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, which is the id of their union; NONE if it is no token."""
        pair = left * self.size + right
        at = self.place(pair, 0)
        key = self.keys[at]
        out = np.where(key == pair, self.values[at], NONE)
        look, step = np.flatnonzero((key != pair) & (key >= 0)), 1
        while len(look) and step < self.steps:
            at = self.place(pair[look], step)
            key = self.keys[at]
            hit = key == pair[look]
            out[look[hit]] = self.values[at[hit]]
            look, step = look[~hit & (key >= 0)], step + 1
        return out

    def merge_long(self, word: bytes) -> list[int]:
        ids = [int(self.single[b]) for b in word]
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        text = [word[i : i + 1] for i in range(len(word))]
        heap = [(r, i, text[i] + text[i + 1]) for i in range(len(ids) - 1) if (r := self.ranks.get(text[i] + text[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, both = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or text[i] + text[j] != both:
                continue  # one of the two has been merged since
            ids[i], text[i], ids[j], after[i] = r, both, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (x := self.ranks.get(text[a] + text[b])) is not None:
                    heapq.heappush(heap, (x, a, text[a] + text[b]))
        return [x for x in ids if x >= 0]

    def merge(self, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places of words, ids) of words of up to JOINT_BYTES; the ids of a word are in order."""
        lengths = np.array([len(w) for w in words], np.int64)
        ids = self.single[np.frombuffer(b"".join(words), np.uint8)]
        word, out = np.repeat(np.arange(len(words)), lengths), []
        while len(ids):
            rank = np.full(len(ids), NONE)
            rank[:-1] = np.where(word[1:] == word[:-1], self.rank(ids[:-1], ids[1:]), NONE)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(ids))))
            done = least == NONE
            out.append((word[done], ids[done]))
            best = np.flatnonzero((rank == least) & ~done)
            best = best[np.concatenate([[True], word[best][1:] != word[best][:-1]])] if len(best) else best
            ids = ids.copy()
            ids[best] = rank[best]
            stay = ~done
            stay[best + 1] = False
            ids, word = ids[stay], word[stay]
        return out

    def learn(self, words: list[str]) -> None:
        """Works out the ids of the words that have been numbered since, in the order of their numbers."""
        raw = [w.encode("utf-8", "replace") for w in words]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        whole = [(i, r) for i, w in enumerate(raw) if (r := self.ranks.get(w)) is not None]
        found.append((np.array([i for i, _ in whole], np.int64), np.array([r for _, r in whole], np.int64)))
        rest = [i for i, w in enumerate(raw) if w not in self.ranks]
        for i in (i for i in rest if len(raw[i]) > JOINT_BYTES):
            ids = self.merge_long(raw[i])
            found.append((np.full(len(ids), i), np.array(ids, np.int64)))
        joint = np.array([i for i in rest if len(raw[i]) <= JOINT_BYTES], np.int64)
        found += [(joint[at], ids) for at, ids in self.merge([raw[i] for i in joint.tolist()])]
        at, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(at, kind="stable")
        counts = np.bincount(at, minlength=len(words))
        self.ids = np.concatenate([self.ids, ids[order]])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin and end."""
        if len(self.index) > KEPT_WORDS:
            self.clear()
        words = [self.words_of(t) for t in texts]
        known = len(self.index)
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        if len(self.index) > known:
            self.learn(list(islice(self.index, known, None)))
        text_ends = np.concatenate([[0], np.cumsum([len(ws) for ws in words])]).astype(np.int64)
        ids, ends = gather(self.ids, self.ends, at)
        return ids, ends[text_ends]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts one after another, and where each text's begin and end."""
        pieces, at = gather(self.all_bytes, self.bytes_at, ids)
        return pieces, at[ends]

    def decimals(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As decode(), but each id written out with a comma after it."""
        pieces, at = gather(self.all_digits, self.digits_at, ids)
        return pieces, at[ends]


def gather(values: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[ends[i] : ends[i + 1]]`` for all i in ``at`` one after another, and where they begin and end."""
    starts, lengths = ends[at], ends[at + 1] - ends[at]
    out = np.concatenate([[0], np.cumsum(lengths)])
    return values[np.repeat(starts - out[:-1], lengths) + np.arange(out[-1])], out


def _encoded(ranks, text: str, columns: list[str]):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value)
        for batch, _, _ in slices(batches, text, SLICE):
            ids, ends = codec.encode([t or "" for t in batch.column(text).to_pylist()])
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), tokens], names=[*columns, "tokens"])

    return encoded


def _decoded(ranks, columns: list[str]):
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100)
                lengths = part.column("tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                data, at = codec.decode(part.column("tokens").flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)]))
                raw = data.tobytes()
                texts = pa.array([raw[a:b] for a, b in zip(at.tolist(), at.tolist()[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), texts], names=[*columns, "decoded"])

    return decoded


def _ranks(spark: SparkSession, vocabulary: str):
    return spark.sparkContext.broadcast(read_ranks(vocabulary))


def encode(docs: DataFrame, columns: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``columns`` of ``docs`` and ``tokens``, the ids of ``text``: empty for empty and null texts."""
    df, text, kept, schema = with_text(docs, columns, T.StructType([T.StructField("tokens", T.ArrayType(T.IntegerType()))]))
    return df.mapInArrow(_encoded(_ranks(docs.sparkSession, vocabulary), text, kept), schema)


def decode(encoded: DataFrame, columns: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``columns`` of ``encoded`` and ``decoded``, the bytes that ``tokens`` stand for: empty where it is null."""
    kept = [c for c in columns if c != "decoded"]
    schema = T.StructType([*(encoded.schema[c] for c in kept), T.StructField("decoded", T.BinaryType())])
    return encoded.select(*kept, *([] if "tokens" in kept else ["tokens"])).mapInArrow(_decoded(_ranks(encoded.sparkSession, vocabulary), kept), schema)


def round_trip(docs: DataFrame, columns: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``columns`` of ``docs``, the tokens of ``text``, their number, and the SHA-256 of the ids and of the bytes that
    they decode to.

    Null texts are empty: no tokens, both digests those of nothing. Repeated rows give repeated rows; columns named
    like the four results are replaced.
    """
    kept = [c for c in columns if c not in ("tokens", "n_tokens", "ids_sha256", "decoded_sha256")]
    # the caller's row goes along as one struct, so that none of its names meets one used here
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row")
    back = decode(encode(docs.select(row, "text"), ["__row"], vocabulary), ["__row", "tokens"], vocabulary)
    listed = F.array_join(F.col("tokens").cast("array<string>"), ",")
    return back.select(
        *[F.col(f"__row.`{c}`") for c in kept],
        "tokens",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
