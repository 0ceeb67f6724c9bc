"""Periodic runs of words, found by multi-scale minimizers.

A run is a stretch of words in which every word equals the one ``period`` places before it, repeated at least three
times, that no neighbouring word extends. Periods up to ``SHORT`` are found by scanning each lag directly. Longer ones
fall into scales whose periods differ by less than half. A scale hashes every stretch of ``k`` words, ``k`` being its
longest period, and keeps the smallest hash of every window. A run's windows repeat at its period, and so do their
minima; as no stretch of k words recurs sooner within the run, two successive equal minima lie one period apart. Each
such pair is a seed, extended to both sides word by word, so nothing is reported that wasn't compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barograph.llm.textbatch import BLANKS, GAP, RangeHash, slices, with_text
from barograph.operators.once import computed_once

#: A run repeats its period at least so often and has at least so many words.
LEAST_TIMES, LEAST_WORDS = 3, 24
#: Periods found by direct scans of their lags.
SHORT = 16

#: Bits of a packed window minimum that hold its place; the rest is the hash.
_PLACE = np.uint64((1 << 30) - 1)


def scales(longest: int, short: int = SHORT) -> Iterator[tuple[int, int, int, int]]:
    """(shortest period, longest period, words hashed, hashes in a window) of each scale up to ``longest``.

    A run of period q has 3 * q words or more, and a pair of minima at distance q needs q + k + window - 1 of them.
    """
    low = short + 1
    while low <= longest:
        high = max(low, low * 3 // 2)
        yield low, high, high, 2 * low - high + 1
        low = high + 1


def short_runs(x: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal stretches with this period that are long enough."""
    if len(x) <= period:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    breaks = np.concatenate([[-1], np.flatnonzero(x[period:] != x[:-period]), [len(x) - period]])
    same = np.diff(breaks) - 1
    long_enough = np.flatnonzero(same + period >= max(LEAST_WORDS, LEAST_TIMES * period))
    begin = breaks[long_enough] + 1
    return begin, begin + same[long_enough] + period


def window_minima(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the leftmost smallest hash of each window of so many successive ones, each place once."""
    packed = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    wide = 1
    while wide * 2 <= window:
        packed = np.minimum(packed[:-wide], packed[wide:])
        wide *= 2
    if wide < window:
        packed = np.minimum(packed[: len(packed) - (window - wide)], packed[window - wide :])
    at = (packed & _PLACE).astype(np.int64)
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def seeds(hashes: np.ndarray, window: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of successive equal minima that lie a period of this scale apart."""
    if len(hashes) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = window_minima(hashes, window)
    at = at[np.argsort(hashes[at], kind="stable")]
    apart = np.diff(at)
    fit = np.flatnonzero((hashes[at[1:]] == hashes[at[:-1]]) & (apart >= low) & (apart <= high))
    return at[fit], apart[fit]


def _agree(x: np.ndarray, i: int, period: int, step: int) -> int:
    """How many places from i on, upwards (step 1) or downwards (-1), equal the place ``period`` after them."""
    n, found, block = len(x) - period, 0, 64
    while True:
        if step > 0:
            a, b = i + found, min(n, i + found + block)
        else:
            a, b = max(0, i - found - block + 1), i - found + 1
        if a >= b:
            return found
        differ = np.flatnonzero(x[a:b] != x[a + period : b + period])
        if len(differ):
            return found + int(differ[0] if step > 0 else b - a - 1 - differ[-1])
        found, block = found + b - a, block * 2


def extended(x: np.ndarray, places: np.ndarray, periods: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(begin, end, period) of the maximal stretch around each seed, once for all seeds that lie in it."""
    order = np.lexsort((places, periods))
    begin = end = period = -1
    for i in order.tolist():
        at, q = int(places[i]), int(periods[i])
        if q == period and at + q < end:
            continue
        if x[at] != x[at + q]:  # equal hashes of different words
            continue
        begin, end, period = at - _agree(x, at - 1, q, -1), at + q + _agree(x, at, q, 1), q
        yield begin, end, q


def runs_of(x: np.ndarray, bounds: np.ndarray, short: int = SHORT) -> np.ndarray:
    """Rows (begin, end, period) of all runs in texts that lie one after another, sorted by begin, then period.

    x: word numbers, a number of its own after each text. bounds: where the texts begin, the longest first, and the end.
    """
    found = [np.empty((0, 3), np.int64)]
    sizes = np.diff(bounds) - 1
    longest = int(sizes.max(initial=0)) // LEAST_TIMES
    for q in range(1, min(short, longest) + 1):
        begin, end = short_runs(x, q)
        found.append(np.stack([begin, end, np.full(len(begin), q)], axis=1))
    if longest > short:
        ranged = RangeHash(x)
        for low, high, k, window in scales(longest, short):
            # only texts that are long enough for this scale
            n = int(bounds[int((sizes >= LEAST_TIMES * low).sum())])
            places = np.arange(max(0, n - k + 1))
            at, apart = seeds(ranged(places, places + k), window, low, high)
            some = [r for r in extended(x, at, apart) if r[1] - r[0] >= max(LEAST_WORDS, LEAST_TIMES * r[2])]
            found.append(np.array(some, np.int64).reshape(-1, 3))
    runs = np.concatenate(found)
    # a stretch found under multiples of its period too is a run of the smallest one
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    same = np.zeros(len(runs), bool)
    same[1:] = (runs[1:, 0] == runs[:-1, 0]) & (runs[1:, 1] == runs[:-1, 1])
    runs = runs[~same]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
MADE = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN, False)),
        T.StructField("collapsed_text", T.StringType()),
    ]
)


def _found(batches: Iterator[pa.RecordBatch], text: str, kept: list[str]) -> Iterator[pa.RecordBatch]:
    for piece, data, starts in slices(batches, text):
        raw, at = data.tobytes(), starts.tolist()
        # bytes.split() parts at the same six characters as WORD
        words = [raw[a:b].split() for a, b in zip(at, at[1:], strict=False)]
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-sizes, kind="stable")
        numbers: dict[bytes, int] = {}
        x = np.empty(int(sizes.sum()) + len(words), np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes[order] + 1)])
        for n, i in enumerate(order.tolist()):
            x[bounds[n] : bounds[n + 1] - 1] = [numbers.setdefault(w, len(numbers)) for w in words[i]]
            x[bounds[n + 1] - 1] = -1 - n
        runs = runs_of(x, bounds)
        of = np.searchsorted(bounds, runs[:, 0], "right") - 1
        first = np.searchsorted(of, np.arange(len(words) + 1))
        rank = np.argsort(order, kind="stable")
        lists, collapsed = [], []
        for i, n in enumerate(rank.tolist()):
            own = runs[first[n] : first[n + 1]] - [bounds[n], bounds[n], 0]
            lists.append(own)
            if len(own):
                # where a run's repeats begin and end, added up: what none covers stays
                cover = np.zeros(sizes[i] + 1, np.int64)
                np.add.at(cover, own[:, 0] + own[:, 2], 1)
                np.add.at(cover, own[:, 1], -1)
                stay = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
                collapsed.append(b" ".join([words[i][j] for j in stay.tolist()]))
            else:
                collapsed.append(b" ".join(words[i]))
        flat = np.concatenate([np.empty((0, 3), np.int64), *lists])
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in lists])]).astype(np.int32)
        # not nullable, as in MADE
        fields = [pa.field(f.name, pa.int64(), False) for f in RUN.fields]
        entries = pa.StructArray.from_arrays([pa.array(c) for c in (flat[:, 0], flat[:, 1] - flat[:, 0], flat[:, 2])], fields=fields)
        made = [
            pa.array(sizes),
            pa.ListArray.from_arrays(pa.array(offsets), entries, type=pa.list_(pa.field("element", entries.type, False))),
            pa.array(collapsed, pa.binary()).cast(pa.string()),
        ]
        yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), *made], names=[*kept, *MADE.fieldNames()])


def periodic_runs(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with n_words, runs and collapsed_text, from the column ``text``.

    runs: start (number of the first word, from 0), length and period in words of every run, by start, then period.
    collapsed_text: the words joined by single spaces, without those that lie in a run after its first ``period`` words.
    A null or blank text has no words, no runs and an empty collapsed text. Repeated rows are treated alike; an empty
    table gives no rows. Columns of ``docs`` named like those made here are replaced. Words are numbered exactly; seeds
    are found by 64-bit hashes and compared word by word.
    """
    df, text, kept, schema = with_text(docs, columns, MADE)
    return df.mapInArrow(lambda batches: _found(batches, text, kept), schema)


def longest_run(runs: Column) -> Column:
    """The run that repeats most often, as an exact fraction; ties to the smallest start, then period. Null without runs."""
    better = lambda a, b: (b["length"] * a["period"]) > (a["length"] * b["period"])
    rest = F.slice(runs, F.lit(2), F.greatest(F.size(runs) - 1, F.lit(0)))
    return F.when(F.size(runs) > 0, F.aggregate(rest, F.get(runs, F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a)))


def planted(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` in which every tenth text, by crc32 of its id, ends in repeats of a stretch of its own words.

    With g the checksum without its last digit, the n words from number g % n on repeat with a period of
    1 + (n - g % n) div (3 + g % 8) words. Texts without words and rows without an id stay as they are.
    """
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    trimmed = F.btrim(F.coalesce("text", F.lit("")), F.lit(BLANKS))
    chosen = (crc % 10 == 0) & (trimmed != "")
    df = computed_once(docs, {"__planted": F.when(chosen, F.split(trimmed, GAP)), "__g": F.floor(crc / 10)})
    n = F.size("__planted")
    df = df.withColumns({"__a": F.col("__g") % n}).withColumns({"__p": 1 + F.floor((n - F.col("__a")) / (3 + F.col("__g") % 8))})
    at = lambda i: F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p"))
    repeated = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.get("__planted", at(i).cast("int"))), " ")
    texts = F.when(F.col("__planted").isNotNull(), repeated).otherwise(F.col("text"))
    return df.select(*[texts.alias(c) if c == "text" else F.col(c) for c in docs.columns])


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the most repeated run, and digests of all runs and of the collapsed text, of planted texts."""
    found = periodic_runs(planted(docs.select("doc_id", "text")), ["doc_id"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = found.withColumn("best", longest_run(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
    )
