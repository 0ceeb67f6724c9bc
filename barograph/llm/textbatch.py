"""Texts of Arrow batches as bytes with offsets, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The white space that parts words, as a pattern for split() and its complement as a pattern for a word.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: The same six characters, for trimming.
BLANKS = " \t\n\x0b\f\r"

SLICE_BYTES = 2 << 20
#: For work that holds many numbers for each byte: arrays of a slice stay below some 50 MB.
SMALL_SLICE = 1 << 19


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and where each text begins and ends in them; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch in pieces whose texts together have about ``limit`` bytes; a longer text is a piece of its own."""
    for batch in batches:
        data, starts = text_bytes(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first), data[starts[first] : starts[last]], starts[first : last + 1] - starts[first]
            first = last


def with_text(docs: DataFrame, columns: list[str], made: T.StructType) -> tuple[DataFrame, str, list[str], T.StructType]:
    """What a task over texts gets and gives: ``columns`` of ``docs`` and the text; the name under which it finds the
    text; the columns kept; and these with those that it makes, which replace any of the same names."""
    kept = [c for c in columns if c not in made.fieldNames()]
    name = "text" if "text" in kept else "__text"
    df = docs.select(*kept, *([] if name == "text" else [docs["text"].alias(name)]))
    return df, name, kept, T.StructType([*(df.schema[c] for c in kept), *made.fields])


_BLANK = np.isin(np.arange(256), list(BLANKS.encode()))
#: Multiplier of range hashes: any odd number has an inverse modulo 2^64.
_ODD = 0x9E3779B97F4A7C15


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in texts that follow each other; a word never goes over the end of its text."""
    blank = _BLANK[data]
    opens = ~blank
    opens[1:] &= blank[:-1]
    own = starts[:-1][starts[:-1] < len(data)]
    opens[own] |= ~blank[own]
    begin = np.flatnonzero(opens)
    stops = np.append(np.flatnonzero(blank), len(data))
    end = stops[np.searchsorted(stops, begin)]
    return begin, np.minimum(end, starts[np.minimum(np.searchsorted(starts, begin, "right"), len(starts) - 1)])


class RangeHash:
    """64-bit hashes of byte ranges, from running sums of byte * odd^place; equal ranges have equal hashes."""

    def __init__(self, data: np.ndarray):
        powers = np.cumprod(np.full(len(data) + 1, _ODD, np.uint64), dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)])
        self.shifts = np.cumprod(np.full(len(data) + 1, pow(_ODD, -1, 1 << 64), np.uint64), dtype=np.uint64)

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.shifts[begin])
