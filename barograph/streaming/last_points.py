"""The live charts' buffer of the newest points, on a stream.

Two forms. ``points_writer`` keeps no state: every micro-batch writes its own newest points, of all or of each source, cut
down in every task before they are shuffled, and the reader takes the newest of all batches. ``last_points_stream``
holds the buffer in Spark's state store. There every Arrow batch is first cut down to its newest n points, of all or of each
source, so that a busy source is a few rows of each. What is left is dealt out over slices, of the log or of the sources;
the newest n points are among the newest n of each slice, so neither the whole log nor one busy source is ever a single group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from barograph.operators.live import BUFFER, last_points, last_points_per_source, live_projection
from barograph.streaming.changes import EVERY, write_batch, written_rows
from barograph.streaming.devices import use_rocksdb

POINT = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("picow_local_ip", T.StringType()),
        T.StructField("time", T.StringType()),
        T.StructField("bme_280_temperature", T.DoubleType()),
        T.StructField("picow_temperature", T.DoubleType()),
        T.StructField("bme_280_pressure", T.DoubleType()),
    ]
)
_STORED = T.StructType([T.StructField("micros", T.LongType()), *POINT.fields[1:]])
_STATE = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in _STORED])
_KEY_TYPES = {"source": T.StringType(), "slice": T.IntegerType()}
#: Groups of sources in the state store. Calls of Python grow with them, not with the sources; the points of one with all sources.
SOURCE_SLICES = 512


def _newest(points: DataFrame, n: int, per_source: bool) -> DataFrame:
    return last_points_per_source(points, n) if per_source else last_points(points, n)


def points_writer(
    messages: DataFrame, path: str, checkpoint: str, n: int = BUFFER, per_source: bool = True, every: int = EVERY
) -> DataStreamWriter:
    """A batch repeated after a failure overwrites its own folder; old batches are folded into their newest points."""

    def write(rows: DataFrame, batch: int) -> None:
        needed = lambda log: _newest(log, n, per_source).drop("slot")
        write_batch(needed(rows), batch, path, needed, every)

    points = live_projection(messages).select(*POINT.fieldNames())
    return points.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def written_points(spark: SparkSession, path: str, n: int = BUFFER, per_source: bool = True) -> DataFrame:
    return _newest(written_rows(spark, path, POINT).drop("batch"), n, per_source)


def buffer_keys(per_source: bool) -> list[str]:
    return ["source", "slice"] if per_source else ["slice"]


def buffer_schema(per_source: bool) -> T.StructType:
    return T.StructType([T.StructField(k, _KEY_TYPES[k]) for k in buffer_keys(per_source)] + _STATE.fields)


def _at_end(n: int, *order: np.ndarray) -> np.ndarray:
    """The rows that are among the last ``n`` of their group by ``order``, sorted; the group is the first of these."""
    rows = np.lexsort(order[::-1])
    group = order[0][rows]
    return rows[np.searchsorted(group, group, "right") - np.arange(len(rows)) <= n]


def _cut(n: int, per_source: bool):
    """Cuts each Arrow batch of points down to its newest ``n``, of each source or of all."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = batch.column("source").dictionary_encode(null_encoding="encode").indices.to_numpy()
            order = [pc.fill_null(batch.column(c).cast(pa.int64()), -1).to_numpy(zero_copy_only=False) for c in _STORED.fieldNames()[:3]]
            yield batch.take(pa.array(_at_end(n, source if per_source else np.zeros_like(source), *order)))

    return cut


class Newest(StatefulProcessor):
    """The newest ``n`` points of a slice, of each source in it or of all, as a list in the state store."""

    def __init__(self, per_source: bool, n: int):
        self.per_source, self.n, self.names = per_source, n, _STORED.fieldNames()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.points = handle.getListState("points", _STORED)

    def _newest(self, points: pd.DataFrame) -> pd.DataFrame:
        source = pd.factorize(points["picow_local_ip"], use_na_sentinel=False)[0] if self.per_source else np.zeros(len(points), np.int64)
        return points.iloc[_at_end(self.n, source, *(points[c].to_numpy("int64") for c in self.names[:3]))]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        stored = [tuple(p) for p in self.points.get()]
        kept, heard = pd.DataFrame(stored, columns=self.names) if stored else None, set()
        for frame in rows:
            heard.update(frame["source"].unique())
            frame = frame[self.names]
            kept = self._newest(frame if kept is None else pd.concat([kept, frame], ignore_index=True))
        # a missing number or text may arrive as NaN, the only value that differs from itself
        points = [tuple(None if v != v else v for v in row) for row in zip(*[kept[c].tolist() for c in self.names])]
        self.points.put(points)
        heard = {None if s != s else s for s in heard}
        at = self.names.index("picow_local_ip")
        groups = [(s, list(g)) for s, g in groupby(points, key=lambda p: p[at]) if s in heard] if self.per_source else [(None, points)]
        columns = {c: [[p[i] for p in g] for _, g in groups] for i, c in enumerate(self.names)}
        first = {"source": pd.Series([s for s, _ in groups], dtype=object)} if self.per_source else {}
        yield pd.DataFrame(first | {"slice": [key[0]] * len(groups)} | columns)

    def close(self) -> None:
        pass


def last_points_stream(messages: DataFrame, n: int = BUFFER, slices: int | None = None, per_source: bool = False) -> DataFrame:
    """The buffer of each slice, or of each source in it, whenever it changes; ``buffered_points`` puts the slices together.

    Unless told otherwise there are ``SOURCE_SLICES`` slices of sources, or as many of the log as shuffle partitions. All
    messages pass through Python here, as Arrow batches, once to be cut down, and what is left of them once more;
    ``points_writer`` cuts each batch down without Python and is the one for a busy log. State is kept in RocksDB.
    """
    spark = messages.sparkSession
    points = live_projection(messages).select(
        F.col("picow_local_ip").alias("source"), F.unix_micros("timestamp").alias("micros"), *_STORED.fieldNames()[1:]
    )
    points = points.mapInArrow(_cut(n, per_source), points.schema)
    slices = slices or (SOURCE_SLICES if per_source else int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = F.xxhash64("source") if per_source else F.xxhash64("partition", "offset")
    points = points.withColumn("slice", F.pmod(dealt, F.lit(slices)).cast("int"))
    use_rocksdb(spark)
    return points.groupBy("slice").transformWithStateInPandas(
        statefulProcessor=Newest(per_source, n), outputStructType=buffer_schema(per_source), outputMode="update", timeMode="none"
    )


def buffered_points(current: DataFrame, n: int = BUFFER, per_source: bool = False) -> DataFrame:
    """The buffer of all sources together, or of each source, from the newest rows of ``last_points_stream``."""
    points = current.select(F.inline(F.arrays_zip(*_STATE.fieldNames())))
    points = points.select(F.timestamp_micros("micros").alias("timestamp"), *_STORED.fieldNames()[1:])
    return _newest(points, n, per_source)
