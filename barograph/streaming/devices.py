"""Devices that come and go, told by timers: a device is offline once it has been silent for too long.

Each device has its last time in the state store (RocksDB). Devices are dealt out over slices, each with an event-time
timer at the end of the first silence that one of its devices is allowed. The timer fires when the watermark passes it, so
that going offline is an event of its own, not something that is only noticed when somebody asks or when the device comes back.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATUS = "source_ip string, status string, at_micros long"
SEEN = "source_ip string, micros long, online boolean"
#: Groups of devices in the state store. Calls of Python grow with them, not with the devices; the rows of one with all devices.
SLICES = 512
_NEVER = np.iinfo("int64").min


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers and lists needs this store; it must be set before such a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Silence(StatefulProcessor):
    """ONLINE at the first message and at the first one after a silence; OFFLINE when ``threshold`` microseconds have passed.

    A group is a slice of the devices, worked through as columns: state is fetched and stored once a slice and batch. Each
    frame of messages is cut down to stretches without a silence before the next one is read.
    """

    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", SEEN)

    def _timers(self, last: pd.Series) -> pd.Series:
        """The millisecond after the last one at which a message would still be in time."""
        return (last + self.threshold) // 1000 + 1

    def _known(self) -> pd.DataFrame:
        rows = [tuple(row) for row in self.seen.get()]
        known = pd.DataFrame(rows, columns=["source_ip", "micros", "online"])
        return known.astype({"source_ip": object, "micros": "int64", "online": bool})

    def _keep(self, known: pd.DataFrame, due: int | None) -> None:
        """Stores the slice. It has one timer, at the first end of a silence, which was at ``due`` before."""
        self.seen.put(list(known.itertuples(index=False, name=None)))
        first = self._due(known)
        if first != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if first is not None:
                self.handle.registerTimer(first)

    def _due(self, known: pd.DataFrame) -> int | None:
        timers = self._timers(known["micros"][known["online"]])
        return int(timers.min()) if len(timers) else None

    def _stretches(self, frame: pd.DataFrame) -> pd.DataFrame:
        """Stretches (begin, micros) of rows (device, begin, micros) that no silence parts, by device and time."""
        frame = frame.sort_values(["device", "begin"], ignore_index=True)
        first = frame["device"] != frame["device"].shift()
        reached = frame.groupby("device")["micros"].cummax()
        new = first | (frame["begin"] - reached.shift().where(~first, frame["begin"]).astype("int64") > self.threshold)
        return frame.groupby(new.cumsum(), sort=False).agg(device=("device", "first"), begin=("begin", "first"), micros=("micros", "max"))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self._known()
        due = self._due(known)
        numbers = {s: i for i, s in enumerate(known["source_ip"])}
        last = known["micros"].tolist()
        heard = pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("device", "begin", "micros")})
        for frame in rows:
            codes, names = pd.factorize(frame["source_ip"], use_na_sentinel=False)
            names = [None if n != n else n for n in names]
            for n in names:
                if n not in numbers:
                    numbers[n] = len(numbers)
                    last.append(None)
            device = np.array([numbers[n] for n in names], "int64")[codes]
            before = np.array([_NEVER if last[numbers[n]] is None else last[numbers[n]] for n in names], "int64")[codes]
            micros = frame["micros"].to_numpy("int64")
            # what is no newer than the newest known of its device changes nothing
            newer = micros > before
            fresh = pd.DataFrame({"device": device[newer], "begin": micros[newer], "micros": micros[newer]})
            heard = self._stretches(pd.concat([heard, fresh], ignore_index=True))
        sources, gone, back = list(numbers), [], []
        online = known["online"].tolist() + [False] * (len(sources) - len(known))
        for device, begin, end in heard.itertuples(index=False, name=None):
            if online[device] and begin - last[device] > self.threshold:
                # came back before the watermark had reached the timer
                gone.append((sources[device], "OFFLINE", last[device] + self.threshold))
                online[device] = False
            if not online[device]:
                back.append((sources[device], "ONLINE", begin))
            last[device], online[device] = end, True
        heard_of = [i for i, t in enumerate(last) if t is not None]
        known = pd.DataFrame({"source_ip": pd.Series([sources[i] for i in heard_of], dtype=object), "micros": pd.Series([last[i] for i in heard_of], dtype="int64"), "online": pd.Series([online[i] for i in heard_of], dtype=bool)})
        self._keep(known, due)
        yield self._rows(gone + back)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """All devices of the slice whose silence has ended by the watermark; the timer goes on to the next one."""
        known = self._known()
        due = self._due(known)
        timers = self._timers(known["micros"])
        gone = known["online"] & ((timers <= expiredTimerInfo.getExpiryTimeInMs()) | (timers < timerValues.getCurrentWatermarkInMs()))
        events = [(s, "OFFLINE", t + self.threshold) for s, t in zip(known["source_ip"][gone], known["micros"][gone].tolist())]
        if events:
            self._keep(known.assign(online=known["online"] & ~gone), due)
        yield self._rows(events)

    @staticmethod
    def _rows(events: list[tuple[str, str, int]]) -> pd.DataFrame:
        sources, status, at = zip(*events) if events else ([], [], [])
        return pd.DataFrame({"source_ip": pd.Series(sources, dtype=object), "status": pd.Series(status, dtype=object), "at_micros": pd.Series(at, dtype="int64")})

    def close(self) -> None:
        pass


def status_changes(readings: DataFrame, threshold_seconds: int, lateness: str = "0 seconds", slices: int = SLICES) -> DataFrame:
    """source_ip, status and time of every change, as it happens. readings: picow_local_ip and read_datetime, a stream.

    Within a batch a device's messages may come in any order. One that is older than the newest known of its device and
    comes in a later batch changes nothing, unless ``lateness`` holds the watermark back for it.
    """
    use_rocksdb(readings.sparkSession)
    rows = readings.withWatermark("read_datetime", lateness)
    source = F.col("picow_local_ip")
    slice_of = F.pmod(F.xxhash64(source), F.lit(slices)).cast("int").alias("slice")
    rows = rows.select(slice_of, source.alias("source_ip"), "read_datetime", F.unix_micros("read_datetime").alias("micros"))
    found = rows.groupBy("slice").transformWithStateInPandas(
        statefulProcessor=Silence(threshold_seconds * 1_000_000), outputStructType=STATUS, outputMode="append", timeMode="eventTime"
    )
    return found.select("source_ip", "status", F.timestamp_micros("at_micros").alias("at"))
