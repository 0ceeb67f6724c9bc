from __future__ import annotations

import os
import sys
import tempfile
from datetime import datetime, timezone

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barograph.schema import MESSAGES  # noqa: E402
from barograph.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, shuffle_partitions=4, memory="4g")


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="barograph-test-")


def at(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


@pytest.fixture
def log(spark):
    """Messages from texts: offsets count from 3, one per second from 2024-03-01 10:00:00, all in partition 0."""

    def make(*values: str | None, first: int = 3, start: str = "2024-03-01 10:00:00", step: float = 1.0):
        begin = at(start).timestamp()
        rows = [
            (None, None if v is None else v.encode(), "t", 0, first + i, datetime.fromtimestamp(begin + i * step, timezone.utc), 0)
            for i, v in enumerate(values)
        ]
        return spark.createDataFrame(rows, MESSAGES)

    return make


def document(i=1, temperature='"19.25C"', humidity='"47.5%"', pressure='"1011.5hPa"', ip='"10.0.0.1"', board="24.5") -> str:
    return (
        f'{{"id": {i}, "bme280": {{"pressure": {pressure}, "temperature": {temperature}, "humidity": {humidity}, '
        f'"read_datetime": "2024-3-1 9:5:7"}}, "picow": {{"local_ip": {ip}, "temperature": {board}, "free_storage_kb": 409.5, '
        f'"mem_alloc_bytes": 60000, "mem_free_bytes": 90000, "cpu_freq_mhz": 125}}}}'
    )


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()
