"""Logs made up as files in the order of arrival: a stretch in as many files as it has rows for, a batch for each stretch."""

from __future__ import annotations

import os

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from barograph.plans.catalogue import QUERIES
from barograph.sources import events


@pytest.fixture
def small_files(monkeypatch):
    monkeypatch.setattr(events, "FILE_ROWS", 40)


def parquet_in(path):
    return sorted((e for e in os.scandir(path) if e.name.endswith(".parquet")), key=lambda e: (e.stat().st_mtime_ns, e.name))


@pytest.mark.parametrize("make", ["arrived_log", "repeated_log"])
def test_a_stretch_comes_in_several_files(spark, folder, small_files, make):
    path, files = getattr(events, make)(spark, SMALL, f"{folder}/log")
    found = parquet_in(path)
    assert files == 7 and len(found) == files * (events.ARRIVALS + (make == "arrived_log"))
    for i in range(events.ARRIVALS):
        rows = [spark.read.parquet(e.path).agg(F.min("offset"), F.max("offset"), F.count("*")).first() for e in found[i * files : (i + 1) * files]]
        assert max(r[2] for r in rows) < 100 and max(r[1] for r in rows) < (i + 1) * 250
        assert make == "repeated_log" or min(r[0] for r in rows) >= i * 250


def test_a_stretch_with_fewer_rows_than_files_has_empty_ones(spark, folder):
    events._arrive(spark.range(2), f"{folder}/in", 5, "id")
    events._arrive(spark.range(0), f"{folder}/in", 5, "id")
    assert len(parquet_in(f"{folder}/in")) == 10 and spark.read.parquet(f"{folder}/in").count() == 2


@pytest.mark.parametrize("name", ["stream_progress", "stream_calibrated", "nmea_receiver_stream"])
def test_results_do_not_depend_on_the_number_of_files(spark, name, monkeypatch):
    rows = []
    for n in (50_000, 40):
        monkeypatch.setattr(events, "FILE_ROWS", n)
        rows.append(sorted(map(repr, QUERIES[name](spark, SMALL).collect())))
    assert rows[0] == rows[1]
