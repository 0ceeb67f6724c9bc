"""Runs that add to what earlier ones have written: versions, offsets and the incremental job."""

from __future__ import annotations

import json

import pytest
from conftest import SMALL, document
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barograph.operators import offsets, readings, rollup
from barograph.plans import hourly_job
from barograph.sinks import versions
from barograph.sources import events

DAYS = T.StructType([T.StructField("v", T.LongType()), T.StructField("day", T.StringType())])


def rows_of(df):
    return sorted(df.collect(), key=repr)


def put(spark, folder, rows, run, replaced=()):
    old = versions.current(spark, folder)
    new = old.with_folders(versions.stage(spark.createDataFrame(rows, DAYS), folder, "t", "day", run), replaced)
    versions.switch(spark, folder, new)
    return new


def test_versions_add_and_replace_parts(spark, folder):
    assert versions.current(spark, folder) == versions.Version()
    first = put(spark, folder, [(1, "a"), (2, "b")], "r1")
    put(spark, folder, [(3, "b"), (4, "c")], "r2")
    now = versions.current(spark, folder)
    assert now.number == 2 and now.parts("t") == {"a", "b", "c"}
    assert rows_of(versions.read(spark, folder, now, "t", DAYS)) == [(1, "a"), (2, "b"), (3, "b"), (4, "c")]
    put(spark, folder, [(5, "b")], "r3", replaced=["t"])
    now = versions.current(spark, folder)
    assert rows_of(versions.read(spark, folder, now, "t", DAYS, ["b"])) == [(5, "b")]
    # a reader of the first version still has it
    assert rows_of(versions.read(spark, folder, first, "t", DAYS)) == [(1, "a"), (2, "b")]
    assert versions.read(spark, folder, now, "other", DAYS).collect() == []


def test_manifests_are_kept_in_a_ring(spark, folder):
    for i in range(versions.KEPT + 2):
        versions.switch(spark, folder, versions.Version(i + 1, (versions.Folder("t", str(i), "f"),)))
    assert versions.current(spark, folder) == versions.Version(versions.KEPT + 2, (versions.Folder("t", str(versions.KEPT + 1), "f"),))
    assert spark.read.parquet(f"{folder}/manifest").count() == versions.KEPT


def test_an_empty_version_is_a_version(spark, folder):
    versions.switch(spark, folder, versions.Version(7))
    assert versions.current(spark, folder) == versions.Version(7)


@pytest.fixture
def marts(spark):
    log = events.messages(spark, SMALL)
    return log, rollup.hourly_rollup(readings.parse_readings(log, rollup.HOURLY_INPUT))


def test_partial_runs_keep_older_hours(spark, folder, marts):
    """A later part alone, then an earlier one, then all: the tables are those of one run over everything."""
    log, want = marts
    parts = [log.where("offset >= 600"), log.where("offset between 100 and 699"), log]
    counts = [hourly_job.run_incremental(spark, p, folder).readings for p in parts]
    done = hourly_job.load_versioned(spark, folder)
    assert rows_of(done.hourly) == rows_of(want) and sum(counts) == 974
    assert rows_of(done.by_source) == rows_of(rollup.messages_by_source(readings.parse_readings(log, rollup.SOURCE_INPUT)))
    taken = {(r["first_offset"], r["last_offset"]): r["messages"] for r in hourly_job.ledger(spark, folder).collect()}
    assert taken == {(600, 999): 400, (100, 599): 500, (0, 99): 100}
    before = versions.current(spark, folder).number
    assert hourly_job.run_incremental(spark, log, folder).readings == 0
    assert versions.current(spark, folder).number == before  # nothing new: no new version


def test_only_the_days_concerned_are_computed_anew(spark, folder, marts):
    log, _ = marts
    hourly_job.run_incremental(spark, log.where("offset < 900"), folder)
    old = versions.current(spark, folder)
    hourly_job.run_incremental(spark, log, folder)
    new = versions.current(spark, folder)
    table = hourly_job.HOURLY_TABLE
    days = {str(r[0]) for r in log.where("offset >= 900").select(F.to_date("timestamp")).distinct().collect()}
    kept = set(old.of(table)) & set(new.of(table))
    assert 0 < len(kept) and {f.part for f in new.folders if f.table == table and f.folder not in kept} <= days


def test_a_run_that_dies_leaves_the_tables_as_they_were(spark, folder, marts, monkeypatch):
    log, want = marts
    hourly_job.run_incremental(spark, log.where("offset < 500"), folder)
    before = rows_of(hourly_job.load_versioned(spark, folder).hourly)

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(versions, "switch", dies)
        with pytest.raises(RuntimeError):
            hourly_job.run_incremental(spark, log, folder)
    assert rows_of(hourly_job.load_versioned(spark, folder).hourly) == before
    assert hourly_job.ledger(spark, folder).count() == 1
    hourly_job.run_incremental(spark, log, folder)
    assert rows_of(hourly_job.load_versioned(spark, folder).hourly) == rows_of(want)


def test_a_run_with_no_messages_or_no_readings(spark, folder, log):
    assert hourly_job.run_incremental(spark, log(document(1)).limit(0), folder).readings == 0
    assert versions.current(spark, folder) == versions.Version()
    marts = hourly_job.run_incremental(spark, log(None, "x", "{}"), folder)
    assert marts.readings == 0 and marts.hourly.collect() == [] and marts.by_source.collect() == []
    assert hourly_job.ledger(spark, folder).first()["messages"] == 3
    assert hourly_job.run_incremental(spark, log(None, "x", "{}", document(4)), folder).readings == 1


def test_unread_by_several_partitions_and_ranges(spark):
    ledger = spark.createDataFrame([("t", 0, 3, 5, 3), ("t", 0, 6, 8, 3), ("t", 0, 20, 22, 3), ("t", 1, 0, 0, 1)], offsets.EXTENT)
    assert offsets.intervals(ledger).where("partition = 0").first()["ranges"] == [(3, 8), (20, 22)]
    messages = spark.createDataFrame([("t", p, o) for p in (0, 1, 2) for o in range(25)], "topic string, partition int, offset long")
    left = {(r["partition"], r["offset"]) for r in offsets.unread(messages, ledger).collect()}
    seen = {(0, o) for o in (*range(3, 9), 20, 21, 22)} | {(1, 0)}
    assert left == {(p, o) for p in (0, 1, 2) for o in range(25)} - seen
    assert json.loads(offsets.starting_offsets(ledger)) == {"t": {"0": 23, "1": 1}}
    assert offsets.starting_offsets(ledger.limit(0)) is None


def test_missing_stretches(spark):
    there = [(None if p == 2 else "t", p, o) for p in (0, 1, 2) for o in (5, 6, 6, 9, 10, 200_000)]
    got = offsets.missing(spark.createDataFrame(there, "topic string, partition int, offset long")).collect()
    assert sorted(tuple(r)[1:] for r in got) == [(p, *gap) for p in (0, 1, 2) for gap in ((7, 8, 2), (11, 199_999, 199_989))]


def test_options_that_would_replace_whole_tables_are_refused(capsys):
    for given in (["--starting", "x"], ["--incremental", "--keep-rejects"]):
        with pytest.raises(SystemExit):
            hourly_job.main(["--log", "a", "--out", "b", *given])
    assert "--incremental" in capsys.readouterr().err
