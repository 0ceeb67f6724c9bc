from __future__ import annotations

import os

from conftest import SMALL, document
from pyspark.sql import functions as F

from barograph.functions.values import naive
from barograph.operators import live, readings, rollup
from barograph.schema import HOUR_KEY, HOURLY_COLUMNS, MESSAGES
from barograph.sources import events
from barograph.sources.messages import read_log, stream_log
from barograph.streaming import changes, hourly, landing, last_points, late
from barograph.streaming import live as live_streams


def arrive(folder, *batches):
    """Each batch is one file, in this order of arrival."""
    for df in batches:
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")


def rows_of(df):
    return sorted(df.collect(), key=repr)


def run_hourly(spark, folder, **kw):
    df = hourly.hourly_stream(stream_log(spark, f"{folder}/in", 1), **kw)
    changes.run_available(changes.change_writer(df, f"{folder}/changes", f"{folder}/cp", HOUR_KEY))
    return changes.current_rows(spark, f"{folder}/changes", df.schema, HOUR_KEY).select(*HOURLY_COLUMNS)


def batch_hourly(messages):
    return rollup.hourly_rollup(readings.parse_readings(messages, rollup.HOURLY_INPUT))


def test_hourly_stream_over_several_batches_equals_the_batch_job(spark, folder, log):
    a = log(*[document(i, temperature=f'"{i}.25C"') for i in range(5)])
    b = log(*[document(i) for i in range(5)], first=8, start="2024-03-01 10:30:00")
    arrive(folder, a)
    assert rows_of(run_hourly(spark, folder)) == rows_of(batch_hourly(a))
    arrive(folder, b)
    assert rows_of(run_hourly(spark, folder)) == rows_of(batch_hourly(a.unionByName(b)))
    assert run_hourly(spark, folder).count() == 1  # nothing new: nothing changes


def test_messages_too_late_for_the_stream_are_found_and_repaired(spark, folder, log):
    early, late = log(document(1), start="2024-03-01 01:00:00"), log(document(2), first=4, start="2024-03-01 01:30:00")
    now = log(document(3), first=5, start="2024-03-02 10:00:00")
    for part in (early, now, now.limit(0), late):
        arrive(folder, part)
        streamed = run_hourly(spark, folder)
    recomputed = batch_hourly(read_log(spark, f"{folder}/in"))
    repair = hourly.hours_to_repair(streamed, recomputed).collect()
    assert [(r.hour, r.status, r.stored_count, r.fresh_count) for r in repair] == [(1, "changed", 1, 2)]


def test_only_hours_with_late_messages_are_computed_anew(spark, folder, log):
    """Messages for an old hour in two late batches, one of them a reject's alone: each repair does what is due."""
    first = log(document(1), document(2), start="2024-03-01 01:00:00")
    now = log(document(3), first=5, start="2024-03-02 10:00:00")
    for part in (first, now, now.limit(0)):
        arrive(folder, part)

    def land():
        changes.run_available(late.log_writer(stream_log(spark, f"{folder}/in", 1), folder, f"{folder}/landing"))
        return run_hourly(spark, folder)

    land()
    assert late.repair(spark, folder) == 0
    arrive(folder, log(document(4), first=6, start="2024-03-01 01:30:00"), log("bad", first=7, start="2024-03-01 05:00:00"))
    streamed = land()
    want = batch_hourly(read_log(spark, f"{folder}/in"))
    assert rows_of(streamed) != rows_of(want)
    assert late.repair(spark, folder) == 2 and late.repair(spark, folder) == 0
    table = late.repaired_table(spark, folder, streamed)
    assert rows_of(table.drop("status")) == rows_of(want)
    assert {(r["day"], r["hour"]): r["status"] for r in table.collect()} == {(1, 1): "repaired", (2, 10): "streamed"}
    arrive(folder, log(document(5), first=8, start="2024-03-01 01:40:00"))
    streamed = land()
    assert late.repair(spark, folder) == 1
    assert late.repaired_table(spark, folder, streamed).where("status = 'repaired'").first()["count"] == 4


def test_landing_keeps_all_messages_once(spark, folder, log):
    arrive(folder, log(document(1), None, "x"))
    for _ in range(2):
        changes.run_available(landing.landing_writer(stream_log(spark, f"{folder}/in"), f"{folder}/log", f"{folder}/cp"))
    landed = read_log(spark, f"{folder}/log")
    assert landed.schema.simpleString() == MESSAGES.simpleString()
    assert rows_of(landed) == rows_of(read_log(spark, f"{folder}/in"))
    assert spark.read.parquet(f"{folder}/log").where(F.col("day") == "2024-03-01").count() == 3


def test_repeated_messages_are_taken_once(spark, folder, log):
    arrive(folder, log(document(1), document(2)), log(document(1), document(2), document(3)))
    stream = stream_log(spark, f"{folder}/in")
    changes.run_available(landing.landing_writer(stream, f"{folder}/log", f"{folder}/cp"))
    assert sorted(r.offset for r in landing.without_repeats(read_log(spark, f"{folder}/log")).collect()) == [3, 4, 5]


def test_late_messages_land(spark, folder, log):
    """Three batches, the last a day behind the one before it, from another partition."""
    parts = [log(document(1), start="2024-03-01 01:00:00"), log(document(2), first=9, start="2024-03-02 10:00:00"), log(document(3), start="2024-03-01 01:30:00").withColumn("partition", F.lit(1))]
    for part in parts:
        arrive(folder, part)
        changes.run_available(landing.landing_writer(stream_log(spark, f"{folder}/in"), f"{folder}/log", f"{folder}/cp"))
    assert landing.without_repeats(read_log(spark, f"{folder}/log")).count() == 3


def test_live_rows_and_lines(spark, folder, log):
    arrive(folder, log(document(1), "no json", document(2, temperature="null")))
    stream = stream_log(spark, f"{folder}/in")
    changes.run_available(live_streams.live_writer(stream, f"{folder}/rows", f"{folder}/cp1"))
    changes.run_available(live_streams.line_writer(stream, f"{folder}/lines", f"{folder}/cp2"))
    want = live.live_projection(read_log(spark, f"{folder}/in"))
    assert rows_of(spark.read.parquet(f"{folder}/rows").select(*want.columns)) == rows_of(want)
    assert rows_of(spark.read.parquet(f"{folder}/lines").select("line")) == rows_of(live.event_lines(want).select("line"))


def test_buffers_over_several_batches(spark, folder, log):
    first = log(*[document(i, ip=f'"{i % 3}"' if i % 3 else "null", board="null") for i in range(70)])
    second = log(*[document(i, ip='"1"', humidity="null") for i in range(20)], first=100, start="2024-03-01 11:00:00")
    names = last_points.POINT.fieldNames() + ["slot"]
    for part in (first, second):
        arrive(folder, part)
        stream = stream_log(spark, f"{folder}/in")
        changes.run_available(last_points.points_writer(stream, f"{folder}/points", f"{folder}/cp0"))
        for per_source in (False, True):
            df = last_points.last_points_stream(stream, per_source=per_source, slices=4)
            changes.run_available(changes.change_writer(df, f"{folder}/changes{per_source}", f"{folder}/cp{per_source}", last_points.buffer_keys(per_source)))
    points = live.live_projection(read_log(spark, f"{folder}/in"))
    for per_source in (False, True):
        keys, schema = last_points.buffer_keys(per_source), last_points.buffer_schema(per_source)
        got = last_points.buffered_points(changes.current_rows(spark, f"{folder}/changes{per_source}", schema, keys), per_source=per_source)
        want = live.last_points_per_source(points) if per_source else live.last_points(points)
        assert rows_of(got.select(*names)) == rows_of(want.select(*names))
    assert rows_of(last_points.written_points(spark, f"{folder}/points").select(*names)) == rows_of(live.last_points_per_source(points).select(*names))


def test_old_batches_are_folded_into_a_base(spark, folder, log):
    """Seven batches with a base after every second: the tables are as without, and old folders go."""
    for i in range(7):
        arrive(folder, log(*[document(j, ip=f'"{j % 2}"') for j in range(4)], first=3 + 4 * i, start=f"2024-03-01 {10 + i // 4}:0{i % 4}:00"))
    stream = stream_log(spark, f"{folder}/in", 1)
    hours = hourly.hourly_stream(stream)
    changes.run_available(changes.change_writer(hours, f"{folder}/changes", f"{folder}/cp", HOUR_KEY, every=2))
    log_rows = read_log(spark, f"{folder}/in")
    current = changes.current_rows(spark, f"{folder}/changes", hours.schema, HOUR_KEY).select(*HOURLY_COLUMNS)
    assert rows_of(current) == rows_of(batch_hourly(log_rows))
    points = live.live_projection(log_rows)
    names = last_points.POINT.fieldNames() + ["slot"]
    for per_source, want in ((True, live.last_points_per_source(points, 5)), (False, live.last_points(points, 5))):
        at = f"{folder}/points{per_source}"
        changes.run_available(last_points.points_writer(stream, at, f"{at}-cp", 5, per_source, every=2))
        assert rows_of(last_points.written_points(spark, at, 5, per_source).select(*names)) == rows_of(want.select(*names))
    for at in (f"{folder}/changes", f"{folder}/pointsTrue", f"{folder}/pointsFalse"):
        assert len([p for p in os.listdir(at) if p.startswith("batch=")]) < 5
        assert len([p for p in os.listdir(at) if p.startswith("base=")]) == 2


def test_a_batch_repeated_after_its_base_changes_nothing(spark, folder):
    def write(batch, *rows):
        df = spark.createDataFrame(rows, "k string, v long")
        changes.write_batch(df, batch, folder, lambda log: changes.newest_rows(log, ["k"]), every=2)
        return df.schema

    write(0, ("a", 1), ("b", 1))
    write(1, ("a", 2))
    schema = write(1, ("a", 2))
    assert rows_of(changes.current_rows(spark, folder, schema, ["k"])) == [("a", 2), ("b", 1)]
    write(2, ("b", 3))
    write(3, ("c", 4))
    write(3, ("c", 4))
    assert rows_of(changes.current_rows(spark, folder, schema, ["k"])) == [("a", 2), ("b", 3), ("c", 4)]
    assert changes.current_rows(spark, f"{folder}/nothing", schema, ["k"]).count() == 0


def test_stream_of_the_events_table_has_the_envelope(spark):
    stream = events.message_stream(spark, SMALL)
    assert stream.isStreaming and [f.dataType for f in stream.schema] == [f.dataType for f in MESSAGES]
    assert naive(F.col("timestamp")) is not None


def test_buffer_of_a_busy_source_and_many_quiet_ones(spark, folder, log):
    """Sources share slices, a busy one's messages are cut down before they meet."""
    first = log(*[document(i, ip='"busy"' if i % 2 else f'"{i % 60}"' if i % 58 else "null") for i in range(400)])
    second = log(*[document(i, ip='"busy"') for i in range(50)], first=500, start="2024-03-01 09:00:00")
    names = last_points.POINT.fieldNames() + ["slot"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        for part in (first, second):
            arrive(folder, part)
            df = last_points.last_points_stream(stream_log(spark, f"{folder}/in"), per_source=True, slices=3)
            changes.run_available(changes.change_writer(df, f"{folder}/changes", f"{folder}/cp", last_points.buffer_keys(True)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = changes.written_rows(spark, f"{folder}/changes", last_points.buffer_schema(True))
    assert {r["slice"] for r in rows.select("slice").collect()} == {0, 1, 2}
    # a source has one row for each batch that brings something of it, whatever the number of slices
    assert rows.groupBy("batch", "source").count().where("count > 1").count() == 0
    got = last_points.buffered_points(changes.current_rows(spark, f"{folder}/changes", last_points.buffer_schema(True), last_points.buffer_keys(True)), per_source=True)
    assert rows_of(got.select(*names)) == rows_of(live.last_points_per_source(live.live_projection(read_log(spark, f"{folder}/in"))).select(*names))
