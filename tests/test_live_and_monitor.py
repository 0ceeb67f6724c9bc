from __future__ import annotations

import json

from conftest import document, plan
from pyspark.sql import functions as F
from test_readings import BAD, V1, V3

from barograph.functions.values import naive
from barograph.operators import live, monitor, readings


def test_projection(log):
    rows = live.live_projection(log(document(1), V1, V3, BAD, '{"id": 1}', None)).orderBy("offset").collect()
    assert [r.offset for r in rows] == [3, 4, 5]
    a, b, c = rows
    assert (a.time, a.bme_280_temperature, a.picow_mem_alloc_bytes) == ("2024-3-1 9:5:7", 19.25, 60000 / 1024)
    assert b.picow_mem_free_bytes is None and b.picow_temperature == 26.5
    assert c.bme_280_pressure == 1003.125 and c.picow_free_cpu_freq_mhz == 0.0


def test_lines(log):
    line = live.event_lines(live.live_projection(log(V1))).first().line
    assert line.startswith("data:{") and line.endswith("}\n\n")
    assert list(json.loads(line[5:])) == live.LIVE_COLUMNS


def test_buffer_slots(log):
    points = live.live_projection(log(*[document(i, ip=f'"10.0.0.{i % 2}"') for i in range(40)]))
    every = live.last_points(points).orderBy("slot").collect()
    assert [r.slot for r in every] == list(range(30)) and [r.offset for r in every] == list(range(13, 43))
    each = live.last_points_per_source(points).where("picow_local_ip = '10.0.0.1'").orderBy("slot").collect()
    assert [r.slot for r in each] == list(range(10, 30)) and each[-1].offset == 42


def test_each_task_limits_its_groups_before_the_shuffle(log):
    text = plan(live.last_points_per_source(live.live_projection(log(document(1)))))
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")
    assert "WindowGroupLimit" in text
    assert "TakeOrderedAndProject" in plan(live.last_points(live.live_projection(log(document(1)))))


def test_latest(log):
    points = live.live_projection(log(document(1), document(2, ip='"b"', board="30"), document(3, temperature='"9.00C"'), document(4, ip="null")))
    got = {r.picow_local_ip: r for r in live.latest_reading(points).collect()}
    assert len(got) == 3 and got["10.0.0.1"].bme_280_temperature == 9.0
    assert live.latest_source(points).first().source_ip == "10.0.0.1"
    assert live.latest_source(points.where("false")).first().source_ip == "Unknown"
    split = {r.picow_local_ip: r for r in live.memory_split(points).collect()}["b"]
    assert split.allocated_share == 60000 / (60000 + 90000)


def test_gauge(log):
    r = live.humidity_gauge(live.live_projection(log(document(1, humidity='"75.00%"')))).first()
    assert (r.band, r.needle) == ("over", 1.5)


def test_freshness(log):
    rows = readings.parse_readings(log(*[document(i, ip='"a"' if i < 2 else '"b"') for i in range(4)], step=200.0))
    got = {r.source_ip: (r.silent_seconds, r.status) for r in monitor.source_freshness(rows).collect()}
    assert got == {"a": (400.0, "OFFLINE"), "b": (0.0, "ONLINE")}
    assert {r.status for r in monitor.source_freshness(rows, threshold=400).collect()} == {"ONLINE"}


def test_topic_profile(log):
    df = log(*[document(i) for i in range(5)]).where("offset <> 5")
    r = monitor.topic_profile(df).first()
    assert (r.first_offset, r.last_offset, r.messages, r.gaps) == (3, 7, 4, 1)


def test_gaps_across_buckets_and_for_no_address(log):
    rows = log(*[document(i, ip="null") for i in range(4)], step=2.0)
    late = log(document(9, ip="null"), first=50, start="2024-03-01 12:00:00")
    got = monitor.cadence_gaps(readings.parse_readings(rows.unionByName(late))).collect()
    assert [(r.source_ip, r.gap_seconds) for r in got] == [(None, 7194.0)]
    assert monitor.cadence_gaps(readings.parse_readings(rows), factor=0.5).count() == 3


def test_top(spark):
    df = spark.createDataFrame([("a", 1), ("b", 7), ("c", 7), (None, 2)], "source_ip string, messages long")
    assert [(r.place, r.source_ip) for r in monitor.top_sources(df, 3).orderBy("place").collect()] == [(1, "b"), (2, "c"), (3, None)]


def test_naive_times_are_utc(log):
    assert str(log(document(1)).select(naive(F.col("timestamp")).alias("t")).first().t) == "2024-03-01 10:00:00"
